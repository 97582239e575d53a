"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Vectors with equal components are one node that stands for its smallest ids, found before any
shuffle by a group limit. Nodes are dealt to shards of about ``SHARD_NODES`` by hash. A shard's
graph is built in insertion order: a node joins the nearest of the nodes before it that are not
closer to one another than to it, on every layer up to its own, and they link back. A layer is a
flat array of neighbour places, a fixed number per node.

Nearness is the inner product. Inside a shard, vectors get one more component that makes all
equally long, so that the order of inner products is an order of distances and the graph is
navigable. Queries go in blocks to every shard, a few blocks at a time, so what is broadcast has a
fixed size; a search climbs down the layers and keeps ``ef`` candidates on the lowest; results of
the shards are merged by exact scores in double precision, first in the task that read the shards.

Defined cases: null, zero or non-finite vectors and those of another length than most take no
part, as queries or candidates; rows with the same id and vector count once; a row of the query's
own id is never its neighbour; ties go to the smaller id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.llm.common import map_batches, saved

SHARD_NODES = 4_096
QUERY_BLOCK = 512  # queries that search together
PACKED_QUERIES, PACKED_COMPONENTS = 1 << 14, 1 << 20  # queries and their vector components in a packed block at most, about
BROADCAST_BLOCKS = 8  # packed blocks that meet the shards in one pass
DEGREE = 16
CANDIDATES = 96
EF = 96


def usable(vector: Column) -> Column:
    """No null, no non-finite component and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """(vector, ids): equal vectors with their ``keep`` smallest ids, ascending."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector"))
    rows = rows.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    # negative zero equals zero
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast("float")))
    ranked = rows.withColumn("_n", F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("_n") <= keep)
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def _pick(sims: np.ndarray, order: np.ndarray, points: np.ndarray, degree: int) -> np.ndarray:
    """Per row up to ``degree`` of its ordered candidates, each nearer to the row than to any picked one; -1 fills.

    All points are equally long, so a larger inner product is a smaller distance. Candidates
    that were passed over fill what is left, nearest first.
    """
    n, c = order.shape
    picked = np.full((n, degree), -1, dtype=np.int32)
    size = np.zeros(n, dtype=np.int64)
    taken = np.zeros((n, c), dtype=bool)
    for turn in range(c):
        cand = order[:, turn]
        own = np.take_along_axis(sims, cand.clip(0)[:, None].astype(np.int64), axis=1)[:, 0]
        between = np.einsum("nd,nmd->nm", points[cand.clip(0)], points[picked.clip(0)])
        blocked = ((between > own[:, None]) & (picked >= 0)).any(axis=1)
        ok = np.flatnonzero((cand >= 0) & ~blocked & (size < degree))
        picked[ok, size[ok]] = cand[ok]
        size[ok] += 1
        taken[ok, turn] = True
    for turn in range(c):
        ok = np.flatnonzero((order[:, turn] >= 0) & ~taken[:, turn] & (size < degree))
        picked[ok, size[ok]] = order[ok, turn]
        size[ok] += 1
    return picked


def build_layer(points: np.ndarray, degree: int, candidates: int = CANDIDATES) -> np.ndarray:
    """Flat neighbour array (n, 2 * degree) of one layer, nodes in insertion order; -1 fills."""
    n, room = len(points), 2 * degree
    links: list[list[int]] = [[] for _ in range(n)]
    for at in range(0, n, 256):
        some = np.arange(at, min(n, at + 256))
        sims = points[some] @ points[: some[-1] + 1].T
        sims[np.arange(len(some))[:, None] <= np.arange(sims.shape[1])[None] - at] = -np.inf
        c = min(candidates, sims.shape[1])
        top = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        values = np.take_along_axis(sims, top, axis=1)
        rank = np.argsort(-values, axis=1, kind="stable")
        order = np.take_along_axis(top, rank, axis=1)
        order[np.take_along_axis(values, rank, axis=1) == -np.inf] = -1
        for i, row in zip(some.tolist(), _pick(sims, order, points, degree)):
            for j in row[row >= 0].tolist():
                links[i].append(j)
                links[j].append(i)
                if len(links[j]) > 2 * room:
                    links[j] = _shrink(j, links[j], points, room)
    out = np.full((n, room), -1, dtype=np.int32)
    for i, row in enumerate(links):
        row = row if len(row) <= room else _shrink(i, row, points, room)
        out[i, : len(row)] = row
    return out


def _shrink(node: int, row: list[int], points: np.ndarray, room: int) -> list[int]:
    """The ``room`` links that lead in the most different directions, nearest first."""
    ids = np.array(row)
    own = points[ids] @ points[node]
    ids = ids[np.argsort(-own, kind="stable")]
    own, between = points[ids] @ points[node], points[ids] @ points[ids].T
    kept: list[int] = []
    for i in range(len(ids)):
        if len(kept) < room and not (between[i, kept] > own[i]).any():
            kept.append(i)
    kept += [i for i in range(len(ids)) if i not in set(kept)][: room - len(kept)]
    return ids[kept].tolist()


def build_graph(vectors: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Layers from the lowest up. Layer l holds the first nodes of the order, one in ``degree`` to the l."""
    norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
    points = np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1).astype(np.float32)
    layers, n = [], len(vectors)
    while True:
        layers.append(build_layer(points[:n], degree))
        n //= degree
        if n < 2:
            return layers


def search(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, ef: int) -> np.ndarray:
    """(q, ef) places of the nearest found, nearest first, -1 fills; all queries step together."""
    q = len(queries)
    at = np.zeros(q, dtype=np.int64)
    best = queries @ vectors[0]
    for layer in layers[:0:-1]:
        going = np.arange(q)
        while len(going):
            near = layer[at[going]]
            sims = np.einsum("qd,qmd->qm", queries[going], vectors[near.clip(0)])
            sims[near < 0] = -np.inf
            top = sims.argmax(axis=1)
            value = sims[np.arange(len(going)), top]
            better = value > best[going]
            going, moved = going[better], near[np.arange(len(going)), top][better]
            at[going], best[going] = moved, value[better]
    seen = np.zeros((q, len(vectors)), dtype=bool)
    rows = np.arange(q)
    seen[rows, at] = True
    found = np.full((q, ef), -1, dtype=np.int64)
    score = np.full((q, ef), -np.inf, dtype=np.float32)
    done = np.ones((q, ef), dtype=bool)
    found[:, 0], score[:, 0], done[:, 0] = at, best, False
    while len(rows):
        open_ = np.where(done[rows], -np.inf, score[rows])
        pick = open_.argmax(axis=1)
        rows, pick = rows[np.isfinite(open_.max(axis=1))], pick[np.isfinite(open_.max(axis=1))]
        if not len(rows):
            break
        done[rows, pick] = True
        near = layers[0][found[rows, pick]]
        fresh = (near >= 0) & ~seen[rows[:, None], near.clip(0)]
        sims = np.einsum("qd,qmd->qm", queries[rows], vectors[near.clip(0)])
        sims[~fresh] = -np.inf
        i, j = np.nonzero(fresh)
        seen[rows[i], near[i, j]] = True
        all_ids = np.concatenate([found[rows], near], axis=1)
        all_scores = np.concatenate([score[rows], sims], axis=1)
        all_done = np.concatenate([done[rows], ~fresh], axis=1)
        keep = np.argpartition(-all_scores, ef - 1, axis=1)[:, :ef]
        found[rows] = np.take_along_axis(all_ids, keep, axis=1)
        score[rows] = np.take_along_axis(all_scores, keep, axis=1)
        done[rows] = np.take_along_axis(all_done, keep, axis=1)
    found[~np.isfinite(score)] = -1
    return np.take_along_axis(found, np.argsort(-score, axis=1, kind="stable"), axis=1)


def build_index(nodes: DataFrame, shard_nodes: int = SHARD_NODES, degree: int = DEGREE) -> DataFrame:
    """One row per shard with its vectors, ids and layers as flat binary arrays.

    Nodes are ordered by hash inside a shard, so insertion order is random and repeatable.
    """
    shards = max(1, -(-nodes.count() // shard_nodes))
    dealt = nodes.withColumn("_hash", F.xxhash64("vector")).withColumn("shard", F.pmod("_hash", F.lit(shards)).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_hash", kind="stable")
        vectors = np.stack(group["vector"].to_numpy()).astype(np.float32)
        ids = [np.asarray(i, dtype=np.int64) for i in group["ids"]]
        layers = build_graph(vectors, degree)
        return pd.DataFrame({
            "shard": [int(group["shard"].iloc[0])],
            "vectors": [vectors.tobytes()],
            "ids": [np.concatenate(ids).tobytes()],
            "id_counts": [np.array([len(i) for i in ids], dtype=np.int32).tobytes()],
            "layers": [[x.tobytes() for x in layers]],
        })

    schema = "shard int, vectors binary, ids binary, id_counts binary, layers array<binary>"
    return saved(dealt.groupBy("shard").applyInPandas(build, schema), "nearest-index")


def shard_hits(queries: np.ndarray, query_ids: np.ndarray, found: np.ndarray, shard: np.ndarray, ids: np.ndarray, counts: np.ndarray, k: int):
    """(query place, id, score): of each query's ``k`` + 1 nearest found nodes the ``k`` best ids that are not its own."""
    exact = np.einsum("qd,qed->qe", queries.astype(np.float64), shard[found.clip(0)].astype(np.float64))
    exact[found < 0] = -np.inf
    order = np.argsort(-exact, axis=1, kind="stable")[:, : k + 1]
    found, exact = np.take_along_axis(found, order, axis=1), np.take_along_axis(exact, order, axis=1)
    q, e = np.nonzero(found >= 0)
    node = found[q, e]
    each = counts[node]
    place = np.repeat((np.cumsum(counts) - counts)[node], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    rows, near, scores = np.repeat(q, each), ids[place], np.repeat(exact[q, e], each)
    other = near != query_ids[rows]
    return first_of(rows[other], near[other], scores[other], k)


def first_of(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, keep: int):
    """(row, id, score) of each row's ``keep`` largest scores, the smaller id on ties."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < keep
    return rows[best], ids[best], scores[best]


def merged(a, b, keep: int):
    """Two results of ``first_of`` as one; an id counts once for a row, by its largest score."""
    rows, ids, scores = (np.concatenate(x) for x in zip(a, b))
    order = np.lexsort((-scores, ids, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    once = np.ones(len(rows), dtype=bool)
    once[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    return first_of(rows[once], ids[once], scores[once], keep)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, ef: int = EF, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every`` their ``k`` nearest.

    A shard returns its ``k`` + 1 nearest nodes of each query at most, each with its smallest ids.
    """
    sized = vectors.filter(usable(F.col("embedding"))).groupBy(F.size("embedding").alias("n")).count()
    common = sized.orderBy(F.desc("count"), "n").limit(1).collect()
    dim = common[0]["n"] if common else 0
    fitting = vectors.filter(F.size("embedding") == dim)
    nodes = saved(distinct_vectors(fitting, k + 1), "nearest-nodes")
    index = build_index(nodes, shard_nodes)

    asked = fitting.filter((F.col("vec_id") % every == 0) & usable(F.col("embedding")))
    asked = asked.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("vector")).distinct()
    total = asked.count()
    blocks = max(1, -(-total // PACKED_QUERIES), -(-total * dim // PACKED_COMPONENTS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "block": [int(group["block"].iloc[0])],
            "query_ids": [group["query_id"].to_numpy(np.int64).tobytes()],
            "queries": [np.stack(group["vector"].to_numpy()).astype(np.float32).tobytes()],
        })

    packed = saved(asked.groupBy("block").applyInPandas(pack, "block int, query_ids binary, queries binary"), "nearest-queries")

    def visit(batches):
        # a query's hits in the shards of this task become one list
        hits: dict[int, tuple] = {}
        for c in batches:
            for i in range(len(c["block"])):
                long = lambda n: np.frombuffer(c[n][i].as_buffer(), np.int64)
                shard = np.frombuffer(c["vectors"][i].as_buffer(), np.float32).reshape(-1, dim)
                ids, counts = long("ids"), np.frombuffer(c["id_counts"][i].as_buffer(), np.int32).astype(np.int64)
                layers = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2 * DEGREE) for x in c["layers"][i].values]
                query_ids, queries = long("query_ids"), np.frombuffer(c["queries"][i].as_buffer(), np.float32).reshape(-1, dim)
                found = []
                for at in range(0, len(queries), QUERY_BLOCK):
                    some = slice(at, at + QUERY_BLOCK)
                    near = search(shard, layers, queries[some], max(ef, k + 1))
                    rows, near_ids, scores = shard_hits(queries[some], query_ids[some], near, shard, ids, counts, k)
                    found.append((rows + at, near_ids, scores))
                found = tuple(np.concatenate(x) for x in zip(*found))
                block = c["block"][i].as_py()
                before = hits.get(block)
                rows, near_ids, scores = found if before is None else merged(before[1:], found, k)
                hits[block] = (query_ids.copy(), rows, near_ids, scores)
        for query_ids, rows, near_ids, scores in hits.values():
            yield {"query_id": query_ids[rows], "vec_id": near_ids, "score": scores}

    # A stated query set against all rows: every block of queries meets every shard. Shards stay where they are read, and
    # Spark doesn't know how large a joined block is, so the blocks are broadcast by name, a fixed number at a time.
    passes = []
    for at in range(0, blocks, BROADCAST_BLOCKS):
        some = packed.filter((F.col("block") >= at) & (F.col("block") < at + BROADCAST_BLOCKS))
        visits = index.drop("shard").crossJoin(F.broadcast(some))
        found = map_batches(visits, visit, "query_id long, vec_id long, score double")
        passes.append(found if blocks <= BROADCAST_BLOCKS else saved(found, "nearest-hits"))
    hits = reduce(DataFrame.unionAll, passes)
    # an id with several vectors counts once, by its nearest
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
