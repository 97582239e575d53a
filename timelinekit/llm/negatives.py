"""Hard negatives by segment summaries: bounds of inner products, refined before exact scoring.

A vector of whole numbers is cut into segments. Of each segment the sum and the deviation (length
of the rest after its mean is taken away) are stored with the vector. Two segments of n components
have an inner product of (product of sums) / n, give or take (product of deviations), so sums over
segments bound a score from both sides. Bounds start with one segment for the whole vector and go
on with four times as many for the pairs that are still open, down to ``FINEST`` segments; only
what no bound rules out is scored exactly.

Rows form blocks by hash, anchors form blocks too, and every block of anchors meets every block
of rows (a stated query set against all rows); blocks of rows stay where they are read, blocks of
anchors are broadcast, a fixed number at a time. A first round finds each anchor's positives: a row
is out when its upper bound is below the fifth largest lower bound of its block. A second round
finds negatives between the given shares of each positive's score: a row is out when its bounds
leave that range, or fall below the fifth largest lower bound among rows surely inside. Results of
the blocks are merged in the task that read them, then by window ranks. Of rows equal in label and vector only the smallest ids can
be returned, so a vector with very many copies costs no more than one with a few.

Defined cases: rows with a null vec_id, a null label, a null or empty vector, or a null or
non-finite component take no part; rows equal in id, label and vector count once; a row of the
anchor's own id is neither its positive nor its negative; an id with several vectors or labels is
several rows; vectors of different lengths never meet; an empty table gives no rows; other columns
are ignored. Components of 2**23 or more in size are refused, as are scores beyond 2**63.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.llm.common import map_batches, saved

FINEST = 16
LEVELS = (1, 4, 16)
ROW_COMPONENTS = 1 << 18  # vector components in a block of rows
ANCHOR_COMPONENTS = 1 << 16
BROADCAST_BLOCKS = 64  # blocks of anchors that meet the rows in one pass
TILE_PAIRS = 1 << 20
DENSE = 0.1  # share of open pairs above which a whole tile is computed


def whole_rows(vectors: DataFrame, scale: int = 256, moved: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, vector): rows that take part, each once; components floor(scale * x), labels of every ``moved``-th id one up."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & ~bad
    rows = vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("x", lambda v: F.floor(v * float(scale))).alias("vector")).distinct()


def smallest_ids(rows: DataFrame, keep: int) -> DataFrame:
    """Of rows equal in label and vector those with the ``keep`` smallest ids."""
    nth = F.row_number().over(Window.partitionBy("label", "vector").orderBy("vec_id"))
    return rows.withColumn("_n", nth).filter(F.col("_n") <= keep).drop("_n")


def segment_ends(dim: int, count: int) -> np.ndarray:
    return np.array([dim * i // count for i in range(count + 1)])


def summaries(vectors: np.ndarray) -> np.ndarray:
    """(rows, 2, segments): sums and sums of squares of the finest segments; empty segments hold zeros."""
    ends = segment_ends(vectors.shape[1], FINEST)
    wide = vectors.astype(np.float64)
    running = [np.concatenate([np.zeros((len(wide), 1)), np.cumsum(x, axis=1)], axis=1) for x in (wide, wide * wide)]
    return np.stack([r[:, ends[1:]] - r[:, ends[:-1]] for r in running], axis=1)


def at_level(summary: np.ndarray, dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the root of the length, and deviations, of ``count`` segments from the finest ones."""
    n = len(summary)
    joined = summary.reshape(n, 2, count, FINEST // count).sum(axis=3)
    length = np.maximum(np.diff(segment_ends(dim, FINEST)).reshape(count, -1).sum(axis=1), 1)
    means = joined[:, 0] / np.sqrt(length)
    return means, np.sqrt(np.maximum(joined[:, 1] - means * means, 0))


def score_bounds(a, b, pairs=None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all pairs, or of the given (i, j) pairs only."""
    if pairs is None:
        mean, spread = a[0] @ b[0].T, a[1] @ b[1].T
    else:
        i, j = pairs
        mean, spread = np.einsum("ns,ns->n", a[0][i], b[0][j]), np.einsum("ns,ns->n", a[1][i], b[1][j])
    # scores are whole numbers; the slack covers rounding of the sums
    slack = 0.5 + 1e-9 * (np.abs(mean) + spread)
    return np.ceil(mean - spread - slack), np.floor(mean + spread + slack)


def exact_scores(a: np.ndarray, b: np.ndarray, pairs=None) -> np.ndarray:
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 2.0**63:
        raise ValueError("scores beyond 2**63")
    kind = np.float64 if most < 2.0**53 else np.int64
    a, b = a.astype(kind), b.astype(kind)
    found = a @ b.T if pairs is None else np.einsum("nd,nd->n", a[pairs[0]], b[pairs[1]])
    return found.astype(np.int64)


def nth_largest(values: np.ndarray, mask: np.ndarray, n: int) -> np.ndarray:
    """Per row the n-th largest value where ``mask`` holds; minus infinity if there are fewer."""
    if values.shape[1] < n:
        return np.full(len(values), -np.inf)
    return np.partition(np.where(mask, values, -np.inf), values.shape[1] - n, axis=1)[:, -n]


class Tile:
    """Pairs of some anchors and the rows of a block, with bounds that narrow from level to level."""

    def __init__(self, anchors: np.ndarray, summary_a: np.ndarray, rows: np.ndarray, summary_r: np.ndarray):
        self.anchors, self.rows, self.summary_a, self.summary_r = anchors, rows, summary_a, summary_r
        self.low = np.full((len(anchors), len(rows)), -np.inf)
        self.high = np.full((len(anchors), len(rows)), np.inf)

    def refine(self, count: int, open_: np.ndarray) -> None:
        dim = self.rows.shape[1]
        a, b = at_level(self.summary_a, dim, count), at_level(self.summary_r, dim, count)
        if open_.mean() > DENSE:
            low, high = score_bounds(a, b)
            self.low, self.high = np.maximum(self.low, low), np.minimum(self.high, high)
        else:
            pairs = np.nonzero(open_)
            low, high = score_bounds(a, b, pairs)
            self.low[pairs], self.high[pairs] = np.maximum(self.low[pairs], low), np.minimum(self.high[pairs], high)

    def score(self, open_: np.ndarray) -> np.ndarray:
        """Exact scores of the open pairs; other places hold anything."""
        if open_.mean() > DENSE:
            return exact_scores(self.anchors, self.rows)
        out = np.zeros(open_.shape, dtype=np.int64)
        pairs = np.nonzero(open_)
        out[pairs] = exact_scores(self.anchors, self.rows, pairs)
        return out


def best(scores: np.ndarray, mask: np.ndarray, keep: int):
    """(row, column) of each row's ``keep`` largest masked scores; columns stand in the order that settles ties."""
    i, j = np.nonzero(mask)
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    return i[nth < keep], j[nth < keep]


def positives_in(tile: Tile, same: np.ndarray, keep: int):
    """(anchor, row, score) of each anchor's ``keep`` best rows among the pairs in ``same``."""
    open_ = same
    for count in LEVELS:
        tile.refine(count, open_)
        open_ = open_ & (tile.high >= nth_largest(tile.low, open_, keep)[:, None])
    scores = tile.score(open_)
    i, j = best(scores, open_, keep)
    return i, j, scores[i, j]


def negatives_in(tile: Tile, other: np.ndarray, wanted: np.ndarray, known: np.ndarray, keep: int, shares: tuple[int, int]):
    """(anchor, nth positive, row, score): each positive's ``keep`` best rows in its range of scores.

    ``wanted`` has a column of scores per positive, ``known`` says where there is one.
    """
    least, most = shares
    width = wanted.shape[1]
    # whole numbers: least * p <= 100 * s is s >= ceil(least * p / 100)
    floor, roof = -((-least * wanted) // 100), (most * wanted) // 100
    open_ = [other & known[:, [k]] for k in range(width)]
    for count in LEVELS:
        tile.refine(count, np.logical_or.reduce(open_))
        for k in range(width):
            inside = open_[k] & (tile.high >= floor[:, [k]]) & (tile.low <= roof[:, [k]])
            sure = inside & (tile.low >= floor[:, [k]]) & (tile.high <= roof[:, [k]])
            open_[k] = inside & (tile.high >= nth_largest(tile.low, sure, keep)[:, None])
    scores = tile.score(np.logical_or.reduce(open_))
    for k in range(width):
        i, j = best(scores, open_[k] & (scores >= floor[:, [k]]) & (scores <= roof[:, [k]]), keep)
        yield i, k, j, scores[i, j]


def _packed(rows: DataFrame, components: int, extra: str = "") -> tuple[DataFrame, int]:
    """(blocks, number): rows in blocks by hash, each with its ids, labels, vectors and summaries as binary columns.

    ``extra`` names array columns of longs that go along, flat with their sizes.
    """
    total = rows.agg(F.sum(F.size("vector"))).first()[0] or 0
    number = max(1, -(-total // components))
    dealt = rows.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("vec_id", "label"), F.lit(number)).cast("int"))
    names = extra.split()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        vectors = np.stack(group["vector"].to_numpy()).astype(np.int64)
        if np.abs(vectors).max() >= 2**31:
            raise ValueError("components of 2**23 or more")
        out = {"dim": [vectors.shape[1]], "block": [int(group["block"].iloc[0])]}
        out |= {n: [group[n].to_numpy(np.int64).tobytes()] for n in ("vec_id", "label", "key")}
        out |= {"vectors": [vectors.astype(np.int32).tobytes()], "summary": [summaries(vectors).tobytes()]}
        for n in names:
            out[n] = [np.concatenate([np.asarray(v, dtype=np.int64) for v in group[n]]).tobytes()]
        if names:
            out["sizes"] = [np.array([len(v) for v in group[names[0]]], dtype=np.int64).tobytes()]
        return pd.DataFrame(out)

    schema = "dim int, block int, vec_id binary, label binary, key binary, vectors binary, summary binary"
    schema += "".join(f", {n} binary" for n in names) + (", sizes binary" if names else "")
    return dealt.groupBy("dim", "block").applyInPandas(pack, schema), number


def _unpacked(c: dict, i: int, side: str):
    dim = c["dim"][i].as_py()
    long = lambda n: np.frombuffer(c[f"{side}{n}"][i].as_buffer(), np.int64)
    vectors = np.frombuffer(c[f"{side}vectors"][i].as_buffer(), np.int32).reshape(-1, dim)
    return long("vec_id"), long("label"), long("key"), vectors, np.frombuffer(c[f"{side}summary"][i].as_buffer(), np.float64).reshape(-1, 2, FINEST)


def _meetings(anchors: DataFrame, blocks: int, rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """What ``work`` finds where every block of anchors stands beside every block of rows of its vector length.

    Spark doesn't know how large a joined block is, so the anchors are broadcast by name, a fixed number of blocks at a time.
    """
    rows, asked = rows.drop("block"), anchors.select("dim", *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "dim"])
    asked, passes = saved(asked, "negatives-asked"), []
    for at in range(0, blocks, BROADCAST_BLOCKS):
        some = asked.filter((F.col("a_block") >= at) & (F.col("a_block") < at + BROADCAST_BLOCKS))
        found = map_batches(rows.join(F.broadcast(some), "dim"), work, schema)
        passes.append(found if blocks <= BROADCAST_BLOCKS else saved(found, "negatives-found"))
    return reduce(DataFrame.unionAll, passes)


def _kept(held: dict, block: tuple, found: list[tuple], keep: int) -> None:
    """Add (group, score, tie, others ...) to what is held of a block of anchors: the ``keep`` best of each group."""
    parts = [np.concatenate(x) for x in zip(*([held[block]] if block in held else []), *found)]
    order = np.lexsort((parts[2], -parts[1], parts[0]))
    groups = parts[0][order]
    order = order[np.arange(len(groups)) - np.searchsorted(groups, groups, side="left") < keep]
    held[block] = tuple(x[order] for x in parts)


def _tiles(n: int, width: int):
    step = max(1, TILE_PAIRS // max(1, width))
    return (slice(at, min(n, at + step)) for at in range(0, n, step))


def top(rows: DataFrame, by: list[str], score: str, tie: str, keep: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= keep)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, shares: tuple[int, int] = (80, 100)
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id is divisible by ``every``.

    Negatives score between the two ``shares``, in hundredths, of their positive's score.
    """
    rows = saved(whole_rows(vectors), "negatives-rows")
    # a key tells rows of one id apart
    keyed = F.monotonically_increasing_id()
    asked = saved(rows.filter(F.col("vec_id") % every == 0).withColumn("key", keyed), "negatives-anchors")
    nodes = smallest_ids(rows, max(positives, negatives) + 1).withColumn("key", F.lit(0).cast("long"))
    blocks, _ = _packed(saved(nodes, "negatives-nodes"), ROW_COMPONENTS)
    blocks = saved(blocks, "negatives-blocks")

    def find_positives(batches):
        # group: the anchor's place in its block
        held: dict[tuple, tuple] = {}
        for c in batches:
            for m in range(len(c["dim"])):
                ids, labels, keys, points, summary = _unpacked(c, m, "a_")
                row_ids, row_labels, _, row_points, row_summary = _unpacked(c, m, "")
                found = []
                for t in _tiles(len(ids), len(row_ids)):
                    tile = Tile(points[t], summary[t], row_points, row_summary)
                    same = (labels[t, None] == row_labels[None]) & (ids[t, None] != row_ids[None])
                    i, j, s = positives_in(tile, same, positives)
                    found.append((t.start + i, s, row_ids[j], keys[t][i]))
                _kept(held, (c["dim"][m].as_py(), c["a_block"][m].as_py()), found, positives)
        for _, s, positive, key in held.values():
            yield {"key": key, "positive_id": positive, "positive_score": s}

    packed, anchor_blocks = _packed(asked, ANCHOR_COMPONENTS)
    found = _meetings(packed, anchor_blocks, blocks, find_positives, "key long, positive_id long, positive_score long")
    ranked = top(found, ["key"], "positive_score", "positive_id", positives)
    # at most ``positives`` rows of a key are left
    listed = ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    listed = listed.select("key", F.col("p.positive_id").alias("p_ids"), F.col("p.positive_score").alias("p_scores"))
    targets = saved(asked.join(saved(listed, "negatives-positives"), "key"), "negatives-targets")

    def find_negatives(batches):
        # group: the anchor's place in its block and the place of its positive
        held: dict[tuple, tuple] = {}
        for c in batches:
            for m in range(len(c["dim"])):
                ids, labels, keys, points, summary = _unpacked(c, m, "a_")
                row_ids, row_labels, _, row_points, row_summary = _unpacked(c, m, "")
                flat = [np.frombuffer(c[f"a_{n}"][m].as_buffer(), np.int64) for n in ("p_ids", "p_scores", "sizes")]
                known = np.arange(positives)[None] < flat[2][:, None]
                p_ids, p_scores = np.zeros(known.shape, np.int64), np.zeros(known.shape, np.int64)
                p_ids[known], p_scores[known] = flat[0], flat[1]
                found = []
                for t in _tiles(len(ids), len(row_ids)):
                    tile = Tile(points[t], summary[t], row_points, row_summary)
                    other = (labels[t, None] != row_labels[None]) & (ids[t, None] != row_ids[None])
                    for i, k, j, s in negatives_in(tile, other, p_scores[t], known[t], negatives, shares):
                        found.append(((t.start + i) * positives + k, s, row_ids[j], keys[t][i], ids[t][i], p_ids[t][i, k], p_scores[t][i, k]))
                _kept(held, (c["dim"][m].as_py(), c["a_block"][m].as_py()), found, negatives)
        for _, s, negative, key, anchor, positive, score in held.values():
            yield {"key": key, "anchor_id": anchor, "positive_id": positive, "negative_id": negative, "positive_score": score, "negative_score": s}

    packed, anchor_blocks = _packed(targets, ANCHOR_COMPONENTS, "p_ids p_scores")
    schema = "key long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = _meetings(packed, anchor_blocks, blocks, find_negatives, schema)
    best_ = top(found, ["key", "positive_id"], "negative_score", "negative_id", negatives)
    return best_.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
