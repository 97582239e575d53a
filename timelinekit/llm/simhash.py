"""SimHash near-duplicates by segment counts.

A fingerprint's 64 bits are seen as 32 segments of two bits. The embedding maps it to the bit
count of each segment; as changing one bit changes one count by one, the Manhattan distance of
two embeddings never exceeds the Hamming distance of the fingerprints. Counts are kept in unary
(one: 01, two: 11), so that the Manhattan distance is the bit count of an exclusive or.

The range join runs on a grid: segments form eight groups, and a Manhattan distance of at most
four leaves at least four groups equal. So every pair meets in a cell made of the counts of four
of the eight groups (70 cells per fingerprint). In a cell, the lower bound is tested, then the
fingerprints themselves.

Pairs inside a group of near copies are never listed: cells first link each fingerprint to the
least, the greatest and the next one of its cell, components are taken, and only fingerprints of
different components are compared after that, the minority of a cell with the rest of it.

Defined cases: null and blank texts have fingerprint zero and are linked like any other; a null
doc_id keeps its row, its component is the smallest id of the group (null if there is none);
equal rows stay equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.llm.common import components, map_batches, saved

LOW_BITS = 0x5555555555555555
GROUPS = 8
SALTS = 16
# Shingles of one text that are hashed and counted at a time.
BLOCK = 16_384
PASSAGE = 12  # shingles of a passage on average
NEAR_BITS = 18  # fingerprints of texts that may be similar differ by no more
SIMILAR, SIMILAR_WORDS = 0.8, 5


def _hashed(text: str | None, shingle: int, seed: int):
    """Blocks of the digests of a text's shingles, eight bytes each; nothing for a text without words."""
    import xxhash

    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.append(0, blanks + 1), np.append(blanks, len(joined))
    n = max(1, len(starts) - shingle + 1)
    last = ends[shingle - 1 :] if len(ends) >= shingle else ends[-1:]
    digest = xxhash.xxh64_digest
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(at + BLOCK, n)].tolist(), last[at : at + BLOCK].tolist())
        yield b"".join([digest(joined[a:b], seed) for a, b in spans])


def _majority(blocks) -> tuple[bytes, list[np.ndarray]]:
    """(fingerprint, the blocks as arrays of unsigned longs)."""
    totals, n, kept = np.zeros(64, dtype=np.int64), 0, []
    for block in blocks:
        totals += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(block) // 8
        kept.append(np.frombuffer(block, ">u8").astype(np.uint64))
    return np.packbits(totals * 2 > n).tobytes(), kept


def text_fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> bytes:
    """Eight bytes, most significant bit first; zero for a text without words."""
    return _majority(_hashed(text, shingle, seed))[0]


def text_profile(text: str | None, shingle: int = 4, seed: int = 42) -> tuple[bytes, list[int]]:
    """The fingerprint, and one number per passage.

    Passages end where the hash of a shingle is divisible by ``PASSAGE``, so the same stretch of
    text makes the same passages wherever it stands. A passage's number is the sum of its shingles'
    hashes; those of fewer than three shingles are left out, unless the text has no other.
    """
    fp, kept = _majority(_hashed(text, shingle, seed))
    if not kept:
        return fp, []
    hashes = np.concatenate(kept)
    starts = np.unique(np.append(0, np.flatnonzero(hashes % PASSAGE == 0)))
    lengths = np.diff(np.append(starts, len(hashes)))
    sums = np.add.reduceat(hashes, starts)
    long = sums[lengths >= 3] if (lengths >= 3).any() else sums
    return fp, np.unique(long).astype(np.int64).tolist()


def shingle_set(text: str | None, shingle: int) -> list[int]:
    """The hashes of a text's distinct shingles."""
    blocks = [np.frombuffer(b, ">i8").astype(np.int64) for b in _hashed(text, shingle, 0)]
    return np.unique(np.concatenate(blocks)).tolist() if blocks else []


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, key: Column | None = None) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long, and the long ``key`` of the row if one is given."""
    carried = {"doc_id": F.col("doc_id").cast("long")} | ({} if key is None else {"key": key})

    def work(batches):
        for batch in batches:
            found = [int.from_bytes(text_fingerprint(t, shingle, seed), "big", signed=True) for t in batch["text"].to_pylist()]
            yield {c: batch[c] for c in names} | {"fp": found}

    names = list(carried)
    schema = "".join(f"{c} long, " for c in names) + "fp long"
    return map_batches(docs.select(*[x.alias(c) for c, x in carried.items()], "text"), work, schema)


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary."""
    low = F.lit(LOW_BITS)
    either = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(low)
    both = fp.bitwiseAND(F.shiftrightunsigned(fp, 1)).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def cell_masks(distance: int) -> list[int]:
    """Signed masks of the group sets of which one is equal in every pair within ``distance``."""
    if not 0 <= distance < GROUPS:
        raise ValueError(f"distance must be below {GROUPS}")
    width = 64 // GROUPS
    masks = [sum(((1 << width) - 1) << (width * g) for g in some) for some in combinations(range(GROUPS), GROUPS - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked(a: Column, b: Column, distance: int) -> Column:
    """The Manhattan lower bound, then the exact Hamming distance."""
    bound = F.bit_count(embedding(a).bitwiseXOR(embedding(b))) <= distance
    return bound & (F.bit_count(a.bitwiseXOR(b)) <= distance)


def salted(rows: DataFrame) -> DataFrame:
    """Each row once for every salt.

    Spark reckons with the rows before they are multiplied and would broadcast many times what it may,
    so the joins with them are merges at any size.
    """
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def cells(prints: DataFrame, distance: int) -> DataFrame:
    """(cell, fp): the fingerprint in each of its grid cells."""
    masks = F.array(*[F.lit(m) for m in cell_masks(distance)])
    numbered = F.transform(masks, lambda m, i: F.xxhash64(F.col("_e").bitwiseAND(m), i))
    return prints.withColumn("_e", embedding(F.col("fp"))).select("fp", F.explode(numbered).alias("cell"))


def link_components(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, component): component is the least fingerprint reachable; only linked ones are listed."""
    pick = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    near = lambda df, a, b: df.filter((F.col(a) != F.col(b)) & linked(F.col(a), F.col(b), distance)).select(*pick(a, b))
    # a cell number may be shared by chance; links are verified, so that only costs a comparison
    every = cells(prints, distance)
    shared = saved(
        every.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1"),
        "simhash-cells",
    )
    crowded = salted(shared.filter("n > 2").select("cell", "low", "top"))
    members = saved(
        every.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(crowded, ["cell", "salt"]),
        "simhash-members",
    )
    after = members.withColumn("next", F.lead("fp").over(Window.partitionBy("cell", "salt").orderBy("fp"))).filter("next is not null")
    first = near(shared, "low", "top").union(near(members, "fp", "low")).union(near(members, "fp", "top")).union(near(after, "fp", "next"))
    edges = saved(first.distinct(), "simhash-links")
    label = components(edges, "simhash-first")

    placed = members.select("cell", "salt", "fp").join(label.withColumnRenamed("node", "fp"), "fp", "left")
    placed = saved(placed.withColumn("component", F.coalesce("component", "fp")), "simhash-placed")
    counts = placed.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("cell").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count(F.lit(1)).alias("kinds"))
    mixed = salted(mixed.filter("kinds > 1").select("cell", "major"))
    rows = saved(placed.join(mixed, ["cell", "salt"]), "simhash-mixed")
    few = rows.filter("component <> major").select("cell", F.col("fp").alias("fp_a"), F.col("component").alias("component_a"))
    rest = rows.select("cell", F.col("fp").alias("fp_b"), F.col("component").alias("component_b"))
    crossing = few.join(rest, "cell").filter((F.col("component_a") != F.col("component_b")) & linked(F.col("fp_a"), F.col("fp_b"), distance))
    bridges = crossing.select(*pick("component_a", "component_b")).distinct()
    if bridges.isEmpty():
        return label.withColumnRenamed("node", "fp")
    # a label is the least node of its component, so labels joined by bridges are nodes too
    joined = label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(bridges)
    return components(joined, "simhash-last").withColumnRenamed("node", "fp")


def tagged_nodes(rows: DataFrame, least: Column, distance: int) -> DataFrame:
    """(fp, least, component): each fingerprint with ``least`` over its rows and the least fingerprint of its component."""
    nodes = saved(rows.groupBy("fp").agg(least.alias("least")), "simhash-nodes")
    label = link_components(nodes.select("fp"), distance)
    return nodes.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def representatives(docs: DataFrame, key: Column, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, key) of one row per component: the smallest doc_id, null last, then the smallest ``key``.

    ``key`` is a long that tells rows apart. Minima are taken per fingerprint first, so neither a
    null doc_id nor a large group meets in one task.
    """
    rows = saved(fingerprints(docs, shingle, seed, key), "simhash-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key"))
    best = tagged_nodes(rows, least, distance).groupBy("component").agg(F.min("least").alias("least"))
    return best.select("least.doc_id", "least.key")


def passage_links(nodes: DataFrame) -> DataFrame:
    """(a, b): fingerprints of different texts that share a passage and differ by at most ``NEAR_BITS``.

    ``nodes`` has (fp, passages). In each passage's list a fingerprint meets the least, the
    greatest and the next one, so the work follows the number of passages however many texts share
    one; near copies share nearly all of theirs.
    """
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pick = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter((F.col("a") != F.col("b")) & (bits <= NEAR_BITS))
    every = nodes.select("fp", F.explode("passages").alias("cell"))
    shared = every.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = saved(shared, "simhash-passages")
    crowded = salted(shared.filter("n > 2").select("cell", "low", "top"))
    dealt = every.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    members = saved(dealt.join(crowded, ["cell", "salt"]), "simhash-sharers")
    after = members.withColumn("next", F.lead("fp").over(Window.partitionBy("cell", "salt").orderBy("fp"))).filter("next is not null")
    found = pick(shared, "low", "top").union(pick(members, "fp", "low")).union(pick(members, "fp", "top")).union(pick(after, "fp", "next"))
    return found.distinct()


def similar_links(docs: DataFrame, links: DataFrame, nodes: DataFrame, key: Column) -> DataFrame:
    """The links whose texts have word shingle sets of a similarity of ``SIMILAR`` or more, exactly.

    ``nodes`` has (fp, least) with the key of the row that stands for a fingerprint. Only texts of
    linked rows are cut into shingles.
    """
    asked = links.select(F.col("a").alias("fp")).union(links.select(F.col("b").alias("fp"))).distinct()
    asked = saved(nodes.join(asked, "fp", "left_semi").select("fp", F.col("least.key").alias("key")), "simhash-asked")
    texts = docs.select(key.alias("key"), "text").join(asked, "key")

    def work(batches):
        for batch in batches:
            yield {"fp": batch["fp"], "held": [shingle_set(t, SIMILAR_WORDS) for t in batch["text"].to_pylist()]}

    # rows equal in all columns share a key; one of them is enough
    sets = map_batches(texts.select("fp", "text"), work, "fp long, held array<long>").groupBy("fp").agg(F.first("held").alias("held"))
    sets = saved(sets, "simhash-sets")
    left, right = (sets.select(F.col("fp").alias(c), F.col("held").alias(f"held_{c}")) for c in ("a", "b"))
    both = links.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("held_a", "held_b")))
    return both.filter(F.col("common") >= SIMILAR * (F.size("held_a") + F.size("held_b") - F.col("common"))).select("a", "b")


def copy_representatives(docs: DataFrame, key: Column, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, key) of one row per group of near copies: the smallest doc_id, null last, then the smallest ``key``.

    Rows are linked when their fingerprints differ in at most ``distance`` bits, and when they share a
    passage and their sets of five-word shingles have a similarity of 0.8 or more. Fingerprints of
    such texts may differ in a dozen bits, which no grid of cells can search at scale; shared
    passages find them, the fingerprints rule most of the rest out, and the sets decide.
    """
    def work(batches):
        for batch in batches:
            found = [text_profile(t, shingle, seed) for t in batch["text"].to_pylist()]
            prints = [int.from_bytes(fp, "big", signed=True) for fp, _ in found]
            yield {"doc_id": batch["doc_id"], "key": batch["key"], "fp": prints, "passages": [p for _, p in found]}

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text")
    rows = saved(map_batches(keyed, work, "doc_id long, key long, fp long, passages array<long>"), "simhash-profiles")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    nodes = rows.groupBy("fp").agg(F.min(row).alias("least"), F.min_by("passages", row).alias("passages"))
    nodes = saved(nodes, "simhash-nodes")
    label = link_components(nodes.select("fp"), distance)
    wide = saved(passage_links(nodes), "simhash-wide")
    close = similar_links(docs, wide, nodes, key)
    joined = label.select(F.col("fp").alias("a"), F.col("component").alias("b")).union(close)
    whole = components(joined, "simhash-copies").withColumnRenamed("node", "fp")
    tagged = nodes.join(whole, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = tagged.groupBy("component").agg(F.min("least").alias("least"))
    return best.select("least.doc_id", "least.key")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest doc_id reachable.

    Equal fingerprints are one node, found by a partial aggregate, so exact copies cost nothing
    beyond their own row.
    """
    rows = saved(fingerprints(docs, shingle, seed), "simhash-rows")
    tagged = tagged_nodes(rows, F.min("doc_id"), distance)
    least = tagged.groupBy("component").agg(F.min("least").alias("component_id"))
    # nodes are distinct fingerprints; the rows of one may be many, so the join key is salted
    named = saved(tagged.join(least, "component").select("fp", "component_id"), "simhash-named")
    spread = salted(named)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, ["fp", "salt"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
