"""Mixing sources to target weights by proportionate-fair scheduling.

The documents of a source form blocks in a shuffled order. Rounds follow each other; in round k a
source takes its weight's number of blocks, or what it has left. Within a round of C blocks the
i-th of a source's q blocks is released in slot floor((i-1)C/q) and due before slot ceil(iC/q).
Earliest deadline first gives every slot to one released block, and at any moment the blocks
taken from a source differ by less than one from its share q/C of the slots passed. While all
sources last, q/C is the target weight. No document is dropped or repeated: when a source runs
out, the others go on in their proportions.

Rounds between two exhaustions are alike, so the schedule is solved once per kind of round (at
most twice the number of sources plus one) and looked up; its cost depends on the number of
sources and the weights, not on the data. The state of the solver is one count per source.

That is ``mix``, whose last round of a source is spread by what the source has left.
``mix_to_weights`` takes windows from the target weights alone until a source's very last block:
block i of a source of weight w is released in slot floor((i-1)W/w) and due before slot
ceil(iW/w), W being the sum of the weights of the sources that last. A new kind begins in the slot
after a source has given its last block, so at every moment before, blocks taken differ by less
than one from the target share.

Defined cases: a null source is a source of its own; weights are whole numbers of at least one,
sources without a given weight get the default; equal rows keep a place each; an empty table
gives no rows; columns that clash with the added ones are refused (``mix_to_weights`` passes any other name
through, ``mix`` also uses some names that begin with an underscore); texts are only hashed, so
their length does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.llm.common import saved

ADDED = ("block", "round", "slot", "nth")
BUCKET_ROWS = 2_048
EXPONENT = 0.7
RESOLUTION = 1_000
CHUNK = 256


def tempered_weights(sizes: DataFrame, exponent: float = EXPONENT, resolution: int = RESOLUTION) -> DataFrame:
    """(source, weight): sizes to the power ``exponent``, in whole parts of about ``resolution``.

    ``sizes`` has one row per source.
    """
    share = F.pow(F.col("docs").cast("double"), F.lit(exponent))
    total = F.sum(share).over(Window.partitionBy())
    return sizes.select("source", F.greatest(F.lit(1), F.round(share / total * resolution)).cast("long").alias("weight"))


def _winner(t: Column, state: Column, total: Column) -> Column:
    """The source (index) of the released block with the earliest deadline in slot t.

    ``state`` is an array of (q, done); ties go to the smaller index.
    """
    def candidate(s: Column, i: Column) -> Column:
        released = (s["done"] < s["q"]) & (F.floor(s["done"] * total / s["q"]) <= t)
        due = F.ceil((s["done"] + 1) * total / s["q"])
        return F.when(released, F.struct(due.alias("due"), i.alias("i")))

    return F.array_min(F.filter(F.transform(state, candidate), lambda c: c.isNotNull()))["i"]


def kind_starts(blocks: Column, weight: Column) -> Column:
    """First rounds of the kinds: a source's quota changes in its last, partial round and after it."""
    everywhere = Window.partitionBy()
    ends = F.collect_set(F.floor(blocks / weight)).over(everywhere)
    both = F.concat(F.array(F.lit(0).cast("long")), ends, F.transform(ends, lambda e: e + 1))
    return F.array_sort(F.array_distinct(both))


def round_patterns(sources: DataFrame) -> DataFrame:
    """(kind_from, kind_slot, total, index, nth, offset): the solved kinds of rounds.

    ``sources`` has (index, blocks, weight, starts), one row per source. kind_slot is the first
    slot of the kind, total the slots of one of its rounds, offset the slot within the round of
    the nth block of a source.
    """
    listed = sources.agg(F.sort_array(F.collect_list(F.struct("index", "blocks", "weight"))).alias("s"), F.first("starts").alias("starts"))
    kinds = listed.select("s", F.explode("starts").alias("kind_from"))
    sum_of = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    quota = F.transform("s", lambda s: F.greatest(F.lit(0).cast("long"), F.least(s["weight"], s["blocks"] - F.col("kind_from") * s["weight"])))
    gone = F.transform("s", lambda s: F.least(s["blocks"], F.col("kind_from") * s["weight"]))
    solved = kinds.withColumn("quota", quota).withColumn("total", sum_of("quota")).withColumn("kind_slot", sum_of(gone))
    # one task per kind
    solved = solved.filter("total > 0").repartition("kind_from")
    begin = F.struct(
        F.transform("quota", lambda q: F.struct(q.alias("q"), F.lit(0).cast("long").alias("done"))).alias("state"),
        F.array().cast("array<int>").alias("won"),
    )

    def grant(acc: Column, winner: Column) -> Column:
        state = F.transform(acc["state"], lambda s, i: F.struct(s["q"].alias("q"), (s["done"] + F.when(i == winner, 1).otherwise(0)).alias("done")))
        return F.struct(state.alias("state"), F.concat(acc["won"], F.array(winner)).alias("won"))

    def step(acc: Column, t: Column) -> Column:
        # an array of one, so that the winner is found once and not for every source
        return F.transform(F.array(_winner(t, acc["state"], F.col("total"))), lambda winner: grant(acc, winner))[0]

    slots = F.sequence(F.lit(0).cast("long"), F.col("total") - 1)
    won = solved.select("kind_from", "kind_slot", "total", "s", F.aggregate(slots, begin, step)["won"].alias("won"))
    each = won.select("kind_from", "kind_slot", "total", "s", F.posexplode("won").alias("offset", "i"))
    each = each.select("kind_from", "kind_slot", "total", F.col("s")[F.col("i")]["index"].alias("index"), "offset")
    nth = F.row_number().over(Window.partitionBy("kind_from", "index").orderBy("offset")) - 1
    return each.withColumn("in_round", nth.cast("long"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def _once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed a single time."""
    return F.transform(F.array(value), then)[0]


def _period(weights: Column) -> Column:
    """Winners of the slots of one period, in chunks: array<array<int>>; a source without blocks has weight 0.

    Chunks keep the cost of growing the list down; only the last one is copied from slot to slot.
    """
    total = _sum(weights)
    fresh = F.transform(weights, lambda w: F.struct(w.alias("q"), F.lit(0).cast("long").alias("done")))

    def slot(acc: Column, t: Column) -> Column:
        def grant(winner: Column) -> Column:
            state = F.transform(acc["state"], lambda s, i: F.struct(s["q"].alias("q"), (s["done"] + F.when(i == winner, 1).otherwise(0)).alias("done")))
            return F.struct(state.alias("state"), F.array_append(acc["won"], winner).alias("won"))

        return _once(_winner(t, acc["state"], total), grant)

    def chunk(acc: Column, c: Column) -> Column:
        last = F.least((c + 1) * CHUNK, total) - 1
        start = F.struct(acc["state"].alias("state"), F.array().cast("array<int>").alias("won"))
        grown = F.aggregate(F.sequence(c * CHUNK, last), start, slot)
        return _once(grown, lambda g: F.struct(g["state"].alias("state"), F.concat(acc["chunks"], F.array(g["won"])).alias("chunks")))

    begin = F.struct(fresh.alias("state"), F.array().cast("array<array<int>>").alias("chunks"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / CHUNK))
    return F.aggregate(chunks, begin, chunk)["chunks"]


def kinds_of_rounds(sources: DataFrame) -> DataFrame:
    """One row per kind: kind, kind_slot, round_from, slots, weights, before, won.

    ``sources`` has (index, blocks, weight), one row per source. ``before`` has the blocks each
    source gave in earlier kinds, ``won`` the winner of each slot of a period (by index, from 0).
    """
    listed = sources.agg(F.sort_array(F.collect_list(F.struct("index", "blocks", "weight"))).alias("s"))
    zero = F.lit(0).cast("long")
    row = "kind_slot bigint, round_from bigint, slots bigint, weights array<bigint>, before array<bigint>, won array<int>"
    begin = F.struct(
        F.transform("s", lambda s: s["blocks"]).alias("left"), zero.alias("slot"), zero.alias("round"),
        F.array().cast(f"array<struct<{row.replace(' ', ':').replace(',:', ',')}>>").alias("kinds"),
    )

    def solve(acc: Column) -> Column:
        weights = F.transform("s", lambda s, i: F.when(acc["left"][i] > 0, s["weight"]).otherwise(zero))
        return _once(F.struct(weights.alias("w"), F.flatten(_period(weights)).alias("won")), lambda p: extend(acc, p["w"], p["won"]))

    def extend(acc: Column, weights: Column, won: Column) -> Column:
        total = _sum(weights)
        places = F.transform(weights, lambda w, i: F.filter(F.transform(won, lambda x, t: F.when(x == i, t.cast("long"))), lambda t: t.isNotNull()))

        def finish(places: Column) -> Column:
            # the slot of a source's last block; the kind ends with the first of them
            last = F.transform(weights, lambda w, i: F.when(w > 0, F.floor((acc["left"][i] - 1) / w) * total + F.get(places[i], ((acc["left"][i] - 1) % w).cast("int"))))
            return _once(F.array_min(last) + 1, lambda n: close(places, n))

        def close(places: Column, slots: Column) -> Column:
            whole, rest = F.floor(slots / total), slots % total
            given = F.transform(weights, lambda w, i: whole * w + F.size(F.filter(places[i], lambda t: t < rest)))
            kind = F.struct(
                acc["slot"].alias("kind_slot"), acc["round"].alias("round_from"), slots.alias("slots"), weights.alias("weights"),
                F.transform("s", lambda s, i: s["blocks"] - acc["left"][i]).alias("before"), won.alias("won"),
            )
            return F.struct(
                F.transform(acc["left"], lambda x, i: x - given[i]).alias("left"), (acc["slot"] + slots).alias("slot"),
                (acc["round"] + F.ceil(slots / total)).alias("round"), F.array_append(acc["kinds"], kind).alias("kinds"),
            )

        return _once(places, finish)

    def step(acc: Column, _: Column) -> Column:
        return F.when(F.exists(acc["left"], lambda x: x > 0), solve(acc)).otherwise(acc)

    # every kind uses up a source
    solved = listed.filter(F.size("s") > 0).select(F.aggregate("s", begin, step)["kinds"].alias("kinds"))
    return solved.select(F.posexplode("kinds").alias("kind", "k")).select("kind", "k.*")


def numbered(docs: DataFrame, block_docs: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sizes): rows (row, source, n) with all columns in ``row`` and the number of the document in
    its source; sizes (source, docs).

    Numbers need no sort of a whole source: hash buckets hold about ``BUCKET_ROWS`` rows, their
    counts are summed, and only inside a bucket rows are ranked.
    """
    buckets = max(1, docs.count() // BUCKET_ROWS)
    hashed = F.xxhash64(*[F.col(c) for c in ("doc_id", "text", "source") if c in docs.columns])
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("source").alias("source"), hashed.alias("hash"))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("hash", 32), F.lit(buckets)))
    counts = saved(rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("hash")) - 1)
    based = ranked.join(base, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    return based.select("row", "source", (F.col("base") + F.col("rank")).alias("n")), counts.groupBy("source").agg(F.sum("n").alias("docs"))


def mix_to_weights(docs: DataFrame, weights: DataFrame | None = None, block_docs: int = 16) -> DataFrame:
    """``docs`` with block (number in its source), round, slot (place of the block in the mix, from
    0, without gaps) and nth (place of the document in its block), by windows from target weights.

    ``weights`` has (source, weight). Columns of any name but the four added ones pass through.
    """
    clash = set(ADDED) & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are added by the mix")
    rows, sizes = numbered(docs, block_docs)
    chosen = tempered_weights(sizes) if weights is None else weights.select("source", F.greatest(F.lit(1), F.col("weight")).cast("long").alias("weight"))
    chosen = chosen.select(F.col("source").alias("_source"), "weight")
    sources = sizes.join(chosen, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", F.ceil(F.col("docs") / block_docs).alias("blocks"), F.coalesce("weight", F.lit(1).cast("long")).alias("weight")
    )
    # one row per source from here on; its index from 0
    index = (F.row_number().over(Window.orderBy("source")) - 1).cast("int")
    sources = saved(sources.withColumn("index", index), "mix-sources")
    kinds = saved(kinds_of_rounds(sources), "mix-kinds")

    each = kinds.select("kind", "kind_slot", "round_from", "weights", "before", F.posexplode("won").alias("offset", "index"))
    each = each.withColumn("in_round", (F.row_number().over(Window.partitionBy("kind", "index").orderBy("offset")) - 1).cast("long"))
    total = _sum(F.col("weights"))
    pattern = each.select("kind", "index", "in_round", "kind_slot", "round_from", "offset", total.alias("total"))
    # where a source's blocks of each kind begin; kinds in which it has none are left out
    spans = kinds.select("kind", F.posexplode(F.arrays_zip("weights", "before")).alias("index", "k")).filter("k.weights > 0")
    starts = spans.groupBy("index").agg(F.sort_array(F.collect_list(F.struct(F.col("k.before").alias("from"), "kind", F.col("k.weights").alias("w")))).alias("starts"))
    placed = sources.join(saved(starts, "mix-starts"), "index").select(F.col("source").alias("_source"), "index", "starts")

    blocks = rows.withColumn("block", F.floor(F.col("n") / block_docs)).join(placed, F.col("source").eqNullSafe(F.col("_source")))
    kind = F.element_at(F.filter("starts", lambda s: s["from"] <= F.col("block")), -1)
    blocks = blocks.withColumn("k", kind).select("row", "n", "block", "index", "k.*").withColumn("inside", F.col("block") - F.col("from"))
    blocks = blocks.withColumn("in_round", F.col("inside") % F.col("w")).withColumn("period", F.floor(F.col("inside") / F.col("w")))
    joined = blocks.join(saved(pattern, "mix-pattern"), ["kind", "index", "in_round"])
    slot = F.col("kind_slot") + F.col("period") * F.col("total") + F.col("offset")
    return joined.select(
        "row.*", "block", (F.col("round_from") + F.col("period")).alias("round"), slot.alias("slot"), (F.col("n") % block_docs).cast("int").alias("nth")
    )


def mix(docs: DataFrame, weights: DataFrame | None = None, block_docs: int = 16) -> DataFrame:
    """``docs`` with block (number in its source), round, slot (place of the block in the mix, from
    0, without gaps) and nth (place of the document in its block).

    ``weights`` has (source, weight). Documents of a source are numbered without a sort of the
    whole source: rows fall into hash buckets of about ``BUCKET_ROWS``, bucket counts are summed,
    and only inside a bucket rows are ranked.
    """
    clash = set(ADDED) & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are added by the mix")
    columns = docs.columns
    buckets = max(1, docs.count() // BUCKET_ROWS)
    keyed = docs.withColumn("_hash", F.xxhash64(*[F.col(c) for c in ("doc_id", "text", "source") if c in columns]))
    keyed = keyed.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_hash", 32), F.lit(buckets)))
    counts = saved(keyed.groupBy("source", "_bucket").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        F.col("source").alias("_source"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")
    )
    sizes = counts.groupBy("source").agg(F.sum("n").alias("docs"))
    chosen = tempered_weights(sizes) if weights is None else weights.select("source", F.greatest(F.lit(1), F.col("weight")).cast("long").alias("weight"))
    chosen = chosen.select(F.col("source").alias("_source"), "weight")
    sources = sizes.join(chosen, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source",
        F.ceil(F.col("docs") / block_docs).alias("blocks"),
        F.coalesce("weight", F.lit(1).cast("long")).alias("weight"),
    )
    # one row per source from here on
    sources = sources.select("*", F.row_number().over(Window.orderBy("source")).cast("int").alias("index"), kind_starts(F.col("blocks"), F.col("weight")).alias("starts"))
    sources = saved(sources, "mix-sources")
    patterns = saved(round_patterns(sources), "mix-patterns")

    inside = Window.partitionBy("source", "_bucket").orderBy("_hash")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1)
    based = ranked.join(base, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_of")))
    numbered = based.withColumn("_n", F.col("_base") + F.col("_rank")).withColumn("block", F.floor(F.col("_n") / block_docs))
    # both tables depend on the number of sources and on the weights only, so every document looks its place up
    quotas = sources.select(F.col("source").alias("_source2"), F.col("weight").alias("_weight"), F.col("index").alias("_index"), F.col("starts").alias("_starts"))
    rounds = numbered.join(quotas, F.col("source").eqNullSafe(F.col("_source2"))).withColumn("round", F.floor(F.col("block") / F.col("_weight")))
    rounds = rounds.withColumn("_in_round", F.col("block") % F.col("_weight"))
    rounds = rounds.withColumn("_kind_from", F.array_max(F.filter("_starts", lambda s: s <= F.col("round"))))
    solved = patterns.select(*[F.col(c).alias(f"_{c}") for c in ("kind_from", "index", "in_round", "kind_slot", "total", "offset")])
    slot = F.col("_kind_slot") + (F.col("round") - F.col("_kind_from")) * F.col("_total") + F.col("_offset")
    joined = rounds.join(solved, ["_kind_from", "_index", "_in_round"]).withColumn("slot", slot)
    return joined.select(*[F.col(c) for c in columns], "block", "round", "slot", (F.col("_n") % block_docs).cast("int").alias("nth"))
