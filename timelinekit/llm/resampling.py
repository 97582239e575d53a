"""Importance resampling towards a target: hashed n-gram weights, Gumbel noise, an exact cutoff.

Runs of 1 to ``longest`` words fall into buckets. A bucket's gain is the logarithm of its smoothed
share in the target over its smoothed share in all documents, in whole thousandths; gains stand in
an array, and a document's weight is the sum over its features. Weight plus Gumbel noise derived
from the id is the score, and the highest scores are a draw without replacement.

The score is written once with the other keys of the order. The cutoff is found by bisecting the
numbers between the lowest and the highest: every round is one exact count over the written table
for several thresholds at once. Rows that tie with the last one are bisected by doc_id, then by
the number of features, then by the place in the written table, so exactly the wanted number is
drawn, and rows left to the last key are equal in all that is returned. Only drawn rows are range
partitioned and sorted; a rank is the place in the partition plus the sizes of those before it.

Defined cases: a null text has no words; a null doc_id draws the noise of the text "null" and
counts as the largest in ties; repeated rows are rows of their own; with an empty or null target
gains come from smoothing alone; an empty table gives no rows; other columns are ignored. Texts
are hashed whole, whatever their length; a row's memory is a small multiple of its text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelinekit.llm.common import saved
from timelinekit.llm.ngrams import bucket_counts, lower_ascii, number_array, run_buckets, summed, words

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLDS = 16  # counted in one round
RANK_ROWS = 100_000  # drawn rows in one range
LARGEST = 2**63 - 1


def features(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``texts`` with n_words and the array ``buckets`` in place of ``text``."""
    found = texts.withColumn("_words", words(lower_ascii(F.col("text")), WORD)).drop("text")
    return found.withColumn("n_words", F.size("_words").cast("long")).withColumn("buckets", run_buckets(F.col("_words"), longest, buckets)).drop("_words")


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Per bucket floor(1000 ln of its share in ``target`` over its share in ``raw``), one added to each count."""
    s, t = dict(bucket_counts(raw, "buckets", F.lit(1))), dict(bucket_counts(target, "buckets", F.lit(1)))
    raw_all, target_all = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * raw_all / ((s.get(b, 0) + 1.0) * target_all))) for b in range(buckets)]


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths from the SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def value_at(rows: DataFrame, key: str, need: int) -> tuple[int, int, int]:
    """(value, below, equal): the ``need``-th smallest value of a whole-number column, with the rows below and at it.

    ``rows`` has ``need`` rows or more. Each round is one exact count job.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low < high:
        steps = sorted({low + (high - low) * i // THRESHOLDS for i in range(1, THRESHOLDS)} - {high})
        counts = rows.agg(*[F.count_if(F.col(key) <= s) for s in steps]).first()
        reached = [s for s, n in zip(steps, counts) if n >= need]
        missed = [s for s, n in zip(steps, counts) if n < need]
        low, high = (missed[-1] + 1 if missed else low), (reached[0] if reached else high)
    below, equal = rows.agg(F.count_if(F.col(key) < low), F.count_if(F.col(key) == low)).first()
    return low, below, equal


def first_rows(rows: DataFrame, keys: list[str], wanted: int) -> Column:
    """A condition that holds for exactly the ``wanted`` first rows in the ascending order of ``keys``.

    Keys are whole numbers without nulls and together tell all rows apart.
    """
    if wanted <= 0:
        return F.lit(False)
    taken: list[Column] = []
    tied = F.lit(True)
    for key in keys:
        value, below, equal = value_at(rows.filter(tied), key, wanted)
        taken.append(tied & (F.col(key) < value))
        tied, wanted = tied & (F.col(key) == value), wanted - below
        if equal == wanted:
            break
    return reduce(lambda a, b: a | b, [*taken, tied])


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 2024
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document, rank from 1 for those drawn and null for the rest.

    ``percent`` of the documents with ``min_words`` or more are drawn; ``target`` has a column text.
    """
    hashed = features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), longest, buckets)
    hashed = saved(hashed.withColumn("row", F.monotonically_increasing_id()), "resample-features")
    gains = number_array(bucket_gains(hashed, features(target.select("text"), longest, buckets), buckets))
    scored = hashed.select(
        "doc_id", F.size("buckets").cast("long").alias("n_features"), summed(F.col("buckets"), gains).alias("weight"), "n_words", "row"
    )
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    keyed = scored.withColumn("less", -F.col("score")).withColumn("id_key", F.coalesce("doc_id", F.lit(LARGEST)))
    keyed = saved(keyed, "resample-scores")

    order = ["less", "id_key", "n_features", "row"]
    long_enough = keyed.filter(F.col("n_words") >= min_words)
    wanted = long_enough.count() * percent // 100
    drawn = (F.col("n_words") >= min_words) & first_rows(long_enough, order, wanted)
    ranges = max(1, -(-wanted // RANK_ROWS))
    placed = keyed.filter(drawn).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the id is the number of the partition in the upper bits and the place in it in the lower 33
    placed = saved(placed.withColumn("place", F.monotonically_increasing_id()), "resample-drawn")
    part = F.shiftright("place", 33)
    sizes = dict(placed.groupBy(part.alias("part")).count().collect())
    before = [sum(n for q, n in sizes.items() if q < p) for p in range(max(sizes, default=0) + 1)]
    rank = number_array(before)[part.cast("int")] + F.col("place").bitwiseAND(F.lit(2**33 - 1)) + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = keyed.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.select(*columns, rank.alias("rank")).unionByName(rest)
