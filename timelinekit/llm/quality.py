"""Quality rules: surface counts of a text, and how much likelier its n-grams are in trusted documents.

Words fall into buckets by CRC-32, a pair of neighbours into the bucket of its two buckets. Over
all documents the buckets are counted (the raw corpus), and over the trusted ones among them (the
target). A bucket's gain is the logarithm of its smoothed target share over its smoothed raw
share, in whole thousandths. A document's score is the mean gain of its n-grams, rounded down; it
is kept when the score reaches the threshold and the surface rules hold.

Trusted documents whose id has an even CRC-32 are counted, the others set the threshold: the
score below which ``LOST`` of a thousand of them fall, found exactly from the number of documents
per score. So no document that sets the threshold has raised its own score. Everything is counted
over all documents; gains are one number per bucket, a parameter, whatever the corpus.

Repeated five-word windows are found inside the row by 64-bit hashes, sorted only where one
occurs twice. Built-in functions only.

Defined cases: a null text has no words and fails; a null doc_id is never trusted; a doc_id with
several labels is trusted if all are 1; repeated documents count each time; without trusted
documents in either half the surface rules alone decide; an empty table gives no rows; other
columns are ignored. Texts are read whole; a row's memory is a small multiple of its text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.llm.common import hold_out, saved
from timelinekit.llm.ngrams import bucket_counts, number_array, summed, word_buckets, words

# fixed values
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW_WORDS = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

SURFACE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
BUCKETS = 16_384
PAIR_FACTOR = 7_919
LOST = 10  # of a thousand trusted documents, those below the threshold


def repeated_words(found: Column) -> Column:
    """Number of words that stand in a window of five words which occurs twice or more."""
    starts = F.sequence(F.lit(1), F.size(found) - (WINDOW_WORDS - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(found, i, WINDOW_WORDS)))
    hashes = F.when(F.size(found) >= WINDOW_WORDS, hashes)

    def covered(ordered: Column) -> Column:
        # ordered is an array of (hash, place); equal hashes are neighbours
        twice = F.filter(ordered, lambda s, k: F.get(ordered, k - 1)["h"].eqNullSafe(s["h"]) | F.get(ordered, k + 1)["h"].eqNullSafe(s["h"]))
        places = F.sort_array(F.transform(twice, lambda s: s["i"]))
        begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

        def step(acc: Column, place: Column) -> Column:
            fresh = place + WINDOW_WORDS - F.greatest(place, acc["end"])
            return F.struct((place + WINDOW_WORDS).alias("end"), (acc["n"] + fresh).alias("n"))

        return F.aggregate(places, begin, step)["n"]

    # arrays of one keep each intermediate from being computed anew where it is used twice
    def judge(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = F.transform(F.array(ordered), covered)[0]
        return F.when(F.size(F.array_distinct(h)) < F.size(h), some).otherwise(F.lit(0).cast("long"))

    return F.coalesce(F.transform(F.array(hashes), judge)[0], F.lit(0).cast("long"))


def surface(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, places): ``places`` has each word's bucket."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("found", words(F.col("text"), WORD))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))
    counted = rows.withColumn("lines", lines).select(
        "doc_id",
        F.size("found").cast("long").alias("n_words"),
        F.aggregate("found", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("found")).alias("n_repeat_words"),
        word_buckets(F.col("found"), buckets).alias("places"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def grams(places: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbouring words."""
    pair = lambda b, i: ((b.cast("long") * PAIR_FACTOR + F.get(places, i + 1)) % buckets).cast("int")
    pairs = F.transform(F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), pair)
    return F.concat(places, pairs)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id): ids all of whose labels say good quality."""
    rows = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return rows.agg(F.min(F.coalesce("quality", F.lit(0))).alias("least")).filter("least = 1").select("doc_id")


def bucket_gains(raw: DataFrame, trusted: DataFrame, buckets: int) -> list[int]:
    """Per bucket floor(1000 ln of its trusted share over its raw share), one added to each count."""
    raw_n, target_n = [0] * buckets, [0] * buckets
    for rows, into in ((raw, raw_n), (trusted, target_n)):
        for b, n in bucket_counts(rows.select(grams(F.col("places"), buckets).alias("g")), "g", F.lit(1)):
            into[b] = n
    raw_all, target_all = float(sum(raw_n) + buckets), float(sum(target_n) + buckets)
    return [math.floor(1000 * math.log((t + 1.0) * raw_all / ((s + 1.0) * target_all))) for s, t in zip(raw_n, target_n)]


def score_threshold(scores: DataFrame, lost: int = LOST) -> int | None:
    """The largest score with at most ``lost`` of a thousand rows below it; null without rows."""
    per = scores.groupBy("score").count()
    # one row per distinct score, which lies between the least and the largest gain
    below = F.coalesce(F.sum("count").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per.select("score", below.alias("below"), F.sum("count").over(Window.partitionBy()).alias("all"))
    return ranked.filter(F.col("below") * 1000 <= F.col("all") * lost).agg(F.max("score")).first()[0]


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, lost: int = LOST) -> DataFrame:
    """Per document the surface counts, base_failed, score (thousandths, null without words) and kept."""
    rows = saved(surface(docs, buckets), "quality-rows")
    ids = saved(trusted_ids(labels), "quality-trusted")
    counted = hold_out(0, 2)
    # of the word arrays only those of the counted half are moved, by the same plan at every size
    target = rows.filter(counted).select("doc_id", "places").join(ids.hint("merge"), "doc_id", "left_semi")
    gains = number_array(bucket_gains(rows, target, buckets))
    n_grams = F.greatest(2 * F.size("places") - 1, F.lit(0))
    score = F.when(F.size("places") > 0, F.floor(summed(grams(F.col("places"), buckets), gains) / n_grams))
    scored = saved(rows.select(*SURFACE, score.alias("score")), "quality-scores")
    trusted = scored.select("doc_id", "score").join(ids, "doc_id", "left_semi")
    threshold = None
    if not trusted.filter(counted).isEmpty():
        threshold = score_threshold(trusted.filter(~counted & F.col("score").isNotNull()), lost)
    reached = F.lit(True) if threshold is None else F.coalesce(F.col("score") >= threshold, F.lit(False))
    return scored.withColumn("kept", ~F.col("base_failed") & reached)
