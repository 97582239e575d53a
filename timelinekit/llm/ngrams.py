"""Hashed word n-grams as array columns, and per-bucket numbers applied to them; built-in functions only."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, pattern: str) -> Column:
    """All matches of ``pattern``; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def word_buckets(found: Column, buckets: int) -> Column:
    """Per word the CRC-32 of its UTF-8 bytes modulo ``buckets``."""
    return F.transform(found, lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))


def run_buckets(found: Column, longest: int, buckets: int) -> Column:
    """Per run of 1 to ``longest`` words, joined by one space, the CRC-32 of its UTF-8 bytes modulo ``buckets``."""
    if longest == 1:
        return word_buckets(found, buckets)

    def of_length(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))

    return word_buckets(F.flatten(F.array(found, *[of_length(n) for n in range(2, longest + 1)])), buckets)


def bucket_counts(rows: DataFrame, column: str, *weights: Column) -> list[list[int]]:
    """Per bucket that occurs: its number and the sum of each weight over all its occurrences.

    Counts are partial aggregates, so a task sends a row per bucket at most; what arrives at the
    driver has as many rows as there are buckets, a parameter.
    """
    named = [w.cast("long").alias(f"w{i}") for i, w in enumerate(weights)]
    each = rows.select(F.explode(column).alias("bucket"), *named)
    counted = each.groupBy("bucket").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(weights))])
    return [list(r) for r in counted.collect()]


def number_array(values: Sequence[int]) -> Column:
    """A constant array of longs, folded to one literal by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def summed(buckets: Column, numbers: Column) -> Column:
    """The sum of ``numbers`` at the places in ``buckets``."""
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda total, b: total + numbers[b])
