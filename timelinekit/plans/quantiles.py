"""Exact percentiles that never hold the values of a group in one aggregation buffer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelinekit.plans.layout import KeyLayout
from timelinekit.plans.ordered import ordered_scan


def _ranked(df: DataFrame, layout: KeyLayout, value: str) -> DataFrame:
    """(keys, value, first index, index after the last) of each distinct value, plus the total."""
    keys = list(layout.keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    # Cuts of another column say nothing about the values; they are taken from the distinct ones.
    value_layout = KeyLayout(layout.keys, value, layout.hot)
    if layout.split and value != layout.order:
        value_layout = KeyLayout.measure(counted, keys, value)
    ranked = ordered_scan(counted, value_layout, [value], upto={"_upto": "_n"})
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    return value_layout.join_per_key(ranked, totals).withColumn("_from", F.col("_upto") - F.col("_n"))


def _at(value: str, index: Column) -> Column:
    return F.max(F.when((F.col("_from") <= index) & (index < F.col("_upto")), F.col(value)))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], layout: KeyLayout | None = None
) -> DataFrame:
    """Linear-interpolation percentiles per key: equal values are counted first (partial
    aggregation), then ranked with a running count, and each percentile reads its two
    neighbours. ``probs`` maps output column to probability; ``n`` is added."""
    layout = layout or KeyLayout.measure(df, keys, value)
    ranked = _ranked(df, layout, value)
    picks = []
    for out, p in probs.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [_at(value, F.floor(position)).alias(f"_lo_{out}"), _at(value, F.ceil(position)).alias(f"_hi_{out}")]
    wide = ranked.groupBy(*keys).agg(F.max("_total").alias("n"), *picks)
    finished = []
    for out, p in probs.items():
        position = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"_lo_{out}").cast("double"), F.col(f"_hi_{out}").cast("double")
        finished.append((low + (high - low) * (position - F.floor(position))).alias(out))
    return wide.select(*keys, "n", *finished)


def upper_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median", layout: KeyLayout | None = None
) -> DataFrame:
    """``sorted(values)[n // 2]``: the upper of the two middle elements, never an average."""
    layout = layout or KeyLayout.measure(df, keys, value)
    ranked = _ranked(df, layout, value)
    return ranked.groupBy(*keys).agg(
        F.max("_total").alias("n"), _at(value, F.floor(F.col("_total") / 2)).alias(out)
    )
