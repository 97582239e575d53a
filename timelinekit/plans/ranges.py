"""Interval joins on dyadic cells, so that a busy key spreads over its cells and no width is chosen.

An interval stands on the level of its own length: the smallest power of two that is not below
it. On that level it touches two cells at most. A point looks into one cell of every level in
use. A cell is at most twice as wide as the intervals listed in it are long, so a fair share of
what meets in a cell are results, whatever lengths are mixed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelinekit.plans.layout import KeyLayout
from timelinekit.plans.ordered import ordered_scan

FINEST = 2.0**-20
_LEVEL, _CELL = "_level", "_cell"


def _listed(spans: DataFrame, span: tuple[str, str], finest: float) -> DataFrame:
    """Spans under each cell they touch on the level of their length."""
    start, end = F.col(span[0]), F.greatest(*[F.col(c) for c in span])
    level = F.ceil(F.log2(F.greatest(end - start, F.lit(finest)))).cast("int")
    width = F.pow(F.lit(2.0), F.col(_LEVEL))
    leveled = spans.withColumn(_LEVEL, level)
    return leveled.withColumn(_CELL, F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))


def _probing(points: DataFrame, at: str, levels: Sequence[int]) -> DataFrame:
    """Points once per level, each in its cell."""
    cells = [F.struct(F.lit(n).alias(_LEVEL), F.floor(F.col(at) / F.lit(2.0**n)).alias(_CELL)) for n in levels]
    return points.withColumn("_c", F.explode(F.array(*cells))).select(*points.columns, f"_c.{_LEVEL}", f"_c.{_CELL}")


def point_join(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, span: tuple[str, str], finest: float = FINEST
) -> DataFrame:
    """Pairs with ``span.start <= at <= span.end``; a point has one cell per level, so no duplicates.

    ``finest`` is the smallest cell, for intervals shorter than it. The driver receives the levels
    in use, as many as there are binary orders of magnitude among the lengths.
    """
    listed = _listed(spans.filter(F.col(span[0]).isNotNull() & F.col(span[1]).isNotNull()), span, finest)
    levels = sorted(r[0] for r in listed.select(_LEVEL).distinct().collect()) or [math.ceil(math.log2(finest))]
    joined = _probing(points, at, levels).join(listed, [*keys, _LEVEL, _CELL])
    return joined.filter((F.col(span[0]) <= F.col(at)) & (F.col(at) <= F.col(span[1]))).drop(_LEVEL, _CELL)


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str],
    finest: float = FINEST,
) -> DataFrame:
    """All (left, right) pairs of a key with ``l.start < r.end and r.start < l.end``.

    In such a pair the later of the two starts lies in the other interval, so it is found by
    exactly one of two point joins: left starts in right intervals, or right starts in left ones.
    """
    ls, le = left_span
    rs, re = right_span
    meet = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    columns = [*left.columns, *[c for c in right.columns if c not in keys]]
    first = point_join(left, right, keys, ls, right_span, finest).filter(meet)
    second = point_join(right, left, keys, rs, left_span, finest).filter(meet & (F.col(rs) > F.col(ls)))
    return first.select(*columns).unionByName(second.select(*columns))


def merge_spans(df: DataFrame, layout: KeyLayout, span: tuple[str, str], tie: Sequence[str] = ()) -> DataFrame:
    """Union of a key's intervals as disjoint (start, end) rows."""
    start, end = span
    keys = list(layout.keys)
    reach = ordered_scan(df, layout, [start, end, *tie], max_before={"_reach": end})
    opened = reach.withColumn(
        "_opens", (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("long")
    )
    numbered = ordered_scan(opened, layout, [start, end, *tie], upto={"_run": "_opens"})
    return numbered.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")
