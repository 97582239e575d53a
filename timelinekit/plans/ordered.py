"""Neighbour values, running totals and carried values over keyed, ordered rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.plans.layout import CHUNK, KeyLayout

Spec = Mapping[str, Column | str]


def _expr(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ordered_scan(
    df: DataFrame,
    layout: KeyLayout,
    order: Sequence[str],
    *,
    prev: Spec | None = None,
    nxt: Spec | None = None,
    before: Spec | None = None,
    upto: Spec | None = None,
    max_before: Spec | None = None,
    last: Spec | None = None,
    coming: Spec | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add ordered columns per key; ``order`` must be total and start with ``layout.order``.

    * ``prev`` / ``nxt``  - value of the neighbouring row
    * ``before`` / ``upto`` - running sum without / with the row itself (0 when empty)
    * ``max_before`` - running maximum over strictly earlier rows
    * ``last`` / ``coming`` - nearest non-null value at or before / at or after the row
    * ``number`` - row number from 1

    One shuffle in either case. With hot keys the rows are partitioned by (key, chunk), and
    what crosses a chunk border comes from a table with one row per chunk, joined on the
    partitioning that is already there.
    """
    if order[0] != layout.order:
        raise ValueError(f"order must start with {layout.order!r}")
    upto = dict(upto or {})
    if number is not None:
        upto[number] = F.lit(1).cast("long")
    groups = {
        "prev": dict(prev or {}), "nxt": dict(nxt or {}), "before": dict(before or {}), "upto": upto,
        "max_before": dict(max_before or {}), "last": dict(last or {}), "coming": dict(coming or {}),
    }
    flat = [(kind, out, f"_x{i}") for i, (kind, out) in enumerate((k, o) for k, s in groups.items() for o in s)]
    rows = df.select("*", *[_expr(groups[kind][out]).alias(x) for kind, out, x in flat])
    temporaries = [x for _, _, x in flat]
    keys = list(layout.keys)

    def local(part: list[str], kind: str, x: str) -> Column:
        forward = Window.partitionBy(*part).orderBy(*order)
        upto_row = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = forward.rowsBetween(Window.unboundedPreceding, -1)
        backward = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order])
        if kind == "prev":
            return F.lag(x).over(forward)
        if kind == "nxt":
            return F.lead(x).over(forward)
        if kind == "before":
            return F.coalesce(F.sum(x).over(earlier), F.lit(0))
        if kind == "upto":
            return F.coalesce(F.sum(x).over(upto_row), F.lit(0))
        if kind == "max_before":
            return F.max(x).over(earlier)
        if kind == "last":
            return F.last(x, ignorenulls=True).over(upto_row)
        return F.last(x, ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    if not layout.split:
        out = rows.select("*", *[local(keys, kind, x).alias(out) for kind, out, x in flat])
        return out.drop(*temporaries)

    rows = layout.tag(rows)
    part = keys + [CHUNK]
    forward = Window.partitionBy(*part).orderBy(*order)
    scanned = rows.select(
        "*",
        *[local(part, kind, x).alias(out) for kind, out, x in flat],
        F.lag(F.lit(1)).over(forward).isNull().alias("_first"),
        F.lead(F.lit(1)).over(forward).isNull().alias("_last"),
    )

    at = F.struct(*order)
    hot_rows_only = rows.join(F.broadcast(layout.hot.select(*keys)), keys, "left_semi")
    summary_columns = []
    for kind, _, x in flat:
        known = F.when(F.col(x).isNotNull(), at)
        summary_columns.append({
            "prev": lambda: F.max_by(F.struct(x), at),
            "nxt": lambda: F.min_by(F.struct(x), at),
            "before": lambda: F.sum(x),
            "upto": lambda: F.sum(x),
            "max_before": lambda: F.max(x),
            "last": lambda: F.max_by(x, known),
            "coming": lambda: F.min_by(x, known),
        }[kind]().alias(f"_s{x}"))
    summary = hot_rows_only.groupBy(*part).agg(*(summary_columns or [F.count(F.lit(1)).alias("_rows")]))
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    chunks_before = across.rowsBetween(Window.unboundedPreceding, -1)
    chunks_after = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for kind, _, x in flat:
        s = f"_s{x}"
        carried.append({
            "prev": lambda: F.lag(s).over(across),
            "nxt": lambda: F.lead(s).over(across),
            "before": lambda: F.sum(s).over(chunks_before),
            "upto": lambda: F.sum(s).over(chunks_before),
            "max_before": lambda: F.max(s).over(chunks_before),
            "last": lambda: F.last(s, ignorenulls=True).over(chunks_before),
            "coming": lambda: F.last(s, ignorenulls=True).over(chunks_after),
        }[kind]().alias(f"_c{x}"))
    carry = summary.select(*part, *carried)
    joined = scanned.join(carry, part, "left")

    def combined(kind: str, out: str, x: str) -> Column:
        c = F.col(f"_c{x}")
        if kind == "prev":
            return F.when(F.col("_first"), c[x]).otherwise(F.col(out))
        if kind == "nxt":
            return F.when(F.col("_last"), c[x]).otherwise(F.col(out))
        if kind in ("before", "upto"):
            return F.col(out) + F.coalesce(c, F.lit(0))
        if kind == "max_before":
            return F.greatest(F.col(out), c)
        return F.coalesce(F.col(out), c)

    names = [c for c in rows.columns if c not in temporaries]
    return joined.select(*names, *[combined(kind, out, x).alias(out) for kind, out, x in flat])


def islands(
    df: DataFrame,
    layout: KeyLayout,
    order: Sequence[str],
    starts: Column,
    *,
    prev: Spec | None = None,
    out: str = "island",
) -> DataFrame:
    """Number maximal runs: a row opens a run when ``starts`` holds.

    ``starts`` may use the ``prev`` columns; the first row of a key always opens a run.
    """
    prev = dict(prev or {})
    seen = ordered_scan(df, layout, order, prev={**prev, "_seen": F.lit(True)})
    flag = (F.col("_seen").isNull() | F.coalesce(starts, F.lit(False))).cast("long")
    return ordered_scan(seen.withColumn("_opens", flag), layout, order, upto={out: "_opens"}).drop(
        "_opens", "_seen"
    )
