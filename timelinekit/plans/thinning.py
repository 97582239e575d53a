"""Greedy thinning: keep a row when it lies more than ``gap`` after the last *kept* row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelinekit.plans.layout import KeyLayout
from timelinekit.plans.ordered import ordered_scan
from timelinekit.session import cut_lineage, hot_rows

MICROS = 1_000_000


def thin(
    df: DataFrame, layout: KeyLayout, order: Sequence[str], gap: float, at_least: bool = False
) -> DataFrame:
    """Rows that survive thinning, with times compared at microsecond resolution.

    ``at_least`` keeps a row at exactly ``gap`` as well. A row further than ``gap`` from its
    neighbour is kept whatever came before, so the rows fall into clusters that do not
    influence each other; the sequential rule runs per cluster, streamed in Arrow batches.
    Clusters larger than the hot-row limit (dense data of a hot key) are resolved by
    pointer doubling joins instead.
    """
    keys = list(layout.keys)
    step = int(round(gap * MICROS)) - (1 if at_least else 0)
    timed = df.withColumn("_t", F.round(F.col(order[0]).cast("double") * MICROS).cast("long"))
    neighbours = ordered_scan(timed, layout, order, prev={"_p": "_t"})
    opens = F.col("_p").isNull() | (F.col("_t") - F.col("_p") > step)
    clusters = ordered_scan(
        neighbours.withColumn("_opens", opens.cast("long")), layout, order, upto={"_cluster": "_opens"}
    ).drop("_p", "_opens")
    if not layout.split:
        return _fold(clusters, keys, order, step).drop("_t", "_cluster")
    limit = hot_rows(df.sparkSession)
    clusters = cut_lineage(clusters)
    sizes = clusters.groupBy(*keys, "_cluster").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    dense = sizes.drop("_rows").cache()
    if dense.isEmpty():
        dense.unpersist()
        return _fold(clusters, keys, order, step).drop("_t", "_cluster")
    by = keys + ["_cluster"]
    small = clusters.join(F.broadcast(dense), by, "left_anti")
    large = clusters.join(F.broadcast(dense), by, "left_semi")
    kept = _fold(small, keys, order, step).unionByName(_double(large, keys, order, step))
    return kept.drop("_t", "_cluster")


def _fold(df: DataFrame, keys: list[str], order: Sequence[str], step: int) -> DataFrame:
    """The sequential rule over rows sorted by cluster; state is one number."""
    by = keys + ["_cluster"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_group, last_kept = None, None
        for batch in batches:
            if batch.empty:
                continue
            times = batch["_t"].to_numpy()
            groups = batch[by]
            changed = (groups.ne(groups.shift())).any(axis=1).to_numpy()
            changed[0] = last_group is None or tuple(groups.iloc[0]) != last_group
            keep = np.zeros(len(batch), dtype=bool)
            for i in range(len(batch)):
                if changed[i] or times[i] - last_kept > step:
                    keep[i] = True
                    last_kept = times[i]
            last_group = tuple(groups.iloc[-1])
            yield batch[keep]

    spread = df.repartition(*by).sortWithinPartitions(*by, *order)
    return spread.mapInPandas(run, schema=df.schema)


def _double(df: DataFrame, keys: list[str], order: Sequence[str], step: int) -> DataFrame:
    """Reachability from the first row along "next row more than ``step`` later" pointers."""
    by = keys + ["_cluster"]
    instants = df.select(*by, "_t").distinct()
    probes = instants.select(*by, (F.col("_t") + step + 1).alias("_x"), F.col("_t").alias("_asks"))
    targets = instants.select(*by, F.col("_t").alias("_x"), F.lit(None).cast("long").alias("_asks"))
    both = probes.unionByName(targets)
    layout = KeyLayout.measure(both, by, "_x")
    found = ordered_scan(
        both.withColumn("_rank", F.when(F.col("_asks").isNull(), F.lit(1)).otherwise(F.lit(0))),
        layout, ["_x", "_rank"],
        coming={"_to": F.when(F.col("_asks").isNull(), F.col("_x"))},
    )
    jump = cut_lineage(
        found.filter(F.col("_asks").isNotNull() & F.col("_to").isNotNull()).select(*by, F.col("_asks").alias("_t"), "_to")
    )
    reached = instants.groupBy(*by).agg(F.min("_t").alias("_t"))
    while True:
        grown = cut_lineage(
            reached.unionByName(reached.join(jump, by + ["_t"]).select(*by, F.col("_to").alias("_t"))).distinct()
        )
        further = jump.alias("a").join(
            jump.select(*by, F.col("_t").alias("_to"), F.col("_to").alias("_next")), by + ["_to"]
        ).select(*by, "_t", F.col("_next").alias("_to"))
        jump = cut_lineage(further)
        reached = grown
        if jump.isEmpty():
            break
    # Several rows may share an instant: the first in order is the one that is kept.
    first = df.join(reached, by + ["_t"], "left_semi").groupBy(*by, "_t").agg(
        F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    )
    return first.select("_row.*")


