"""How the rows of one key are spread over tasks.

A window over ``partitionBy(key)`` puts every row of a key into one task, which stops
working once a single media item, user or source holds a large share of the table.
``KeyLayout`` measures the keys once (a partial aggregate over the key column only). When
no key is larger than the limit, ordered work uses ordinary windows. Otherwise the large
keys, and only they, are cut along the order column at values of a random sample, each key
into as many chunks as its own row count asks for, so that a task receives about ``limit``
rows. Rows of a key that are equal in the order column stay together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelinekit.session import hot_rows

CHUNK = "_chunk"
_BOUNDS = "_chunk_bounds"
# Rows drawn per chunk: a chunk holds its share to within about a fifth.
SAMPLE_PER_CHUNK = 20


def _blocks(cuts: Column, width: Column) -> Column:
    """Sorted cuts in blocks of about the square root of their number."""
    starts = F.sequence(F.lit(0), F.size(cuts) - 1, width)
    return F.transform(starts, lambda i: F.slice(cuts, i + 1, width))


def _cuts_upto(blocks: Column, at: Column) -> Column:
    """How many cuts are not above ``at``: the block first, then the place in it."""
    full = F.size(F.filter(blocks, lambda b: b[0] <= at))
    inside = F.size(F.filter(F.element_at(blocks, full), lambda b: b <= at))
    return F.when(full == 0, F.lit(0)).otherwise((full - 1) * F.size(blocks[0]) + inside)


@dataclass(frozen=True)
class KeyLayout:
    keys: tuple[str, ...]
    order: str
    hot: DataFrame | None = None

    @staticmethod
    def measure(df: DataFrame, keys: Sequence[str], order: str, limit: int | None = None) -> "KeyLayout":
        """Find keys above ``limit`` rows and the values that cut them, of the column's own type.

        The driver only receives hot keys and their cuts; both are fewer than rows / limit.
        """
        spark = df.sparkSession
        limit = hot_rows(spark) if limit is None else limit
        keys = tuple(keys)
        large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit).collect()
        if not large:
            return KeyLayout(keys, order)
        sizes = spark.createDataFrame(
            [(*(r[k] for k in keys), -(-r["_rows"] // limit)) for r in large],
            df.select(*keys, F.lit(0).cast("long").alias("_chunks")).schema,
        )
        drawn = (
            df.select(*keys, F.col(order).alias("_o"), F.rand(7).alias("_r"))
            .filter(F.col("_o").isNotNull())
            .join(F.broadcast(sizes), list(keys))
            .groupBy(*keys, "_chunks", F.floor(F.col("_r") * F.col("_chunks") * SAMPLE_PER_CHUNK).alias("_draw"))
            .agg(F.max_by("_o", "_r").alias("_o"))
        )
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))
        cuts = (
            drawn.withColumn("_place", place - 1)
            .filter((F.col("_place") > 0) & (F.col("_place") % SAMPLE_PER_CHUNK == 0))
            .groupBy(*keys).agg(F.array_sort(F.collect_set("_o")).alias("_cuts"), F.ceil(F.sqrt(F.count_distinct("_o"))).cast("int").alias("_w"))
            .select(*keys, _blocks(F.col("_cuts"), F.col("_w")).alias(_BOUNDS))
        )
        bounds = spark.createDataFrame(cuts.collect(), cuts.schema)
        return KeyLayout(keys, order, bounds)

    @property
    def split(self) -> bool:
        return self.hot is not None

    def tag(self, df: DataFrame) -> DataFrame:
        """Add the chunk number; rows of ordinary keys are all in chunk 0."""
        if CHUNK in df.columns:
            return df
        if self.hot is None:
            return df.withColumn(CHUNK, F.lit(0))
        number = _cuts_upto(F.col(_BOUNDS), F.col(self.order))
        return (
            df.join(F.broadcast(self.hot), list(self.keys), "left")
            .withColumn(CHUNK, F.when(F.col(_BOUNDS).isNull(), F.lit(0)).otherwise(number))
            .drop(_BOUNDS)
        )

    def join_per_key(self, df: DataFrame, per_key: DataFrame, how: str = "inner") -> DataFrame:
        """Join a table with one row per key without sending a hot key to one task."""
        keys = list(self.keys)
        if self.hot is None:
            return df.join(per_key, keys, how)
        hot = self.hot.select(*keys)
        few = per_key.join(F.broadcast(hot), keys, "left_semi")
        big = df.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(few), keys, how)
        rest = df.join(F.broadcast(hot), keys, "left_anti").join(per_key, keys, how)
        return big.unionByName(rest)


def lookup_join(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join against a table that is unique on ``keys``.

    A plain equi-join: no job runs while the plan is built, and where a key is hot adaptive
    execution splits its partition, since the other side has one row per key.
    """
    return df.join(per_key, list(keys), how)
