"""What the operators share: tables, saved intermediates, raw files, batches, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelinekit.session import shared_root

# Rows of one Arrow batch; texts may hold a megabyte, so batches stay small.
BATCH_ROWS = 256
BATCH_BYTES = "32m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_root(spark)}/llm-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write the rows once as a table in the shared folder and go on from there.

    Lineage ends at files that survive the loss of any executor.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_raw(df: DataFrame, column: str, path: str, separator: str) -> None:
    """Write a binary column as plain files, one per partition, each value followed by ``separator``.

    Spark's own text sink and commit protocol do the work, so a lost executor or a repeated
    task leaves no partial or double file on any store Spark can write to.
    """
    df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", separator).text(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): whole files, one row each."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task under ``name``, made at the first call."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def make_room(name: str | None) -> None:
    """Let go of all that is kept under other names: workers go on from one operator to the next,
    and a pipeline's stages would otherwise add up their tables."""
    if _kept.keys() - {name}:
        for other in _kept.keys() - {name}:
            del _kept[other]
        gc.collect()


def give_back() -> None:
    """Return unused memory of Arrow and of the C library to the machine, which counts it as the executor's."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def map_batches(
    df: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: str, keeps: str | None = None
) -> DataFrame:
    """``mapInArrow`` on column lists: ``work`` receives and yields dicts of columns.

    ``keeps`` names what ``work`` keeps in its worker (see ``kept``); the rest goes.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def columns():
            for b in batches:
                yield {n: b.column(i) for i, n in enumerate(b.schema.names)}

        make_room(keeps)
        for out in work(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def learned_from(remainders: tuple[int, ...], modulus: int) -> Column:
    """Whether crc32 of doc_id as text has one of the remainders; a null id is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)).isin(*remainders), F.lit(False))


def hold_out(remainder: int, modulus: int) -> Column:
    """crc32 of doc_id as text modulo ``modulus`` equals ``remainder``; false for a null id."""
    return learned_from((remainder,), modulus)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Each round takes the smallest label among neighbours and then that label's own label, so
    rounds grow with the logarithm of the longest chain. Minima are partial aggregates; the
    joins read saved tables, whose skewed partitions adaptive execution splits.
    """
    both = saved(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(),
        f"{label}-edges",
    )
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), f"{label}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        mid = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("component").alias("up"))
        moved = saved(mid.join(up, "mid", "left").select("node", "old", F.least("mid", "up").alias("component")), f"{label}-labels")
        labels = moved.select("node", "component")
        if moved.filter("component <> old").isEmpty():
            return labels
