"""Session settings the library reads, and the folder that cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

HOT_ROWS_KEY = "timelinekit.hot.rows"
DEFAULT_HOT_ROWS = 4_000_000


def build_session(app: str = "timelinekit", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one that is there."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def hot_rows(spark: SparkSession) -> int:
    """Rows one key may hold before its ordered work is cut into chunks."""
    return int(spark.conf.get(HOT_ROWS_KEY, str(DEFAULT_HOT_ROWS)))


def shared_root(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir``.

    Only a plain local session (tests, benchmarks) may run without the setting and then gets a
    local folder; on a cluster a machine-local folder would lose data, so that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="timelinekit-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an iteration's state once as a table in the shared folder and go on from there.

    Unlike an eager checkpoint, which computes its input once to count it and once to write it,
    this runs one job, and the table's size is known to the planner.
    """
    path = f"{shared_root(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
