"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sparkevidence", master: str | None = None, **conf: str) -> SparkSession:
    """Build or reuse a session; cluster settings (master, memory) come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.cteRecursionLevelLimit": "1000",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; only a local session falls back to a temp folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return spark.sparkContext.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a written table when the driver ends; a session that has ended before keeps it."""
    if spark.sparkContext._jsc is not None:
        home = spark._jvm.org.apache.hadoop.fs.Path(path)
        home.getFileSystem(spark._jsc.hadoopConfiguration()).delete(home, True)


def unique_name(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later stages survive executor loss."""
    spark = df.sparkSession
    path = unique_name(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a scan gives fewer partitions than the cluster has slots.

    Large inputs already have more splits than slots and are left as they are (no shuffle).
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
