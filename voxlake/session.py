"""Session for local runs, tests and the benchmark. Cluster jobs bring their own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "voxlake", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("VOXLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_ready(spark: SparkSession) -> None:
    """Make `DataFrame.checkpoint()` usable.

    A cluster names a shared folder in `spark.checkpoint.dir`. Where that is unset, a local session (tests) uses a
    temporary folder and a cluster session is refused, because other machines could not read it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one that checkpoints go to."""
    checkpoint_ready(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint, so that lost executors cost a re-read only."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few large input files over all cores before expensive per-row work; leaves well split input alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
