"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # the JVM interprets methods over 8000 bytes of bytecode; above that, let Spark use its split projections
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    # no call-site capture around every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Small local tables: keep all cores busy although partitions are far below the usual sizes.
LOCAL_SETTINGS = {
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows before costly work per row when the input has fewer partitions than there are cores.

    That happens with a few files of one row group. Larger inputs pass unchanged, without a shuffle. `df` must be
    a scan with projections, so that asking for its partitions runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sunloom")
    for key, value in {**SETTINGS, **LOCAL_SETTINGS}.items():
        builder = builder.config(key, value)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return (builder.config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.driver.memory", memory).getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as `spark.checkpoint.dir` names it; only a local run may fall back to its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    # local-cluster has executors of its own
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), "sunloom-shared")
