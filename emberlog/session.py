"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "emberlog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # the parsers make thousands of column calls; tracing each call site costs more
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the zone: log stamps carry none, so every reader must agree on one."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


#: Bytes of code up to which the JVM compiles a method; a longer one is interpreted for good.
METHOD_BYTES = 8000


def compiled_methods(spark: SparkSession) -> SparkSession:
    """Let no stage run as one generated method that the JVM will not compile: the parse of a line is four times too long."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_BYTES)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder reliable checkpoints go to; shared storage on a cluster.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may do
    without: there a temporary folder is made, since every task sees it.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_KEY} is not set; on {master} it must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="emberlog-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir() or named


_scratch: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder for written intermediates, on the same shared storage."""
    path = os.path.join(checkpoint_root(spark), f"{label}-{uuid.uuid4().hex}")
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediates that this application has written; results that still read them must be done.

    Gives how many folders were there to delete.
    """
    conf, dropped = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for folder in _scratch.pop(spark.sparkContext.applicationId, []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        dropped += path.getFileSystem(conf).delete(path, True)
    return dropped


#: Rows of a parsed table that one task takes at most; parsing costs some 0.1 ms a row.
TASK_ROWS = 1 << 16


def spread(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Deal rows over at least as many tasks as there are cores, and few enough rows to each.

    Parsing costs far more than moving the rows. The number of file pieces says little: all rows of a Parquet row group
    come in one of them, however large, and the others are empty. So the rows of each piece are counted, which reads file
    footers only, and an input whose pieces are many and small enough is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("piece")).agg(F.count(F.lit(1)).alias("n"))
    pieces, most, rows = held.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    if pieces >= cores and most <= task_rows:
        return df
    return df.repartition(max(cores, math.ceil((rows or 0) / task_rows)))
