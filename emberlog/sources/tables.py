"""Stored tables whose rows are replaced, removed and added up.

A table is a folder of Parquet files with one folder per key. Rows are replaced a key at a time: Spark writes the new
rows beside the table and puts them in place when all are written, so a run that fails leaves the old rows. What is
removed is renamed out of the table first, which takes effect at once, and deleted then.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions import fixed_values as fixed
from emberlog.functions.scores import risk_step, type_rank
from emberlog.operators.findings import stamp_literal
from emberlog.schema import FINDINGS, SESSIONS, conform

NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def replace_keys(rows: DataFrame, path: str, *keys: str) -> None:
    """Put ``rows`` in place of the stored rows of the same keys; other keys stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, files = _folder(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def remove_key(spark: SparkSession, path: str, key: str, value: str | None = None) -> int:
    """Take all rows of a key out of a table that has ``key`` as its first folder; without ``value`` those of every key.

    Gives how many folders went.
    """
    wanted = NO_KEY if value is None else value
    gone = [n for n in _names(spark, path) if n.startswith(f"{key}=") and (value is None or unquote(n.split("=", 1)[1]) == wanted)]
    where, files = _folder(spark, path)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    away = make(os.path.join(path, f"_removed-{uuid.uuid4().hex}"))  # readers pass over names that begin so
    if gone:
        files.mkdirs(away)
    for name in gone:
        if not files.rename(make(where, name), make(away, name)):
            raise OSError(f"{name} of {path} can't be moved")
    if gone:
        files.delete(away, True)
    return len(gone)


# --- sessions ----------------------------------------------------------------------

def write_sessions(sessions: DataFrame, path: str) -> None:
    """Store sessions; a session that is there already is replaced."""
    replace_keys(conform(sessions, SESSIONS).repartition("session_id"), path, "session_id")


def stored_sessions(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.schema(SESSIONS).parquet(path), SESSIONS) if _names(spark, path) else spark.createDataFrame([], SESSIONS)


def end_session(spark: SparkSession, path: str, session_id: str, *, end: str, total_lines: int = 0, anomalies_found: int = 0, files_analyzed: int | None = None,
                status: str = "COMPLETED") -> None:
    """Close a stored session: its end, its totals, its status. A session that is not stored stays unknown."""
    own = stored_sessions(spark, path).filter(F.col("session_id") == session_id)
    new = {"end_time": stamp_literal(end), "total_lines": F.lit(total_lines).cast("bigint"), "anomalies_found": F.lit(anomalies_found).cast("bigint"), "status": F.lit(status)}
    if files_analyzed is not None:
        new["files_analyzed"] = F.lit(files_analyzed).cast("bigint")
    replace_keys(conform(own.withColumns(new), SESSIONS), path, "session_id")


# --- findings of sessions ----------------------------------------------------------

def write_session_findings(findings: DataFrame, path: str) -> None:
    """Store findings by session and day of the event. The sessions they belong to are replaced, all days of them."""
    spark = findings.sparkSession
    dated = conform(findings, FINDINGS).withColumn("event_date", F.col("event_ts").cast("date"))
    ready = os.path.join(path, f"_new-{uuid.uuid4().hex}")
    dated.repartition("session_id", "event_date").write.partitionBy("session_id", "event_date").parquet(ready)
    where, files = _folder(spark, path)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in [n for n in _names(spark, ready) if n.startswith("session_id=")]:
        old = make(where, name)
        if files.exists(old):
            files.rename(old, make(ready, f"_old-{name}"))
        if not files.rename(make(make(ready), name), old):
            raise OSError(f"{name} of {path} can't be put in place")
    files.delete(make(ready), True)


def stored_findings(spark: SparkSession, path: str) -> DataFrame:
    """All stored findings, with their day in ``event_date``."""
    schema = T.StructType([*FINDINGS.fields, T.StructField("event_date", T.DateType())])
    if not any(n.startswith("session_id=") for n in _names(spark, path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def clear_findings(spark: SparkSession, path: str, session_id: str | None = None, *, with_all: list[str] | None = None) -> int:
    """Remove the stored findings of a session, or all of them; then also all rows of the tables ``with_all`` (timeline, alerts,
    correlations). Gives how many findings went."""
    rows = stored_findings(spark, path)
    n = (rows if session_id is None else rows.filter(F.col("session_id") == session_id)).count()
    remove_key(spark, path, "session_id", session_id)
    if session_id is None:
        for table in with_all or []:
            where, files = _folder(spark, table)
            files.delete(where, True)
    return n


# --- totals of addresses -----------------------------------------------------------

IP_STATE = "source_ip string, first_seen timestamp_ntz, last_seen timestamp_ntz, anomaly_count bigint, steps bigint, first_step bigint, first_batch bigint"


def ip_state(findings: DataFrame, batch: int) -> DataFrame:
    """Findings of a batch as rows of ``IP_STATE``, which add up: the step of an address's very first finding is kept apart,
    since that one starts its risk at a fixed value."""
    step = risk_step(F.col("severity")).cast("bigint")
    order = F.struct(F.col("log_file").isNull().alias("late"), F.struct("log_file", "line_number", type_rank(F.col("type")).alias("rank"), "id").alias("seq"))
    return findings.filter("source_ip IS NOT NULL").groupBy("source_ip").agg(
        F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"), F.count(F.lit(1)).alias("anomaly_count"), F.sum(step).alias("steps"),
        F.min_by(step, order).alias("first_step"), F.lit(batch).cast("bigint").alias("first_batch"))


def add_up(states: DataFrame) -> DataFrame:
    """One row of ``IP_STATE`` for each address."""
    return states.groupBy("source_ip").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("anomaly_count").alias("anomaly_count"), F.sum("steps").alias("steps"),
        F.min_by("first_step", "first_batch").alias("first_step"), F.min("first_batch").alias("first_batch"))


def add_ip_batch(findings: DataFrame, path: str, batch: int) -> None:
    """Store the totals of a batch. A batch that comes again replaces itself, so a replay counts once."""
    ip_state(findings, batch).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch}"))


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the folders of a kind that were written to their end."""
    found = [int(n.split("=", 1)[1]) for n in _names(spark, path) if n.startswith(f"{kind}=")]
    return sorted(n for n in found if "_SUCCESS" in _names(spark, os.path.join(path, f"{kind}={n}")))


def _ip_states(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest sum of batches and the batches after it."""
    bases = [n for n in _numbers(spark, path, "upto") if upto is None or n <= upto]
    base = bases[-1] if bases else -1
    parts = [f"upto={base}"] if bases else []
    parts += [f"batch={n}" for n in _numbers(spark, path, "batch") if n > base and (upto is None or n <= upto)]
    if not parts:
        return spark.createDataFrame([], IP_STATE)
    return spark.read.schema(IP_STATE).parquet(*[os.path.join(path, p) for p in parts])


def stored_ip_stats(spark: SparkSession, path: str) -> DataFrame:
    """The totals of all stored batches, as ``rates.ip_stats`` gives them over all findings."""
    whole = add_up(_ip_states(spark, path))
    risk = (F.lit(fixed.FIRST_RISK_STEP) + F.col("steps") - F.col("first_step")) / 100
    return whole.select("source_ip", "first_seen", "last_seen", "anomaly_count", F.least(F.lit(1.0), risk).alias("risk_score"))


def sum_up_ip_batches(spark: SparkSession, path: str, upto: int) -> None:
    """Write the sum of the batches up to a number, so that readers have one table less per batch. Readers take it once it is whole."""
    add_up(_ip_states(spark, path, upto)).write.mode("overwrite").parquet(os.path.join(path, f"upto={upto}"))
