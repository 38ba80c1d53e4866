"""Alerts, sessions and other small stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed
from emberlog.operators.findings import stamp_literal
from emberlog.schema import ALERT_ACTIONS, ALERTS, SESSIONS, conform


def make_alerts(findings: DataFrame) -> DataFrame:
    """An alert for every HIGH or CRITICAL finding."""
    rows = findings.filter(F.col("severity").isin("HIGH", "CRITICAL"))
    return rows.select(
        F.xxhash64(F.col("id"), F.lit("alert")).alias("alert_id"), F.col("id").alias("anomaly_id"),
        F.col("type").alias("alert_type"), "severity",
        F.format_string(fixed.ALERT_TITLE, "type").alias("title"), F.col("detail").alias("message"),
        F.col("detected_ts").alias("created_at"))


def _act(alert_ids: DataFrame, action: str, at: datetime | str) -> DataFrame:
    return conform(alert_ids.select("alert_id", F.lit(action).alias("action"), stamp_literal(at).alias("acted_at")),
                   ALERT_ACTIONS)


def mark_read(alert_ids: DataFrame, *, at: datetime | str) -> DataFrame:
    """Rows to append to the actions table."""
    return _act(alert_ids, "read", at)


def dismiss(alert_ids: DataFrame, *, at: datetime | str) -> DataFrame:
    return _act(alert_ids, "dismissed", at)


def alert_state(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts with ``is_read`` and ``is_dismissed``."""
    done = actions.groupBy("alert_id").agg(
        F.max(F.col("action") == "read").alias("is_read"), F.max(F.col("action") == "dismissed").alias("is_dismissed"))
    joined = alerts.join(done, "alert_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_read", "is_dismissed")})


def unread_alerts(alerts: DataFrame, findings: DataFrame, actions: DataFrame | None = None, *,
                  limit: int = 50) -> DataFrame:
    """Newest alerts neither read nor dismissed, with their finding where it exists.

    The list is cut to ``limit`` before the join, so that at most that many rows
    look for their finding.
    """
    if actions is not None:
        alerts = alerts.join(actions.select("alert_id").distinct(), "alert_id", "left_anti")
    newest = alerts.orderBy(F.desc("created_at"), "alert_id").limit(limit)
    wanted = F.broadcast(newest.select(F.col("anomaly_id").alias("id")).distinct())
    found = findings.select("id", F.col("type").alias("anomaly_type"), "source_ip").join(wanted, "id", "left_semi")
    return (newest.join(found, newest["anomaly_id"] == found["id"], "left").drop("id")
            .orderBy(F.desc("created_at"), "alert_id"))


def session_row(entries: DataFrame, findings: DataFrame, *, session_id: str, start: datetime | str,
                end: datetime | str | None = None, status: str = "COMPLETED", notes: str | None = None) -> DataFrame:
    """The summary row of one run over one or many files."""
    read = entries.agg(F.count_distinct("log_file").alias("files_analyzed"), F.count(F.lit(1)).alias("total_lines"))
    found = findings.agg(F.count(F.lit(1)).alias("anomalies_found"))
    keyed = lambda df: df.withColumn("session_id", F.lit(session_id))
    return conform(keyed(read).join(keyed(found), "session_id").select(
        "*", stamp_literal(start).alias("start_time"),
        (stamp_literal(end) if end else F.lit(None).cast("timestamp_ntz")).alias("end_time"),
        F.lit(status).alias("status"), F.lit(notes).alias("notes")), SESSIONS)


def start_session(spark, *, session_id: str, start: datetime | str) -> DataFrame:
    return conform(spark.range(1).select(
        F.lit(session_id).alias("session_id"), stamp_literal(start).alias("start_time"),
        F.lit("RUNNING").alias("status")), SESSIONS)


def read_sessions(sessions: DataFrame, limit: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc("start_time"), "session_id").limit(limit)


def recent_inputs(inputs: DataFrame, limit: int = 20) -> DataFrame:
    """Latest load of each path, newest first. ``inputs``: path, name, size, loaded_at."""
    latest = inputs.groupBy("path").agg(
        F.max_by(F.struct("name", "size"), F.struct("loaded_at", "name", "size")).alias("last"),
        F.max("loaded_at").alias("loaded_at"))
    return latest.select("path", "last.name", "last.size", "loaded_at").orderBy(F.desc("loaded_at"), "path").limit(limit)
