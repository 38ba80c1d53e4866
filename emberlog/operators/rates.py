"""Rate rules: too many rows of one address within a time window.

A rule keeps the recent times of each address and forgets them when it fires, so
it is sequential per address; ``operators/reset_window`` takes it apart.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed
from emberlog.functions.scores import risk_score
from emberlog.functions.stamps import micros
from emberlog.operators.findings import as_findings, stamp_literal
from emberlog.operators.reset_window import BLOCK_LINES, held_after_files, reset_window

SECOND = 1_000_000


def _timed(entries: DataFrame, ingest_ts: datetime | str) -> DataFrame:
    return entries.withColumn("t", micros(F.coalesce(F.col("ts").cast("timestamp_ntz"), stamp_literal(ingest_ts))))


def _moment(t: Column) -> Column:
    return F.timestamp_micros(t).cast("timestamp_ntz")


def failed_logins(entries: DataFrame, *, ingest_ts: datetime | str) -> DataFrame:
    """The rows the sign-in rules look at, with their time in microseconds."""
    rows = entries.filter("log_type = 'AUTH' and status = 'FAILED' and source_ip is not null")
    return _timed(rows, ingest_ts)


def login_rule(entries: DataFrame, *, ingest_ts: datetime | str, attempts: int = 5, window_seconds: int = 300,
               order: str = "file", block_lines: int = BLOCK_LINES) -> DataFrame:
    """Fires and leftovers of failed sign-ins, for the two rules below."""
    return reset_window(failed_logins(entries, ingest_ts=ingest_ts), window_us=window_seconds * SECOND,
                        threshold=attempts, order=order, payload=["user", "raw_line"], block_lines=block_lines)


def detect_brute_force(entries: DataFrame, *, ingest_ts: datetime | str, attempts: int = 5, window_seconds: int = 300,
                       order: str = "file", block_lines: int = BLOCK_LINES, scanned: DataFrame | None = None) -> DataFrame:
    """``attempts`` failed sign-ins of one address within the window (inclusive).

    ``scanned`` takes a result of ``login_rule`` to share it between rules.
    """
    events = scanned if scanned is not None else login_rule(
        entries, ingest_ts=ingest_ts, attempts=attempts, window_seconds=window_seconds, order=order, block_lines=block_lines)
    return brute_force_findings(events.filter("kind = 'fire'"), ingest_ts=ingest_ts, window_seconds=window_seconds)


def brute_force_findings(fires: DataFrame, *, ingest_ts: datetime | str, window_seconds: int) -> DataFrame:
    """What the fires of the sign-in rule say."""
    kind = F.lit("BRUTE_FORCE")
    return as_findings(fires.select(
        "log_file", "line_number", "source_ip", kind.alias("type"), F.lit("HIGH").alias("severity"),
        F.col("user").alias("target"),
        F.format_string(fixed.BRUTE_FORCE_DETAIL, F.col("count"), F.lit(window_seconds)).alias("detail"),
        F.array("raw_line").alias("evidence"), _moment(F.col("t")).alias("event_ts"),
        risk_score(kind, F.col("count")).alias("score"), "count",
    ), "brute_force", ingest_ts=ingest_ts)


def detect_residual(entries: DataFrame, *, ingest_ts: datetime | str, at_least: int = 3, attempts: int = 5,
                    window_seconds: int = 300, order: str = "file", block_lines: int = BLOCK_LINES,
                    scanned: DataFrame | None = None, per_file: bool = False) -> DataFrame:
    """Addresses that still hold failed sign-ins when all lines have been read.

    ``per_file`` asks this at the end of every file of ``entries`` instead, in the order of their names: an address
    that holds rows is found again for each later file until its own rows change that.
    """
    if per_file:
        if order != "file":
            raise ValueError("files end in the order of their lines only")
        found = held_after_files(
            failed_logins(entries, ingest_ts=ingest_ts), entries.select("log_file"), window_us=window_seconds * SECOND,
            threshold=attempts, at_least=at_least, block_lines=block_lines)
    else:
        events = scanned if scanned is not None else login_rule(
            entries, ingest_ts=ingest_ts, attempts=attempts, window_seconds=window_seconds, order=order, block_lines=block_lines)
        found = events.filter((F.col("kind") == "held") & (F.col("count") >= at_least)).select("source_ip", "count")
    return as_findings(found.select(
        *[c for c in ("log_file",) if per_file], "source_ip", F.lit("SUSPICIOUS_ACCESS").alias("type"), F.lit("LOW").alias("severity"),
        F.format_string(fixed.RESIDUAL_DETAIL, F.col("count")).alias("detail"),
        F.lit(0.4).alias("score"), "count",
    ), "residual", ingest_ts=ingest_ts)


def web_requests(entries: DataFrame, *, ingest_ts: datetime | str) -> DataFrame:
    rows = entries.filter(F.col("log_type").isin("WEB_ACCESS", "WEB_ERROR") & F.col("source_ip").isNotNull())
    return _timed(rows, ingest_ts)


def detect_ddos(entries: DataFrame, *, ingest_ts: datetime | str, requests: int = 100, window_seconds: int = 60,
                order: str = "file", block_lines: int = BLOCK_LINES) -> DataFrame:
    """``requests`` web lines of one address within the window (inclusive)."""
    events = reset_window(web_requests(entries, ingest_ts=ingest_ts), window_us=window_seconds * SECOND,
                          threshold=requests, order=order, block_lines=block_lines)
    return ddos_findings(events.filter("kind = 'fire'"), ingest_ts=ingest_ts, window_seconds=window_seconds)


def ddos_findings(fires: DataFrame, *, ingest_ts: datetime | str, window_seconds: int) -> DataFrame:
    """What the fires of the request rule say."""
    return as_findings(fires.select(
        "log_file", "line_number", "source_ip", F.lit("DDOS").alias("type"), F.lit("CRITICAL").alias("severity"),
        F.format_string(fixed.DDOS_DETAIL, F.col("count"), F.lit(window_seconds)).alias("detail"),
        _moment(F.col("t")).alias("event_ts"),
        F.least(F.lit(1.0), F.col("count") / 200).alias("score"), "count",
    ), "ddos", ingest_ts=ingest_ts)


def api_requests(entries: DataFrame, *, ingest_ts: datetime | str, marks: list[str] | None = None) -> DataFrame:
    url = F.coalesce(F.nullif("url", F.lit("")), F.col("target"), F.lit(""))
    is_api = F.lit(False)
    for mark in marks or fixed.API_MARKS:
        is_api = is_api | F.contains(url, F.lit(mark))
    rows = entries.filter(is_api & F.col("source_ip").isNotNull() & (F.col("source_ip") != ""))
    return _timed(rows.withColumn("endpoint", url), ingest_ts)


def detect_api_abuse(entries: DataFrame, *, ingest_ts: datetime | str, requests: int = 50, window_seconds: int = 60,
                     marks: list[str] | None = None, order: str = "file", block_lines: int = BLOCK_LINES) -> DataFrame:
    """``requests`` API calls of one address, all newer than the window's start."""
    events = reset_window(api_requests(entries, ingest_ts=ingest_ts, marks=marks),
                          window_us=window_seconds * SECOND - 1, threshold=requests, order=order,
                          payload=["endpoint", "raw_line"], block_lines=block_lines)
    return api_findings(events.filter("kind = 'fire'"), ingest_ts=ingest_ts)


def api_findings(fires: DataFrame, *, ingest_ts: datetime | str) -> DataFrame:
    """What the fires of the API rule say."""
    return as_findings(fires.select(
        "log_file", "line_number", "source_ip", F.lit("API_ABUSE").alias("type"), F.lit("HIGH").alias("severity"),
        F.col("endpoint").alias("target"),
        F.format_string(fixed.API_ABUSE_DETAIL, F.col("count"), F.col("source_ip")).alias("detail"),
        F.array("raw_line").alias("evidence"), _moment(F.col("t")).alias("event_ts"),
        F.least(F.lit(1.0), F.col("count") / 100).alias("score"), "count",
        F.create_map(F.lit("requests_per_minute"), F.col("count").cast("string"),
                     F.lit("endpoint"), F.col("endpoint")).alias("extra"),
    ), "api_abuse", ingest_ts=ingest_ts)


def rate_sliding(rows: DataFrame, *, window_us: int) -> DataFrame:
    """Rows of an address within the window before each of its times, no reset.

    ``rows`` has ``source_ip`` and ``t``. Rows of one time are counted first, map
    side. Each count is then put into its own window-wide time bucket and, as
    history, into the next one, so that a window function sees two buckets of one
    address at most, never all of it.
    """
    width = window_us + 1
    counted = rows.groupBy("source_ip", "t").agg(F.count(F.lit(1)).alias("at_time"))
    bucket = F.floor(F.col("t") / width)
    spread = counted.select("*", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    recent = W.partitionBy("source_ip", "bucket").orderBy("t").rangeBetween(-window_us, 0)
    return (spread.withColumn("in_window", F.sum("at_time").over(recent))
            .filter(F.col("bucket") == F.floor(F.col("t") / width))
            .select("source_ip", "t", "at_time", "in_window"))


def ip_stats(findings: DataFrame) -> DataFrame:
    """Per address: first and last time, number of findings, risk.

    The first finding starts the risk at 0.2 whatever it is; each further one adds
    the step of its severity; the sum stops at 1. Everything is a plain
    aggregate, so that partial sums travel, not rows.
    """
    from emberlog.functions.scores import risk_step, type_rank
    step = risk_step(F.col("severity"))
    seq = F.struct("log_file", "line_number", type_rank(F.col("type")), "id")
    raised = F.struct(F.col("log_file").isNull().alias("late"), seq.alias("seq"))
    total = F.lit(fixed.FIRST_RISK_STEP) + F.sum(step) - F.min_by(step, raised)
    return findings.filter("source_ip is not null").groupBy("source_ip").agg(
        F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"),
        F.count(F.lit(1)).alias("anomaly_count"),
        F.least(F.lit(1.0), total / 100).alias("risk_score"))
