"""Rules that look at one line at a time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed
from emberlog.functions.literals import any_found_in, case_blind, found_in
from emberlog.functions.regex import drop_nulls, filled
from emberlog.functions.scores import risk_score, severity_of
from emberlog.functions.staging import once
from emberlog.operators.findings import as_findings


def signature_types(lowered: str, *, strict: bool = False) -> Column:
    """Attack categories whose signature a column from ``case_blind`` holds, each once."""
    tests = []
    for category, patterns in fixed.SIGNATURES.items():
        kept = [p for p in patterns if not (strict and p in fixed.NOISY_PATTERNS)]
        tests.append(F.when(any_found_in(lowered, kept), F.lit(category)))
    return drop_nulls(F.array(*tests))


def with_line_hits(entries: DataFrame, *, strict: bool = False) -> DataFrame:
    """Adds ``line_hit``: whether ``detect_signatures`` or ``detect_unauthorized`` finds something on the line."""
    text = F.concat_ws(" ", "raw_line", filled(F.col("url")))
    refused = F.col("log_type").isin("WEB_ACCESS", "WEB_ERROR") & F.col("status").isin("401", "403")
    lowered = once(entries, _low=case_blind(text))
    return lowered.withColumn("line_hit", F.coalesce(refused, F.lit(False)) | (F.size(signature_types("_low", strict=strict)) > 0)).drop("_low")


def detect_signatures(entries: DataFrame, *, ingest_ts: datetime | str, strict: bool = False) -> DataFrame:
    """One finding per category and line. One pass, no shuffle."""
    text = F.concat_ws(" ", "raw_line", filled(F.col("url")))
    columns = ["log_file", "line_number", "raw_line", "source_ip", "target", "url", "ts"]
    hits = entries.select(*columns, case_blind(text).alias("_low")).select(
        *columns, F.explode(signature_types("_low", strict=strict)).alias("type"))
    return as_findings(hits.select(
        "log_file", "line_number", "source_ip", "type",
        severity_of(F.col("type")).alias("severity"),
        F.coalesce(filled(F.col("target")), "url").alias("target"),
        F.format_string(fixed.SIGNATURE_DETAIL, "type").alias("detail"),
        F.array("raw_line").alias("evidence"),
        F.col("ts").alias("event_ts"),
        risk_score(F.col("type"), F.lit(1)).alias("score"),
    ), "signatures", ingest_ts=ingest_ts)


def detect_unauthorized(entries: DataFrame, *, ingest_ts: datetime | str) -> DataFrame:
    """Web lines answered with 401 or 403."""
    rows = entries.filter(F.col("log_type").isin("WEB_ACCESS", "WEB_ERROR") & F.col("status").isin("401", "403"))
    return as_findings(rows.select(
        "log_file", "line_number", "source_ip",
        F.lit("UNAUTHORIZED_ACCESS").alias("type"), F.lit("LOW").alias("severity"),
        F.col("url").alias("target"),
        F.format_string(fixed.UNAUTHORIZED_DETAIL, "status").alias("detail"),
        F.array("raw_line").alias("evidence"), F.col("ts").alias("event_ts"),
        F.lit(0.3).alias("score"),
    ), "unauthorized", ingest_ts=ingest_ts)


def detect_sensitive_data(entries: DataFrame, *, ingest_ts: datetime | str,
                          patterns: list[str] | None = None) -> DataFrame:
    """The first pattern that a line holds; evidence is cut to 200 characters."""
    patterns = patterns or fixed.SENSITIVE_PATTERNS
    text = F.concat_ws(" ", F.coalesce(filled(F.col("raw_line")), "message"), F.coalesce("url", F.lit("")))
    first = F.coalesce(*[F.when(found_in("_low", p), F.lit(i)) for i, p in enumerate(patterns)])
    columns = ["log_file", "line_number", "raw_line", "source_ip", "target", "ts"]
    lowered = entries.select(*columns, case_blind(text).alias("_low"))
    rows = once(lowered, _i=first).filter("_i is not null")
    return as_findings(rows.select(
        "log_file", "line_number", "source_ip", "target",
        F.lit("SENSITIVE_DATA_EXPOSURE").alias("type"), F.lit("CRITICAL").alias("severity"),
        F.lit(fixed.SENSITIVE_DETAIL).alias("detail"),
        F.array(F.substring("raw_line", 1, 200)).alias("evidence"),
        F.col("ts").alias("event_ts"), F.lit(0.9).alias("score"),
        F.create_map(
            F.lit("pattern_index"), F.col("_i").cast("string"),
            F.lit("pattern_matched"), F.get(F.array(*[F.lit(p) for p in patterns]), F.col("_i")),
        ).alias("extra"),
    ), "sensitive_data", ingest_ts=ingest_ts)


def detect_off_hours(entries: DataFrame, *, ingest_ts: datetime | str, start_hour: int = 8, end_hour: int = 20,
                     weekend_suspicious: bool = True) -> DataFrame:
    """Activity outside working hours, or at the weekend. Lines without time are left out."""
    hour, weekday = F.hour("ts"), F.weekday("ts")
    outside = (hour < start_hour) | (hour >= end_hour)
    weekend = (weekday >= 5) & F.lit(weekend_suspicious)
    rows = entries.filter(F.col("ts").isNotNull() & (outside | weekend))
    names = F.array(*[F.lit(d) for d in fixed.WEEKDAYS])
    return as_findings(rows.select(
        "log_file", "line_number", "source_ip", "target",
        F.lit("ANOMALOUS_TIME").alias("type"),
        F.when(outside, "MEDIUM").otherwise("LOW").alias("severity"),
        F.format_string(fixed.OFF_HOURS_DETAIL, F.concat_ws(
            " ", F.date_format("ts", "HH:mm"), F.get(names, weekday))).alias("detail"),
        F.col("ts").alias("event_ts"),
        F.when(outside, 0.4).otherwise(0.2).alias("score"),
        F.create_map(F.lit("hour"), hour.cast("string"), F.lit("weekday"), weekday.cast("string")).alias("extra"),
    ), "off_hours", ingest_ts=ingest_ts)
