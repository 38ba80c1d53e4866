"""Findings as outbound events: JSON, syslog and CEF lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed
from emberlog.functions.regex import filled
from emberlog.functions.scores import _lookup

PRODUCT, VERSION = "emberlog", "1.0"


def iso_text(ts: Column) -> Column:
    """ISO form; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def to_event(findings: DataFrame) -> DataFrame:
    return findings.select(
        iso_text(F.col("event_ts")).alias("timestamp"),
        F.coalesce(filled(F.col("log_file")), F.lit("unknown")).alias("source"),
        F.col("type").alias("event_type"), "severity", F.col("detail").alias("message"),
        "source_ip", "target", F.get("evidence", F.lit(0)).alias("raw_log"), "ml_score",
        F.array("type").alias("tags"), F.lit(None).cast("map<string,string>").alias("custom_fields"))


def event_filter(events: DataFrame, *, severities: list[str] | None = None,
                 max_message_length: int = fixed.FORWARDED_MESSAGE_LENGTH, include_raw_log: bool = True,
                 include_ml_score: bool = True) -> DataFrame:
    """The forwarding settings: severities, message length, optional fields."""
    kept = events.filter(F.col("severity").isin(severities or fixed.FORWARDED_SEVERITIES))
    kept = kept.withColumn("message", F.substring("message", 1, max_message_length))
    if not include_raw_log:
        kept = kept.withColumn("raw_log", F.lit(None).cast("string"))
    if not include_ml_score:
        kept = kept.withColumn("ml_score", F.lit(None).cast("double"))
    return kept


def to_event_json(events: DataFrame, *, application: str = PRODUCT, version: str = VERSION) -> DataFrame:
    """``value``: the event as JSON without its null fields."""
    fields = [F.col(c) for c in events.columns]
    return events.select(F.to_json(F.struct(
        *fields, F.lit(application).alias("application"), F.lit(version).alias("version"))).alias("value"))


def to_syslog_line(events: DataFrame, *, facility: str = "LOCAL0", hostname: str = "-", application: str = PRODUCT) -> DataFrame:
    """``value``: RFC 5424 lines; the time is that of the event."""
    level = _lookup(F.upper("severity"), fixed.SYSLOG_SEVERITIES, fixed.OTHER_SYSLOG_SEVERITY)
    priority = (level + fixed.SYSLOG_FACILITIES[facility] * 8).cast("string")
    name = F.replace(F.upper("event_type"), F.lit(" "), F.lit("_"))
    quoted = lambda key, value: F.concat(F.lit(f' {key}="'), value, F.lit('"'))
    data = F.concat(
        F.lit(f"[{application.lower()}@0"), quoted("severity", F.col("severity")), quoted("type", F.col("event_type")),
        F.coalesce(quoted("sourceIP", filled(F.col("source_ip"))), F.lit("")),
        F.coalesce(F.when(F.col("ml_score") != 0, quoted("mlScore", F.format_string("%.2f", "ml_score"))), F.lit("")),
        F.lit("]"))
    return events.select(F.concat_ws(
        " ", F.concat(F.lit("<"), priority, F.lit(">1")), "timestamp", F.lit(hostname), F.lit(application), F.lit("-"),
        name, data, F.replace("message", F.lit("\n"), F.lit(" "))).alias("value"))


def to_cef_line(events: DataFrame, *, vendor: str = PRODUCT, product: str = "SecurityAnalyzer", version: str = VERSION,
                escape: bool = False) -> DataFrame:
    """``value``: CEF lines. ``escape`` protects the format's own marks in values."""
    safe = (lambda c: F.regexp_replace(c, r"([\\=|])", r"\\$1")) if escape else (lambda c: c)
    level = _lookup(F.upper("severity"), fixed.CEF_SEVERITIES, fixed.OTHER_CEF_SEVERITY).cast("string")
    part = lambda key, c: F.concat(F.lit(f"{key}="), safe(filled(c)))
    extension = F.concat_ws(" ", F.concat(F.lit("msg="), safe(F.col("message"))),
                            part("src", F.col("source_ip")), part("dst", F.col("target")))
    return events.select(F.concat_ws(
        "|", F.lit("CEF:0"), F.lit(vendor), F.lit(product), F.lit(version), safe(F.col("event_type")),
        safe(F.col("event_type")), level, extension).alias("value"))
