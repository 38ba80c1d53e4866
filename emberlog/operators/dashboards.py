"""Counts, shares and short lists shown on the dashboards and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed
from emberlog.operators.findings import order_keys, stamp_literal

_SEVERITIES = list(fixed.SEVERITY_RANK)
_URGENT = ("CRITICAL", "HIGH")


def _is(severity: str) -> Column:
    return F.col("severity") == severity


def _ago(as_of: datetime | str, **back: int) -> Column:
    unit, n = next(iter(back.items()))
    return stamp_literal(as_of) - F.expr(f"interval {n} {unit}")


def counts(findings: DataFrame) -> DataFrame:
    """All, critical and unreviewed findings, in one aggregate."""
    unreviewed = F.count_if(~F.coalesce("reviewed", F.lit(False))) if "reviewed" in findings.columns else F.count(F.lit(1))
    return findings.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.count_if(_is("CRITICAL")).alias("critical_count"),
        unreviewed.alias("unreviewed_count"))


def by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "type")


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def top_ips(findings: DataFrame, limit: int = 10) -> DataFrame:
    return (findings.filter("source_ip is not null").groupBy("source_ip").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "source_ip").limit(limit))


def top_types(findings: DataFrame, limit: int = 10) -> DataFrame:
    return by_type(findings).limit(limit)


def recent_counts(findings: DataFrame, *, as_of: datetime | str, time_column: str = "detected_ts") -> DataFrame:
    """Findings of the last 24 hours, of the day, of the last 7 days."""
    at = F.col(time_column)
    return findings.agg(
        F.count_if(at >= _ago(as_of, hours=24)).alias("recent_count"),
        F.count_if(at.cast("date") == stamp_literal(as_of).cast("date")).alias("today_count"),
        F.count_if(at >= _ago(as_of, days=7)).alias("week_count"))


def timeline(findings: DataFrame, *, as_of: datetime | str, hours: int = 24, interval: str = "hour",
             time_column: str = "detected_ts") -> DataFrame:
    """Findings per minute, hour or day, in all and by severity, in time order."""
    layout = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd"}.get(interval, "yyyy-MM-dd HH:mm")
    return (findings.filter(F.col(time_column) >= _ago(as_of, hours=hours))
            .groupBy(F.date_format(time_column, layout).alias("time_bucket"))
            .agg(F.count(F.lit(1)).alias("total"),
                 *[F.count_if(_is(s)).alias(s.lower()) for s in reversed(_SEVERITIES)])
            .orderBy("time_bucket"))


PERIODS = ("all", "last_6h", "last_12h", "working_hours", "off_hours")


def timeline_of_day(findings: DataFrame, *, minutes: int = 60, period: str = "all",
                    as_of: datetime | str | None = None, time_column: str = "event_ts") -> DataFrame:
    """Findings by time of day across dates, with the number of files they come from."""
    at = F.col(time_column)
    hour = F.hour(at)
    rows = findings.filter(at.isNotNull())
    if period in ("last_6h", "last_12h"):
        rows = rows.filter(at >= _ago(as_of, hours=6 if period == "last_6h" else 12))
    elif period == "working_hours":
        rows = rows.filter((hour >= 8) & (hour < 18))
    elif period == "off_hours":
        rows = rows.filter((hour < 8) | (hour >= 18))
    elif period != "all":
        raise ValueError(f"period must be one of {PERIODS}")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    bucket = F.concat(two(hour), F.lit(":"), two(F.minute(at) - F.minute(at) % minutes))
    name = F.element_at(F.split("log_file", "/"), -1)
    return (rows.groupBy(bucket.alias("time_of_day"))
            .agg(F.count(F.lit(1)).alias("total"),
                 *[F.count_if(_is(s)).alias(s.lower()) for s in reversed(_SEVERITIES)],
                 F.count_distinct(F.nullif(name, F.lit(""))).alias("files"))
            .orderBy("time_of_day"))


def live_metrics(findings: DataFrame, *, as_of: datetime | str, time_column: str = "detected_ts") -> DataFrame:
    """Last 5 minutes, last hour, rate, most frequent severity and active addresses."""
    at = F.col(time_column)
    hour = findings.filter(at >= _ago(as_of, hours=1)).agg(
        F.count_if(at >= _ago(as_of, minutes=5)).alias("last_5min"),
        F.count(F.lit(1)).alias("last_hour"),
        F.count_distinct("source_ip").alias("active_ips"),
        *[F.count_if(_is(s)).alias(s) for s in _SEVERITIES])
    ranked = F.array(*[F.struct(F.col(s).alias("n"), F.lit(r).alias("rank"), F.lit(s).alias("name"))
                       for s, r in fixed.SEVERITY_RANK.items()])
    return hour.select(
        "last_5min", "last_hour", F.round(F.col("last_hour") / 60, 2).alias("rate_per_min"),
        F.when(F.col("last_hour") > 0, F.array_max(ranked)["name"]).otherwise("N/A").alias("dominant_severity"),
        "active_ips")


def engine_stats(entries: DataFrame, findings: DataFrame, *, trained: bool = False) -> DataFrame:
    """Processed lines and findings: in all, by type, by severity, found by the model."""
    key = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    keys = F.array(key("findings", F.lit("detected")), key("type", F.col("type")), key("severity", F.col("severity")),
                   key("findings", F.when(F.col("type") == "ML_DETECTED", "ml")))
    found = (findings.select(F.explode(keys).alias("k")).filter("k.name is not null")
             .groupBy("k.kind", "k.name").agg(F.count(F.lit(1)).alias("value")))
    read = entries.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("lines").alias("kind"), F.lit("processed").alias("name"), "value")
    flag = read.sparkSession.range(1).select(
        F.lit("model").alias("kind"), F.lit("trained").alias("name"), F.lit(int(trained)).cast("bigint").alias("value"))
    return read.unionByName(found).unionByName(flag)


def severity_share(findings: DataFrame) -> DataFrame:
    """Share of each severity; the window runs over the few counted rows only."""
    counted = by_severity(findings)
    return counted.select("severity", "count", (F.col("count") / F.sum("count").over(W.partitionBy())).alias("share"))


def type_percent(findings: DataFrame) -> DataFrame:
    counted = findings.groupBy("type").agg(F.count(F.lit(1)).alias("count"))
    share = F.round(F.col("count") * 100 / F.sum("count").over(W.partitionBy()), 1)
    return counted.select("type", "count", share.alias("percent")).orderBy(F.desc("count"), "type")


def top_threats(findings: DataFrame, limit: int = 5) -> DataFrame:
    """The first urgent findings; the first of any kind only if none is urgent."""
    urgent = F.col("severity").isin(*_URGENT)
    first = findings.withColumn("_urgent", urgent).orderBy(F.desc("_urgent"), *order_keys()).limit(limit)
    any_urgent = F.max("_urgent").over(W.partitionBy())
    return first.withColumn("_any", any_urgent).filter(F.col("_urgent") == F.col("_any")).drop("_urgent", "_any")


def source_split(findings: DataFrame) -> DataFrame:
    by_model = F.count_if(F.col("type") == "ML_DETECTED")
    return findings.agg(
        F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - by_model).alias("by_pattern"), by_model.alias("by_ml"))


def report_limit(findings: DataFrame, limit: int = 100) -> DataFrame:
    """The findings a report lists; reports of different kinds list 100, 50 or 20."""
    return findings.orderBy(*order_keys()).limit(limit)


def recommendations(findings: DataFrame) -> DataFrame:
    """Numbered advice for the types, severities and addresses found.

    Everything joined here is one row per finding type or less.
    """
    spark = findings.sparkSession
    urgent = findings.filter(_is("CRITICAL")).select("severity").limit(1).select(
        F.lit(0).alias("place"), F.lit(fixed.URGENT_ADVICE).alias("recommendation"))
    rules = spark.createDataFrame(
        [(i + 1, kind, text) for i, (kind, text) in enumerate(fixed.ADVICE.items())],
        "place int, type string, recommendation string")
    typed = rules.join(findings.select("type").distinct(), "type", "left_semi").select("place", "recommendation")
    leaders = top_ips(findings, 3).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("count")).alias("n"), "source_ip"))).alias("ips"))
    block = leaders.filter(F.size("ips") > 0).select(
        F.lit(100).alias("place"),
        F.format_string(fixed.BLOCK_ADVICE, F.array_join(F.col("ips.source_ip"), ", ")).alias("recommendation"))
    general = spark.createDataFrame(
        [(101 + i, text) for i, text in enumerate(fixed.GENERAL_ADVICE)], "place int, recommendation string")
    rows = urgent.unionByName(typed).unionByName(block).unionByName(general)
    return rows.select(F.row_number().over(W.orderBy("place")).alias("position"), "recommendation").orderBy("position")
