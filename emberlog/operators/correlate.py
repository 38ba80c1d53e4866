"""Addresses behind several kinds of attack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed


def _group_id(session_id: str | None, digits: int) -> Column:
    """Repeatable group name; 16 hex digits keep names apart at scale."""
    return F.substring(F.sha2(F.concat_ws("|", "source_ip", F.lit(session_id or "")), 256), 1, digits)


def correlate(findings: DataFrame, *, session_id: str | None = None, min_findings: int = 3, min_types: int = 2,
              id_digits: int = 16) -> DataFrame:
    """One row per address with enough findings of enough types.

    Only counts and the set of types (a handful) are gathered per address; the
    findings of a group are rows of ``correlation_members``.
    """
    types = F.array_sort(F.collect_set("type"))
    grouped = findings.filter("source_ip is not null and source_ip <> ''").groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("count"), types.alias("attack_types"))
    kept = grouped.filter((F.col("count") >= min_findings) & (F.size("attack_types") >= min_types))
    return kept.select(
        _group_id(session_id, id_digits).alias("group_id"),
        F.lit("multi_vector_attack").alias("correlation_type"), "source_ip", "attack_types", "count",
        F.least(F.lit(0.9), F.size("attack_types") * F.lit(0.3)).alias("confidence"),
        F.format_string(fixed.CORRELATION_DETAIL, F.col("source_ip"), F.array_join("attack_types", ", ")).alias("description"))


def correlation_members(findings: DataFrame, correlations: DataFrame) -> DataFrame:
    """(group_id, anomaly_id), one row per finding of a group.

    Both sides grow with the input, and what Spark takes the findings' size for is a guess from the size of the files they
    were made from, so neither side may be broadcast.
    """
    groups = correlations.select("source_ip", "group_id").hint("merge")
    return findings.join(groups, "source_ip").select("group_id", F.col("id").alias("anomaly_id"))


def mark_correlated(findings: DataFrame, correlations: DataFrame) -> DataFrame:
    """Findings with ``is_correlated`` and their ``correlation_group``."""
    groups = correlations.select("source_ip", F.col("group_id").alias("correlation_group"))
    return findings.join(groups, "source_ip", "left").withColumn(
        "is_correlated", F.col("correlation_group").isNotNull())


def read_correlations(correlations: DataFrame) -> DataFrame:
    """All groups, newest first."""
    return correlations.orderBy(F.desc("created_at"), "group_id")
