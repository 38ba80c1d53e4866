"""The common shape of findings, and reading them back by condition."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.scores import type_rank
from emberlog.schema import FINDINGS, conform


def stamp_literal(at: datetime | str) -> Column:
    """A given moment. Nothing here reads the wall clock, so that runs repeat."""
    return F.lit(str(at)).cast("timestamp_ntz")


def as_findings(rows: DataFrame, rule: str, *, ingest_ts: datetime | str) -> DataFrame:
    """Complete rows that carry at least ``type`` and ``severity`` to findings.

    A finding without event time takes the ingest time. The id depends only on
    where the finding is and what it says, so that a repeated run gives it again;
    what it says keeps apart the lines of a stream, which have no numbers.
    """
    at = stamp_literal(ingest_ts)
    have = set(rows.columns)
    new = {
        "detected_ts": at,
        "event_ts": F.coalesce(F.col("event_ts").cast("timestamp_ntz"), at) if "event_ts" in have else at,
        "rule": F.lit(rule),
    }
    if "count" not in have:
        new["count"] = F.lit(1)
    rows = conform(rows.withColumns(new), FINDINGS)
    return rows.withColumn("id", F.xxhash64(
        "log_file", "line_number", "source_ip", "type", "rule", "event_ts", "target", "detail", "evidence"))


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def order_keys() -> list[Column]:
    """The order in which findings are raised: by line, then by type within it."""
    return [F.col("log_file"), F.col("line_number"), type_rank(F.col("type")), F.col("id")]


def filter_anomalies(findings: DataFrame, *, type: str | None = None, severity: str | None = None,
                     session_id: str | None = None, source_ip: str | None = None,
                     start: datetime | str | None = None, end: datetime | str | None = None,
                     time_column: str = "detected_ts", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Equality filters and a closed time range, newest first. All rows unless a screen asks for a page of them."""
    for name, wanted in (("type", type), ("severity", severity), ("session_id", session_id), ("source_ip", source_ip)):
        if wanted:
            findings = findings.filter(F.col(name) == wanted)
    if start:
        findings = findings.filter(F.col(time_column) >= stamp_literal(start))
    if end:
        findings = findings.filter(F.col(time_column) <= stamp_literal(end))
    newest = findings.orderBy(F.col(time_column).desc(), *order_keys())
    page = newest.offset(offset) if offset else newest
    return page if limit is None else page.limit(limit)


def search_anomalies(findings: DataFrame, *, text: str = "", severity: str | None = None,
                     limit: int = 100) -> DataFrame:
    """Substring search over type, detail and address; first ``limit`` in raised order."""
    if severity:
        findings = findings.filter(F.col("severity") == severity)
    if text:
        findings = findings.filter(_searchable().contains(F.lit(text.lower())))
    return findings.orderBy(*order_keys()).limit(limit)


def search_counts(findings: DataFrame, *, text: str = "", severity: str | None = None) -> DataFrame:
    """How many findings a search shows, of how many."""
    hit = F.lit(True)
    if severity:
        hit = hit & (F.col("severity") == severity)
    if text:
        hit = hit & _searchable().contains(F.lit(text.lower()))
    return findings.agg(F.count_if(hit).alias("shown"), F.count(F.lit(1)).alias("total"))


def _searchable() -> Column:
    return F.lower(F.concat_ws(" ", "type", "detail", F.coalesce("source_ip", F.lit(""))))
