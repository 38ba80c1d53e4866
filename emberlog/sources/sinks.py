"""Writing findings, tables, reports and event lines."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed
from emberlog.functions.outbound import iso_text, to_cef_line, to_event, to_event_json, to_syslog_line
from emberlog.operators import dashboards
from emberlog.operators.alerts import make_alerts
from emberlog.operators.correlate import correlate, correlation_members
from emberlog.operators.findings import order_keys, stamp_literal
from emberlog.operators.numbering import number_rows
from emberlog.session import scratch_dir


def write_anomalies(findings: DataFrame, path: str, *, mode: str = "append") -> None:
    """Parquet, one folder per event day, so that time ranges read few files.

    The rows of a day are brought together first, in as many parts as their size asks for.
    """
    dated = findings.withColumn("event_date", F.col("event_ts").cast("date")).hint("rebalance", "event_date")
    dated.write.mode(mode).partitionBy("event_date").parquet(path)


def read_anomalies(spark: SparkSession, path: str, *, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Stored findings with an event time in a closed range; days outside it are not read."""
    rows = spark.read.parquet(path)
    if start:
        rows = rows.filter((F.col("event_date") >= stamp_literal(start).cast("date")) & (F.col("event_ts") >= stamp_literal(start)))
    if end:
        rows = rows.filter((F.col("event_date") <= stamp_literal(end).cast("date")) & (F.col("event_ts") <= stamp_literal(end)))
    return rows.drop("event_date")


def timeline_rows(findings: DataFrame) -> DataFrame:
    """What the timeline shows of a finding; the description is cut to 200 characters."""
    return findings.select(
        F.col("detected_ts").alias("event_time"), F.col("type").alias("event_type"), "severity", "source_ip",
        F.substring("detail", 1, 200).alias("description"), F.col("id").alias("anomaly_id"), "session_id")


def write_timeline(findings: DataFrame, path: str, *, mode: str = "append") -> None:
    timeline_rows(findings).write.mode(mode).parquet(path)


def write_alerts(findings: DataFrame, path: str, *, mode: str = "append") -> None:
    make_alerts(findings).write.mode(mode).parquet(path)


def write_correlations(findings: DataFrame, path: str, *, created_at: datetime | str, session_id: str | None = None,
                       mode: str = "append") -> None:
    """Groups and their members, as two tables. The findings are worked out once."""
    slim, path_of_slim = findings.select("id", "type", "source_ip"), scratch_dir(findings.sparkSession, "correlated")
    slim.write.parquet(path_of_slim)
    findings = findings.sparkSession.read.schema(slim.schema).parquet(path_of_slim)
    groups = correlate(findings, session_id=session_id)
    groups.withColumn("created_at", stamp_literal(created_at)).write.mode(mode).parquet(os.path.join(path, "groups"))
    correlation_members(findings, groups).write.mode(mode).parquet(os.path.join(path, "members"))


def save_training(vectors: DataFrame, path: str, *, created_at: datetime | str, label: str = "label") -> None:
    """Append labelled feature vectors."""
    training_rows(vectors, created_at=created_at, label=label).write.mode("append").parquet(path)


def training_rows(vectors: DataFrame, *, created_at: datetime | str, label: str = "label",
                  anomaly_type: str | None = None) -> DataFrame:
    kind = F.col(anomaly_type) if anomaly_type else F.lit(None)
    return vectors.select(
        F.array(*fixed.FEATURE_NAMES).alias("features"), F.col(label).cast("int").alias("label"),
        kind.cast("string").alias("anomaly_type"), stamp_literal(created_at).alias("created_at"))


def normalise_for_export(findings: DataFrame, *, prefer_ml_score: bool = False) -> DataFrame:
    """Findings in the columns reports use. ``prefer_ml_score`` shows the model's
    score in place of the rule's, also where it is missing."""
    score = F.col("ml_score") if prefer_ml_score else F.col("score")
    return findings.select(
        "type", "severity", "source_ip", "target", "detail", iso_text(F.col("event_ts")).alias("timestamp"),
        score.alias("score"), "log_file", "evidence")


def export_rows(findings: DataFrame) -> DataFrame:
    """The CSV columns, numbered in raised order."""
    numbered = number_rows(findings, *order_keys(), name="_n")
    return numbered.withColumns({"id": F.col("_n"), "timestamp": iso_text(F.col("event_ts"))}).select(
        *fixed.EXPORT_COLUMNS)


def export_csv(findings: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """CSV with a header; a line of text instead when there is no finding."""
    rows = export_rows(findings)
    if rows.isEmpty():
        nothing = rows.sparkSession.range(1).select(F.lit(fixed.NO_FINDINGS_TEXT).alias("value"))
        nothing.coalesce(1).write.mode(mode).text(path)
        return
    rows.write.mode(mode).option("header", True).csv(path)


def report_summary(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: totals, counts by severity and type, first addresses, advice.

    The findings are read once for all counts, by type and severity, and once by address; what is then put together are a
    few dozen counts and the first addresses.
    """
    cells = findings.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("type", "severity", "n")).alias("cells"))

    def by(key: str) -> Column:
        names = F.array_sort(F.array_distinct(F.filter(F.transform("cells", lambda c: c[key]), lambda k: k.isNotNull())))
        own = lambda k: F.aggregate(F.filter("cells", lambda c: c[key] == k), F.lit(0).cast("bigint"), lambda total, c: total + c["n"])
        return F.map_from_arrays(names, F.transform(names, own))

    totals = cells.select(F.aggregate("cells", F.lit(0).cast("bigint"), lambda total, c: total + c["n"]).alias("total_anomalies"),
                          by("severity").alias("by_severity"), by("type").alias("by_type"))
    leaders = dashboards.top_ips(findings).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("count")).alias("n"), "source_ip"))).alias("leaders"))
    top = leaders.select(F.transform("leaders", lambda r: F.struct(r["source_ip"].alias("ip"), (-r["n"]).alias("count"))).alias("top_ips"))
    advice = dashboards.recommendations(findings).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("position", "recommendation"))),
        lambda r: r["recommendation"]).alias("recommendations"))
    row = entries.agg(F.count(F.lit(1)).alias("total_entries_processed"))
    for side in (totals, top, advice):  # a single row each
        row = row.join(F.broadcast(side), F.lit(True))
    return row


def export_json(entries: DataFrame, findings: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """The findings as JSON lines, and the report's one-row summary beside them."""
    normalise_for_export(findings).write.mode(mode).json(os.path.join(path, "anomalies"))
    report_summary(entries, findings).coalesce(1).write.mode(mode).json(os.path.join(path, "summary"))


def export(entries: DataFrame, findings: DataFrame, path: str, format: str = "json") -> None:
    """Write a report in a format given by name."""
    name = format.lower()
    if name == "csv":
        export_csv(findings, path)
    elif name == "json":
        export_json(entries, findings, path)
    else:
        raise ValueError(f"unknown format: {format}")


def sink_jsonl(events: DataFrame, path: str, *, max_records: int = 0, max_bytes: int = 0, mode: str = "append", **names: str) -> None:
    """Append events as JSON lines; a new file starts after ``max_records``, or after the line that goes beyond ``max_bytes``."""
    lines = to_event_json(events, **names)
    if max_bytes:
        write_rotated(lines, path, max_bytes=max_bytes, mode=mode)
    else:
        lines.write.mode(mode).option("maxRecordsPerFile", max_records).text(path)


def write_rotated(lines: DataFrame, path: str, *, max_bytes: int, mode: str = "append") -> None:
    """Write ``value`` as text in files that end with the line that goes beyond ``max_bytes``; one folder ``part=n`` per file.

    Lines keep the order of their partitions. Each gets the number of bytes before it: those of its own partition, and
    those of the partitions before, of which one row each is added up. A file is then the lines of one stretch of bytes.
    """
    spark = lines.sparkSession
    place = F.monotonically_increasing_id()
    sized = lines.select("value", (F.octet_length("value") + 1).cast("bigint").alias("n"), F.shiftright(place, 33).alias("task"), place.alias("place"))
    folder = scratch_dir(spark, "rotated")
    sized.write.parquet(folder)
    rows = spark.read.schema(sized.schema).parquet(folder)
    block = F.shiftright("place", 16)  # a window of at most 65,536 rows
    blocks = rows.groupBy(block.alias("block")).agg(F.sum("n").alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("block", before.alias("before"))  # a row per 65,536 lines
    inside = F.coalesce(F.sum("n").over(W.partitionBy("block").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.withColumn("block", block).withColumn("inside", inside).join(starts, "block").withColumn(
        "part", F.floor((F.col("before") + F.col("inside")) / max_bytes))
    numbered.repartition("part").sortWithinPartitions("part", "place").select("value", "part").write.mode(mode).partitionBy("part").text(path)


def sink_text(lines: DataFrame, path: str, *, mode: str = "append") -> None:
    """Append formatted lines."""
    lines.select("value").write.mode(mode).text(path)


Writer = Callable[[DataFrame, dict], None]
SINK_TYPES: dict[str, Writer] = {
    "file": lambda events, c: sink_jsonl(events, c["path"], max_records=c.get("max_records", 0), max_bytes=c.get("max_bytes", 0), mode=c.get("mode", "append")),
    "syslog_text": lambda events, c: sink_text(
        to_syslog_line(events, facility=c.get("facility", "LOCAL0"), hostname=c.get("hostname", "-")), c["path"], mode=c.get("mode", "append")),
    "cef_text": lambda events, c: sink_text(to_cef_line(events, escape=c.get("escape", False)), c["path"], mode=c.get("mode", "append")),
}


class SinkList:
    """Named sinks; every event goes to each one that is switched on."""

    def __init__(self, configs: list[dict] | None = None):
        self.sinks: list[dict] = []
        self.sent = self.failed = 0
        for config in configs or []:
            self.add(config)

    def add(self, config: dict) -> bool:
        """False for a type that has no writer."""
        if config.get("type", "file") not in SINK_TYPES:
            return False
        self.sinks.append(config)
        return True

    def remove(self, name: str) -> None:
        self.sinks = [s for s in self.sinks if s.get("name") != name]

    def fan_out(self, events: DataFrame, *, batch: int | None = None) -> None:
        """Write to every sink; a failing sink does not stop the others.

        The events are worked out once. With ``batch``, each sink has a folder for it that is
        written anew, and failures are raised when all sinks were tried.
        """
        events, failures = events.persist(), []
        try:
            n = events.count()
            for sink in self.sinks:
                if not sink.get("enabled", True):
                    self.failed += n
                    continue
                own = sink if batch is None else {**sink, "path": os.path.join(sink["path"], f"batch={batch}"), "mode": "overwrite"}
                try:
                    SINK_TYPES[sink.get("type", "file")](events, own)
                    self.sent += n
                except Exception as error:
                    print(f"sink {sink.get('name')}: {error}")
                    self.failed += n
                    failures.append(error)
        finally:
            events.unpersist()
        if batch is not None and failures:
            raise ExceptionGroup("sinks failed", failures)

    def stats(self) -> dict:
        return {"events_sent": self.sent, "events_failed": self.failed, "connectors": len(self.sinks)}


def fan_out_findings(findings: DataFrame, sinks: SinkList) -> None:
    sinks.fan_out(to_event(findings))
