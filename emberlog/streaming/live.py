"""Live lines: growing files, rules with state, minutes of counts, outbound events."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from emberlog.functions import fixed_values as fixed
from emberlog.functions.outbound import to_event
from emberlog.functions.stamps import micros
from emberlog.operators.findings import stamp_literal, union_findings
from emberlog.operators.parse import parse_logs
from emberlog.operators.rates import SECOND, api_findings, api_requests, brute_force_findings, ddos_findings, failed_logins, web_requests
from emberlog.operators.reset_window import ADDRESS_ROWS, crowded_addresses, reset_window, walk_addresses
from emberlog.operators.signatures import (
    detect_off_hours, detect_sensitive_data, detect_signatures, detect_unauthorized)
from emberlog.session import compiled_methods
from emberlog.sources import growing
from emberlog.sources.files import clean_line
from emberlog.sources.sinks import SinkList

LOG_FILES = "*.{log,txt,json}"


def stream_logs(spark: SparkSession, paths: str | list[str], *, bytes_per_trigger: int, split_bytes: int = 32 << 20) -> DataFrame:
    """Lines of files that grow: named files from their end on, folders with all their log files from the start.

    ``line_number`` is the place of the line in its file, in bytes: it orders the lines and names them. A batch takes
    at most ``bytes_per_trigger`` of each file.
    """
    growing.register(spark)
    named = [paths] if isinstance(paths, str) else list(paths)
    lines = (spark.readStream.format(growing.FORMAT).option("paths", json.dumps(named))
             .option("bytesPerTrigger", bytes_per_trigger).option("splitBytes", split_bytes).load())
    return lines.select("log_file", F.col("position").alias("line_number"), clean_line(F.col("value")).alias("raw_line")).filter("raw_line <> ''")


def stream_finished(spark: SparkSession, folder: str, *, files_per_trigger: int) -> DataFrame:
    """Lines of every new file in a folder into which finished files are put. They have no line numbers."""
    reader = spark.readStream.format("text").option("pathGlobFilter", LOG_FILES).option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select(
        F.col("_metadata.file_path").alias("log_file"),
        F.lit(None).cast("bigint").alias("line_number"),
        clean_line(F.col("value")).alias("raw_line")).filter("raw_line <> ''")


def tail_follow(lines: DataFrame, on_batch: Callable[[DataFrame, int], None], *, checkpoint: str,
                every: str = "1 second") -> DataStreamWriter:
    """Hand each batch of new lines to a function, at a fixed pace."""
    return (lines.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .trigger(processingTime=every))


def parse_stream(lines: DataFrame, *, default_year: int) -> DataFrame:
    return parse_logs(lines, default_year=default_year)


def stateless_findings(entries: DataFrame, *, ingest_ts: datetime | str) -> DataFrame:
    """The rules that look at one line only work on a stream as they are."""
    return (detect_signatures(entries, ingest_ts=ingest_ts)
            .unionByName(detect_unauthorized(entries, ingest_ts=ingest_ts))
            .unionByName(detect_sensitive_data(entries, ingest_ts=ingest_ts))
            .unionByName(detect_off_hours(entries, ingest_ts=ingest_ts)))


@dataclass(frozen=True)
class LiveRule:
    """A reset-window rule on a stream: which rows it looks at, its window, and what its fires say."""

    name: str
    rows: Callable[..., DataFrame]
    findings: Callable[..., DataFrame]
    window_us: int
    threshold: int
    payload: list[str] = field(default_factory=list)


def brute_force_rule(*, attempts: int = 5, window_seconds: int = 300) -> LiveRule:
    say = lambda events, ingest_ts: brute_force_findings(events, ingest_ts=ingest_ts, window_seconds=window_seconds)
    return LiveRule("brute_force", failed_logins, say, window_seconds * SECOND, attempts, ["user", "raw_line"])


def ddos_rule(*, requests: int = 100, window_seconds: int = 60) -> LiveRule:
    say = lambda events, ingest_ts: ddos_findings(events, ingest_ts=ingest_ts, window_seconds=window_seconds)
    return LiveRule("ddos", web_requests, say, window_seconds * SECOND, requests)


def api_abuse_rule(*, requests: int = 50, window_seconds: int = 60) -> LiveRule:
    say = lambda events, ingest_ts: api_findings(events, ingest_ts=ingest_ts)
    return LiveRule("api_abuse", api_requests, say, window_seconds * SECOND - 1, requests, ["endpoint", "raw_line"])


class LiveRun:
    """A run over a stream of lines, batch by batch, in tables under ``folder``.

    Each batch has its own part of every table and writes it anew when it is replayed:

    * ``entries``: the parsed lines, with ``late``: whether the line's own stamp is more than ``late`` older than the
      newest stamp of the batches before. Late lines are kept and counted; no rule judges them.
    * ``events/<rule>``: fires of the batch, and what each address holds at its end. The next batch starts from there, so a
      rule runs over a batch as over a stored table. Addresses whose rows are out of reach of every line that may still
      come hold nothing any more.
    * ``crowded/<rule>``: addresses with so many rows in the batch that these are spread over tasks; the others are walked by
      one task each.
    * ``findings``: all findings of the batch; ``minutes``: counts by minute, as rows that add up.
    * ``progress``: newest stamp, lines read, lines judged and lines that came late.

    Rows of an address are taken by event time within a batch, batches in their order. Undated lines count at
    ``ingest_ts``; they are never late and make no other line late.
    """

    def __init__(self, folder: str, rules: list[LiveRule], *, default_year: int, ingest_ts: datetime | str, late_seconds: int, single_line: bool = True,
                 sinks: SinkList | None = None, address_rows: int = ADDRESS_ROWS):
        self.folder, self.rules, self.default_year, self.ingest_ts = folder, rules, default_year, ingest_ts
        self.late_us, self.single_line, self.sinks, self.address_rows = late_seconds * SECOND, single_line, sinks, address_rows

    def path(self, table: str, batch: int | None = None) -> str:
        return os.path.join(self.folder, table, *([f"batch={batch}"] if batch is not None else []))

    def _put(self, rows: DataFrame, table: str, batch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(table, batch))
        return rows.sparkSession.read.schema(rows.schema).parquet(self.path(table, batch))

    def table(self, spark: SparkSession, table: str) -> DataFrame:
        """All batches of a table, with their number in ``batch``."""
        return spark.read.parquet(self.path(table))

    def newest(self, spark: SparkSession, before: int) -> int | None:
        """The newest stamp of the batches before a batch, in microseconds."""
        if before == 0:
            return None
        return self.table(spark, "progress").filter(F.col("batch") < before).agg(F.max("newest")).first()[0]

    def take(self, lines: DataFrame, batch: int) -> None:
        """Judge one batch."""
        spark = compiled_methods(lines.sparkSession)
        newest = self.newest(spark, batch)
        entries = parse_logs(lines, default_year=self.default_year)
        stamp = micros(F.col("ts"))
        late = F.coalesce(stamp < F.lit(newest - self.late_us), F.lit(False)) if newest is not None else F.lit(False)
        entries = self._put(entries.withColumn("late", late), "entries", batch)
        n, n_late, top = entries.agg(F.count(F.lit(1)), F.count_if(F.col("late")), F.max(stamp)).first()
        top = max((x for x in (newest, top) if x is not None), default=None)
        judged = entries.filter(~F.col("late")).drop("late")
        found = []
        for rule in self.rules:
            events = self._put(self._events(rule, judged, batch, newest), f"events/{rule.name}", batch)
            found.append(rule.findings(events.filter("kind = 'fire'"), self.ingest_ts))
        if self.single_line:
            found.append(stateless_findings(judged, ingest_ts=self.ingest_ts))
        findings = self._put(union_findings(*found), "findings", batch)
        self._put(minute_counts(findings), "minutes", batch)
        if self.sinks is not None:
            self.sinks.fan_out(to_event(findings), batch=batch)
        # last: a batch without this row is taken again
        self._put(spark.createDataFrame([(top, n, n - n_late, n_late)], "newest bigint, n_lines bigint, n_judged bigint, n_late bigint"), "progress", batch)

    def _events(self, rule: LiveRule, judged: DataFrame, batch: int, newest: int | None) -> DataFrame:
        held = None
        if batch:
            before = judged.sparkSession.read.parquet(self.path(f"events/{rule.name}", batch - 1))
            held = before.filter("kind = 'held'").select("source_ip", F.col("times").alias("held"))
            if newest is not None:  # older times are out of reach of every line that this batch judges
                undated = int(datetime.fromisoformat(str(self.ingest_ts)).replace(tzinfo=timezone.utc).timestamp() * SECOND)
                held = held.filter(F.array_max("held") + rule.window_us >= min(newest - self.late_us, undated))
        rows = rule.rows(judged, ingest_ts=self.ingest_ts)
        how = {"window_us": rule.window_us, "threshold": rule.threshold, "order": "event_time", "payload": rule.payload}
        crowded = self._put(crowded_addresses(rows, self.address_rows), f"crowded/{rule.name}", batch)
        if crowded.isEmpty():
            return walk_addresses(rows, entering=held, **how)
        few, many = ([None if df is None else df.join(crowded, "source_ip", kind) for df in (rows, held)] for kind in ("left_anti", "left_semi"))
        return walk_addresses(few[0], entering=few[1], **how).unionByName(reset_window(many[0], entering=many[1], **how))

    def start(self, lines: DataFrame, *, checkpoint: str, every: str = "1 second") -> DataStreamWriter:
        """The writer of a stream of ``log_file``, ``line_number``, ``raw_line``; ``start()`` runs it."""
        return tail_follow(lines, self.take, checkpoint=checkpoint, every=every)


SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def minute_counts(findings: DataFrame, time_column: str = "event_ts") -> DataFrame:
    """Findings by minute: counts by severity and a sketch of the addresses. Rows of one minute add up."""
    return findings.groupBy(F.date_trunc("minute", time_column).alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("source_ip").alias("addresses"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def metrics_from_minutes(minutes: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """``dashboards.live_metrics`` from rows of ``minute_counts``, whole minutes back from ``as_of``.

    Counts are exact. ``active_ips`` is estimated from sketches of 2^12 registers: within 4 % in 95 of 100 cases.
    """
    at = stamp_literal(as_of)
    ago = lambda minutes: F.date_trunc("minute", at) - F.make_dt_interval(mins=F.lit(minutes))
    recent = minutes.filter((F.col("minute") >= ago(60)) & (F.col("minute") <= at))
    none = F.lit(0).cast("bigint")
    total = recent.agg(
        F.coalesce(F.sum(F.when(F.col("minute") >= ago(5), F.col("n"))), none).alias("last_5min"), F.coalesce(F.sum("n"), none).alias("last_hour"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("addresses")), none).alias("active_ips"), *[F.coalesce(F.sum(s), none).alias(s) for s in SEVERITIES])
    ranked = F.array(*[F.struct(F.col(s).alias("n"), F.lit(r).alias("rank"), F.lit(s).alias("name")) for s, r in fixed.SEVERITY_RANK.items() if s in SEVERITIES])
    return total.select(
        "last_5min", "last_hour", F.round(F.col("last_hour") / 60, 2).alias("rate_per_min"),
        F.when(F.col("last_hour") > 0, F.array_max(ranked)["name"]).otherwise("N/A").alias("dominant_severity"), "active_ips", *SEVERITIES)


def live_counts(findings: DataFrame, *, late: str, width: str = "5 minutes") -> DataFrame:
    """Findings and addresses per window of event time; rows later than ``late`` are left out."""
    timed = findings.withColumn("event_ts", F.col("event_ts").cast("timestamp")).withWatermark("event_ts", late)
    return timed.groupBy(F.window("event_ts", width)).agg(
        F.count(F.lit(1)).alias("findings"), F.approx_count_distinct("source_ip").alias("active_ips"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])


def fan_out_stream(findings: DataFrame, sinks: SinkList, *, checkpoint: str) -> DataStreamWriter:
    """Send the findings of a stream to every sink, batch by batch.

    A batch has its own folder in each sink, which a replay writes anew. A sink that
    fails ends the query after the others have their batch, so that the checkpoint
    does not pass it and a restart sends the batch again.
    """
    def send(batch: DataFrame, number: int) -> None:
        sinks.fan_out(to_event(batch), batch=number)
    return findings.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)


def on_finding(findings: DataFrame, listeners: list[Callable[[DataFrame], None]], *, checkpoint: str) -> DataStreamWriter:
    """Call listeners with each batch of findings. All are called; then a failure ends the
    query, so that the batch comes again after a restart."""
    def call(batch: DataFrame, _: int) -> None:
        failures = []
        for listener in listeners:
            try:
                listener(batch)
            except Exception as error:
                failures.append(error)
        if failures:
            raise ExceptionGroup("listeners failed", failures)
    return findings.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint)
