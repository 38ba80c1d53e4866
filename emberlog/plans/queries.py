"""The registered queries: every operator over the whole given tables.

Each entry pairs a Spark query with the DuckDB text that must give the same rows.
Entries without text cannot be said in SQL (streams, the forest, the classifier).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed
from emberlog.functions.literals import case_blind
from emberlog.functions.outbound import event_filter, to_cef_line, to_event, to_event_json, to_syslog_line
from emberlog.functions.scores import risk_score, severity_of, severity_rank
from emberlog.functions.stamps import clock_text, parse_timestamp
from emberlog.operators import alerts, classifier, correlate, dashboards, findings, forest, numbering, rates
from emberlog.operators import parse, parse_extended, signatures
from emberlog.operators.detectors import DetectorRegistry, detector_stats
from emberlog.operators.features import FEATURES, extract_features, scale
from emberlog.plans import corpus, oracle
from emberlog.plans.corpus import sql_lines, written
from emberlog.plans.oracle import INGEST, ORDER, YEAR, clock, lit
from emberlog.plans.pipeline import analyse
from emberlog.session import scratch_dir, use_utc
from emberlog.sources import files, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-20 12:00:00"
BRUTE = {"attempts": 4, "window_seconds": 172_800}
DDOS = {"requests": 6, "window_seconds": 172_800}
API = {"requests": 2, "window_seconds": 864_000}


def query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(use_utc(spark), sf_dir)
        QUERIES[name] = pinned
        if sql:
            ORACLES[name] = sql
        return run
    return add


# --- inputs shared by the queries ---------------------------------------------

def entries_of(spark: SparkSession, sf_dir: str, name: str, *formats: str) -> DataFrame:
    lines = corpus.lines(spark, sf_dir, name)
    return parse.parse_logs(lines, default_year=YEAR, formats=formats) if formats else parse.parse_logs(lines, default_year=YEAR)


def access_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of(spark, sf_dir, "access", "access")


def auth_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of(spark, sf_dir, "auth", "syslog")


#: What the rules for single lines read of an entry.
RULE_COLUMNS = ["log_file", "line_number", "raw_line", "log_type", "ts", "source_ip", "status", "target", "url"]


def access_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both rules find. The entries are parsed once and written, since each rule reads them."""
    entries = stored_frame(access_entries(spark, sf_dir).select(*RULE_COLUMNS), "rule-entries")
    return signatures.detect_signatures(entries, ingest_ts=INGEST).unionByName(
        signatures.detect_unauthorized(entries, ingest_ts=INGEST))


def stored(df: DataFrame, label: str, write: Callable[[DataFrame, str], None]) -> str:
    path = scratch_dir(df.sparkSession, label)
    write(df, path)
    return path


def stored_frame(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def entry_rows(entries: DataFrame) -> DataFrame:
    return entries.select(
        "log_file", "line_number", "log_type", clock_text(F.col("ts")).alias("ts"), "source_ip", F.col("user").alias("user_name"),
        "action", "status", "message", "target", F.array_join("attack_indicators", ",").alias("indicators"), "url",
        "method", "protocol", "size", "referer", "user_agent", F.col("status_code").cast("string").alias("status_code"), "hostname", "process", "pid")


def finding_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "log_file", "line_number", "type", "severity", "source_ip", "target", "detail",
        F.get("evidence", F.lit(0)).alias("evidence"), clock_text(F.col("event_ts")).alias("event_ts"),
        F.round("score", 6).alias("score"))


SQL_FINDING = f"""log_file, line_number, type, severity, source_ip, target, detail, evidence,
 {clock('event_ts')} AS event_ts, round(score, 6) AS score"""
SQL_FINDINGS = oracle.findings()
SQL_ACCESS = oracle.access_entries()
SQL_AUTH = oracle.parsed(sql_lines("auth"), ("syslog",))
SQL_MIXED = oracle.parsed(sql_lines("mixed"))
SQL_DOCS = f"""SELECT *, CAST(NULL AS STRING) AS url, CAST(NULL AS STRING) AS target, CAST(NULL AS STRING) AS source_ip,
 CAST(NULL AS TIMESTAMP) AS ts FROM ({corpus.SQL_DOCUMENT_LINES}) d"""


# --- flagship -------------------------------------------------------------------

@query("flagship", f"""SELECT source_ip, count(*) AS "count" FROM ({oracle.unauthorized_findings(SQL_ACCESS)}) f
 WHERE source_ip IS NOT NULL GROUP BY source_ip ORDER BY count(*) DESC, source_ip LIMIT 10""")
def flagship(spark, sf_dir):
    """Lines, access parser, refused requests, first ten addresses."""
    return dashboards.top_ips(signatures.detect_unauthorized(access_entries(spark, sf_dir), ingest_ts=INGEST))


# --- sources ----------------------------------------------------------------------

def written_logs(spark: SparkSession, sf_dir: str) -> str:
    """The mixed lines as text files, one folder per event type, blank lines included."""
    lines = corpus.lines(spark, sf_dir, "mixed").join(
        corpus.table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("line_number"), "event_type"), "line_number")
    padded = F.when(F.col("line_number") % 7 == 0, F.concat(F.lit("\n  "), "raw_line", F.lit("  "))).otherwise(F.col("raw_line"))
    path = scratch_dir(spark, "logs")
    lines.select(padded.alias("value"), "event_type").write.partitionBy("event_type").option("maxRecordsPerFile", 400).text(path)
    return path


def _folder(column: str = "log_file") -> Column:
    return F.regexp_extract(column, "event_type=([a-z]+)", 1)


@query("read_logs", f"""SELECT e.event_type, raw_line, count(*) AS lines FROM ({sql_lines('mixed')}) l
 JOIN events e ON e.event_id + 1 = l.line_number GROUP BY e.event_type, raw_line""")
def read_logs(spark, sf_dir):
    rows = files.read_logs(spark, os.path.join(written_logs(spark, sf_dir), "*"), line_numbers=False)
    return rows.groupBy(_folder().alias("event_type"), "raw_line").agg(F.count(F.lit(1)).alias("lines"))


@query("with_line_numbers", """SELECT event_type, count(*) + count(*) FILTER ((event_id + 1) % 7 = 0) AS lines,
 count(*) AS filled, CAST(1 AS INT) AS consecutive FROM events GROUP BY event_type""")
def with_line_numbers(spark, sf_dir):
    """Per file the numbers must run from 1 to the number of physical lines."""
    text = spark.read.text(os.path.join(written_logs(spark, sf_dir), "*"))
    numbered = files.with_line_numbers(text)
    per_file = numbered.groupBy("log_file").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("line_number").alias("d"), F.min("line_number").alias("a"),
        F.max("line_number").alias("b"), F.count_if(files.clean_line(F.col("value")) != "").alias("filled"))
    good = (F.col("n") == F.col("d")) & (F.col("a") == 1) & (F.col("b") == F.col("n"))
    return per_file.groupBy(_folder().alias("event_type")).agg(
        F.sum("n").alias("lines"), F.sum("filled").alias("filled"), F.min(good.cast("int")).alias("consecutive"))


@query("read_many", f"""SELECT e.event_type, log_type, count(*) AS lines FROM ({SQL_MIXED}) l
 JOIN events e ON e.event_id + 1 = l.line_number GROUP BY e.event_type, log_type""")
def read_many(spark, sf_dir):
    """Every folder that was written, as one scan, parsed under one run."""
    path = written_logs(spark, sf_dir)
    kinds = [r[0] for r in corpus.table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]
    rows = files.read_many(spark, [os.path.join(path, f"event_type={kind}") for kind in kinds])
    return parse.parse_logs(rows, default_year=YEAR).groupBy(_folder().alias("event_type"), "log_type").agg(
        F.count(F.lit(1)).alias("lines"))


query("read_many_folders", ORACLES["read_many"])(read_many)


# --- parsers ----------------------------------------------------------------------

@query("parse_logs", oracle.entry_rows(SQL_MIXED))
def parse_logs(spark, sf_dir):
    return entry_rows(entries_of(spark, sf_dir, "mixed"))


@query("parse_json_line", oracle.entry_rows(oracle.parsed(sql_lines("json"), ("json",)), "log_type = 'JSON'"))
def parse_json_line(spark, sf_dir):
    return entry_rows(parse.parse_json_line(corpus.lines(spark, sf_dir, "json"), default_year=YEAR))


@query("parse_web_access", oracle.entry_rows(SQL_ACCESS, "log_type = 'WEB_ACCESS'"))
def parse_web_access(spark, sf_dir):
    return entry_rows(parse.parse_web_access(corpus.lines(spark, sf_dir, "access"), default_year=YEAR))


@query("parse_web_error", oracle.entry_rows(oracle.parsed(sql_lines("error"), ("error",)), "log_type = 'WEB_ERROR'"))
def parse_web_error(spark, sf_dir):
    return entry_rows(parse.parse_web_error(corpus.lines(spark, sf_dir, "error"), default_year=YEAR))


@query("parse_syslog", oracle.entry_rows(SQL_AUTH, "log_type IN ('SYSLOG', 'AUTH')"))
def parse_syslog(spark, sf_dir):
    return entry_rows(parse.parse_syslog(corpus.lines(spark, sf_dir, "auth"), default_year=YEAR))


@query("parse_auth_message", f"""SELECT action AS pattern, status, count(*) AS lines, count(DISTINCT usr) AS users,
 count(DISTINCT source_ip) AS addresses FROM ({SQL_AUTH}) e WHERE action IS NOT NULL GROUP BY action, status""")
def parse_auth_message(spark, sf_dir):
    rows = auth_entries(spark, sf_dir).filter("action is not null")
    return rows.groupBy(F.col("action").alias("pattern"), "status").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("user").alias("users"),
        F.count_distinct("source_ip").alias("addresses"))


@query("parse_generic", oracle.entry_rows(oracle.parsed(
    f"{sql_lines('generic')} UNION ALL {corpus.SQL_DOCUMENT_LINES} UNION ALL {corpus.SQL_CONVERSATION_LINES}", ())))
def parse_generic(spark, sf_dir):
    """Event lines, and every line of the documents and conversations."""
    lines = corpus.lines(spark, sf_dir, "generic").unionByName(corpus.document_lines(spark, sf_dir)).unionByName(
        corpus.conversation_lines(spark, sf_dir))
    return entry_rows(parse.parse_generic(lines, default_year=YEAR))


@query("parse_timestamp", f"""SELECT line_number, {clock(oracle.stamp_value('stamp'))} AS ts FROM (
 SELECT line_number, {oracle.stamp_at_start('raw_line')} AS stamp FROM (SELECT event_id + 1 AS line_number,
 {written("CASE event_id % 6 WHEN 0 THEN concat('[', $clf$, ' +0000]') WHEN 1 THEN $iso$ WHEN 2 THEN $slash$ WHEN 3 THEN $dmy$ WHEN 4 THEN $sys$ ELSE concat('Feb 29 ', $clock$) END", 'duckdb')}
 AS raw_line FROM events) l) s""")
def parse_timestamp_query(spark, sf_dir):
    text = written("CASE event_id % 6 WHEN 0 THEN concat('[', $clf$, ' +0000]') WHEN 1 THEN $iso$ WHEN 2 THEN $slash$ "
                   "WHEN 3 THEN $dmy$ WHEN 4 THEN $sys$ ELSE concat('Feb 29 ', $clock$) END", "spark")
    rows = corpus.table(spark, sf_dir, "events").selectExpr("event_id + 1 AS line_number", f"{text} AS raw_line")
    return rows.select("line_number", clock_text(parse_timestamp(F.col("raw_line"), YEAR)).alias("ts"))


@query("tag_indicators", f"""SELECT log_file, line_number, {oracle.tags(oracle.fold('raw_line'), fixed.INDICATORS)} AS indicators
 FROM ({corpus.SQL_DOCUMENT_LINES}) d""")
def tag_indicators(spark, sf_dir):
    rows = corpus.document_lines(spark, sf_dir)
    lowered = rows.select("log_file", "line_number", case_blind(F.col("raw_line")).alias("low"))
    return lowered.select("log_file", "line_number", F.array_join(parse.tag_indicators("low"), ",").alias("indicators"))


@query("parse_stats", f"""WITH e AS MATERIALIZED ({SQL_MIXED})
 SELECT 'lines' AS kind, 'total' AS name, count(*) AS lines FROM e UNION ALL SELECT 'lines', 'parsed', count(*) FROM e
 UNION ALL SELECT 'log_type', log_type, count(*) FROM e GROUP BY log_type
 UNION ALL SELECT 'indicator', i, count(*) FROM (SELECT unnest(string_split(indicators, ',')) AS i FROM e) x WHERE i <> '' GROUP BY i""")
def parse_stats(spark, sf_dir):
    return parse.parse_stats(entries_of(spark, sf_dir, "mixed"))


def ext_rows(entries: DataFrame) -> DataFrame:
    return entries.select("line_number", "log_type", clock_text(F.col("ts")).alias("ts"), "source_ip",
                          F.col("user").alias("user_name"), "action", "status", "message", "target", "severity")


SQL_EXT = oracle.extended(sql_lines("extended"))


@query("parse_extended", oracle.extended_rows(SQL_EXT))
def parse_extended_query(spark, sf_dir):
    return ext_rows(parse_extended.parse_extended(corpus.lines(spark, sf_dir, "extended"), default_year=YEAR))


_FURTHER = "c.log_type = 'GENERIC' AND e.log_type IS NOT NULL"
_ONE_OF = ", ".join(f"CASE WHEN {_FURTHER} THEN e.{n} ELSE c.{n} END AS {n}" for n in ("log_type", "source_ip", "status", "target"))


@query("parse_further", f"""SELECT c.line_number, {_ONE_OF}, {clock(f'CASE WHEN {_FURTHER} THEN e.ts ELSE c.ts END')} AS ts
 FROM ({oracle.parsed(sql_lines("extended"))}) c LEFT JOIN ({SQL_EXT}) e USING (line_number)""")
def parse_further(spark, sf_dir):
    """Core and further formats in one pass over lines of all kinds."""
    core = parse.parse_logs(corpus.lines(spark, sf_dir, "extended"), default_year=YEAR)
    return parse_extended.parse_further(core, default_year=YEAR).select(
        "line_number", "log_type", "source_ip", "status", "target", clock_text(F.col("ts")).alias("ts"))


def _family(name: str, parser, types: list[str]) -> None:
    wanted = ", ".join(lit(t) for t in types)

    @query(name, oracle.extended_rows(SQL_EXT, f"log_type IN ({wanted})"))
    def run(spark, sf_dir):
        return ext_rows(parser(corpus.lines(spark, sf_dir, "extended"), default_year=YEAR))


_family("parse_windows_event", parse_extended.parse_windows_event, ["WINDOWS_EVENT"])
_family("parse_iis", parse_extended.parse_iis, ["IIS"])
_family("parse_postgresql", parse_extended.parse_postgresql, ["POSTGRESQL"])
_family("parse_mysql", parse_extended.parse_mysql, ["MYSQL_ERROR", "MYSQL_QUERY"])
_family("parse_firewall", parse_extended.parse_firewall, ["FIREWALL_UFW", "FIREWALL_IPTABLES", "FIREWALL_WINDOWS"])
_family("parse_container", parse_extended.parse_container, ["DOCKER", "DOCKER_COMPOSE"])


@query("detect_format", f"""SELECT CASE WHEN log_type = 'WINDOWS_EVENT' THEN 'windows' WHEN log_type = 'IIS' THEN 'iis'
 WHEN log_type = 'POSTGRESQL' THEN 'postgresql' WHEN starts_with(log_type, 'MYSQL') THEN 'mysql'
 WHEN starts_with(log_type, 'FIREWALL') THEN 'firewall' WHEN starts_with(log_type, 'DOCKER') THEN 'docker' END AS format,
 count(*) AS lines FROM ({SQL_EXT}) e GROUP BY 1""")
def detect_format(spark, sf_dir):
    entries = parse_extended.parse_extended(corpus.lines(spark, sf_dir, "extended"), default_year=YEAR)
    return parse_extended.detect_format(entries).groupBy("format").agg(F.count(F.lit(1)).alias("lines"))


@query("security_event_lookup", f"""SELECT action, severity, count(*) AS lines FROM ({SQL_EXT}) e
 WHERE log_type = 'WINDOWS_EVENT' GROUP BY action, severity""")
def security_event_lookup(spark, sf_dir):
    entries = parse_extended.parse_windows_event(corpus.lines(spark, sf_dir, "extended"), default_year=YEAR)
    return entries.groupBy("action", "severity").agg(F.count(F.lit(1)).alias("lines"))


@query("extended_stats", f"""WITH e AS MATERIALIZED ({SQL_EXT}) SELECT 'lines' AS kind, 'total' AS name, count(*) AS lines FROM e
 UNION ALL SELECT 'lines', 'parsed', count(*) FROM e WHERE log_type IS NOT NULL
 UNION ALL SELECT 'log_type', log_type, count(*) FROM e WHERE log_type IS NOT NULL GROUP BY log_type""")
def extended_stats(spark, sf_dir):
    return parse_extended.extended_stats(
        parse_extended.parse_extended(corpus.lines(spark, sf_dir, "extended"), default_year=YEAR))


# --- single-line rules --------------------------------------------------------------

@query("detect_signatures", f"SELECT {SQL_FINDING} FROM ({oracle.signature_findings(SQL_ACCESS)}) f")
def detect_signatures(spark, sf_dir):
    return finding_rows(signatures.detect_signatures(access_entries(spark, sf_dir), ingest_ts=INGEST))


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines with the entry columns the rules read."""
    return parse.parse_generic(corpus.document_lines(spark, sf_dir), default_year=YEAR)


@query("detect_signatures_documents", f"""SELECT log_file, line_number, type, severity, round(score, 6) AS score
 FROM ({oracle.signature_findings(SQL_DOCS)}) f""")
def detect_signatures_documents(spark, sf_dir):
    found = signatures.detect_signatures(document_entries(spark, sf_dir), ingest_ts=INGEST)
    return found.select("log_file", "line_number", "type", "severity", F.round("score", 6).alias("score"))


@query("detect_signatures_pages", f"""SELECT log_file, type, severity, target FROM ({oracle.signature_findings(
    f"SELECT *, CAST(NULL AS STRING) AS target, CAST(NULL AS STRING) AS source_ip, CAST(NULL AS TIMESTAMP) AS ts FROM ({corpus.SQL_PAGE_LINES}) p")}) f""")
def detect_signatures_pages(spark, sf_dir):
    """Whole pages with their url, as one text each."""
    pages = corpus.page_lines(spark, sf_dir).select("*", *[
        F.lit(None).cast(t).alias(c) for c, t in (("target", "string"), ("source_ip", "string"), ("ts", "timestamp_ntz"))])
    return signatures.detect_signatures(pages, ingest_ts=INGEST).select("log_file", "type", "severity", "target")


@query("severity_of", f"""SELECT type, severity, {oracle.case('severity', fixed.SEVERITY_RANK, '0')} AS severity_rank, count(*) AS findings
 FROM (SELECT type, {oracle.case('type', fixed.SEVERITY_OF_TYPE, lit('MEDIUM'))} AS severity FROM ({SQL_FINDINGS}) f) g GROUP BY 1, 2, 3""")
def severity_of_query(spark, sf_dir):
    rows = access_findings(spark, sf_dir).select("type", severity_of(F.col("type")).alias("severity"))
    return rows.groupBy("type", "severity", severity_rank(F.col("severity")).alias("severity_rank")).agg(
        F.count(F.lit(1)).alias("findings"))


@query("risk_score", f"""SELECT type, "count", round(CAST(least(1.0, {oracle.case('type', fixed.BASE_SCORES, '0.5')}
 + least(0.1, 0.01 * "count")) AS DOUBLE), 6) AS score FROM (SELECT type, count(*) AS "count" FROM ({SQL_FINDINGS}) f GROUP BY type) g""")
def risk_score_query(spark, sf_dir):
    counted = access_findings(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("count"))
    return counted.select("type", "count", F.round(risk_score(F.col("type"), F.col("count")), 6).alias("score"))


@query("detect_unauthorized", f"SELECT {SQL_FINDING} FROM ({oracle.unauthorized_findings(SQL_ACCESS)}) f")
def detect_unauthorized(spark, sf_dir):
    return finding_rows(signatures.detect_unauthorized(access_entries(spark, sf_dir), ingest_ts=INGEST))


SQL_SENSITIVE_TEXTS = f"""SELECT log_file, line_number, raw_line, CAST(NULL AS STRING) AS url FROM ({corpus.SQL_DOCUMENT_LINES}) d
 UNION ALL SELECT log_file, line_number, raw_line, url FROM ({SQL_ACCESS}) a"""


@query("detect_sensitive_data", f"""SELECT log_file, line_number, CAST(i AS STRING) AS pattern_index, substr(raw_line, 1, 200) AS evidence,
 CAST(0.9 AS DOUBLE) AS score FROM (SELECT *, CASE {' '.join(
    f"WHEN {oracle.has(oracle.fold('full_text'), p)} THEN {i}" for i, p in enumerate(fixed.SENSITIVE_PATTERNS))} END AS i
 FROM (SELECT *, concat(raw_line, ' ', coalesce(url, '')) AS full_text FROM ({SQL_SENSITIVE_TEXTS}) t) u) v WHERE i IS NOT NULL""")
def detect_sensitive_data(spark, sf_dir):
    entries = document_entries(spark, sf_dir).unionByName(access_entries(spark, sf_dir))
    return signatures.detect_sensitive_data(entries, ingest_ts=INGEST).select(
        "log_file", "line_number", F.col("extra")["pattern_index"].alias("pattern_index"),
        F.get("evidence", F.lit(0)).alias("evidence"), "score")


@query("detect_off_hours", f"""SELECT line_number, CASE WHEN hour(ts) < 8 OR hour(ts) >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 concat('Atividade em horário anómalo: ', strftime(ts, '%H:%M %A')) AS detail,
 CASE WHEN hour(ts) < 8 OR hour(ts) >= 20 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS score
 FROM ({SQL_ACCESS}) e WHERE ts IS NOT NULL AND (hour(ts) < 8 OR hour(ts) >= 20 OR isodow(ts) >= 6)""")
def detect_off_hours(spark, sf_dir):
    return signatures.detect_off_hours(access_entries(spark, sf_dir), ingest_ts=INGEST).select(
        "line_number", "severity", "detail", "score")


@query("filter_anomalies", f"""SELECT {SQL_FINDING} FROM ({SQL_FINDINGS}) f WHERE severity = 'CRITICAL'
 AND event_ts >= TIMESTAMP '2024-01-05 00:00:00' AND event_ts <= TIMESTAMP '2024-01-25 00:00:00'
 ORDER BY f.event_ts DESC, {ORDER} LIMIT 100 OFFSET 20""")
def filter_anomalies(spark, sf_dir):
    return finding_rows(findings.filter_anomalies(
        access_findings(spark, sf_dir), severity="CRITICAL", start="2024-01-05 00:00:00", end="2024-01-25 00:00:00",
        time_column="event_ts", limit=100, offset=20))


@query("search_anomalies", f"""SELECT {SQL_FINDING} FROM ({SQL_FINDINGS}) f WHERE severity = 'CRITICAL'
 AND contains(lower(concat_ws(' ', type, detail, coalesce(source_ip, ''))), 'sql_inj') ORDER BY {ORDER} LIMIT 100""")
def search_anomalies(spark, sf_dir):
    return finding_rows(findings.search_anomalies(access_findings(spark, sf_dir), text="SQL_Inj", severity="CRITICAL"))


@query("search_counts", f"""SELECT count(*) FILTER (contains(lower(concat_ws(' ', type, detail, coalesce(source_ip, ''))), '10.0.0.1')) AS shown,
 count(*) AS total FROM ({SQL_FINDINGS}) f""")
def search_counts(spark, sf_dir):
    return findings.search_counts(access_findings(spark, sf_dir), text="10.0.0.1")


# --- rate rules -----------------------------------------------------------------------

def _numbered(entries: str, where: str) -> str:
    return f"""SELECT source_ip, row_number() OVER (PARTITION BY source_ip ORDER BY log_file, line_number) AS n,
 epoch_us(ts) AS t, log_file, line_number FROM ({entries}) e WHERE source_ip IS NOT NULL AND {where}"""


SQL_FAILED = _numbered(SQL_AUTH, "log_type = 'AUTH' AND status = 'FAILED'")
SQL_BRUTE = f"""{oracle.reset_fires(SQL_FAILED, BRUTE['window_seconds'] * 1_000_000, BRUTE['attempts'])}
 SELECT source_ip, line_number, strftime(make_timestamp(t), '%Y-%m-%d %H:%M:%S') AS event_ts,
 'Brute-force: {BRUTE['attempts']} tentativas em {BRUTE['window_seconds']}s' AS detail, CAST({BRUTE['attempts']} AS BIGINT) AS "count",
 round(CAST(least(1.0, 0.75 + 0.04) AS DOUBLE), 6) AS score FROM w WHERE fired"""


def brute_rows(rows: DataFrame) -> DataFrame:
    return rows.select("source_ip", "line_number", clock_text(F.col("event_ts")).alias("event_ts"), "detail", "count",
                       F.round("score", 6).alias("score"))


@query("detect_brute_force", SQL_BRUTE)
def detect_brute_force(spark, sf_dir):
    return brute_rows(rates.detect_brute_force(auth_entries(spark, sf_dir), ingest_ts=INGEST, **BRUTE))


@query("detect_brute_force_hot", SQL_BRUTE)
def detect_brute_force_hot(spark, sf_dir):
    """The same rule in blocks of 50 lines, run apart and put together."""
    return brute_rows(rates.detect_brute_force(auth_entries(spark, sf_dir), ingest_ts=INGEST, block_lines=50, **BRUTE))


@query("detect_ddos", f"""{oracle.reset_fires(_numbered(SQL_ACCESS, "log_type = 'WEB_ACCESS'"), DDOS['window_seconds'] * 1_000_000, DDOS['requests'])}
 SELECT source_ip, line_number, 'DDOS' AS type, 'CRITICAL' AS severity, CAST({DDOS['requests']} AS BIGINT) AS "count",
 round(CAST({DDOS['requests']} / 200.0 AS DOUBLE), 6) AS score FROM w WHERE fired""")
def detect_ddos(spark, sf_dir):
    return rates.detect_ddos(access_entries(spark, sf_dir), ingest_ts=INGEST, **DDOS).select(
        "source_ip", "line_number", "type", "severity", "count", F.round("score", 6).alias("score"))


@query("detect_api_abuse", f"""{oracle.reset_fires(_numbered(SQL_ACCESS, "regexp_matches(coalesce(url, ''), '/api/|/v1/|/v2/|/graphql')"),
    API['window_seconds'] * 1_000_000 - 1, API['requests'])}
 SELECT w.source_ip, line_number, concat('Abuso de API: {API['requests']} requests/min de ', w.source_ip) AS detail,
 CAST({API['requests']} AS BIGINT) AS "count" FROM w WHERE fired""")
def detect_api_abuse(spark, sf_dir):
    return rates.detect_api_abuse(access_entries(spark, sf_dir), ingest_ts=INGEST, **API).select(
        "source_ip", "line_number", "detail", "count")


@query("detect_residual", f"""{oracle.reset_fires(SQL_FAILED, BRUTE['window_seconds'] * 1_000_000, BRUTE['attempts'])}
 SELECT source_ip, concat('IP suspeito: ', len(held), ' tentativas falhadas') AS detail, CAST(len(held) AS BIGINT) AS "count"
 FROM (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY n DESC) AS back FROM w) x WHERE back = 1 AND len(held) >= 2""")
def detect_residual(spark, sf_dir):
    return rates.detect_residual(auth_entries(spark, sf_dir), ingest_ts=INGEST, at_least=2, **BRUTE).select(
        "source_ip", "detail", "count")


SQL_FILE = "concat('part-', CAST(line_number % 5 AS STRING), '.log')"
SQL_HELD = f"""SELECT source_ip, row_number() OVER (PARTITION BY source_ip ORDER BY {SQL_FILE}, line_number) AS n, epoch_us(ts) AS t, {SQL_FILE} AS log_file, line_number
 FROM ({SQL_AUTH}) e WHERE source_ip IS NOT NULL AND log_type = 'AUTH' AND status = 'FAILED'"""


@query("detect_residual_per_file", f"""{oracle.reset_fires(SQL_HELD, BRUTE['window_seconds'] * 1_000_000, BRUTE['attempts'])},
 files AS (SELECT DISTINCT {SQL_FILE} AS log_file FROM ({SQL_AUTH}) a),
 last AS (SELECT f.log_file, w.source_ip, arg_max(w.held, w.n) AS held FROM files f JOIN w ON w.log_file <= f.log_file GROUP BY f.log_file, w.source_ip)
 SELECT log_file, source_ip, concat('IP suspeito: ', len(held), ' tentativas falhadas') AS detail, CAST(len(held) AS BIGINT) AS "count" FROM last WHERE len(held) >= 2""")
def detect_residual_per_file(spark, sf_dir):
    """The lines dealt over five files: what every address holds at the end of each of them."""
    entries = auth_entries(spark, sf_dir).withColumn("log_file", F.expr(SQL_FILE))
    return rates.detect_residual(entries, ingest_ts=INGEST, at_least=2, per_file=True, block_lines=64, **BRUTE).select("log_file", "source_ip", "detail", "count")


@query("rate_sliding", f"""SELECT DISTINCT source_ip, t, at_time, in_window FROM (SELECT source_ip, t,
 count(*) OVER (PARTITION BY source_ip, t) AS at_time, count(*) OVER (PARTITION BY source_ip ORDER BY t
 RANGE BETWEEN {BRUTE['window_seconds'] * 1_000_000} PRECEDING AND CURRENT ROW) AS in_window FROM ({SQL_FAILED}) r) s""")
def rate_sliding(spark, sf_dir):
    rows = rates.failed_logins(auth_entries(spark, sf_dir), ingest_ts=INGEST)
    return rates.rate_sliding(rows, window_us=BRUTE["window_seconds"] * rates.SECOND)


SQL_STEP = oracle.case("severity", fixed.RISK_STEPS, str(fixed.OTHER_RISK_STEP))
SQL_IP_STATS = f"""SELECT source_ip, min(event_ts) AS first_seen, max(event_ts) AS last_seen, count(*) AS anomaly_count,
 least(1.0, CAST(20 + sum(step) - arg_min(step, line_number * 100 + place) AS DOUBLE) / 100) AS risk_score
 FROM (SELECT *, {SQL_STEP} AS step FROM ({SQL_FINDINGS}) f) g WHERE source_ip IS NOT NULL GROUP BY source_ip"""
SQL_IP_ROW = f"""source_ip, {clock('first_seen')} AS first_seen, {clock('last_seen')} AS last_seen, anomaly_count,
 round(CAST(risk_score AS DOUBLE), 6) AS risk_score"""


def ip_rows(rows: DataFrame) -> DataFrame:
    return rows.select("source_ip", clock_text(F.col("first_seen")).alias("first_seen"),
                       clock_text(F.col("last_seen")).alias("last_seen"), "anomaly_count",
                       F.round("risk_score", 6).alias("risk_score"))


@query("ip_stats", f"SELECT {SQL_IP_ROW} FROM ({SQL_IP_STATS}) s")
def ip_stats(spark, sf_dir):
    return ip_rows(rates.ip_stats(access_findings(spark, sf_dir)))


@query("upsert_ip", f"SELECT {SQL_IP_ROW} FROM ({SQL_IP_STATS}) s")
def upsert_ip(spark, sf_dir):
    """Totals stored in three batches of days; the second comes twice, and the first two are summed up in between."""
    rows, path = access_findings(spark, sf_dir), scratch_dir(spark, "ip-totals")
    batch = F.when(F.dayofmonth("event_ts") <= 8, 0).when(F.dayofmonth("event_ts") <= 20, 1).otherwise(2)
    for number in (0, 1, 1):
        tables.add_ip_batch(rows.filter(batch == number), path, number)
    tables.sum_up_ip_batches(spark, path, 1)
    for number in (1, 2):
        tables.add_ip_batch(rows.filter(batch == number), path, number)
    return ip_rows(tables.stored_ip_stats(spark, path))


# --- dashboards -------------------------------------------------------------------------

SQL_SEVERITIES = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))


@query("counts", f"""SELECT count(*) AS total_anomalies, count(*) FILTER (severity = 'CRITICAL') AS critical_count,
 count(*) AS unreviewed_count FROM ({SQL_FINDINGS}) f""")
def counts(spark, sf_dir):
    return dashboards.counts(access_findings(spark, sf_dir))


SQL_BY_TYPE = f"""SELECT type, count(*) AS "count" FROM ({SQL_FINDINGS}) f GROUP BY type"""


@query("by_type", SQL_BY_TYPE)
def by_type(spark, sf_dir):
    return dashboards.by_type(access_findings(spark, sf_dir))


@query("by_severity", f"""SELECT severity, count(*) AS "count" FROM ({SQL_FINDINGS}) f GROUP BY severity""")
def by_severity(spark, sf_dir):
    return dashboards.by_severity(access_findings(spark, sf_dir))


@query("top_ips", f"""SELECT source_ip, count(*) AS "count" FROM ({SQL_FINDINGS}) f WHERE source_ip IS NOT NULL
 GROUP BY source_ip ORDER BY count(*) DESC, source_ip LIMIT 10""")
def top_ips(spark, sf_dir):
    return dashboards.top_ips(access_findings(spark, sf_dir))


@query("recent_counts", f"""SELECT count(*) FILTER (event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS recent_count,
 count(*) FILTER (CAST(event_ts AS DATE) = CAST(TIMESTAMP '{AS_OF}' AS DATE)) AS today_count,
 count(*) FILTER (event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS week_count FROM ({SQL_FINDINGS}) f""")
def recent_counts(spark, sf_dir):
    return dashboards.recent_counts(access_findings(spark, sf_dir), as_of=AS_OF, time_column="event_ts")


def _timeline(interval: str, layout: str) -> None:
    @query(f"timeline_{interval}", f"""SELECT strftime(event_ts, '{layout}') AS time_bucket, count(*) AS total, {SQL_SEVERITIES}
 FROM ({SQL_FINDINGS}) f WHERE event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR GROUP BY 1""")
    def run(spark, sf_dir):
        return dashboards.timeline(access_findings(spark, sf_dir), as_of=AS_OF, hours=240, interval=interval, time_column="event_ts")


_timeline("minute", "%Y-%m-%d %H:%M")
_timeline("hour", "%Y-%m-%d %H:00")
_timeline("day", "%Y-%m-%d")


def _time_of_day(minutes: int, period: str, where: str) -> None:
    @query(f"timeline_of_day_{minutes}_{period}", f"""SELECT concat(lpad(CAST(hour(event_ts) AS STRING), 2, '0'), ':',
 lpad(CAST(minute(event_ts) - minute(event_ts) % {minutes} AS STRING), 2, '0')) AS time_of_day, count(*) AS total, {SQL_SEVERITIES},
 count(DISTINCT log_file) AS files FROM ({SQL_FINDINGS}) f WHERE {where} GROUP BY 1""")
    def run(spark, sf_dir):
        return dashboards.timeline_of_day(access_findings(spark, sf_dir), minutes=minutes, period=period, as_of=AS_OF)


_time_of_day(60, "all", "true")
_time_of_day(30, "working_hours", "hour(event_ts) >= 8 AND hour(event_ts) < 18")
_time_of_day(15, "off_hours", "(hour(event_ts) < 8 OR hour(event_ts) >= 18)")
_time_of_day(60, "last_6h", f"event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR")
_time_of_day(60, "last_12h", f"event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 12 HOUR")


@query("live_metrics", f"""WITH h AS MATERIALIZED (SELECT * FROM ({SQL_FINDINGS}) f WHERE event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR)
 SELECT count(*) FILTER (event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE) AS last_5min, count(*) AS last_hour,
 round(CAST(count(*) AS DOUBLE) / 60, 2) AS rate_per_min, coalesce((SELECT severity FROM h GROUP BY severity
 ORDER BY count(*) DESC, {oracle.case('severity', fixed.SEVERITY_RANK, '0')} DESC LIMIT 1), 'N/A') AS dominant_severity,
 count(DISTINCT source_ip) AS active_ips FROM h""")
def live_metrics(spark, sf_dir):
    return dashboards.live_metrics(access_findings(spark, sf_dir), as_of=AS_OF, time_column="event_ts")


@query("engine_stats", f"""WITH f AS MATERIALIZED ({SQL_FINDINGS}) SELECT 'lines' AS kind, 'processed' AS name, count(*) AS value FROM events
 UNION ALL SELECT 'findings', 'detected', count(*) FROM f UNION ALL SELECT 'type', type, count(*) FROM f GROUP BY type
 UNION ALL SELECT 'severity', severity, count(*) FROM f GROUP BY severity UNION ALL SELECT 'model', 'trained', CAST(0 AS BIGINT)""")
def engine_stats(spark, sf_dir):
    return dashboards.engine_stats(access_entries(spark, sf_dir), access_findings(spark, sf_dir))


@query("severity_share", f"""SELECT severity, count(*) AS "count", round(count(*) / sum(count(*)) OVER (), 9) AS share
 FROM ({SQL_FINDINGS}) f GROUP BY severity""")
def severity_share(spark, sf_dir):
    return dashboards.severity_share(access_findings(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("type_percent", f"""SELECT type, count(*) AS "count", round(count(*) * 100 / sum(count(*)) OVER (), 1) AS percent
 FROM ({SQL_FINDINGS}) f GROUP BY type""")
def type_percent(spark, sf_dir):
    return dashboards.type_percent(access_findings(spark, sf_dir))


@query("top_types", f"{SQL_BY_TYPE} ORDER BY count(*) DESC, type LIMIT 5")
def top_types(spark, sf_dir):
    return dashboards.top_types(access_findings(spark, sf_dir), 5)


@query("top_threats", f"SELECT {SQL_FINDING} FROM ({SQL_FINDINGS}) f WHERE severity IN ('CRITICAL', 'HIGH') ORDER BY {ORDER} LIMIT 5")
def top_threats(spark, sf_dir):
    return finding_rows(dashboards.top_threats(access_findings(spark, sf_dir)))


@query("source_split", f"""SELECT count(*) AS total, count(*) AS by_pattern, CAST(0 AS BIGINT) AS by_ml FROM ({SQL_FINDINGS}) f""")
def source_split(spark, sf_dir):
    return dashboards.source_split(access_findings(spark, sf_dir))


@query("report_limit", f"SELECT {SQL_FINDING} FROM ({SQL_FINDINGS}) f ORDER BY {ORDER} LIMIT 50")
def report_limit(spark, sf_dir):
    return finding_rows(dashboards.report_limit(access_findings(spark, sf_dir), 50))


_ADVICE = " UNION ALL ".join(
    [f"SELECT 0 AS place, {lit(fixed.URGENT_ADVICE)} AS recommendation WHERE EXISTS (SELECT 1 FROM f WHERE severity = 'CRITICAL')"]
    + [f"SELECT {i + 1}, {lit(text)} WHERE EXISTS (SELECT 1 FROM f WHERE type = '{kind}')" for i, (kind, text) in enumerate(fixed.ADVICE.items())]
    + ["""SELECT 100, concat('Considerar bloquear os IPs mais ativos: ', string_agg(source_ip, ', ' ORDER BY n DESC, source_ip))
 FROM (SELECT source_ip, count(*) AS n FROM f WHERE source_ip IS NOT NULL GROUP BY source_ip ORDER BY n DESC, source_ip LIMIT 3) t"""]
    + [f"SELECT {101 + i}, {lit(text)}" for i, text in enumerate(fixed.GENERAL_ADVICE)])
SQL_ADVICE = f"""WITH f AS MATERIALIZED ({SQL_FINDINGS}) SELECT CAST(row_number() OVER (ORDER BY place) AS INT) AS "position",
 recommendation FROM ({_ADVICE}) a"""


@query("recommendations", SQL_ADVICE)
def recommendations(spark, sf_dir):
    return dashboards.recommendations(access_findings(spark, sf_dir))


@query("timeline_orders", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS time_bucket, count(*) AS total,
 count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
 count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low
 FROM (SELECT *, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END AS severity
 FROM orders) o GROUP BY 1""")
def timeline_orders(spark, sf_dir):
    """The timeline at the size of a large table: orders by day and priority."""
    first = F.substring("o_orderpriority", 1, 1)
    rows = corpus.table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("event_ts"),
        F.when(first == "1", "CRITICAL").when(first == "2", "HIGH").when(first == "3", "MEDIUM").otherwise("LOW").alias("severity"))
    return dashboards.timeline(rows, as_of="2024-01-01 00:00:00", hours=24 * 366 * 60, interval="day", time_column="event_ts")


# --- joins, correlation, updates ----------------------------------------------------------

SQL_ALERTS = f"SELECT * FROM ({SQL_FINDINGS}) f WHERE severity IN ('HIGH', 'CRITICAL')"


@query("write_alerts", f"""SELECT type AS alert_type, severity, concat(type, ' Detetado') AS title, detail AS message, count(*) AS alerts
 FROM ({SQL_ALERTS}) a GROUP BY 1, 2, 3, 4""")
def write_alerts(spark, sf_dir):
    path = stored(access_findings(spark, sf_dir), "alerts", sinks.write_alerts)
    return spark.read.parquet(path).groupBy("alert_type", "severity", "title", "message").agg(F.count(F.lit(1)).alias("alerts"))


@query("unread_alerts", f"""SELECT alert_type, severity, title, message, anomaly_type, source_ip, created_at FROM (
 SELECT type AS alert_type, severity, concat(type, ' Detetado') AS title, detail AS message, type AS anomaly_type, source_ip,
 {clock('event_ts')} AS created_at FROM ({SQL_ALERTS}) a WHERE type NOT IN ('XSS', 'SCANNER') AND line_number > 0) b
 ORDER BY created_at DESC, source_ip, alert_type LIMIT 50""")
def unread_alerts(spark, sf_dir):
    """XSS alerts have been read; the rest is listed newest first, alerts at their event time."""
    rows = stored_frame(access_findings(spark, sf_dir), "findings")
    made = alerts.make_alerts(rows.withColumn("detected_ts", F.col("event_ts"))).withColumn(
        "alert_id", F.struct("anomaly_id"))
    ids = rows.select(F.col("id").alias("anomaly_id"), F.struct("source_ip", "type").alias("key"))
    # Spark guesses the size of computed rows from that of their file, far too low, and would broadcast them
    made = made.join(ids.hint("merge"), "anomaly_id").withColumn("alert_id", F.col("key")).drop("key")
    read = made.filter("alert_type = 'XSS'").select("alert_id")
    actions = read.withColumns({"action": F.lit("read"), "acted_at": F.lit(None).cast("timestamp_ntz")})
    return alerts.unread_alerts(made, rows, actions).select(
        "alert_type", "severity", "title", "message", "anomaly_type", "source_ip",
        clock_text(F.col("created_at")).alias("created_at"))


@query("mark_read", f"""SELECT type AS alert_type, CAST(max(CASE WHEN type = 'XSS' THEN 1 ELSE 0 END) AS INT) AS is_read,
 CAST(max(CASE WHEN type = 'XXE' THEN 1 ELSE 0 END) AS INT) AS is_dismissed, count(*) AS alerts FROM ({SQL_ALERTS}) a GROUP BY type""")
def mark_read(spark, sf_dir):
    """State after some alerts were read and others dismissed."""
    made = alerts.make_alerts(access_findings(spark, sf_dir))
    actions = alerts.mark_read(made.filter("alert_type = 'XSS'"), at=INGEST).unionByName(
        alerts.dismiss(made.filter("alert_type = 'XXE'"), at=INGEST))
    state = alerts.alert_state(made, actions)
    return state.groupBy("alert_type").agg(
        F.max(F.col("is_read").cast("int")).alias("is_read"), F.max(F.col("is_dismissed").cast("int")).alias("is_dismissed"),
        F.count(F.lit(1)).alias("alerts"))


SQL_CORRELATE = f"""SELECT source_ip, string_agg(DISTINCT type, ',' ORDER BY type) AS attack_types, count(*) AS "count",
 CAST(least(0.9, 0.3 * count(DISTINCT type)) AS DOUBLE) AS confidence,
 concat('Ataque multi-vetor de ', source_ip, ': ', string_agg(DISTINCT type, ', ' ORDER BY type)) AS description
 FROM ({SQL_FINDINGS}) f WHERE source_ip IS NOT NULL GROUP BY source_ip HAVING count(*) >= 3 AND count(DISTINCT type) >= 2"""


def group_rows(rows: DataFrame) -> DataFrame:
    return rows.select("source_ip", F.array_join("attack_types", ",").alias("attack_types"), "count",
                       F.round("confidence", 6).alias("confidence"), "description")


@query("correlate", SQL_CORRELATE)
def correlate_query(spark, sf_dir):
    return group_rows(correlate.correlate(access_findings(spark, sf_dir)))


@query("mark_correlated", f"""SELECT type, count(*) FILTER (g.source_ip IS NOT NULL) AS correlated, count(*) AS findings
 FROM ({SQL_FINDINGS}) f LEFT JOIN ({SQL_CORRELATE}) g ON g.source_ip = f.source_ip GROUP BY type""")
def mark_correlated(spark, sf_dir):
    rows = access_findings(spark, sf_dir)
    marked = correlate.mark_correlated(rows, correlate.correlate(rows))
    return marked.groupBy("type").agg(F.count_if("is_correlated").alias("correlated"), F.count(F.lit(1)).alias("findings"))


@query("write_correlations", f"""SELECT g.source_ip, g."count", count(*) AS members FROM ({SQL_CORRELATE}) g
 JOIN ({SQL_FINDINGS}) f ON f.source_ip = g.source_ip GROUP BY g.source_ip, g."count" """)
def write_correlations(spark, sf_dir):
    path = stored(access_findings(spark, sf_dir), "correlations",
                  lambda df, p: sinks.write_correlations(df, p, created_at=INGEST))
    groups, members = spark.read.parquet(f"{path}/groups"), spark.read.parquet(f"{path}/members")
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    return groups.join(sizes.hint("merge"), "group_id").select("source_ip", "count", "members")  # a row per address: never broadcast


@query("read_correlations", f"SELECT row_number() OVER (ORDER BY source_ip) AS n, source_ip, attack_types FROM ({SQL_CORRELATE}) g")
def read_correlations(spark, sf_dir):
    """Groups newest first; here the groups were made in the order of their addresses, backwards."""
    groups = correlate.correlate(access_findings(spark, sf_dir)).withColumns({
        "created_at": F.lit(0), "group_id": F.col("source_ip")})
    listed = correlate.read_correlations(groups).withColumn("place", F.monotonically_increasing_id())  # the order they come in
    return numbering.number_rows(listed, "place", name="n").select(
        "n", "source_ip", F.array_join("attack_types", ",").alias("attack_types"))


@query("novelty_filter", f"""SELECT a.line_number, a.source_ip FROM ({SQL_AUTH}) a WHERE NOT EXISTS (
 SELECT 1 FROM (SELECT DISTINCT source_ip FROM ({SQL_FINDINGS}) f WHERE type = 'XXE') k WHERE k.source_ip IS NOT DISTINCT FROM a.source_ip)
""")
def novelty_filter(spark, sf_dir):
    """The sign-in lines of addresses without an XXE finding."""
    known = access_findings(spark, sf_dir).filter("type = 'XXE'")
    return forest.novelty_filter(auth_entries(spark, sf_dir), known).select("line_number", "source_ip")


SQL_INPUTS = "SELECT concat('/logs/user', user_id % 500, '.log') AS path, event_type AS name, CAST(event_id AS BIGINT) AS size, ts AS loaded_at FROM events"


@query("recent_inputs", f"""SELECT path, name, size, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded_at FROM (SELECT *, row_number() OVER (
 PARTITION BY path ORDER BY loaded_at DESC, name DESC, size DESC) AS r FROM ({SQL_INPUTS}) i) j WHERE r = 1
 ORDER BY j.loaded_at DESC, path LIMIT 20""")
def recent_inputs(spark, sf_dir):
    inputs = corpus.table(spark, sf_dir, "events").selectExpr(
        "concat('/logs/user', user_id % 500, '.log') AS path", "event_type AS name", "event_id AS size", "ts AS loaded_at")
    return alerts.recent_inputs(inputs).withColumn("loaded_at", clock_text(F.col("loaded_at")))


@query("row_id", f"""SELECT row_number() OVER (ORDER BY {ORDER}) AS row_id, line_number, type FROM ({SQL_FINDINGS}) f""")
def row_id(spark, sf_dir):
    return numbering.number_rows(access_findings(spark, sf_dir), *findings.order_keys()).select("row_id", "line_number", "type")


SQL_OF_SESSION = "concat('s', line_number % 3)"


@query("clear", f"""SELECT strftime(event_ts, '%Y-%m-%d') AS event_date, {SQL_OF_SESSION} AS session_id, type, count(*) AS findings, CAST(count(*) FILTER (line_number % 5 > 0) AS BIGINT) AS rewritten
 FROM ({SQL_FINDINGS}) f WHERE {SQL_OF_SESSION} <> 's1' AND ({SQL_OF_SESSION} <> 's2' OR line_number % 5 > 0) GROUP BY 1, 2, 3""")
def clear(spark, sf_dir):
    """Findings of three sessions are stored; one session comes again with fewer rows, one is cleared; what the table holds then."""
    path = scratch_dir(spark, "session-findings")
    rows = access_findings(spark, sf_dir).withColumn("session_id", F.concat(F.lit("s"), (F.col("line_number") % 3).cast("string")))
    tables.write_session_findings(rows, path)
    tables.write_session_findings(rows.filter("session_id = 's2' AND line_number % 5 > 0"), path)
    tables.clear_findings(spark, path, "s1")
    return tables.stored_findings(spark, path).groupBy(F.col("event_date").cast("string").alias("event_date"), "session_id", "type").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("line_number") % 5 > 0).alias("rewritten"))


@query("union_findings", f"""SELECT type, count(*) AS findings FROM (SELECT type FROM ({SQL_FINDINGS}) f
 UNION ALL SELECT 'BRUTE_FORCE' FROM ({SQL_BRUTE}) b) u GROUP BY type""")
def union_findings(spark, sf_dir):
    """Entries are parsed once and written: the rate rule reads its rows twice."""
    logins = stored_frame(auth_entries(spark, sf_dir).select(*RULE_COLUMNS, "user"), "login-entries")
    found = findings.union_findings(
        access_findings(spark, sf_dir), rates.detect_brute_force(logins, ingest_ts=INGEST, **BRUTE))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("findings"))


@query("types_of_ip", f"""SELECT source_ip, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM ({SQL_FINDINGS}) f
 WHERE source_ip IS NOT NULL GROUP BY source_ip""")
def types_of_ip(spark, sf_dir):
    return access_findings(spark, sf_dir).groupBy("source_ip").agg(
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


# --- sinks ------------------------------------------------------------------------------------

@query("read_anomalies", f"""SELECT {SQL_FINDING} FROM ({SQL_FINDINGS}) f
 WHERE event_ts >= TIMESTAMP '2024-01-05 00:00:00' AND event_ts <= TIMESTAMP '2024-01-09 12:00:00'""")
def read_anomalies(spark, sf_dir):
    """Findings written by day and read back for a range of days."""
    path = stored(access_findings(spark, sf_dir), "anomalies", sinks.write_anomalies)
    return finding_rows(sinks.read_anomalies(spark, path, start="2024-01-05 00:00:00", end="2024-01-09 12:00:00"))


@query("write_anomalies", f"""SELECT strftime(event_ts, '%Y-%m-%d') AS event_date, type, count(*) AS findings, round(sum(score), 4) AS score
 FROM ({SQL_FINDINGS}) f GROUP BY 1, 2""")
def write_anomalies(spark, sf_dir):
    path = stored(access_findings(spark, sf_dir), "anomalies", sinks.write_anomalies)
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date"), "type").agg(
        F.count(F.lit(1)).alias("findings"), F.round(F.sum("score"), 4).alias("score"))


@query("write_timeline", f"""SELECT type AS event_type, severity, source_ip, substr(detail, 1, 200) AS description, count(*) AS rows_written
 FROM ({SQL_FINDINGS}) f GROUP BY 1, 2, 3, 4""")
def write_timeline(spark, sf_dir):
    path = stored(access_findings(spark, sf_dir), "timeline", sinks.write_timeline)
    return spark.read.parquet(path).groupBy("event_type", "severity", "source_ip", "description").agg(
        F.count(F.lit(1)).alias("rows_written"))


@query("write_session", f"""SELECT 's-1' AS session_id, '2024-02-01 00:00:00' AS start_time, '2024-02-01 00:10:00' AS end_time,
 CAST(NULL AS BIGINT) AS files_analyzed, (SELECT count(*) FROM events) AS total_lines, count(*) AS anomalies_found, 'COMPLETED' AS status FROM ({SQL_FINDINGS}) f
 UNION ALL SELECT 's-2', '2024-02-01 00:00:00', '2024-02-01 00:20:00', CAST(1 AS BIGINT), (SELECT count(*) FROM events), count(*), 'COMPLETED' FROM ({SQL_FINDINGS}) f
 UNION ALL SELECT 's-3', '2024-02-01 00:00:00', NULL, NULL, NULL, NULL, 'RUNNING'""")
def write_session(spark, sf_dir):
    """Three sessions begin; two end with the totals of the run, one of them by its whole row, and both twice: a row each is stored."""
    path, end = scratch_dir(spark, "sessions"), "2024-02-01 00:10:00"
    entries, found = access_entries(spark, sf_dir), access_findings(spark, sf_dir)
    for name in ("s-1", "s-2", "s-3"):
        tables.write_sessions(alerts.start_session(spark, session_id=name, start=INGEST), path)
    n_lines, n_found = entries.count(), found.count()
    for _ in range(2):
        tables.end_session(spark, path, "s-1", end=end, total_lines=n_lines, anomalies_found=n_found)
        tables.write_sessions(alerts.session_row(entries, found, session_id="s-2", start=INGEST, end="2024-02-01 00:20:00"), path)
    tables.end_session(spark, path, "unknown", end=end)
    return tables.stored_sessions(spark, path).select(
        "session_id", clock_text(F.col("start_time")).alias("start_time"), clock_text(F.col("end_time")).alias("end_time"),
        "files_analyzed", "total_lines", "anomalies_found", "status")


@query("read_sessions", """SELECT concat('day-', strftime(d, '%Y-%m-%d')) AS session_id, n AS total_lines FROM (
 SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1) x ORDER BY d DESC LIMIT 20""")
def read_sessions(spark, sf_dir):
    """Every day of events as one session."""
    days = corpus.table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("total_lines"))
    rows = days.select(F.concat(F.lit("day-"), F.col("d").cast("string")).alias("session_id"),
                       F.col("d").cast("timestamp_ntz").alias("start_time"), "total_lines")
    return alerts.read_sessions(rows).select("session_id", "total_lines")


SQL_SHORT_FEATURES = "request_length, url_length, num_dots, num_slashes, status_code_class, ip_octet_4"


@query("save_training", """SELECT label, count(*) AS vectors, sum(CAST(hour(ts) AS BIGINT)) AS hours
 FROM (SELECT ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events) e GROUP BY label""")
def save_training(spark, sf_dir):
    entries = extract_features(access_entries(spark, sf_dir)).withColumn("label", (F.col("status") == "401").cast("int"))
    path = stored(entries, "training", lambda df, p: sinks.save_training(df, p, created_at=INGEST))
    return spark.read.parquet(path).groupBy("label").agg(
        F.count(F.lit(1)).alias("vectors"), F.sum(F.get("features", F.lit(0)).cast("bigint")).alias("hours"))


@query("read_training", """SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, event_id, CAST(hour(ts) AS INT) AS hour_of_day
 FROM events ORDER BY ts DESC, event_id LIMIT 1000""")
def read_training(spark, sf_dir):
    """The newest labelled vectors of the events."""
    vectors = corpus.table(spark, sf_dir, "events").select(
        F.array(F.hour("ts").cast("double"), F.col("event_id").cast("double")).alias("features"),
        (F.col("event_type") == "error").cast("int").alias("label"), F.col("event_type").alias("anomaly_type"),
        F.col("ts").alias("created_at"))
    return files.read_training(vectors, 1000).select(
        "label", F.get("features", F.lit(1)).cast("bigint").alias("event_id"),
        F.get("features", F.lit(0)).cast("int").alias("hour_of_day"))


SQL_EXPORT = f"""SELECT CAST(row_number() OVER (ORDER BY {ORDER}) AS STRING) AS id, type, severity, source_ip, target, detail,
 strftime(event_ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", CAST(round(score, 6) AS STRING) AS score, log_file FROM ({SQL_FINDINGS}) f"""


@query("export_csv", SQL_EXPORT)
def export_csv(spark, sf_dir):
    path = stored(access_findings(spark, sf_dir), "report-csv", sinks.export_csv)
    schema = ", ".join(f"{c} string" for c in fixed.EXPORT_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("escape", "\\").csv(path)


@query("export", SQL_EXPORT)
def export(spark, sf_dir):
    path = scratch_dir(spark, "report")
    sinks.export(access_entries(spark, sf_dir), access_findings(spark, sf_dir), path, "CSV")
    schema = ", ".join(f"{c} string" for c in fixed.EXPORT_COLUMNS)
    return spark.read.schema(schema).option("header", True).csv(path)


@query("export_json", f"""WITH f AS MATERIALIZED ({SQL_FINDINGS}) SELECT (SELECT count(*) FROM events) AS total_entries_processed,
 count(*) AS total_anomalies, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (type = 'XSS') AS xss,
 (SELECT source_ip FROM f WHERE source_ip IS NOT NULL GROUP BY source_ip ORDER BY count(*) DESC, source_ip LIMIT 1) AS first_ip,
 count(*) AS listed FROM f""")
def export_json(spark, sf_dir):
    path = scratch_dir(spark, "report-json")
    sinks.export_json(access_entries(spark, sf_dir), access_findings(spark, sf_dir), path)
    summary = spark.read.schema("total_entries_processed bigint, total_anomalies bigint, by_severity map<string,bigint>, "
                                "by_type map<string,bigint>, top_ips array<struct<ip:string,count:bigint>>").json(f"{path}/summary")
    listed = spark.read.schema("type string").json(f"{path}/anomalies").agg(F.count(F.lit(1)).alias("listed"))
    one = F.lit(1)
    return summary.withColumn("_one", one).join(listed.withColumn("_one", one), "_one").select(
        "total_entries_processed", "total_anomalies", F.col("by_severity")["CRITICAL"].alias("critical"),
        F.col("by_type")["XSS"].alias("xss"), F.get("top_ips", F.lit(0))["ip"].alias("first_ip"), "listed")


@query("normalise_for_export", f"""SELECT type, severity, source_ip, target, detail, strftime(event_ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp",
 round(score, 6) AS score, log_file, evidence FROM ({SQL_FINDINGS}) f""")
def normalise_for_export(spark, sf_dir):
    return sinks.normalise_for_export(access_findings(spark, sf_dir)).withColumns({
        "score": F.round("score", 6), "evidence": F.get("evidence", F.lit(0))})


# --- events ---------------------------------------------------------------------------------------

SQL_EVENT = f"""SELECT strftime(event_ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", log_file AS source, type AS event_type, severity,
 detail AS message, source_ip, target, evidence AS raw_log FROM ({SQL_FINDINGS}) f"""


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_event(access_findings(spark, sf_dir))


@query("to_event", f"SELECT *, event_type AS tag FROM ({SQL_EVENT}) e")
def to_event_query(spark, sf_dir):
    return access_events(spark, sf_dir).select(
        "timestamp", "source", "event_type", "severity", "message", "source_ip", "target", "raw_log",
        F.array_join("tags", ",").alias("tag"))


@query("to_event_json", f"""SELECT event_type, source_ip, target, application, count(*) AS events FROM (
 SELECT event_type, source_ip, target, 'emberlog' AS application FROM ({SQL_EVENT}) e) g GROUP BY 1, 2, 3, 4""")
def to_event_json_query(spark, sf_dir):
    """The JSON text read back."""
    text = to_event_json(access_events(spark, sf_dir))
    parsed = F.from_json("value", "event_type string, source_ip string, target string, application string")
    return text.select(parsed.alias("e")).select("e.*").groupBy("event_type", "source_ip", "target", "application").agg(
        F.count(F.lit(1)).alias("events"))


_SYSLOG_LEVEL = oracle.case("severity", {s: 128 + n for s, n in fixed.SYSLOG_SEVERITIES.items()}, "134")


SQL_SYSLOG = f"""SELECT concat('<', {_SYSLOG_LEVEL}, '>1 ', "timestamp", ' - emberlog - ', upper(event_type), ' [emberlog@0 severity="', severity,
 '" type="', event_type, '"', CASE WHEN source_ip <> '' THEN concat(' sourceIP="', source_ip, '"') ELSE '' END, '] ', message) AS value
 FROM ({SQL_EVENT}) e"""
SQL_CEF = f"""SELECT concat('CEF:0|emberlog|SecurityAnalyzer|1.0|', event_type, '|', event_type, '|', {oracle.case('severity', fixed.CEF_SEVERITIES, '5')},
 '|msg=', message, CASE WHEN source_ip <> '' THEN concat(' src=', source_ip) ELSE '' END,
 CASE WHEN target <> '' THEN concat(' dst=', target) ELSE '' END) AS value FROM ({SQL_EVENT}) e"""


@query("to_syslog_line", SQL_SYSLOG)
def to_syslog_query(spark, sf_dir):
    return to_syslog_line(access_events(spark, sf_dir))


@query("to_cef_line", SQL_CEF)
def to_cef_query(spark, sf_dir):
    return to_cef_line(access_events(spark, sf_dir))


@query("event_filter", f"""SELECT "timestamp", event_type, severity, substr(message, 1, 12) AS message FROM ({SQL_EVENT}) e
 WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM')""")
def event_filter_query(spark, sf_dir):
    return event_filter(access_events(spark, sf_dir), max_message_length=12).select("timestamp", "event_type", "severity", "message")


@query("sink_jsonl", f"SELECT event_type, severity, count(*) AS events FROM ({SQL_EVENT}) e GROUP BY 1, 2")
def sink_jsonl(spark, sf_dir):
    path = stored(access_events(spark, sf_dir), "events", lambda df, p: sinks.sink_jsonl(df, p, max_records=5000))
    return spark.read.schema("event_type string, severity string").json(path).groupBy("event_type", "severity").agg(
        F.count(F.lit(1)).alias("events"))


ROTATE_AT = 100_000


@query("sink_jsonl_rotated", f"""SELECT event_type, severity, count(*) AS events, true AS files_are_bounded, true AS files_are_full FROM ({SQL_EVENT}) e GROUP BY 1, 2""")
def sink_jsonl_rotated(spark, sf_dir):
    """All events in files of 100,000 bytes and a line at most; but for the last, none has less."""
    path = stored(access_events(spark, sf_dir), "events", lambda df, p: sinks.sink_jsonl(df, p, max_bytes=ROTATE_AT))
    lines, size = spark.read.text(path), F.octet_length("value") + 1  # the many folders are listed once
    files = lines.withColumn("file", F.input_file_name()).groupBy("part").agg(
        F.sum(size).alias("bytes"), F.max(size).alias("longest"), F.count_distinct("file").alias("files"))
    whole = files.withColumn("last", F.col("part") == F.max("part").over(W.partitionBy())).agg(
        F.bool_and((F.col("bytes") <= ROTATE_AT + F.col("longest")) & (F.col("files") == 1)).alias("files_are_bounded"),
        F.bool_and((F.col("bytes") > ROTATE_AT - F.col("longest")) | F.col("last")).alias("files_are_full"))
    events = lines.select(F.from_json("value", "event_type string, severity string").alias("e")).select("e.*")
    counted = events.groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("events"))
    return counted.join(F.broadcast(whole), F.lit(True))


@query("sink_text", SQL_CEF)
def sink_text(spark, sf_dir):
    path = stored(to_cef_line(access_events(spark, sf_dir)), "cef", sinks.sink_text)
    return spark.read.text(path)


@query("fan_out", f"SELECT 'cef' AS sink, value FROM ({SQL_CEF}) c UNION ALL SELECT 'syslog', value FROM ({SQL_SYSLOG}) s")
def fan_out(spark, sf_dir):
    """Every finding to two sinks; a third is switched off."""
    cef, syslog = scratch_dir(spark, "cef"), scratch_dir(spark, "syslog")
    targets = sinks.SinkList([
        {"name": "cef", "type": "cef_text", "path": cef}, {"name": "log", "type": "syslog_text", "path": syslog},
        {"name": "off", "type": "file", "path": scratch_dir(spark, "off"), "enabled": False}])
    sinks.fan_out_findings(access_findings(spark, sf_dir), targets)
    both = [spark.read.text(p).select(F.lit(n).alias("sink"), "value") for n, p in (("cef", cef), ("syslog", syslog))]
    return both[0].unionByName(both[1])


# --- whole runs -------------------------------------------------------------------------------------

THRESHOLDS = {"login": BRUTE, "ddos": DDOS, "residual": {"at_least": 2}}
SQL_RUN_ROWS = """SELECT source_ip, row_number() OVER (PARTITION BY source_ip ORDER BY log_file, line_number) AS n,
 epoch_us(coalesce(ts, TIMESTAMP '{ingest}')) AS t, log_file, line_number FROM e WHERE source_ip IS NOT NULL AND {where}"""
SQL_RUN = f"""WITH RECURSIVE e AS MATERIALIZED ({SQL_MIXED}),
 {oracle.reset_part('brute', SQL_RUN_ROWS.format(ingest=INGEST, where="log_type = 'AUTH' AND status = 'FAILED'"), BRUTE['window_seconds'] * 1_000_000, BRUTE['attempts'])},
 {oracle.reset_part('ddos', SQL_RUN_ROWS.format(ingest=INGEST, where="log_type IN ('WEB_ACCESS', 'WEB_ERROR')"), DDOS['window_seconds'] * 1_000_000, DDOS['requests'])},
 found AS MATERIALIZED (SELECT log_file, line_number, type, severity, source_ip, target, detail, evidence, event_ts, score FROM ({oracle.signature_findings('SELECT * FROM e')}) s
 UNION ALL SELECT log_file, line_number, type, severity, source_ip, target, detail, evidence, event_ts, score FROM ({oracle.unauthorized_findings('SELECT * FROM e')}) u
 UNION ALL SELECT w.log_file, w.line_number, 'BRUTE_FORCE', 'HIGH', w.source_ip, e.usr, 'Brute-force: {BRUTE['attempts']} tentativas em {BRUTE['window_seconds']}s', e.raw_line, make_timestamp(w.t),
  CAST(0.75 + 0.04 AS DOUBLE) FROM w_brute w JOIN e USING (line_number) WHERE fired
 UNION ALL SELECT w.log_file, w.line_number, 'DDOS', 'CRITICAL', w.source_ip, NULL, 'Possível DDoS: {DDOS['requests']} requests em {DDOS['window_seconds']}s', NULL, make_timestamp(w.t),
  CAST({DDOS['requests'] / 200} AS DOUBLE) FROM w_ddos w WHERE fired
 UNION ALL SELECT NULL, NULL, 'SUSPICIOUS_ACCESS', 'LOW', source_ip, NULL, concat('IP suspeito: ', len(held), ' tentativas falhadas'), NULL, TIMESTAMP '{INGEST}', CAST(0.4 AS DOUBLE)
  FROM (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY n DESC) AS back FROM w_brute) x WHERE back = 1 AND len(held) >= 2)"""


def run_over_mixed(spark: SparkSession, sf_dir: str, **how):
    return analyse(corpus.lines(spark, sf_dir, "mixed"), default_year=YEAR, ingest_ts=INGEST, session_id="run", extended=False, thresholds=THRESHOLDS, **how)


@query("analyse_run", f"{SQL_RUN} SELECT {SQL_FINDING}, 'run' AS session_id FROM found")
def analyse_run(spark, sf_dir):
    """A whole run over mixed lines: every finding of every rule."""
    found = run_over_mixed(spark, sf_dir).findings
    return finding_rows(found).join(found.select("session_id").distinct(), F.lit(True))


@query("analyse_known_model", f"""{SQL_RUN} SELECT count(DISTINCT line_number) AS lines_of_rules, count(*) AS rule_findings, CAST(0 AS BIGINT) AS model_on_lines_of_rules,
 true AS some_are_found, true AS all_are_sure, true AS none_is_lost FROM found""")
def analyse_known_model(spark, sf_dir):
    """A model that was fitted on access lines, stored and loaded, in a run over mixed lines: it adds findings only where no rule has any."""
    path = scratch_dir(spark, "model")
    forest.save_model(spark, forest.fit_isolation_forest(_keyed(extract_features(access_entries(spark, sf_dir))), KEYS, contamination=0.15), path)
    model = forest.load_model(spark, path)
    run = run_over_mixed(spark, sf_dir, model=model, model_confidence=0.5)
    rules, added = run.findings.filter("rule <> 'known_model'"), run.findings.filter("rule = 'known_model'")
    of_rules = rules.filter("line_number IS NOT NULL").select("log_file", "line_number").distinct()
    sure = forest.score_isolation_forest(extract_features(run.entries), model).filter("is_anomaly AND confidence > 0.5")
    wanted = sure.join(of_rules, KEYS, "left_anti").agg(F.count(F.lit(1)).alias("wanted"))
    one = lambda df: df.withColumn("one", F.lit(1))
    counted = one(rules.agg(F.count(F.lit(1)).alias("rule_findings"))).join(one(of_rules.agg(F.count(F.lit(1)).alias("lines_of_rules"))), "one").join(
        one(added.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("score") > 0.5), F.lit(True)).alias("all_are_sure"))), "one").join(
        one(added.join(of_rules, KEYS, "left_semi").agg(F.count(F.lit(1)).alias("model_on_lines_of_rules"))), "one").join(one(wanted), "one")
    return counted.select("lines_of_rules", "rule_findings", "model_on_lines_of_rules", (F.col("n") > 0).alias("some_are_found"), "all_are_sure", (F.col("n") == F.col("wanted")).alias("none_is_lost"))


# --- detectors --------------------------------------------------------------------------------------

SQL_API_FIRES = f"""{oracle.reset_fires(_numbered(SQL_ACCESS, "regexp_matches(coalesce(url, ''), '/api/|/v1/|/v2/|/graphql')"),
    API['window_seconds'] * 1_000_000 - 1, API['requests'])} SELECT count(*) FROM w WHERE fired"""
SQL_SENSITIVE_ACCESS = " OR ".join(oracle.has("concat(raw_line, ' ', url)", p) for p in fixed.SENSITIVE_PATTERNS)


def access_registry() -> DetectorRegistry:
    registry = DetectorRegistry()
    registry.configure("api_abuse", **API)
    return registry


SQL_DETECTIONS = f"""SELECT 'api_abuse' AS plugin_id, ({SQL_API_FIRES}) AS detections
 UNION ALL SELECT 'sensitive_data', count(*) FROM ({SQL_ACCESS}) e WHERE {SQL_SENSITIVE_ACCESS}
 UNION ALL SELECT 'anomalous_time', count(*) FROM ({SQL_ACCESS}) e WHERE hour(ts) < 8 OR hour(ts) >= 20 OR isodow(ts) >= 6"""


@query("run_all_detectors", SQL_DETECTIONS)
def run_all_detectors(spark, sf_dir):
    found = access_registry().run_all(access_entries(spark, sf_dir), ingest_ts=INGEST)
    return found.groupBy(F.col("extra")["plugin_id"].alias("plugin_id")).agg(F.count(F.lit(1)).alias("detections"))


@query("run_one_detector", f"""SELECT line_number, 'Sensitive Data Detector' AS plugin_name FROM ({SQL_ACCESS}) e WHERE {SQL_SENSITIVE_ACCESS}""")
def run_one_detector(spark, sf_dir):
    found = DetectorRegistry().run_one("sensitive_data", access_entries(spark, sf_dir), ingest_ts=INGEST)
    return found.select("line_number", F.col("extra")["plugin_name"].alias("plugin_name"))


@query("detector_stats", f"SELECT plugin_id, (SELECT count(*) FROM events) AS entries_processed, detections FROM ({SQL_DETECTIONS}) d")
def detector_stats_query(spark, sf_dir):
    registry, entries = access_registry(), access_entries(spark, sf_dir)
    return detector_stats(entries, registry.run_all(entries, ingest_ts=INGEST), registry)


# --- features and models ---------------------------------------------------------------------------------

def _flag(words: list[str], text: str) -> str:
    return "CAST(" + " OR ".join(f"contains(lower({text}), {lit(w)})" for w in words) + " AS INT)"


def _octet(i: int) -> str:
    return f"coalesce(TRY_CAST(string_split(source_ip, '.')[{i}] AS INT), 0)"


_SQL_FEATURES = {
    "hour_of_day": "coalesce(hour(ts), 12)", "day_of_week": "coalesce(isodow(ts) - 1, 3)",
    "request_length": "length(m)", "url_length": "length(u)",
    "num_special_chars": "length(regexp_replace(m, '[\\pL\\pN \\t\\n]', '', 'g'))",
    "num_dots": "length(m) - length(replace(m, '.', ''))",
    "num_slashes": "length(m) - length(replace(replace(m, '/', ''), chr(92), ''))",
    "num_params": "length(u) - length(replace(replace(u, '&', ''), '?', ''))",
    "has_sql_keywords": _flag(fixed.FEATURE_SQL_WORDS, "m"), "has_script_tags": "CAST(contains(lower(m), '<script') AS INT)",
    "has_path_traversal": "CAST(contains(m, '../') AS INT)", "has_encoded_chars": "CAST(contains(m, '%') AS INT)",
    "status_code_class": "CASE WHEN st IS NULL THEN 2 ELSE coalesce(TRY_CAST(st AS INT) // 100, 2) END",
    "is_error_status": "CASE WHEN TRY_CAST(st AS INT) >= 400 THEN 1 ELSE 0 END",
    "response_size": "coalesce(TRY_CAST(size AS BIGINT), 0)",
    "ip_octet_1": f"CASE WHEN contains(source_ip, '.') THEN {_octet(1)} ELSE 0 END",
    "ip_octet_4": f"CASE WHEN contains(source_ip, '.') THEN {_octet(4)} ELSE 0 END",
    "is_private_ip": f"""CASE WHEN contains(source_ip, '.') AND ({_octet(1)} IN (10, 127) OR ({_octet(1)} = 192
 AND string_split(source_ip, '.')[2] = '168')) THEN 1 ELSE 0 END""",
    "user_agent_length": "length(coalesce(user_agent, ''))",
    "is_known_scanner": _flag(fixed.FEATURE_SCANNERS, "coalesce(user_agent, '')"),
}
SQL_FEATURES = "SELECT line_number, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _SQL_FEATURES.items()) + f"""
 FROM (SELECT *, coalesce(nullif(message, ''), raw_line) AS m, coalesce(nullif(url, ''), target, '') AS u,
 coalesce(nullif(status, ''), CAST(status_code AS STRING)) AS st FROM ({SQL_MIXED}) e0) e1"""


def mixed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_features(entries_of(spark, sf_dir, "mixed"))


@query("extract_features", SQL_FEATURES)
def extract_features_query(spark, sf_dir):
    return mixed_features(spark, sf_dir).select("line_number", *FEATURES)


_SQL_SCALED = ", ".join(f"""round(({n} - avg({n}) OVER ()) / CASE WHEN stddev_pop({n}) OVER () > 0 THEN stddev_pop({n}) OVER () ELSE 1 END, 6) + 0.0 AS {n}"""
                        for n in FEATURES)


@query("scale", f"SELECT line_number, {_SQL_SCALED} FROM ({SQL_FEATURES}) f")
def scale_query(spark, sf_dir):
    """The features are written once: mean and deviation are read from them first, then all rows."""
    scaled = scale(stored_frame(mixed_features(spark, sf_dir).select("line_number", *FEATURES), "features"))
    return scaled.select("line_number", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in FEATURES])


def _keyed(features: DataFrame) -> DataFrame:
    """Features written once: the forest reads them several times."""
    path = scratch_dir(features.sparkSession, "features")
    kept = features.select("log_file", "line_number", "raw_line", "source_ip", "target", "url", "ts", *FEATURES)
    kept.write.parquet(path)
    return features.sparkSession.read.schema(kept.schema).parquet(path)


KEYS = ["log_file", "line_number"]


def within_share(found: Column, at_most_cut: Column, n: Column, share: float) -> Column:
    """Whether a share of the rows are outliers, within rounding; rows equal to the cut may be either."""
    return (found <= F.ceil(F.lit(share) * n)) & (at_most_cut >= F.floor(F.lit(share) * n))


@query("fit_isolation_forest", """SELECT true AS is_trained, count(*) AS samples_trained, least(256, count(*)) AS sample_size, CAST(100 AS BIGINT) AS trees,
 CAST(0.15 AS DOUBLE) AS contamination, true AS found_within_share, true AS trees_are_bounded FROM events""")
def fit_isolation_forest(spark, sf_dir):
    """What training reports: rows, size of the draws, trees, and whether the outliers are the share asked for."""
    model = forest.fit_isolation_forest(_keyed(mixed_features(spark, sf_dir)), KEYS, contamination=0.15)
    bounded = bool((model.nodes.groupby("tree").size() < 2 * model.sample_size).all() and (model.nodes["depth"] >= 0).all())
    n = model.samples_trained
    return forest.model_info(spark, model).select(
        "is_trained", F.col("samples_trained").cast("bigint").alias("samples_trained"), F.col("sample_size").cast("bigint").alias("sample_size"),
        F.lit(model.nodes["tree"].nunique()).cast("bigint").alias("trees"), "contamination",
        F.lit(abs(model.anomalies_found - 0.15 * n) <= max(1.0, 0.01 * n)).alias("found_within_share"), F.lit(bounded).alias("trees_are_bounded"))


@query("score_isolation_forest", """SELECT count(*) AS scored, true AS within_share, true AS confidence_follows, true AS sign_follows, true AS equal_rows_agree FROM events""")
def score_isolation_forest(spark, sf_dir):
    """Every line has a score; outliers are the share asked for, the confidence follows the score, equal lines have equal scores."""
    rows = _keyed(mixed_features(spark, sf_dir))
    scored = forest.score_isolation_forest(rows, forest.fit_isolation_forest(rows, KEYS, contamination=0.15))
    same = scored.groupBy(*FEATURES).agg((F.max("anomaly_score") - F.min("anomaly_score")).alias("apart"), F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("found"),
                                         F.count_if(F.col("anomaly_score") <= 0).alias("at_most"),
                                         F.bool_and(F.abs(F.col("confidence") - F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - F.col("anomaly_score")))) < 1e-12).alias("follows"),
                                         F.bool_and(F.col("is_anomaly") == (F.col("anomaly_score") < 0)).alias("sign"))
    return same.agg(F.sum("n").alias("scored"), within_share(F.sum("found"), F.sum("at_most"), F.sum("n"), 0.15).alias("within_share"),
                    F.bool_and("follows").alias("confidence_follows"), F.bool_and("sign").alias("sign_follows"), (F.max("apart") == 0).alias("equal_rows_agree"))


@query("ml_findings", f"""SELECT (SELECT count(DISTINCT source_ip) FROM ({SQL_FINDINGS}) f WHERE type = 'XXE') AS known_addresses, CAST(0 AS BIGINT) AS of_known_addresses,
 true AS some_are_found, true AS all_are_sure, true AS none_is_lost""")
def ml_findings(spark, sf_dir):
    """Outliers of addresses that no error finding has named: all sure ones of other addresses, none of a known one."""
    rows = _keyed(mixed_features(spark, sf_dir))
    scored = stored_frame(forest.score_isolation_forest(rows, forest.fit_isolation_forest(rows, KEYS, contamination=0.15)), "scored")
    known = access_findings(spark, sf_dir).filter("type = 'XXE'")
    found = forest.ml_findings(scored, known, ingest_ts=INGEST, min_confidence=0.5)
    addresses = known.select("source_ip").distinct()
    named = F.broadcast(addresses.withColumn("named", F.lit(True))) if addresses.count() < 1_000_000 else addresses.withColumn("named", F.lit(True))
    flagged = found.join(named, found["source_ip"].eqNullSafe(named["source_ip"]), "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("named").alias("of_known_addresses"), F.coalesce(F.bool_and(F.col("score") > 0.5), F.lit(True)).alias("all_are_sure"))
    sure = scored.filter("is_anomaly AND confidence > 0.5").join(named, scored["source_ip"].eqNullSafe(named["source_ip"]), "left_anti").agg(F.count(F.lit(1)).alias("wanted"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(flagged).join(one(sure), "one").join(one(addresses.agg(F.count("source_ip").alias("known_addresses"))), "one").select(
        "known_addresses", "of_known_addresses", (F.col("n") > 0).alias("some_are_found"), "all_are_sure", (F.col("n") == F.col("wanted")).alias("none_is_lost"))


SQL_PROFILES = "SELECT * FROM (VALUES " + ", ".join(
    f"({lit(p)}, CAST({c} AS DOUBLE), (SELECT count(*) FROM events), true)" for p, c in fixed.PROFILES.items()) + ") v(profile, contamination, scored, within_share)"


@query("fit_profile", f"SELECT CAST({fixed.PROFILES['web_server']} AS DOUBLE) AS contamination, count(*) AS scored, true AS within_share FROM events")
def fit_profile(spark, sf_dir):
    """A forest of the web scenario, grown on the access lines, kept as a table and read back."""
    rows = _keyed(extract_features(access_entries(spark, sf_dir)))
    path = scratch_dir(spark, "model")
    forest.save_model(spark, forest.fit_profile(rows, KEYS, "web_server"), path)
    scored = forest.score_isolation_forest(rows, forest.load_model(spark, path))
    share = fixed.PROFILES["web_server"]
    counted = scored.agg(F.count(F.lit(1)).alias("scored"), F.count_if("is_anomaly").alias("found"), F.count_if(F.col("anomaly_score") <= 0).alias("at_most"))
    return counted.select(F.lit(share).alias("contamination"), "scored", within_share(F.col("found"), F.col("at_most"), F.col("scored"), share).alias("within_share"))


@query("model_profiles", SQL_PROFILES)
@query("fit_profiles", SQL_PROFILES)
def model_profiles(spark, sf_dir):
    """A forest for every profile. Of the rows scored, its share are outliers within rounding; rows equal to the cut may be either."""
    return profile_counts(_keyed(mixed_features(spark, sf_dir))).select(
        "profile", "contamination", "scored",
        ((F.col("outliers") <= F.ceil(F.col("contamination") * F.col("scored")))
         & (F.col("at_most_cut") >= F.floor(F.col("contamination") * F.col("scored")))).alias("within_share"))


def profile_counts(rows: DataFrame) -> DataFrame:
    """profile, contamination, rows scored, outliers found, and outliers with the rows equal to the cut, of a forest per profile."""
    found = None
    for profile in forest.model_profiles(rows.sparkSession).orderBy("profile").collect():
        scored = forest.score_isolation_forest(rows, forest.fit_profile(rows, KEYS, profile["profile"]))
        one = scored.agg(F.count(F.lit(1)).alias("scored"), F.count_if("is_anomaly").alias("outliers"),
                         F.count_if(F.col("anomaly_score") <= 0).alias("at_most_cut")).select(
            F.lit(profile["profile"]).alias("profile"), F.lit(profile["contamination"]).alias("contamination"), "scored", "outliers", "at_most_cut")
        found = one if found is None else found.union(one)
    return found


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every labelled document's text as one entry."""
    docs = corpus.table(spark, sf_dir, "documents").join(corpus.table(spark, sf_dir, "labels"), "doc_id")
    none = lambda t: F.lit(None).cast(t)
    return extract_features(docs.select(
        "doc_id", F.col("quality").alias("label"), F.col("text").alias("message"), F.col("text").alias("raw_line"),
        none("timestamp_ntz").alias("ts"), *[none("string").alias(c) for c in ("url", "target", "status", "size", "source_ip", "user_agent")],
        none("int").alias("status_code")))


SQL_LABELLED = "(SELECT d.text, l.quality FROM documents d JOIN labels l USING (doc_id))"


@query("fit_classifier", f"""SELECT count(*) FILTER (quality IS NOT NULL) AS samples_trained, string_agg(DISTINCT CAST(quality AS STRING), ',' ORDER BY CAST(quality AS STRING)) AS classes,
 true AS learned FROM {SQL_LABELLED} x""")
def fit_classifier(spark, sf_dir):
    """Rows, classes, and whether the rows held out are told apart better than by the larger class alone."""
    rows = labelled_documents(spark, sf_dir)
    fitted = classifier.fit_classifier(rows)
    larger = rows.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    return spark.range(1).select(F.lit(fitted.samples_trained).cast("bigint").alias("samples_trained"), F.lit(",".join(fitted.classes)).alias("classes"),
                                 F.lit(fitted.accuracy > larger).alias("learned"))


@query("predict_type", f"""SELECT length(regexp_replace(text, '[\\p{{L}}\\p{{N}} \\t\\n]', '', 'g')) > 20 AS is_anomaly, count(*) AS documents,
 CASE WHEN is_anomaly THEN count(*) ELSE 0 END AS predicted, true AS classes_are_known, true AS loaded_agrees FROM {SQL_LABELLED} x GROUP BY 1""")
def predict_type(spark, sf_dir):
    """Types of the documents flagged, of no others; a classifier that was stored and read back says the same."""
    rows, path = labelled_documents(spark, sf_dir).withColumn("is_anomaly", F.col("num_special_chars") > 20), scratch_dir(spark, "classifier")
    fitted = classifier.fit_classifier(rows)
    classifier.save_classifier(fitted, path)
    told = classifier.predict_type(rows, fitted)
    again = classifier.predict_type(told.withColumnRenamed("predicted_type", "first_type"), classifier.load_classifier(path))
    return again.groupBy("is_anomaly").agg(
        F.count(F.lit(1)).alias("documents"), F.count("first_type").alias("predicted"),
        F.coalesce(F.bool_and(F.col("first_type").isin(fitted.classes)), F.lit(True)).alias("classes_are_known"),
        F.bool_and(F.col("first_type").eqNullSafe(F.col("predicted_type"))).alias("loaded_agrees"))
