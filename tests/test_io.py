import os

import pytest
from pyspark.sql import functions as F

from emberlog.operators import alerts, dashboards
from emberlog.operators.correlate import correlate, correlation_members
from emberlog.operators.detectors import Detector, DetectorRegistry, batch_detector
from emberlog.operators.numbering import number_rows
from emberlog.operators.parse import parse_logs
from emberlog.operators.signatures import detect_off_hours, detect_signatures, detect_unauthorized
from emberlog.plans.pipeline import analyse
from emberlog.session import scratch_dir
from emberlog.sources import files, sinks, tables
from emberlog.streaming import live

NOW = "2024-04-01 00:00:00"
WEB = '10.0.0.%d - - [05/Mar/2024:09:%02d:00 +0000] "GET %s HTTP/1.1" %d 10'


def web_lines(lines):
    texts = [WEB % (1, 1, "/a/../../etc/passwd", 200), WEB % (1, 2, "/q?u=<script>", 403), WEB % (1, 3, "/ok", 200),
             WEB % (2, 4, "/x", 401), WEB % (3, 5, "/fine", 200)]
    return parse_logs(lines(texts), default_year=2024)


def test_line_numbers_over_many_blocks(spark, tmp_path):
    """Small splits: every number is the physical place of its line."""
    for name, n in (("a.log", 900), ("b.log", 1)):
        text = "".join(("\n" if i % 9 == 0 else f"  line {name} {i} \n") for i in range(1, n + 1))
        (tmp_path / name).write_bytes(text.encode() + b"bad \xff byte\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.read_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for row in rows:
        name = os.path.basename(row["log_file"])
        last = {"a.log": 901, "b.log": 2}[name]
        assert row["raw_line"] == ("bad  byte" if row["line_number"] == last else f"line {name} {row['line_number']}")
    assert len(rows) == 900 - 100 + 1 + 2


def test_number_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    rows = number_rows(df, "v").collect()
    assert sorted((r["row_id"], r["v"]) for r in rows) == [(i + 1, i) for i in range(5000)]


def test_findings_and_correlation(lines):
    entries = web_lines(lines)
    found = detect_signatures(entries, ingest_ts=NOW).unionByName(detect_unauthorized(entries, ingest_ts=NOW)).cache()
    got = {(r["line_number"], r["type"]): (r["severity"], round(r["score"], 4)) for r in found.collect()}
    assert got == {(1, "PATH_TRAVERSAL"): ("HIGH", 0.81), (2, "XSS"): ("HIGH", 0.71), (2, "UNAUTHORIZED_ACCESS"): ("LOW", 0.3),
                   (4, "UNAUTHORIZED_ACCESS"): ("LOW", 0.3)}
    groups = correlate(found)
    row = groups.first()
    assert (row["source_ip"], row["count"], row["attack_types"]) == ("10.0.0.1", 3, ["PATH_TRAVERSAL", "UNAUTHORIZED_ACCESS", "XSS"])
    assert row["confidence"] == pytest.approx(0.9)
    assert correlation_members(found, groups).count() == 3
    texts = [r["recommendation"] for r in dashboards.recommendations(found).collect()]
    assert len(texts) == 6 and "10.0.0.1, 10.0.0.2" in texts[2]
    empty = found.limit(0)
    assert dashboards.live_metrics(empty, as_of=NOW).first()["dominant_severity"] == "N/A"
    assert dashboards.recommendations(empty).count() == 3
    calm = found.filter("severity = 'LOW'")
    assert dashboards.top_threats(calm).count() == 2 and dashboards.top_threats(found).count() == 2


def test_members_are_found_without_a_broadcast(spark):
    """Findings that look small to Spark, here as a few rows, are not sent to the driver to be broadcast."""
    schema = "id bigint, type string, source_ip string"
    found = spark.createDataFrame([(i, ("XSS", "XXE")[i % 2], f"10.0.0.{i % 3}") for i in range(12)], schema)
    members = correlation_members(found, correlate(found))
    assert "Broadcast" not in members._jdf.queryExecution().executedPlan().toString()
    assert members.count() == 12 and members.select("group_id").distinct().count() == 3
    path = scratch_dir(spark, "correlations")
    sinks.write_correlations(found, path, created_at="2024-02-01 00:00:00")
    assert spark.read.parquet(f"{path}/members").count() == 12 and spark.read.parquet(f"{path}/groups").count() == 3


def test_alerts_and_sessions(spark, lines):
    found = detect_signatures(web_lines(lines), ingest_ts=NOW)
    made = alerts.make_alerts(found)
    assert made.count() == 2
    read = alerts.mark_read(made.filter("alert_type = 'XSS'"), at=NOW)
    left = alerts.unread_alerts(made, found, read).collect()
    assert [(r["anomaly_type"], r["source_ip"]) for r in left] == [("PATH_TRAVERSAL", "10.0.0.1")]
    begun = alerts.start_session(spark, session_id="s", start=NOW)
    ended = alerts.session_row(web_lines(lines), found, session_id="s", start=NOW, end=NOW)
    path = scratch_dir(spark, "sessions")
    for rows in (begun, ended, ended, alerts.start_session(spark, session_id="t/1 =x", start=NOW)):
        tables.write_sessions(rows, path)
    got = {r["session_id"]: (r["total_lines"], r["anomalies_found"], r["status"]) for r in tables.stored_sessions(spark, path).collect()}
    assert got == {"s": (5, 2, "COMPLETED"), "t/1 =x": (None, None, "RUNNING")}
    tables.end_session(spark, path, "t/1 =x", end=NOW, total_lines=7)
    assert tables.stored_sessions(spark, path).filter("session_id = 't/1 =x' AND status = 'COMPLETED' AND total_lines = 7").count() == 1


def test_a_failed_write_leaves_the_stored_rows(spark):
    path = scratch_dir(spark, "sessions")
    tables.write_sessions(alerts.start_session(spark, session_id="s", start=NOW), path)
    bad = alerts.start_session(spark, session_id="s", start=NOW).withColumn("notes", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.write_sessions(bad, path)
    assert [r["status"] for r in tables.stored_sessions(spark, path).collect()] == ["RUNNING"]


def test_sessions_are_cleared_from_storage(spark, lines):
    found, path = detect_signatures(web_lines(lines), ingest_ts=NOW), scratch_dir(spark, "findings")
    assert tables.stored_findings(spark, path).count() == 0
    for name in ("a", "b", None):
        tables.write_session_findings(found.withColumn("session_id", F.lit(name).cast("string")), path)
    assert tables.stored_findings(spark, path).count() == 6
    assert tables.clear_findings(spark, path, "a") == 2 and tables.clear_findings(spark, path, "a") == 0
    assert {r["session_id"] for r in tables.stored_findings(spark, path).collect()} == {"b", None}
    tables.write_session_findings(found.withColumn("session_id", F.lit("b")).limit(1), path)
    assert tables.stored_findings(spark, path).filter("session_id = 'b'").count() == 1
    assert tables.clear_findings(spark, path) == 3 and tables.stored_findings(spark, path).count() == 0


def test_text_does_not_move_for_its_line_numbers(spark, tmp_path):
    """With broadcasting off, too, no exchange holds the lines; numbers are right over many blocks of many files."""
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" if i % 3 else "\n" for i in range(1, 4001)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(old, ("-1", "3000", "100"), strict=True):
            spark.conf.set(k, v)
        rows = files.read_logs(spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
        moved = [line for line in plan.splitlines() if "Exchange" in line]
        assert moved and not any("value" in line or "log_file" in line for line in moved)
        got = [(r["raw_line"], r["line_number"]) for r in rows.collect()]
        assert len(got) == 2 * 2667 and all(int(text.split()[1]) == number for text, number in got)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_rotation_keeps_order_and_bounds_files(spark):
    lines, path = spark.range(5000).repartition(5).select(F.repeat(F.col("id").cast("string"), 7).alias("value")), scratch_dir(spark, "rotated")
    sinks.write_rotated(lines, path, max_bytes=9000)
    sizes = [r["n"] for r in spark.read.text(path).groupBy("part").agg(F.sum(F.length("value") + 1).alias("n")).orderBy("part").collect()]
    assert max(sizes) <= 9000 + 29 and min(sizes[:-1]) > 9000 - 29 and spark.read.text(path).distinct().count() == 5000


def test_off_hours_switch(lines):
    entries = parse_logs(lines(["2024-03-02 10:00:00 sat", "2024-03-04 07:59:59 mon", "2024-03-04 10:00:00 mon", "none"]), default_year=2024)
    assert detect_off_hours(entries, ingest_ts=NOW).count() == 2
    assert detect_off_hours(entries, ingest_ts=NOW, weekend_suspicious=False).count() == 1


def test_registry(lines):
    def long_lines(batch):
        return batch[batch["raw_line"].str.len() > 80].assign(type="LONG_LINE", severity="LOW", detail="long", score=0.1)

    entries = web_lines(lines)
    registry = DetectorRegistry()
    registry.register(batch_detector("long", "Long lines", long_lines, columns=["raw_line"]))
    assert [d["id"] for d in registry.list()] == ["api_abuse", "sensitive_data", "anomalous_time", "long"]
    assert registry.disable("anomalous_time") and not registry.disable("unknown")
    assert registry.configure("api_abuse", requests=2)
    found = registry.run_all(entries, ingest_ts=NOW).collect()
    assert {r["extra"]["plugin_id"] for r in found} == {"long"}
    assert registry.run_one("anomalous_time", entries, ingest_ts=NOW).count() == 0
    assert registry.unregister("long") and not registry.unregister("long")


def test_sinks(spark, lines):
    found = detect_signatures(web_lines(lines), ingest_ts=NOW)
    path = scratch_dir(spark, "csv")
    sinks.export_csv(found.limit(0), path)
    assert [r[0] for r in spark.read.text(path).collect()] == ["Sem anomalias detetadas"]
    with pytest.raises(ValueError):
        sinks.export(web_lines(lines), found, path, "pdf")
    targets = sinks.SinkList([{"name": "a", "type": "file", "path": scratch_dir(spark, "a")},
                              {"name": "b", "type": "cef_text", "path": scratch_dir(spark, "b"), "enabled": False}])
    assert not targets.add({"type": "splunk"})
    sinks.fan_out_findings(found, targets)
    assert targets.stats() == {"events_sent": 2, "events_failed": 2, "connectors": 2}


def test_pipeline(lines):
    run = analyse(lines([WEB % (i % 3 + 1, i % 60, "/a?x=<script>" if i % 5 == 0 else "/ok", 403 if i % 7 == 0 else 200) for i in range(60)]),
                  default_year=2024, ingest_ts=NOW, session_id="s1", detectors=DetectorRegistry(), forest=True)
    kinds = {r["type"] for r in run.findings.select("type").distinct().collect()}
    assert {"XSS", "UNAUTHORIZED_ACCESS"} <= kinds
    assert run.findings.filter("session_id <> 's1' or session_id is null").count() == 0
    assert run.correlations.count() == 3


def test_stream_in_batches_equals_batch(spark, lines, tmp_path):
    """Files taken one by one, state kept between them."""
    text = "Mar  5 09:%02d:%02d h sshd[1]: Failed password for bob from 10.0.0.%d port 22 ssh2"
    texts = [text % (i // 6, (i % 6) * 10, i % 2) for i in range(60)]
    for n in range(6):
        (tmp_path / f"part{n}.log").write_text("\n".join(texts[n * 10:n * 10 + 10]) + "\n")
        os.utime(tmp_path / f"part{n}.log", (1000 + n, 1000 + n))
    (tmp_path / "ignored.gz").write_text("x")
    run = live.LiveRun(scratch_dir(spark, "run"), [live.brute_force_rule(attempts=4, window_seconds=100)], default_year=2024, ingest_ts=NOW, late_seconds=600, single_line=False)
    lines_in = live.stream_finished(spark, str(tmp_path), files_per_trigger=1)
    run.start(lines_in, checkpoint=scratch_dir(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert run.table(spark, "progress").count() == 6
    from emberlog.operators.rates import detect_brute_force
    batch = detect_brute_force(parse_logs(lines(texts), default_year=2024), ingest_ts=NOW, attempts=4, window_seconds=100)
    got = [(r["source_ip"], r["event_ts"]) for r in run.table(spark, "findings").collect()]
    assert sorted(got) == sorted((r["source_ip"], r["event_ts"]) for r in batch.collect()) and got


def test_detector_is_a_plain_record():
    assert Detector("x", "X", lambda e, ingest_ts: e).enabled
