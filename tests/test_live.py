"""Streams over several batches: undated lines, ids, sinks that fail."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from emberlog.operators.findings import as_findings
from emberlog.operators.parse import parse_logs
from emberlog.operators.rates import web_requests
from emberlog.operators.reset_window import reset_window
from emberlog.session import scratch_dir
from emberlog.sources import sinks
from emberlog.streaming import live

NOW = "2024-04-01 00:00:00"
WEB = '10.0.0.%d - - [05/Mar/2024:09:%02d:%02d +0000] "GET /x%d HTTP/1.1" 200 10'


def land(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def finish(query: StreamingQuery) -> None:
    query.processAllAvailable()
    query.stop()


def live_run(spark, rules, **how):
    return live.LiveRun(scratch_dir(spark, "run"), rules, **{"default_year": 2024, "ingest_ts": NOW, "late_seconds": 600, "single_line": False, **how})


def test_undated_line_makes_no_line_late(spark, tmp_path):
    """The first batch holds an error line without a readable stamp; the rule still counts the dated lines after it."""
    folder = tmp_path / "in"
    folder.mkdir()
    run = live_run(spark, [live.ddos_rule(requests=4, window_seconds=600)])
    query = run.start(live.stream_finished(spark, str(folder), files_per_trigger=1), checkpoint=scratch_dir(spark, "cp")).start()
    for i in range(3):
        undated = ["[Tue Mar 05 09:00:01.000001 2024] [error] [client 10.0.0.9] nothing"] if i == 0 else []
        land(folder, f"{i}.log", undated + [WEB % (1, 2 * i, s, s) for s in range(4)])
        query.processAllAvailable()
    finish(query)
    assert run.table(spark, "findings").filter("source_ip = '10.0.0.1'").count() == 3
    assert run.table(spark, "progress").agg(F.sum("n_late")).first()[0] == 0


def test_late_lines_are_kept_and_counted(spark):
    """Lines read = lines judged + lines that came late; a late line neither fires nor changes what is held."""
    run = live_run(spark, [live.ddos_rule(requests=3, window_seconds=3600)])
    rows = lambda lines: spark.createDataFrame([("a.log", i, t) for i, t in enumerate(lines)], "log_file string, line_number bigint, raw_line string")
    run.take(rows([WEB % (1, 30, 0, 0), WEB % (1, 31, 0, 1)]), 0)
    run.take(rows([WEB % (1, 5, 0, 2), WEB % (1, 10, 0, 3), WEB % (1, 22, 0, 4), "no stamp at all"]), 1)
    run.take(rows([WEB % (1, 40, 0, 5), WEB % (1, 41, 0, 6), WEB % (1, 20, 59, 7)]), 2)
    counted = {r["batch"]: (r["n_lines"], r["n_judged"], r["n_late"]) for r in run.table(spark, "progress").collect()}
    assert counted == {0: (2, 2, 0), 1: (4, 2, 2), 2: (3, 2, 1)}
    assert sorted(r["line_number"] for r in run.table(spark, "entries").filter("late").collect()) == [0, 1, 2]
    # the third judged request fires in the second batch, after it two more are held
    assert [(r["batch"], r["count"]) for r in run.table(spark, "findings").collect()] == [(1, 3)]
    assert run.table(spark, "events/ddos").filter("kind = 'held' AND batch = 2").first()["count"] == 2


def test_a_replayed_batch_changes_nothing(spark):
    rows = lambda lines: spark.createDataFrame([("a.log", i, t) for i, t in enumerate(lines)], "log_file string, line_number bigint, raw_line string")
    run = live_run(spark, [live.ddos_rule(requests=3, window_seconds=3600)], single_line=True)
    batches = [rows([WEB % (1, m, s, s) for s in range(4)]) for m in (0, 1, 2)]
    for number in (0, 1, 1, 2, 2):
        run.take(batches[number], number)
    assert run.table(spark, "findings").filter("type = 'DDOS'").count() == 4
    assert run.table(spark, "progress").agg(F.sum("n_lines")).first()[0] == 12
    told = live.metrics_from_minutes(run.table(spark, "minutes"), as_of="2024-03-05 09:03:00").first()
    assert told["last_hour"] == run.table(spark, "findings").count() and told["active_ips"] == 1
    assert live.metrics_from_minutes(run.table(spark, "minutes"), as_of="2024-03-09 09:03:00").first()["dominant_severity"] == "N/A"


def read_to_end(spark, lines, out, checkpoint):
    lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return [r["raw_line"] for r in spark.read.parquet(out).collect()]


def test_growing_files_give_each_line_once(spark, tmp_path):
    """Lines are added between batches and between starts; half a line waits, a file that is emptied is read anew."""
    folder, out, checkpoint = tmp_path / "in", scratch_dir(spark, "lines"), scratch_dir(spark, "cp")
    folder.mkdir()
    stream = lambda: live.stream_logs(spark, str(folder), bytes_per_trigger=1 << 20, split_bytes=16)
    (folder / "a.log").write_bytes(b"one\r\ntwo \xff\n\n  three\nhal")
    (folder / "b.gz").write_text("no log file\n")
    assert sorted(read_to_end(spark, stream(), out, checkpoint)) == ["one", "three", "two"]
    with open(folder / "a.log", "ab") as file:
        file.write(b"f\nfour")
    (folder / "b.TXT").write_text("five\n")
    assert sorted(read_to_end(spark, stream(), out, checkpoint)) == ["five", "half", "one", "three", "two"]
    query = stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    with open(folder / "a.log", "ab") as file:
        file.write(b"\nsix\n")
    query.processAllAvailable()
    (folder / "b.TXT").write_text("new start\nseven\n")
    query.processAllAvailable()
    finish(query)
    got = sorted(r["raw_line"] for r in spark.read.parquet(out).collect())
    assert got == sorted(["one", "two", "three", "half", "five", "four", "six", "new start", "seven"])
    places = spark.read.parquet(out).filter("log_file LIKE '%a.log'").orderBy("line_number").collect()
    assert [r["raw_line"] for r in places] == ["one", "two", "three", "half", "four", "six"] and places[3]["line_number"] == 20


def test_named_files_are_followed_from_their_end(spark, tmp_path):
    path, out, checkpoint = tmp_path / "app.out", scratch_dir(spark, "lines"), scratch_dir(spark, "cp")
    path.write_text("old\nin prog")
    stream = lambda: live.stream_logs(spark, [str(path)], bytes_per_trigger=8)
    query = stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    query.processAllAvailable()
    with open(path, "a") as file:
        file.write("ress\n" + "".join(f"line {i}\n" for i in range(40)) + "a line longer than the limit\n")
    query.processAllAvailable()
    n_batches = query.lastProgress["batchId"]
    finish(query)
    assert sorted(r["raw_line"] for r in spark.read.parquet(out).collect()) == sorted(["in progress", *[f"line {i}" for i in range(40)], "a line longer than the limit"])
    assert n_batches >= 20  # at most eight bytes a batch


def test_listeners_are_all_called_and_failures_raised(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    land(folder, "a.log", [WEB % (1, 0, 0, 1) + " <script>"])

    def broken(batch):
        raise ValueError("listener is broken")

    found = lambda: live.stateless_findings(parse_logs(live.stream_logs(spark, str(folder), bytes_per_trigger=1 << 20), default_year=2024), ingest_ts=NOW)
    checkpoint = scratch_dir(spark, "cp")
    query = live.on_finding(found(), [broken, lambda batch: seen.append(batch.count())], checkpoint=checkpoint).start()
    with pytest.raises(Exception, match="listeners failed"):
        query.processAllAvailable()
    query.stop()
    finish(live.on_finding(found(), [lambda batch: seen.append(batch.count())], checkpoint=checkpoint).start())
    assert len(seen) == 2 and seen[0] == seen[1] > 0  # the batch came again


def test_ids_differ_without_line_numbers(spark):
    rows = spark.range(200).select(
        F.lit("a.log").alias("log_file"), F.lit(None).cast("bigint").alias("line_number"), F.lit("10.0.0.1").alias("source_ip"), F.lit("XSS").alias("type"),
        F.lit("HIGH").alias("severity"), F.array(F.concat(F.lit("line "), "id")).alias("evidence"))
    ids = as_findings(rows, "signature", ingest_ts=NOW)
    assert ids.select("id").distinct().count() == 200
    again = as_findings(rows, "signature", ingest_ts=NOW).select("id")
    assert ids.select("id").exceptAll(again).isEmpty()


def test_failed_sink_is_raised_and_a_replay_writes_once(spark, tmp_path):
    folder, good, bad = tmp_path / "in", scratch_dir(spark, "good"), tmp_path / "bad"
    folder.mkdir()
    bad.write_text("a file where a folder should be")
    land(folder, "a.log", [WEB % (1, 0, 0, 1) + " <script>", '10.0.0.2 - - [05/Mar/2024:09:01:00 +0000] "GET /q?u=<script> HTTP/1.1" 403 10'])
    checkpoint = scratch_dir(spark, "cp")

    def start(paths):
        entries = parse_logs(live.stream_finished(spark, str(folder), files_per_trigger=10), default_year=2024)
        targets = sinks.SinkList([{"name": p, "type": "file", "path": str(p)} for p in paths])
        return live.fan_out_stream(live.stateless_findings(entries, ingest_ts=NOW), targets, checkpoint=checkpoint).start()

    query = start([bad, good])
    with pytest.raises(Exception, match="sinks failed"):
        query.processAllAvailable()
    query.stop()
    first = spark.read.text(good).count()
    assert first > 0  # the other sink has its batch
    finish(start([tmp_path / "mended", good]))
    assert spark.read.text(good).count() == first  # sent again, kept once
    assert spark.read.text(os.path.join(tmp_path, "mended")).count() == first


def test_stored_findings_are_pruned_by_day(spark):
    rows = spark.range(500).select(
        F.lit("a.log").alias("log_file"), F.col("id").alias("line_number"), F.lit("10.0.0.1").alias("source_ip"), F.lit("XSS").alias("type"),
        F.lit("HIGH").alias("severity"), F.timestamp_seconds(1704067200 + F.col("id") * 3600).cast("timestamp_ntz").alias("event_ts"))
    path = scratch_dir(spark, "anomalies")
    sinks.write_anomalies(as_findings(rows, "signature", ingest_ts=NOW), path)
    got = sinks.read_anomalies(spark, path, start="2024-01-03 00:00:00", end="2024-01-03 11:30:00")
    assert got.count() == 12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    files = spark.read.parquet(path).select("event_date", F.input_file_name().alias("f")).distinct().groupBy("event_date").count()
    assert files.agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize("address_rows", [0, 7, 10 ** 6])
def test_crowded_and_other_addresses_give_what_a_scan_gives(spark, address_rows):
    """Addresses walked by one task, spread over tasks, or some of each: the same fires and the same held times in all batches."""
    rows = lambda lines: spark.createDataFrame([("a.log", i, t) for i, t in enumerate(lines)], "log_file string, line_number bigint, raw_line string")
    batch = lambda n: [WEB % (1 + i % 4 * (i % 3), (10 * n + i // 6) % 60, i * 7 % 60, i) for i in range(48)] + ["[x] [error] [client 10.0.0.3] undated"] * 2
    run = live_run(spark, [live.ddos_rule(requests=4, window_seconds=45)], address_rows=address_rows)
    for number in range(3):
        lines = rows(batch(number) if number < 2 else batch(number)[:1])
        run.take(lines, number)
        entries = run.table(spark, "entries").filter(F.col("batch") == number).drop("batch", "late")
        before = None if number == 0 else run.table(spark, "events/ddos").filter((F.col("batch") == number - 1) & (F.col("kind") == "held")).select("source_ip", F.col("times").alias("held"))
        scan = reset_window(web_requests(entries, ingest_ts=NOW), window_us=45_000_000, threshold=4, order="event_time", entering=before)
        told = lambda df: sorted(map(str, df.select("source_ip", "kind", "count", "t", "log_file", "line_number", "times").collect()))
        got, want = told(run.table(spark, "events/ddos").filter(F.col("batch") == number)), told(scan)
        assert got == want and got
    assert run.table(spark, "progress").agg(F.sum("n_late")).first()[0] == 0
    assert run.table(spark, "findings").count() > 3
    crowded = run.table(spark, "crowded/ddos").filter("batch = 0").count()
    assert crowded == 0 if address_rows > 100 else crowded > 0


def test_few_rows_of_an_address_are_no_blocks(spark):
    """One exchange for the rows of addresses that one task can walk, and no stage whose code the JVM would not compile."""
    run = live_run(spark, [live.ddos_rule(requests=3, window_seconds=3600)])
    lines = spark.createDataFrame([("a.log", i, WEB % (1, i, 0, i)) for i in range(4)], "log_file string, line_number bigint, raw_line string")
    run.take(lines, 0)
    entries = run.table(spark, "entries").drop("late", "batch")
    text = run._events(run.rules[0], entries, 1, None)._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and text.count("Exchange hashpartitioning") == 1
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
