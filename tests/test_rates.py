import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.functions.reset_scan import _summarise_few, _summarise_many, enter, join, run, summarise
from emberlog.operators import rates, reset_window
from emberlog.operators.parse import parse_logs


def loop(times, window, threshold):
    held, fires = [], []
    for i, now in enumerate(times):
        held = [t for t in held if now - t <= window] + [now]
        if len(held) >= threshold:
            fires.append(i)
            held = []
    return fires, len(held)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(-10, 10), min_size=1, max_size=120), st.integers(0, 20), st.integers(1, 6),
       st.lists(st.integers(1, 119), max_size=5), st.booleans(), st.randoms(use_true_random=False))
def test_chunks_equal_a_loop(steps, window, threshold, cuts, ordered, draw):
    times = np.cumsum(np.abs(steps) if ordered else steps).tolist()
    edges = [0, *sorted({c for c in cuts if c < len(times)}), len(times)]
    parts = [times[a:b] for a, b in zip(edges, edges[1:])]
    held, fires, at, chunks = [], [], 0, []
    for part in parts:
        chunk = summarise(part, window, threshold)
        assert chunk == _summarise_few(part, window, threshold) == _summarise_many(np.array(part), window, threshold)
        found, left = run(held, part, window, threshold)
        assert enter(chunk, held, window, threshold) == left
        fires, held, at = fires + [at + f for f in found], left, at + len(part)
        chunks.append(chunk)
    assert (fires, len(held)) == loop(times, window, threshold)
    states = [run([], before, window, threshold)[1] for before in ([], [times[0]], [times[0] - draw.randint(0, 30) for _ in range(4)], times[:7])]
    while len(chunks) > 1:  # put together in any shape of tree
        i = draw.randrange(len(chunks) - 1)
        chunks[i:i + 2] = [join(chunks[i], chunks[i + 1], window, threshold)]
        assert all(len(c.tail) < threshold and len(c.marks) < threshold for c in chunks)
    for state in states:
        assert enter(chunks[0], state, window, threshold) == run(state, times, window, threshold)[1]


@pytest.mark.parametrize("times,fires,held", [
    ([0, 60, 120, 180, 240], [240], 0), ([0, 60, 120, 180, 240, 250, 260], [240], 2), ([0, 100, 200, 300, 400, 500], [], 4)])
def test_fixture_times(spark, times, fires, held):
    rows = spark.createDataFrame([("a", t, "f", i) for i, t in enumerate(times)],
                                 "source_ip string, t bigint, log_file string, line_number bigint")
    got = rates.reset_window(rows, window_us=300, threshold=5).collect()
    assert [r["t"] for r in got if r["kind"] == "fire"] == fires
    assert sum(r["count"] for r in got if r["kind"] == "held") == held


@pytest.mark.parametrize("order", ["file", "event_time"])
@pytest.mark.parametrize("block_lines", [1, 30, 10 ** 6])
def test_hot_addresses(spark, order, block_lines, monkeypatch):
    """One address holds half of the rows; the result does not depend on where its rows are cut."""
    monkeypatch.setattr(reset_window, "FAN", 4)
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"ip{rng.randint(0, 30)}", f"f{n // 700}", n % 700, n * 3 + rng.randint(-20, 20), f"p{n}")
            for n in range(2000)]
    df = spark.createDataFrame(rows, "source_ip string, log_file string, line_number bigint, t bigint, raw_line string")
    key = (lambda r: (r[1], r[2])) if order == "file" else (lambda r: (r[3], r[1], r[2]))
    fires, held = [], {}
    for ip in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == ip), key=key)
        at, left = loop([r[3] for r in mine], 30, 5)
        fires += [(ip, mine[i][4]) for i in at]
        if left:
            held[ip] = left
    got = rates.reset_window(df, window_us=30, threshold=5, order=order, payload=["raw_line"], block_lines=block_lines).collect()
    assert sorted((r["source_ip"], r["raw_line"]) for r in got if r["kind"] == "fire") == sorted(fires)
    assert {r["source_ip"]: r["count"] for r in got if r["kind"] == "held"} == held
    assert all(len(r["times"]) == r["count"] for r in got if r["kind"] == "held")


def test_hot_address_at_one_moment(spark):
    """All rows of one address at the same time are still cut into blocks."""
    df = spark.range(3000).select(F.lit("hot").alias("source_ip"), F.lit(7).cast("bigint").alias("t"),
                                  F.lit("f").alias("log_file"), F.col("id").alias("line_number"))
    got = rates.reset_window(df, window_us=60, threshold=7, order="event_time", block_lines=100).collect()
    assert sorted(r["line_number"] for r in got if r["kind"] == "fire") == list(range(6, 3000, 7))
    assert [r["count"] for r in got if r["kind"] == "held"] == [3000 % 7]


def test_entering_times_and_two_halves(spark):
    """Two runs, the second from what the first holds, fire where one run does."""
    rng = random.Random(9)
    rows = [(f"ip{rng.randint(0, 8)}", n * 2 + rng.randint(0, 9), "f", n) for n in range(600)]
    ddl = "source_ip string, t bigint, log_file string, line_number bigint"
    how = {"window_us": 25, "threshold": 4, "order": "event_time", "block_lines": 20}
    fires = lambda got: sorted((r["source_ip"], r["line_number"]) for r in got if r["kind"] == "fire")
    whole = rates.reset_window(spark.createDataFrame(rows, ddl), **how).collect()
    cut = sorted(r[1] for r in rows)[300]
    first = rates.reset_window(spark.createDataFrame([r for r in rows if r[1] < cut], ddl), **how).collect()
    state = spark.createDataFrame([(r["source_ip"], r["times"]) for r in first if r["kind"] == "held"], "source_ip string, held array<bigint>")
    second = rates.reset_window(spark.createDataFrame([r for r in rows if r[1] >= cut], ddl), entering=state, **how).collect()
    assert fires(first) + fires(second) and sorted(fires(first) + fires(second)) == fires(whole)
    left = lambda got: {r["source_ip"]: r["times"] for r in got if r["kind"] == "held"}
    assert {**left(second)} == left(whole)


def test_no_job_runs_while_the_plan_is_built(spark, lines):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("built", "the plan alone")
    entries = parse_logs(lines(["Mar  5 09:00:00 h sshd[1]: Failed password for bob from 198.51.100.9 port 22 ssh2"] * 8), default_year=2024)
    found = rates.detect_brute_force(entries, ingest_ts="2024-04-01 00:00:00").unionByName(
        rates.detect_residual(entries, ingest_ts="2024-04-01 00:00:00", per_file=True))
    assert list(tracker.getJobIdsForGroup("built")) == []
    assert found.count() == 2 and len(tracker.getJobIdsForGroup("built")) > 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_residual_of_every_file(spark):
    """What is held stays held in later files, whether the address shows there or not."""
    rng = random.Random(3)
    entries = [("AUTH", "FAILED", f"10.0.0.{rng.randint(1, 6)}" if n % 3 else "10.0.0.1", f"f{n // 40}", n % 40, f"2024-03-05 {n // 60 % 24:02d}:{n % 60:02d}:00") for n in range(400)]
    entries += [("SYSLOG", None, None, f"f{i}", 99, "2024-03-05 00:00:00") for i in (3, 11, 12)]
    df = spark.createDataFrame(entries, "log_type string, status string, source_ip string, log_file string, line_number bigint, at string").selectExpr(
        "*", "CAST(at AS timestamp_ntz) AS ts", "'' AS raw_line", "'' AS user")
    got = {(r["log_file"], r["source_ip"], r["count"]) for r in rates.detect_residual(
        df, ingest_ts="2024-04-01 00:00:00", at_least=2, attempts=5, window_seconds=1800, per_file=True, block_lines=7).collect()}
    held, want, files = {}, set(), sorted({e[3] for e in entries})
    for name in files:
        for e in sorted((e for e in entries if e[3] == name and e[1] == "FAILED"), key=lambda e: e[4]):
            at = int(e[5][11:13]) * 60 + int(e[5][14:16])
            now = [t for t in held.get(e[2], []) if at - t <= 30] + [at]
            held[e[2]] = [] if len(now) >= 5 else now
        want |= {(name, ip, len(times)) for ip, times in held.items() if len(times) >= 2}
    assert got == want and len({w[0] for w in want}) == len(files)


def test_sliding(spark):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.7 else "b", rng.randint(0, 300)) for _ in range(400)]
    got = rates.rate_sliding(spark.createDataFrame(rows, "source_ip string, t bigint"), window_us=25).collect()
    assert {(r["source_ip"], r["t"]) for r in got} == set(rows)
    for r in got:
        assert r["in_window"] == sum(ip == r["source_ip"] and r["t"] - 25 <= t <= r["t"] for ip, t in rows)


def test_login_rules(lines):
    text = "Mar  5 09:%02d:00 h sshd[1]: Failed password for bob from 198.51.100.9 port 22 ssh2"
    entries = parse_logs(lines([text % m for m in (0, 1, 2, 3, 4, 20, 21, 22)]), default_year=2024)
    shared = rates.login_rule(entries, ingest_ts="2024-04-01 00:00:00")
    fire = rates.detect_brute_force(entries, ingest_ts="2024-04-01 00:00:00", scanned=shared).collect()
    assert [(r["line_number"], r["target"], r["count"], round(r["score"], 4)) for r in fire] == [(5, "bob", 5, 0.8)]
    left = rates.detect_residual(entries, ingest_ts="2024-04-01 00:00:00", scanned=shared).collect()
    assert [(r["source_ip"], r["count"], r["type"]) for r in left] == [("198.51.100.9", 3, "SUSPICIOUS_ACCESS")]
