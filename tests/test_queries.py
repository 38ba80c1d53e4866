"""A part of the registered queries against DuckDB, and what their plans look like.

All of them: python tests/check_oracles.py /root/testdata/sf0.01
"""

import pytest
from check_oracles import compare, entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "flagship", "parse_logs", "parse_extended", "tag_indicators", "detect_signatures", "detect_brute_force",
    "detect_brute_force_hot", "detect_residual_per_file", "ip_stats", "correlate", "timeline_hour", "unread_alerts", "extract_features", "export_csv",
    "upsert_ip", "clear", "write_session", "sink_jsonl_rotated", "stream_logs", "tail_follow", "live_run", "live_metrics_minutes", "analyse_run",
    "analyse_known_model", "fit_isolation_forest", "score_isolation_forest", "ml_findings", "fit_classifier", "predict_type"])
def test_against_duckdb(spark, name):
    good, note = compare(spark, SMALL, name)
    assert good, note


def plan(spark, name):
    return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["parse_logs", "parse_extended", "detect_signatures", "detect_sensitive_data", "extract_features",
                                  "by_type", "correlate", "ip_stats"])
def test_no_python_in_the_plan(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "InPandas" not in text and "CartesianProduct" not in text


def test_columns_are_pruned(spark):
    text = plan(spark, "timeline_orders")
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz,o_orderpriority:string>" in text and "PushedFilters" in text


@pytest.mark.parametrize("name", ["parse_logs", "detect_signatures", "extract_features"])
def test_line_work_only_spreads(spark, name):
    """The one exchange is the spreading of a small input."""
    text = plan(spark, name)
    assert text.count("Exchange") == text.count("RoundRobinPartitioning") <= 1


def test_alerts_meet_their_findings_by_a_shuffle(spark):
    """The findings are computed once, and their join is never a broadcast, whatever Spark takes their size for."""
    text = plan(spark, "unread_alerts")
    assert "SortMergeJoin [anomaly_id" in text and "Generate" not in text


@pytest.mark.parametrize("name", ["scale", "union_findings", "by_type"])
def test_lines_are_parsed_once(spark, name):
    """What reads entries or features more than once reads them written."""
    assert "inline(array(struct(_doc" not in plan(spark, name)


def test_rotated_files_are_listed_once(spark):
    text = plan(spark, "sink_jsonl_rotated")
    assert "FileScan text" in text and "FileScan json" not in text


def test_every_written_folder_is_read(spark):
    good, note = compare(spark, SMALL, "read_many")
    assert good, note
    kinds = {r["event_type"] for r in entry.queries()["read_many"](spark, SMALL).collect()}
    assert kinds == {r[0] for r in spark.read.parquet(f"{SMALL}/events.parquet").select("event_type").distinct().collect()} and len(kinds) == 5


def test_every_profile_is_fitted(spark):
    good, note = compare(spark, SMALL, "model_profiles")
    assert good, note


def test_every_query_is_listed():
    assert set(entry.oracle_sql()) <= set(entry.queries())
