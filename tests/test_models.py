import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.operators import classifier, forest
from emberlog.operators.features import FEATURES, extract_features, fit_scaler, scale
from emberlog.operators.parse import parse_logs
from emberlog.operators.quantile import exact_percentile
from emberlog.session import scratch_dir


@pytest.fixture(scope="module")
def rows(spark):
    """500 ordinary rows and 10 far away."""
    base = spark.range(510).withColumn("far", F.col("id") >= 500)
    noise = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000
    return base.select("id", "far", *[
        (noise(i) + F.when(F.col("far"), 8 + noise(i + 50)).otherwise(0)).alias(c) if i < 6 else F.lit(0.0).alias(c)
        for i, c in enumerate(FEATURES)]).cache()


def test_forest_finds_far_rows_and_repeats(spark, rows):
    model = forest.fit_isolation_forest(rows, ["id"], contamination=0.1)
    assert abs(model.anomalies_found - 51) <= 1 and model.samples_trained == 510
    scored = forest.score_isolation_forest(rows, model)
    first = [r["far"] for r in scored.orderBy("anomaly_score").select("far").limit(10).collect()]
    assert all(first)
    again = forest.fit_isolation_forest(rows.repartition(7), ["id"], contamination=0.1)
    assert again.offset == model.offset and again.nodes.equals(model.nodes)
    path = scratch_dir(spark, "model")
    forest.save_model(spark, model, path)
    loaded = forest.load_model(spark, path)
    assert loaded.offset == model.offset
    assert forest.score_isolation_forest(rows, loaded).filter("is_anomaly").count() == model.anomalies_found


def test_blocks_of_rows_end_in_the_leaves_that_single_rows_end_in():
    """Against a walk of one row through one tree at a time; a missing value goes right, a tree may be a single leaf."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 5, (700, len(FEATURES))).astype(float)
    values[::50, 2] = np.nan
    columns = ["feature", "cut", "left", "right", "depth"]
    sample = np.nan_to_num(values)
    grown = [pd.DataFrame(forest._grow(rows, np.random.default_rng(i), 8), columns=columns)
             for i, rows in enumerate([sample[:256], sample[100:300], sample[:1], sample[:2]])]

    def walked(row) -> float:
        total = 0.0
        for tree in grown:
            node = tree.loc[0]
            while node["feature"] >= 0:
                node = tree.loc[int(node["left"] if row[int(node["feature"])] <= node["cut"] else node["right"])]
            total += node["depth"]
        return total

    got = forest._total_depth(values.T, [forest._packed(tree) for tree in grown])
    assert got.tolist() == [walked(row) for row in values]


def test_forest_needs_rows(rows):
    with pytest.raises(ValueError):
        forest.fit_isolation_forest(rows.limit(19), ["id"])


def test_novelty_treats_missing_address_as_known(spark):
    schema = "log_file string, line_number bigint, source_ip string"
    candidates = spark.createDataFrame([("f", 1, None), ("f", 2, "a"), ("f", 3, "b")], schema)
    found = spark.createDataFrame([("XSS", None), ("XSS", "a"), ("ML_DETECTED", "b")], "type string, source_ip string")
    assert [r["line_number"] for r in forest.novelty_filter(candidates, found).collect()] == [3]


@pytest.mark.parametrize("share", [0.0, 0.05, 0.15, 0.5, 0.999, 1.0])
def test_exact_percentile(spark, share):
    values = [((i * 7919) % 10007) / 7.0 for i in range(9000)] + [3.25] * 6000
    df = spark.createDataFrame([(v,) for v in values], "s double")
    assert exact_percentile(df, "s", share) == pytest.approx(np.percentile(values, share * 100), abs=1e-12)


def test_features(lines):
    text = '192.168.3.9 - - [02/Mar/2024:23:10:11 +0000] "GET /a/../b?x=%41&y=select HTTP/1.1" 404 77 "-" "Nikto/2"'
    row = extract_features(parse_logs(lines([text]), default_year=2024)).first()
    wanted = dict(hour_of_day=23, day_of_week=5, request_length=len(text), url_length=len("/a/../b?x=%41&y=select"),
                  num_special_chars=sum(not c.isalnum() and c not in " \t\n" for c in text), num_dots=text.count("."),
                  num_slashes=text.count("/"), num_params=2, has_sql_keywords=1, has_script_tags=0, has_path_traversal=1,
                  has_encoded_chars=1, status_code_class=4, is_error_status=1, response_size=77, ip_octet_1=192, ip_octet_4=9,
                  is_private_ip=1, user_agent_length=7, is_known_scanner=1)
    assert {n: row[n] for n in FEATURES} == wanted
    plain = extract_features(parse_logs(lines([text]), default_year=2024), compat=True).first()
    assert (plain["response_size"], plain["user_agent_length"], plain["is_known_scanner"]) == (0, 0, 0)


def test_scale(rows):
    scaled = scale(rows, fit_scaler(rows))
    stats = scaled.agg(F.avg(FEATURES[0]), F.stddev_pop(FEATURES[0]), F.max(FEATURES[10])).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1) and stats[2] == 0


def test_classifier(rows):
    labelled = rows.withColumn("label", F.when(F.col(FEATURES[0]) > 0.5, "high").otherwise("low"))
    fitted = classifier.fit_classifier(labelled, trees=10, depth=4)
    assert fitted.accuracy > 0.9 and fitted.classes == ["high", "low"]
    out = classifier.predict_type(labelled.withColumn("is_anomaly", F.col("far")), fitted)
    assert out.filter("predicted_type is not null").count() == 10
