"""Isolation forest: outliers are the rows that few random cuts set apart.

MLlib has no such model. A tree is grown from at most ``sample_size`` rows, so
the whole forest is a small table whatever the size of the data; trees are grown
in parallel, rows are scored in Arrow batches where they are.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed
from emberlog.operators.features import FEATURES, extract_features
from emberlog.operators.findings import as_findings
from emberlog.operators.quantile import exact_percentile
from emberlog.operators.signatures import with_line_hits
from emberlog.session import scratch_dir

NODES = "tree int, node int, feature int, cut double, left int, right int, depth double"
MIN_ROWS = 20


@dataclass
class ForestModel:
    """Node table, and what scoring needs beside it."""

    nodes: pd.DataFrame
    sample_size: int
    offset: float
    contamination: float
    samples_trained: int
    anomalies_found: int
    mean_score: float


def _mean_depth(n: float) -> float:
    """Average depth of an unsuccessful search in a random tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(values: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[list] = []
    todo = [(values, 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 if side == "left" else 3] = me
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(varying) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + _mean_depth(len(rows))])
            continue
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        nodes.append([feature, cut, -1, -1, 0.0])
        goes_left = rows[:, feature] <= cut
        todo += [(rows[goes_left], depth + 1, me, "left"), (rows[~goes_left], depth + 1, me, "right")]
    return [tuple(n) for n in nodes]


DRAWN = "tree int, place bigint, row_hash bigint, " + ", ".join(f"{c} double" for c in FEATURES)
#: Odd factors of the trees; multiplying by one is a bijection of 64 bits.
STEP = 0x9E3779B97F4A7C15


def tree_places(hashes: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """The place of each row in the order that a tree draws in, from the row's one hash."""
    rng = np.random.default_rng([seed, tree, 1])
    factor = np.uint64(int(rng.integers(0, 1 << 63)) * 2 + 1)
    return (hashes ^ np.uint64(int(rng.integers(0, 1 << 63)))) * factor * np.uint64(STEP)


def _draw(features: DataFrame, keys: list[str], n: int, trees: int, size: int, seed: int, extra: float) -> DataFrame:
    """(tree, place, features) of at least the ``size`` first rows of every tree, all but surely.

    A tree draws by the order of its places, so the rows that tasks find add up to the same draw however the data is
    split. Places beyond a bound that ``size`` rows pass by ``extra`` deviations are not sent.
    """
    share = min(1.0, (size + extra * math.sqrt(size) + 16) / n)
    bound = np.uint64((1 << 64) - 1 if share >= 1 else int(share * (1 << 64)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, found = batch.column("row_hash").to_numpy().view(np.uint64), []
            for tree in range(trees):
                places = tree_places(hashes, seed, tree)
                rows = np.flatnonzero(places <= bound)
                found.append((np.full(len(rows), tree, np.int32), places[rows], rows))
            tree, place, rows = (np.concatenate(x) for x in zip(*found, strict=True))
            signed = (place ^ np.uint64(1 << 63)).view(np.int64)  # in the same order
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(signed), *batch.take(pa.array(rows)).columns], ["tree", "place", *batch.schema.names])

    return features.select(F.xxhash64(F.lit(seed), *keys).alias("row_hash"), *FEATURES).mapInArrow(draw, DRAWN)


def fit_isolation_forest(features: DataFrame, keys: list[str], *, contamination: float = 0.1, trees: int = 100,
                         sample_size: int = 256, seed: int = 42) -> ForestModel:
    """Grow the forest and set the cut so that the given share scores as outliers.

    ``keys`` identify a row; draws depend on them and the seed only. Every tree grows from
    exactly ``sample_size`` rows (all, if there are fewer). Actions: one
    count, the trees (at most ``trees * 2 * sample_size`` nodes reach the driver),
    and one scoring pass whose scores are written for the exact cut.
    """
    n = features.count()
    if n < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} rows are needed, got {n}")
    size = min(sample_size, n)
    limit = max(1, math.ceil(math.log2(size)))

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["place", "row_hash"]).head(size)[FEATURES].to_numpy(dtype=float)
        grown = _grow(rows, np.random.default_rng([seed, int(key[0])]), limit)
        out = pd.DataFrame(grown, columns=["feature", "cut", "left", "right", "depth"])
        return out.assign(tree=int(key[0]), node=range(len(out)), drawn=len(rows))[["tree", "node", "feature", "cut", "left", "right", "depth", "drawn"]]

    extra = 6.0
    while True:  # once, but for one run in many millions
        drawn = _draw(features, keys, n, trees, size, seed, extra)
        grown = drawn.groupBy("tree").applyInPandas(grow, NODES + ", drawn int").toPandas().sort_values(["tree", "node"], ignore_index=True)
        if (grown.groupby("tree")["drawn"].first().reindex(range(trees), fill_value=0) == size).all():
            break
        extra *= 2
    nodes = grown.drop(columns="drawn")
    model = ForestModel(nodes, size, 0.0, contamination, n, 0, 0.0)

    path = scratch_dir(features.sparkSession, "forest-scores")
    features.select(_raw_score(features.sparkSession, model).alias("s")).write.parquet(path)
    scores = features.sparkSession.read.schema("s double").parquet(path)
    model.offset = exact_percentile(scores, "s", contamination)
    found, mean = scores.agg(F.count_if(F.col("s") < model.offset), F.avg(F.col("s") - model.offset)).first()
    model.anomalies_found, model.mean_score = int(found), float(mean)
    return model


#: Rows that go down the trees together, so that what they need stays in the processor's cache.
SCORE_ROWS = 4096


def _packed(tree: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Feature, cut, next nodes (right, then left, of every node), depth, and the steps of the longest way. A leaf follows itself."""
    feature, left, right = (tree[c].to_numpy() for c in ("feature", "left", "right"))
    me, leaf = np.arange(len(tree)), feature < 0
    following = np.empty(2 * len(tree), np.intp)
    following[0::2], following[1::2] = np.where(leaf, me, right), np.where(leaf, me, left)
    steps = np.zeros(len(tree), int)
    for node in me[~leaf]:  # a node stands before the nodes below it
        steps[[left[node], right[node]]] = steps[node] + 1
    return np.where(leaf, 0, feature).astype(np.intp), tree["cut"].to_numpy(dtype=float), following, tree["depth"].to_numpy(dtype=float), int(steps.max())


def _total_depth(values: np.ndarray, trees: list[tuple]) -> np.ndarray:
    """The summed depth of the leaves that a block of rows comes to; ``values`` has a line for each feature."""
    values = np.ascontiguousarray(values)
    flat, n = values.ravel(), values.shape[1]
    row, total = np.arange(n), np.zeros(n)
    for feature, cut, following, depth, steps in trees:
        node, begin = np.zeros(n, np.intp), feature * n  # where the line of a node's feature begins
        for _ in range(steps):
            at = begin.take(node, mode="clip")
            at += row
            left = flat.take(at, mode="clip") <= cut.take(node, mode="clip")
            node += node
            node += left
            node = following.take(node, mode="clip")
        total += depth.take(node, mode="clip")
    return total


def _raw_score(spark: SparkSession, model: ForestModel) -> Column:
    """Minus two to the power of the relative mean depth, in (-1, 0)."""
    # a few ten thousand numbers, bounded by the size of the forest
    shared = spark.sparkContext.broadcast([_packed(g) for _, g in model.nodes.groupby("tree", sort=True)])
    normal = _mean_depth(model.sample_size) or 1.0

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        values, trees = np.stack([c.to_numpy(dtype=float) for c in columns]), shared.value
        depth = [_total_depth(values[:, begin:begin + SCORE_ROWS], trees) for begin in range(0, values.shape[1], SCORE_ROWS)]
        return pd.Series(-np.exp2(-np.concatenate([*depth, np.zeros(0)]) / (len(trees) * normal)))

    return score(*[F.col(c) for c in FEATURES])


def score_isolation_forest(features: DataFrame, model: ForestModel) -> DataFrame:
    """Adds ``is_anomaly``, ``anomaly_score`` and ``confidence``."""
    scored = features.withColumn("anomaly_score", _raw_score(features.sparkSession, model) - F.lit(model.offset))
    return scored.withColumns({
        "is_anomaly": F.col("anomaly_score") < 0,
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - F.col("anomaly_score"))),
    })


def novelty_filter(candidates: DataFrame, rule_findings: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Candidates whose address no rule has found, the first ``limit`` or all; a missing
    address equals a missing address."""
    known = rule_findings.filter(F.col("type") != "ML_DETECTED").select(F.col("source_ip").alias("known_ip")).distinct()
    fresh = candidates.join(known, candidates["source_ip"].eqNullSafe(known["known_ip"]), "left_anti")
    return fresh if limit is None else fresh.orderBy("log_file", "line_number").limit(limit)


def ml_findings(scored: DataFrame, rule_findings: DataFrame, *, ingest_ts, min_confidence: float = 0.7,
                limit: int | None = None) -> DataFrame:
    """Findings of a model trained on the same lines: new addresses only. A screen may
    list the first ``limit``; what is stored is whole."""
    sure = scored.filter(F.col("is_anomaly") & (F.col("confidence") > min_confidence))
    fresh = novelty_filter(sure, rule_findings, limit=limit)
    return as_findings(fresh.select(
        "log_file", "line_number", "source_ip",
        F.coalesce(F.nullif("url", F.lit("")), "target").alias("target"),
        F.lit("ML_DETECTED").alias("type"), F.lit("MEDIUM").alias("severity"),
        F.format_string(fixed.FOREST_DETAIL, F.rint(F.col("confidence") * 100).cast("int")).alias("detail"),
        F.array(F.substring("raw_line", 1, 200)).alias("evidence"), F.col("ts").alias("event_ts"),
        F.col("confidence").alias("score"), F.col("anomaly_score").alias("ml_score"),
    ), "forest", ingest_ts=ingest_ts)


def known_model_findings(entries: DataFrame, model: ForestModel, fires: DataFrame, *, ingest_ts, strict: bool = False,
                         min_confidence: float = 0.7) -> DataFrame:
    """Findings of a model loaded before the run: lines on which no rule has found anything.

    What the rules for single lines say is worked out beside the score, in the same row. Only the lines on which a rate
    rule has fired (``fires``: ``log_file``, ``line_number``), one in as many as its threshold, are looked up.
    """
    scored = score_isolation_forest(extract_features(entries), model)
    sure = scored.filter(F.col("is_anomaly") & (F.col("confidence") > min_confidence))
    quiet = with_line_hits(sure, strict=strict).filter("NOT line_hit")
    known = fires.filter("line_number IS NOT NULL").select("log_file", "line_number").distinct()
    fresh = quiet.join(known, ["log_file", "line_number"], "left_anti")
    return as_findings(fresh.select(
        "log_file", "line_number", "source_ip", "target",
        F.lit("ML_DETECTED").alias("type"), F.lit("MEDIUM").alias("severity"),
        F.format_string(fixed.KNOWN_MODEL_DETAIL, F.col("confidence") * 100).alias("detail"),
        F.array("raw_line").alias("evidence"), F.col("ts").alias("event_ts"),
        F.col("confidence").alias("score"), F.col("anomaly_score").alias("ml_score"),
    ), "known_model", ingest_ts=ingest_ts)


def fit_profile(features: DataFrame, keys: list[str], profile: str, **options) -> ForestModel:
    """A forest with the outlier share of a named scenario, grown on real rows."""
    return fit_isolation_forest(features, keys, contamination=fixed.PROFILES[profile], **options)


def model_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.PROFILES.items()), "profile string, contamination double")


_STATE = ("sample_size", "offset", "contamination", "samples_trained", "anomalies_found", "mean_score")


def save_model(spark: SparkSession, model: ForestModel, path: str) -> None:
    spark.createDataFrame(model.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "nodes"))
    model_info(spark, model).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "state"))


def load_model(spark: SparkSession, path: str) -> ForestModel:
    nodes = spark.read.parquet(os.path.join(path, "nodes")).toPandas().sort_values(["tree", "node"], ignore_index=True)
    state = spark.read.parquet(os.path.join(path, "state")).first()
    return ForestModel(nodes=nodes, **{name: state[name] for name in _STATE})


def model_info(spark: SparkSession, model: ForestModel | None) -> DataFrame:
    if model is None:
        return spark.range(1).select(F.lit(False).alias("is_trained"), F.lit(0).cast("bigint").alias("samples_trained"))
    values = {name: getattr(model, name) for name in _STATE}
    return spark.range(1).select(F.lit(True).alias("is_trained"), *[F.lit(v).alias(n) for n, v in values.items()])
