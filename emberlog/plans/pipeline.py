"""One run over log lines: parse, detect, correlate."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.correlate import correlate
from emberlog.operators.detectors import DetectorRegistry
from emberlog.operators.features import extract_features
from emberlog.operators.findings import union_findings
from emberlog.operators.forest import ForestModel, fit_isolation_forest, known_model_findings, ml_findings, score_isolation_forest
from emberlog.operators.parse import parse_logs
from emberlog.operators.parse_extended import parse_further
from emberlog.operators.rates import detect_brute_force, detect_ddos, detect_residual, login_rule
from emberlog.operators.signatures import detect_signatures, detect_unauthorized
from emberlog.session import scratch_dir


@dataclass
class Analysis:
    entries: DataFrame
    findings: DataFrame
    correlations: DataFrame


def rule_findings(entries: DataFrame, *, ingest_ts: datetime | str, order: str = "file", strict: bool = False,
                  residual_per_file: bool = False, thresholds: dict[str, dict] | None = None) -> DataFrame:
    """All rule findings of entries, as one union. ``thresholds`` has options of the rules ``login``, ``ddos`` and ``residual``."""
    given = thresholds or {}
    login, residual = given.get("login", {}), given.get("residual", {})
    logins = login_rule(entries, ingest_ts=ingest_ts, order=order, **login)
    return union_findings(
        detect_signatures(entries, ingest_ts=ingest_ts, strict=strict),
        detect_brute_force(entries, ingest_ts=ingest_ts, scanned=logins, **login),
        detect_ddos(entries, ingest_ts=ingest_ts, order=order, **given.get("ddos", {})),
        detect_unauthorized(entries, ingest_ts=ingest_ts),
        detect_residual(entries, ingest_ts=ingest_ts, scanned=logins, per_file=residual_per_file, **login, **residual))


def analyse(lines: DataFrame, *, default_year: int, ingest_ts: datetime | str, session_id: str | None = None,
            strict: bool = False, order: str = "file", detectors: DetectorRegistry | None = None,
            forest: bool = False, contamination: float = 0.15, residual_per_file: bool = False,
            extended: bool = True, model: ForestModel | None = None, model_confidence: float = 0.7, thresholds: dict[str, dict] | None = None) -> Analysis:
    """Parse once, write the entries, and run everything from the written table.

    ``extended`` reads the further formats too, where no core layout fits a line.

    ``model`` is a forest fitted before; what it finds with at least ``model_confidence`` on lines without a rule finding is added.

    The text is read, parsed and written a single time; the rules then read only the
    columns they need. The findings are written too, since the correlation and
    every report read them again.
    """
    spark = lines.sparkSession
    parsed = parse_logs(lines, default_year=default_year, strict=strict)
    entries = _stored(parse_further(parsed, default_year=default_year) if extended else parsed, scratch_dir(spark, "entries"))
    found = rule_findings(entries, ingest_ts=ingest_ts, order=order, strict=strict, residual_per_file=residual_per_file, thresholds=thresholds)
    if detectors is not None:
        found = found.unionByName(detectors.run_all(entries, ingest_ts=ingest_ts))
    if model is not None:
        found = _stored(found, scratch_dir(spark, "rule-findings"))
        fires = found.filter(F.col("rule").isin("brute_force", "ddos"))
        found = found.unionByName(known_model_findings(
            entries, model, fires, ingest_ts=ingest_ts, strict=strict, min_confidence=model_confidence))
    rules = _stored(found.withColumn("session_id", F.lit(session_id)), scratch_dir(spark, "findings"))
    findings = rules
    if forest:
        features = extract_features(entries)
        model = fit_isolation_forest(features, ["log_file", "line_number"], contamination=contamination)
        scored = score_isolation_forest(features, model)
        fresh = ml_findings(scored, rules, ingest_ts=ingest_ts).withColumn("session_id", F.lit(session_id))
        findings = _stored(rules.unionByName(fresh), scratch_dir(spark, "all-findings"))
    return Analysis(entries, findings, correlate(findings, session_id=session_id))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
