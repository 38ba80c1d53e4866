"""Severity and score lookups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed

# Order in which one line's findings are raised.
TYPE_ORDER = [*fixed.SIGNATURES, "BRUTE_FORCE", "DDOS", "UNAUTHORIZED_ACCESS", "SUSPICIOUS_ACCESS",
              "API_ABUSE", "SENSITIVE_DATA_EXPOSURE", "ANOMALOUS_TIME", "ML_DETECTED"]


def _lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def severity_of(kind: Column) -> Column:
    return _lookup(kind, fixed.SEVERITY_OF_TYPE, "MEDIUM")


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, fixed.SEVERITY_RANK, 0)


def type_rank(kind: Column) -> Column:
    return _lookup(kind, {name: i for i, name in enumerate(TYPE_ORDER)}, len(TYPE_ORDER))


def risk_score(kind: Column, count: Column) -> Column:
    """Base score of the type plus a hundredth per hit, at most a tenth; never above 1."""
    base = _lookup(kind, fixed.BASE_SCORES, fixed.OTHER_BASE_SCORE)
    return F.least(F.lit(1.0), base + F.least(F.lit(0.1), count * F.lit(0.01)))


def risk_step(severity: Column) -> Column:
    """What a finding adds to the risk of its address, in hundredths."""
    return _lookup(severity, fixed.RISK_STEPS, fixed.OTHER_RISK_STEP)
