"""Twenty numbers per entry for the models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import fixed_values as fixed
from emberlog.functions.regex import filled

FEATURES = fixed.FEATURE_NAMES


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("int")


def _holds_any(text: Column, words: list[str]) -> Column:
    return _flag(reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words]))


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def extract_features(entries: DataFrame, *, compat: bool = False) -> DataFrame:
    """Adds the feature columns. One projection, all built-in functions.

    ``compat`` reads the url from ``target`` only and leaves size and agent out,
    as when those fields are nested out of the extractor's sight.
    """
    message = F.coalesce(filled(F.col("message")), "raw_line", F.lit(""))
    target = F.coalesce("target", F.lit(""))
    url = target if compat else F.coalesce(filled(F.col("url")), target)
    agent = F.lit("") if compat else F.coalesce("user_agent", F.lit(""))
    status = filled(F.col("status")) if compat else F.coalesce(filled(F.col("status")), F.col("status_code").cast("string"))
    code = F.when(status.isNull(), F.lit(200)).otherwise(status.try_cast("int"))
    size = F.lit(0) if compat else F.coalesce(F.col("size").try_cast("bigint"), F.lit(0))
    octet = lambda i: F.get(F.split("source_ip", r"\."), F.lit(i))
    first = F.coalesce(octet(0).try_cast("int"), F.lit(0))
    dotted = F.contains("source_ip", F.lit("."))
    lowered = F.lower(message)
    values = {
        "hour_of_day": F.coalesce(F.hour("ts"), F.lit(12)),
        "day_of_week": F.coalesce(F.weekday("ts"), F.lit(3)),
        "request_length": F.length(message),
        "url_length": F.length(url),
        "num_special_chars": F.length(F.regexp_replace(message, r"[\p{L}\p{N} \t\n]", "")),
        "num_dots": _count_of(message, "."),
        "num_slashes": _count_of(message, "/\\"),
        "num_params": _count_of(url, "&?"),
        "has_sql_keywords": _holds_any(lowered, fixed.FEATURE_SQL_WORDS),
        "has_script_tags": _flag(F.contains(lowered, F.lit("<script"))),
        "has_path_traversal": _flag(F.contains(message, F.lit("../"))),
        "has_encoded_chars": _flag(F.contains(message, F.lit("%"))),
        "status_code_class": F.coalesce(F.floor(code / 100), F.lit(2)),
        "is_error_status": _flag(code >= 400),
        "response_size": size,
        "ip_octet_1": F.when(dotted, first).otherwise(0),
        "ip_octet_4": F.when(dotted, F.coalesce(octet(3).try_cast("int"), F.lit(0))).otherwise(0),
        "is_private_ip": _flag(dotted & (first.isin(10, 127) | ((first == 192) & (octet(1) == "168")))),
        "user_agent_length": F.length(agent),
        "is_known_scanner": _holds_any(F.lower(agent), fixed.FEATURE_SCANNERS),
    }
    return entries.withColumns({name: values[name].cast("double") for name in FEATURES})


def fit_scaler(features: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature (1 where it never varies).

    One aggregate; forty numbers come to the driver.
    """
    row = features.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES],
                       *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in FEATURES}


def scale(features: DataFrame, scaler: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """z-scores of the feature columns."""
    scaler = scaler or fit_scaler(features)
    return features.withColumns({c: (F.col(c) - mean) / spread for c, (mean, spread) in scaler.items()})
