"""Row types shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_STRINGS = T.ArrayType(T.StringType())
_MAP = T.MapType(T.StringType(), T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One parsed line. The last block holds optional fields that later operators
# read directly, so that they stay columns and can be pruned.
ENTRIES = _struct(
    ("log_file", _S), ("line_number", _L), ("raw_line", _S), ("log_type", _S),
    ("ts", T.TimestampNTZType()), ("source_ip", _S), ("user", _S), ("action", _S),
    ("status", _S), ("message", _S), ("target", _S), ("severity", _S),
    ("attack_indicators", _STRINGS), ("extra", _MAP),
    ("url", _S), ("method", _S), ("protocol", _S), ("size", _S), ("referer", _S),
    ("user_agent", _S), ("status_code", _I), ("hostname", _S), ("process", _S), ("pid", _S),
)

# One finding. ``rule`` names the operator that made it.
FINDINGS = _struct(
    ("id", _L), ("type", _S), ("severity", _S), ("source_ip", _S), ("target", _S),
    ("detail", _S), ("evidence", _STRINGS), ("event_ts", T.TimestampNTZType()),
    ("detected_ts", T.TimestampNTZType()), ("score", _D), ("ml_score", _D), ("count", _L),
    ("log_file", _S), ("line_number", _L), ("session_id", _S), ("rule", _S), ("extra", _MAP),
)

ALERTS = _struct(
    ("alert_id", _L), ("anomaly_id", _L), ("alert_type", _S), ("severity", _S),
    ("title", _S), ("message", _S), ("created_at", T.TimestampNTZType()),
)

ALERT_ACTIONS = _struct(
    ("alert_id", _L), ("action", _S), ("acted_at", T.TimestampNTZType()),
)

SESSIONS = _struct(
    ("session_id", _S), ("start_time", T.TimestampNTZType()), ("end_time", T.TimestampNTZType()),
    ("files_analyzed", _L), ("total_lines", _L), ("anomalies_found", _L), ("status", _S), ("notes", _S),
)

TRAINING = _struct(
    ("features", T.ArrayType(_D)), ("label", _I), ("anomaly_type", _S),
    ("created_at", T.TimestampNTZType()),
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``; columns it lacks become nulls."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
