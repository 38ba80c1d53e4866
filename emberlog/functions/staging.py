"""Columns that are worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters read but never repeat.

    A filter on a computed column is normally pushed below the projection, with
    the whole expression copied into it; for a chain of regular expressions that
    doubles the work. A generator with one row per row is not crossed.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
