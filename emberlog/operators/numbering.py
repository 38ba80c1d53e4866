"""Consecutive row numbers over data of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.session import scratch_dir


def number_rows(df: DataFrame, *order: str | Column, name: str = "row_id") -> DataFrame:
    """1..n in the given order, without bringing the rows into one task.

    The sorted rows are written once with their place inside their partition;
    only one count per partition is then added up.
    """
    place = F.monotonically_increasing_id()
    placed = df.orderBy(*order).withColumns({
        "_part": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))})
    path = scratch_dir(df.sparkSession, "numbered")
    placed.write.parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row per partition of the sort: safe to broadcast
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    return rows.join(offsets, "_part").select(
        (F.col("_before") + F.col("_place") + 1).alias(name), *df.columns)
