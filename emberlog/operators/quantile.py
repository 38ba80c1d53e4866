"""Exact quantile of a column of any length."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the sketch. Its ranks are off by 0.01 % of the rows or less in 99 of 100 cases.
SKETCH = 32768
MARGIN = 0.0004


def exact_percentile(df: DataFrame, column: str, share: float, *, margin: float = MARGIN, sketch: int = SKETCH) -> float:
    """Percentile with linear interpolation between neighbours, in two passes.

    A quantile sketch gives two values that the wanted ranks lie between; the second pass counts the rows below and, by value,
    the rows between them, of which ``2 * margin`` of all rows are expected. Should the ranks lie outside after all,
    the second pass is run again with a wider margin. Give it a written table, as every pass reads the column again.
    """
    values = df.select(F.col(column).alias("v")).filter("v IS NOT NULL")
    held = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.kll_sketch_agg_double(F.col("v").cast("double"), sketch).alias("s"))
    rank = lambda by: F.kll_sketch_get_quantile_double("s", F.lit(min(1.0, max(0.0, share + by))))
    n, low, high, *near = held.select("n", "low", "high", F.when(F.col("n") > 0, rank(-margin)), F.when(F.col("n") > 0, rank(margin))).first()
    if not n:
        raise ValueError("no values")
    place = share * (n - 1)
    below, above = math.floor(place), math.ceil(place)
    begin, end = (low if share <= margin else near[0]), (high if share >= 1 - margin else near[1])
    while True:
        between = F.col("v").between(F.lit(begin), F.lit(end))
        counted = values.groupBy(F.when(between, F.col("v")).alias("v"), (F.col("v") < F.lit(begin)).alias("less")).agg(F.count(F.lit(1)).alias("n")).filter("v IS NOT NULL OR less").collect()
        before = sum(r["n"] for r in counted if r["v"] is None)
        inside = sorted((r["v"], r["n"]) for r in counted if r["v"] is not None)
        if before <= below and above < before + sum(count for _, count in inside):
            break
        begin, end = low, high  # the sketch was off by more than the margin
    found, at = {}, before
    for value, count in inside:
        for wanted in (below, above):
            if at <= wanted < at + count:
                found[wanted] = value
        at += count
    return found[below] + (found[above] - found[below]) * (place - below)
