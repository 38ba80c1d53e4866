"""Log files and stored tables to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clean_line(text: Column) -> Column:
    """Undecodable bytes dropped, blanks of any script cut at both ends."""
    return F.regexp_replace(F.regexp_replace(text, "�", ""), r"(?U)^\s+|\s+$", "")


def read_logs(spark: SparkSession, paths: str | list[str], *, line_numbers: bool = True) -> DataFrame:
    """``log_file``, ``line_number``, ``raw_line`` of one file, folder or many.

    Blank lines are left out but counted. ``line_numbers=False`` saves the second
    pass over the text: ``line_number`` then only grows with the position in the
    file, which is all that ordering needs.
    """
    text = spark.read.text(paths)
    numbered = with_line_numbers(text) if line_numbers else text.select(
        F.col("_metadata.file_path").alias("log_file"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(
            F.lit((1 << 33) - 1))).alias("line_number"),
        "value")
    return numbered.select("log_file", "line_number", clean_line(F.col("value")).alias("raw_line")).filter("raw_line <> ''")


read_many = read_logs


def line_index(placed: DataFrame) -> DataFrame:
    """(``file``, ``block``, ``shift``): what turns a row's place in its task into its line number.

    A row for each block of a file that a task reads, 128 MB of text as Spark cuts files: 100 TB have 800,000, three
    numbers each. ``file`` is a hash of the path.
    """
    blocks = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return blocks.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))


def with_line_numbers(text: DataFrame) -> DataFrame:
    """1-based physical line numbers for ``spark.read.text`` rows.

    The lines of each block are counted first; the counts of a file's earlier blocks are then added to the place of a
    line inside its block. The index goes to the text, so the text itself never moves.
    """
    placed = text.select(
        F.col("_metadata.file_path").alias("log_file"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")
    index = F.broadcast(line_index(placed.select("file", "block", "place")))
    return placed.join(index, ["file", "block"]).select("log_file", (F.col("place") + F.col("shift")).alias("line_number"), "value")


def read_training(training: DataFrame, limit: int = 10_000) -> DataFrame:
    """Newest labelled vectors."""
    return training.orderBy(F.desc("created_at"), "features").limit(limit).select("features", "label", "anomaly_type")
