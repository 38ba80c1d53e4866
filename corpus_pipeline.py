"""From raw documents to a training mix, in five stages.

Each stage is written as Parquet and read again by the next. A stage does not change its input; what
it decides (rows that go, words that go, rows that repeat) is in its result. SQL can't express the
flights of the mixing and the fingerprints, so the rows are tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bench_prefix, cube_mix, golay_simhash, line_winnow, quality_fences
from emberlog.llm.rows import read, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the quality rules go."""
    return quality_fences.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs are cut from the texts; n_chars follows the text."""
    cut = line_winnow.remove_repeats(docs)
    return cut.select(*[F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else cut[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose SimHash fingerprints (three-word shingles) link at two or fewer bits stays."""
    return golay_simhash.drop_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows contaminated by the benchmark go."""
    return bench_prefix.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, with the number of the copy."""
    return cube_mix.take(docs)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("mixing", mixing),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
