"""Row keys that survive a lost executor, and written intermediates."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import scratch_dir

#: A row is named by a hash of its file's path and its place in that file. Both are the
#: same however often a task runs again, also for rows that are equal in every column.
KEY = ("row_file", "row_at")
KEY_DDL = "row_file bigint, row_at bigint"
#: What goes to a Python worker at a time. Texts differ too much in length to count rows.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, so that long texts don't add up in a worker."""
    for name, value in BATCH_BYTES.items():
        spark.conf.set(name, value)


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: lineage ends here."""
    path = scratch_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only filters and projects the rows of files, so that each row has a place of its own."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


def anchored(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns (or all) as rows of files: as they are for a scan of files, else written once.

    An operator that names its rows more than once starts with this, so that both names agree.
    """
    bound_batches(docs.sparkSession)
    picked = docs.select(*[docs[c] for c in columns]) if columns else docs
    return picked if _is_scan(picked) else stored(picked, "rows")


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``docs`` with KEY before them.

    Only the named columns are taken: other columns, whatever their names, can't get in the way.
    """
    place = (F.xxhash64("_metadata.file_path").alias(KEY[0]), F.col("_metadata.row_index").alias(KEY[1]))
    return anchored(docs, *columns).select(*place, *columns)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from the columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    return next(n for i in itertools.count() if (n := name + "_" * i).lower() not in taken)


def whole_rows(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns of ``docs`` and a key, whose names no column of ``docs`` has."""
    names = [free_name(docs, k) for k in KEY]
    found = located(docs, *docs.columns)
    return found.toDF(*names, *docs.columns), names


def chosen_rows(docs: DataFrame, keys: DataFrame, how: str, *, many: bool = False) -> DataFrame:
    """The rows of ``docs`` (anchored) whose KEY is among ``keys`` (``left_semi``) or is not (``left_anti``).

    ``many`` says that the keys are a share of all rows: they meet the rows by a shuffle whatever their number, are hashed,
    and no text is sorted.
    """
    rows, names = whole_rows(docs)
    picked = keys.select(*[F.col(k).alias(f"of_{k}") for k in KEY])
    picked = picked.hint("shuffle_hash") if many else picked
    return rows.join(picked, [rows[n] == picked[f"of_{k}"] for n, k in zip(names, KEY, strict=True)], how).select(*[rows[c] for c in docs.columns])


def scan(df: DataFrame, added: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], keep: tuple[str, ...]) -> DataFrame:
    """Arrow batches through ``work``; the columns ``keep`` go along as they are.

    ``work`` yields for every batch, in turn, the new columns as a dict of Arrow arrays.
    Texts are read whole and don't come back from the workers.
    """
    bound_batches(df.sparkSession)
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in keep), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, behind = itertools.tee(batches)
        for batch, new in zip(ahead, work(behind), strict=True):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new.values()], [*keep, *new])

    return df.mapInArrow(run, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

