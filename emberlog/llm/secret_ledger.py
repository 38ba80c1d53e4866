"""Secret scans over content: a ledger of blobs that have been scanned, by rule version.

A text is a blob, named by the SHA-256 of its bytes, whatever path and version of a file holds it.
The ledger is a Parquet folder with one row for each blob and rule version that was scanned and the
spans found. A run

1. names the blob of every row,
2. keeps the blobs that the ledger lacks under the present rule version, each with one row that holds it,
3. scans the text of those rows only and appends them to the ledger (an append of Parquet is whole or absent), and
4. joins the ledger's spans back to all rows with the blob.

A second run over a history that grew reads all texts to name them but scans the new blobs only;
where those are few, Spark sends their names to the texts instead of moving texts.

Nulls: a null text is the empty blob; a null ``doc_id`` is a value like another. Equal rows each get
the findings of their blob. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.rows import KEY, anchored, located, stored

FOUND = "array<struct<kind:string,rank:int,start:int,stop:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern; ``secret`` is the group whose length counts. Texts without any of ``pieces`` are not searched."""

    kind: str
    pattern: str
    least: int
    secret: int = 0
    pieces: tuple[str, ...] = ()
    any_case: bool = False


# Fixed values. The first three are the base rules; a change to any of them needs a new version.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2,
         ("password", "passwd", "secret", "token", "api_key", "apikey"), True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, ("AKIA",)),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0, ("PRIVATE KEY-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, 0, ("eyJ",)),
    Rule("hosted_token", r"gh[oprsu]_[A-Za-z0-9]+", 40, 0, ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 15, 0, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", 8, 0, ("://",)),
)
BASE_KINDS = ("assign", "access", "hex")
RULE_VERSION = "2"


def find_secrets(text: str, rules: tuple[Rule, ...], patterns: list[re.Pattern]) -> list[dict]:
    """Spans by start, then in the order of the rules; a match that is too short still uses up its text."""
    found, lowered = [], None
    for rank, (rule, pattern) in enumerate(zip(rules, patterns, strict=True)):
        if rule.pieces:
            if rule.any_case and lowered is None:
                lowered = text.lower()
            if not any(p in (lowered if rule.any_case else text) for p in rule.pieces):
                continue
        found += [{"kind": rule.kind, "rank": rank, "start": m.start(), "stop": m.end()}
                  for m in pattern.finditer(text) if len(m[rule.secret]) >= rule.least]
    return sorted(found, key=lambda s: (s["start"], s["rank"]))


def scan_blobs(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, text) to (blob_id, found)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("rank", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # runs of ASCII digits and letters a-f are long enough or fail: no need to look at short ones
        patterns = [re.compile(r.pattern if r.kind != "hex" else f"[0-9a-f]{{{r.least},}}", re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules]
        for batch in batches:
            found = [find_secrets(t.as_py() or "", rules, patterns) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("blob_id"), pa.array(found, kind)], ["blob_id", "found"])

    return texts.select("blob_id", "text").mapInArrow(work, f"blob_id string, found {FOUND}")


def read_ledger(spark, folder: str, version: str) -> DataFrame:
    """(blob_id, found) under a rule version; nothing where the folder is not there yet."""
    schema = f"blob_id string, found {FOUND}, rule_version string"
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], schema).drop("rule_version")
    return spark.read.schema(schema).parquet(folder).filter(F.col("rule_version") == version).drop("rule_version")


def scan_incremental(docs: DataFrame, folder: str, *, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """KEY, doc_id, blob_id and found of every row of ``docs``; the ledger in ``folder`` grows by the unseen blobs."""
    spark = docs.sparkSession
    docs = anchored(docs, "doc_id", "text")
    rows = located(docs, "doc_id", "text")
    paths = stored(rows.select(*KEY, "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob_id")), "paths")
    holder = F.min(F.struct(*KEY)).alias("holder")
    unseen = paths.groupBy("blob_id").agg(holder).join(read_ledger(spark, folder, version), "blob_id", "left_anti")
    unseen = stored(unseen.select("blob_id", *[F.col(f"holder.{k}").alias(k) for k in KEY]), "unseen")
    texts = located(docs, "text").join(unseen, [*KEY])
    scan_blobs(texts, rules).withColumn("rule_version", F.lit(version)).write.mode("append").partitionBy("rule_version").parquet(folder)
    # two runs at a time may both have scanned a blob; rows are made distinct after the join, where no key is hot
    return paths.join(read_ledger(spark, folder, version), "blob_id").dropDuplicates([*KEY])
