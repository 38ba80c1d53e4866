"""Benchmark decontamination by a prefix-filtered set join.

A window is an item-sized stretch of a benchmark item: ``window`` consecutive words, or all
words of a shorter item. It is a set of overlapping shingles of ``shingle`` words. To contain
the whole set, a document must hold the set's rarest member; so only that one, the window's
prefix, is looked up. The order by rarity comes from counts over all documents.

1. Windows are made distinct; each lists its shingles with their offsets.
2. A pass over the documents counts those shingles. A bit map of fixed size keeps all other
   shingles from leaving the task. A window with a shingle that no document has is done.
3. A second pass gives each place of a prefix shingle with the words around it; a join on the
   shingle brings the windows to it.
4. The offset says where the window would have to start. Where the document reaches that far
   on both sides (position and length bounds), the words themselves are compared.

Nulls: a null text has no words; a null ``doc_id`` or ``item_id`` is a value like another
(in the list of items, null ids are left out). Equal rows each get their own result. Empty
tables give empty results or no hits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import ragged
from emberlog.llm.gram_filter import bit_map, passing_grams
from emberlog.llm.rows import KEY, anchored, chosen_rows, located, scan, stored

WINDOW = 13
SHINGLE = 5


def _benchmark_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, words (joined by one space), n, shingles: array of (offset, code)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, table = ragged.lower_bytes(), ragged.letter_bytes()
        for batch in batches:
            data, offsets = ragged.text_bytes(batch.column("text"))
            for low, high in ragged.blocks(offsets):
                piece, rows = lower[data[offsets[low]:offsets[high]]], offsets[low:high + 1] - offsets[low]
                starts, ends, first = ragged.word_bounds(piece, rows, table)
                codes = ragged.word_hashes(piece, starts, ends)
                raw = piece.tobytes()
                out: dict[str, list] = {"item_id": [], "words": [], "n": [], "shingles": []}
                for i in range(high - low):
                    own = range(first[i], first[i + 1])
                    n = min(window, len(own))
                    k = min(shingle, n)
                    grams = ragged.gram_hashes(codes[own.start:own.stop], k) if n else ()
                    words = [raw[starts[j]:ends[j]].decode("utf-8", "replace") for j in own]
                    for at in range(len(own) - n + 1 if n else 0):
                        out["item_id"].append(batch.column("item_id")[low + i])
                        out["words"].append(" ".join(words[at:at + n]))
                        out["n"].append(n)
                        out["shingles"].append([{"offset": j, "code": int(c)} for j, c in enumerate(ragged.signed(grams[at:at + n - k + 1]))])
                yield pa.RecordBatch.from_arrays([
                    pa.array([x.as_py() for x in out["item_id"]], batch.schema.field("item_id").type), pa.array(out["words"], pa.string()), pa.array(out["n"], pa.int32()),
                    pa.array(out["shingles"], pa.list_(pa.struct([("offset", pa.int32()), ("code", pa.int64())])))], list(out))

    kind = dict(items.dtypes)["item_id"]
    return items.select("item_id", "text").mapInArrow(
        work, f"item_id {kind}, words string, n int, shingles array<struct<offset:int,code:bigint>>")


def _counts(docs: DataFrame, sizes: list[int], bits) -> DataFrame:
    """How often each code that passes the map occurs in the documents; added up in the task first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, found in passing_grams(batch.column("text"), sizes, bits.value):
                codes, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in found)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ragged.signed(codes)), pa.array(n)], ["code", "n"])

    return docs.select("text").mapInArrow(work, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("seen"))


def _places(docs: DataFrame, sizes: list[int], bits, window: int) -> DataFrame:
    """One row per document: n_words and, for each prefix place, the words around it."""
    around = pa.struct([("code", pa.int64()), ("at", pa.int32()), ("ahead", pa.int32()), ("words", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n_words, spots = [], []
            for low, high, piece, starts, ends, first, stop, found in passing_grams(batch.column("text"), sizes, bits.value):
                n_words.append(np.diff(first))
                own: list[list] = [[] for _ in range(high - low)]
                for size, places, codes in found:
                    rows = np.searchsorted(first, places, "right") - 1
                    for p, code, row in zip(places.tolist(), ragged.signed(codes).tolist(), rows.tolist(), strict=True):
                        left, right = max(first[row], p - window + size), min(stop[p], p + window)
                        words = " ".join(piece[starts[j]:ends[j]].tobytes().decode("utf-8", "replace") for j in range(left, right))
                        own[row].append({"code": code, "at": p - int(first[row]), "ahead": p - int(left), "words": words})
                spots += own
            yield {"n_words": pa.array(np.concatenate(n_words).astype(np.int64) if n_words else np.zeros(0, np.int64)), "spots": pa.array(spots, pa.list_(around))}

    return scan(docs, "n_words bigint, spots array<struct<code:bigint,at:int,ahead:int,words:string>>", work, (*KEY, "doc_id"))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, spans, owners): each row with its n_words; each window found (start, n, window_id) by KEY; the items of a window."""
    spark = docs.sparkSession
    texts = located(docs, "doc_id", "text")
    owners = stored(_benchmark_windows(benchmark, window, shingle).withColumn("window_id", F.sha2("words", 256)), "windows")
    windows = owners.dropDuplicates(["window_id"]).select("window_id", "words", "n", "shingles")
    members = windows.select("window_id", "words", "n", F.inline("shingles"))
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle)).alias("k")).distinct().collect())
    seen = _counts(texts, sizes, spark.sparkContext.broadcast(bit_map(members)))
    ranked = members.join(seen, "code", "left").withColumn("place", F.row_number().over(
        Window.partitionBy("window_id").orderBy(F.coalesce("seen", F.lit(0)), "offset")))
    prefixes = stored(ranked.filter("place = 1 AND seen > 0").select("window_id", F.split("words", " ").alias("wanted"), "n", "offset", "code"), "prefixes")
    found = stored(_places(texts, sizes, spark.sparkContext.broadcast(bit_map(prefixes)), window), "places")
    near = found.select(*KEY, F.inline("spots"))
    begin = F.col("ahead") - F.col("offset")
    spans = near.join(prefixes, "code").filter((begin >= 0) & (begin + F.col("n") <= F.size(F.split("words", " ")))).filter(
        F.slice(F.split("words", " "), begin + 1, F.col("n")) == F.col("wanted")).select(
        *KEY, (F.col("at") - F.col("offset")).alias("start"), "n", "window_id")
    return found.drop("spots"), spans, owners.select("window_id", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE, percent: int = 5) -> DataFrame:
    """One row per document: KEY, doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if at least ``percent`` in a hundred of its words lie in a window found.
    """
    rows, spans, owners = contaminated_spans(docs, benchmark, window=window, shingle=shingle)
    spans = stored(spans.distinct(), "spans")
    by_start = Window.partitionBy(*KEY).orderBy("start")
    stop = F.col("start") + F.col("n")
    before = F.coalesce(F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.groupBy(*KEY, "start").agg(F.max(stop).alias("stop")).withColumn("before", before).groupBy(*KEY).agg(
        F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before"))).cast("bigint").alias("n_hit"))
    items = spans.select(*KEY, "window_id").distinct().join(owners, "window_id").groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("nameless"))
    hit, words = F.coalesce("n_hit", F.lit(0)), F.col("n_words")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(covered, [*KEY], "left").join(items, [*KEY], "left").select(
        *KEY, "doc_id", "n_words", hit.alias("n_hit"), (F.size(listed) + F.coalesce("nameless", F.lit(0))).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), ((hit > 0) & (hit * 100 >= words * percent)).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE, percent: int = 5) -> DataFrame:
    """``docs`` without the contaminated rows."""
    docs = anchored(docs)
    found = decontaminate(docs, benchmark, window=window, shingle=shingle, percent=percent)
    return chosen_rows(docs, stored(found.filter("contaminated").select(*KEY), "contaminated"), "left_anti")
