"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; what is no letter is a blank, and blanks in a row are one. All n-grams of one to
four characters of a whole text count. Their hash picks one of 2^16 columns.

Learning adds up counts by language and column over all learning rows: a task keeps one array per
language and gives only its totals, so that the hot language is a sum like the others. Scoring
broadcasts the matrix of log-probabilities and adds up, for every text, the rows of the n-grams it
has. The matrix goes out in parts of ``part`` languages (64 times 2^16 floats, 16 MB, at most); with more
languages each part is one pass, and the best of the parts wins.

Nulls: rows with a null text or language teach nothing; a text that is null or without a letter is
``und`` with score 0, and so is every text if nothing was learned. Equal rows get equal results. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm import ragged
from emberlog.llm.rows import KEY, located, scan, stored

COLUMNS = 1 << 16
LONGEST = 4
SMOOTHING = 0.5
PART = 64
#: Languages a task adds up before it gives its totals.
HELD = 128
BLOCK_CHARS = 1 << 20


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def text_blocks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, lower-cased texts) of about BLOCK_CHARS characters; null is empty."""
    held, size, begin = [], 0, 0
    for i, text in enumerate(column):
        held.append((text.as_py() or "").lower())
        size += len(held[-1])
        if size >= BLOCK_CHARS:
            yield begin, held
            held, size, begin = [], 0, i + 1
    if held:
        yield begin, held


def gram_columns(texts: list[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, rows, lettered): the column of every n-gram, the text it is of (ascending within each length
    of n-gram), and whether each text has a letter."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = letter[codes]
    # a letter stays; of other characters the first of each row of them, as a blank
    stays = inside.copy()
    stays[1:] |= inside[:-1] & (rows[1:] == rows[:-1])
    kept, rows = np.where(inside, codes, 32)[stays].astype(np.uint64), rows[stays]
    lettered = np.zeros(len(texts), bool)
    lettered[rows[kept != 32]] = True
    columns, owners, total = [], [], np.zeros(len(kept), np.uint64)
    for size in range(1, min(LONGEST, len(kept)) + 1):
        total = total[:len(kept) - size + 1] * np.uint64(0x100000001B3) + kept[size - 1:]
        there = rows[size - 1:] == rows[:len(rows) - size + 1]
        columns.append((ragged.mixed(total[there] + np.uint64(size << 40)) & np.uint64(COLUMNS - 1)).astype(np.int64))
        owners.append(rows[:len(rows) - size + 1][there])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *columns]), np.concatenate([none, *owners]), lettered


def learn(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with text and lang (neither null) to (lang, column, n) and (lang, docs)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, sums = letters(), {}

        def totals() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "column", "n"])
            sums.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for begin, texts in text_blocks(batch.column("text")):
                columns, owners, _ = gram_columns(texts, letter)
                names, which = np.unique(np.array(langs[begin:begin + len(texts)], object), return_inverse=True)
                of = which[owners]
                for k, lang in enumerate(names):
                    sums.setdefault(lang, np.zeros(COLUMNS, np.int64))
                    sums[lang] += np.bincount(columns[of == k], minlength=COLUMNS)
                if len(sums) > HELD:
                    yield from totals()
        yield from totals()

    taught = rows.select("text", "lang")
    counts = taught.mapInArrow(work, "lang string, column int, n bigint").groupBy("lang", "column").agg(F.sum("n").alias("n"))
    return stored(counts, "grams"), stored(taught.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "langs")


def log_matrix(counts: DataFrame, docs: dict[str, int], langs: list[str]) -> np.ndarray:
    """COLUMNS + 1 rows, one column per language: log-probabilities, and in the last row the logs of the shares."""
    found = counts.filter(F.col("lang").isin(langs)).toPandas()
    n = np.zeros((len(langs), COLUMNS))
    n[found["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(np.int64), found["column"].to_numpy(np.int64)] = found["n"].to_numpy()
    n += SMOOTHING
    shares = np.array([docs[lang] for lang in langs], float) / sum(docs.values())
    return np.vstack([np.log(n / n.sum(axis=1, keepdims=True)).T, np.log(shares)[None, :]]).astype(np.float32)


def _score(docs: DataFrame, langs: list[str], matrix) -> DataFrame:
    """KEY, doc_id, lettered, and of these languages the best, its log-likelihood and the log of the sum of all likelihoods."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        letter, logs = letters(), matrix.value
        for batch in batches:
            sums, has = [np.zeros((0, len(langs)))], [np.zeros(0, bool)]
            for _, texts in text_blocks(batch.column("text")):
                columns, owners, lettered = gram_columns(texts, letter)
                total = np.tile(logs[-1].astype(float), (len(texts), 1))
                # the n-grams of one length are in the order of the texts; each stretch of one text is one sum
                edges = np.flatnonzero(np.diff(owners, prepend=-1))
                if len(edges):
                    np.add.at(total, owners[edges], np.add.reduceat(logs[columns], edges, axis=0, dtype=float))
                sums.append(total)
                has.append(lettered)
            total = np.concatenate(sums)
            best = total.argmax(axis=1)
            top = total[np.arange(len(total)), best]
            every = top + np.log(np.exp(total - top[:, None]).sum(axis=1))
            yield {"lettered": pa.array(np.concatenate(has)), "best": pa.array(np.array(langs, object)[best], pa.string()), "top": pa.array(top), "every": pa.array(every)}

    return scan(docs, "lettered boolean, best string, top double, every double", work, (*KEY, "doc_id"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row is kept from learning: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, taught: DataFrame, *, part: int = PART) -> DataFrame:
    """KEY, doc_id, lang_pred and score (the share of the best language in all likelihoods) of every row of ``docs``;
    learned from ``taught`` (text, lang)."""
    counts, sizes = learn(taught.filter("text IS NOT NULL AND lang IS NOT NULL"))
    docs_of = {r["lang"]: r["docs"] for r in sizes.collect()}  # one row per language
    langs, texts, parts = sorted(docs_of), located(docs, "doc_id", "text"), []
    if not langs:
        return texts.select(*KEY, "doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for low in range(0, len(langs), part):
        own = langs[low:low + part]
        parts.append(_score(texts, own, docs.sparkSession.sparkContext.broadcast(log_matrix(counts, docs_of, own))))
    found = parts[0]
    if len(parts) > 1:
        for more in parts[1:]:
            found = found.union(more)
        found = stored(found, "parts").groupBy(*KEY, "doc_id").agg(
            F.max("lettered").alias("lettered"), F.max(F.struct("top", "best")).alias("win"), F.max("every").alias("peak"), F.collect_list("every").alias("everies")).select(
            *KEY, "doc_id", "lettered", "win.best", "win.top", (F.col("peak") + F.log(F.aggregate(
                "everies", F.lit(0.0), lambda total, e: total + F.exp(e - F.col("peak"))))).alias("every"))
    return found.select(*KEY, "doc_id", F.when(F.col("lettered"), F.col("best")).otherwise("und").alias("lang_pred"),
                        F.when(F.col("lettered"), F.least(F.lit(1.0), F.exp(F.col("top") - F.col("every")))).otherwise(F.lit(0.0)).alias("score"))
