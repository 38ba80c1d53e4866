"""Removal of repeated runs of text by winnowing over line hashes.

Corpora break lines anywhere and passages begin in the middle of lines, so a line here is what a
fixed width makes of a text: ``line`` words from any word on. A text is the sequence of the hashes
of its rolling lines. Of every ``window`` neighbouring hashes the smallest is a fingerprint. A run that
occurs twice and has at least ``line + window - 1`` words (50) has a fingerprint in common for certain, and
neighbouring fingerprints of a run are never further apart than a line is long, so they leave no gap.

1. One pass gives the fingerprints of every document. Documents are numbered in the order of
   ``doc_id``, and a word has one address over the whole corpus: its document's number times the
   longest length, plus its place. The first occurrence of a fingerprint is a minimum of addresses.
2. Each later occurrence is joined to the first (never to all others). Those on one diagonal, with the
   same distance, that touch form runs.
3. Runs that touch in the text make an island. At its ends up to ``window`` words are compared with those at
   the sources of the runs that end there, and the island grows by the equal ones. That is as far as it can go:
   further on there would be a fingerprint.
4. The words of the islands are deleted from the later place. Each deleted word has an equal one at a
   smaller address, so the first copy of everything stays.

Nulls: a null text has no words and stays null; null ``doc_id`` come last, in the order of the rows.
Equal rows: the first keeps its text. Texts of fewer than ``line`` words are never touched. Empty
tables give empty results. Other columns are passed on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import ragged
from emberlog.llm.gram_filter import MAP_BITS, bit_map
from emberlog.llm.rows import KEY, anchored, located, scan, stored, whole_rows
from emberlog.operators.numbering import number_rows

LINE = 26
WINDOW = 25


def sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """``least`` of every ``width`` neighbours; ``width - 1`` fewer than in ``x``."""
    span = 1
    while 2 * span <= width:
        x, span = least(x[:-span], x[span:]), 2 * span
    return least(x[:len(x) - (width - span)], x[width - span:]) if width > span else x


def winnowed(words: np.ndarray, first: np.ndarray, line: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints; a row with lines but no whole window has its smallest one."""
    count, top = len(words), np.uint64(0xFFFFFFFFFFFFFFFF)
    if count < line:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, stop = np.arange(count), ragged.row_ends(first)
    codes = np.full(count, top)
    codes[:count - line + 1] = ragged.gram_hashes(words, line)
    there = place + line <= stop
    codes[~there] = top
    reach = sliding(np.concatenate([codes, np.full(window - 1, top)]), window, np.minimum)
    reach[place + line + window - 1 > stop] = 0
    peak = sliding(np.concatenate([np.zeros(window - 1, np.uint64), reach]), window, np.maximum)
    chosen = there & (codes == peak)
    n_words = np.diff(first)
    short = np.flatnonzero((n_words >= line) & (n_words < line + window - 1))
    if len(short):
        edges = np.stack([first[short], first[short + 1]], axis=1).ravel()
        smallest = np.zeros(len(n_words), np.uint64)
        smallest[short] = np.minimum.reduceat(np.concatenate([codes, [top]]), edges)[::2]
        chosen |= there & (codes == np.repeat(smallest, n_words))
    spots = np.flatnonzero(chosen)
    return spots, codes[spots]


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    lower, table = ragged.lower_bytes(), ragged.solid_bytes()
    data, offsets = ragged.text_bytes(batch.column("text"))
    for low, high in ragged.blocks(offsets):
        piece, rows = lower[data[offsets[low]:offsets[high]]], offsets[low:high + 1] - offsets[low]
        starts, ends, first = ragged.word_bounds(piece, rows, table)
        yield low, high, ragged.word_hashes(piece, starts, ends), first


def _marks(docs: DataFrame, line: int, window: int) -> DataFrame:
    """KEY, doc_id, n_words, and the codes and places of the fingerprints."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n_words, counts, codes, places = ([np.zeros(0, np.int64)] for _ in range(4))
            for _, _, words, first in _blocks_of(batch):
                spots, found = winnowed(words, first, line, window)
                row = np.searchsorted(first, spots, "right") - 1
                n_words.append(np.diff(first))
                counts.append(np.bincount(row, minlength=len(first) - 1))
                codes.append(ragged.signed(found))
                places.append(spots - first[row])
            count = np.concatenate(counts)
            yield {"n_words": pa.array(np.concatenate(n_words)), "codes": ragged.lists(count, pa.array(np.concatenate(codes))),
                   "places": ragged.lists(count, pa.array(np.concatenate(places)))}

    return scan(docs, "n_words bigint, codes array<bigint>, places array<bigint>", work, (*KEY, "doc_id"))


def _around(texts: DataFrame, width: int) -> DataFrame:
    """``texts`` (rank, text, asked: array of (at, side)) to (rank, at, side, near): the hashes of up to ``width``
    words before place ``at`` (side -1) or from it on (side 1), nearest first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            n, flat = np.diff(asked.offsets.to_numpy()), asked.flatten()
            edges = np.concatenate([[0], np.cumsum(n)])
            at, side = flat.field("at").to_numpy(), flat.field("side").to_numpy()
            rank = np.repeat(batch.column("rank").to_numpy(), n)
            for low, high, words, first in _blocks_of(batch):
                own = slice(edges[low], edges[high])
                row = np.repeat(np.arange(high - low), n[low:high])
                begin = first[row] + at[own]
                steps = np.arange(width)
                spots = np.where(side[own][:, None] > 0, begin[:, None] + steps, begin[:, None] - 1 - steps)
                inside = (spots >= first[row][:, None]) & (spots < first[row + 1][:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank[own]), pa.array(at[own]), pa.array(side[own]), ragged.lists(inside.sum(axis=1), pa.array(ragged.signed(words[spots[inside]])))],
                    ["rank", "at", "side", "near"])

    return texts.select("rank", "text", "asked").mapInArrow(work, "rank bigint, at bigint, side int, near array<bigint>")


def _asked_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the rows that are asked for. A bit map of fixed size keeps most other texts out of the shuffle."""
    name = F.xxhash64(*KEY).alias("code")
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(wanted.select(name)))

    @F.arrow_udf("boolean")
    def listed(codes: pa.Array) -> pa.Array:
        at = codes.to_numpy().view(np.uint64)
        place = (at & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
        return pa.array((bits.value[place >> 6] >> (at & np.uint64(63))) & np.uint64(1) == 1)

    texts = located(docs, "text").withColumn("code", name)
    return texts.filter(listed("code")).drop("code").join(wanted, [*KEY])


def repeated_runs(docs: DataFrame, *, line: int = LINE, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(documents, runs): KEY, doc_id, n_words and rank of every row; rank, start and stop of the merged runs to delete, in words."""
    if window >= line:
        raise ValueError("fingerprints must lie closer than a line is long")
    docs = anchored(docs, "doc_id", "text")
    marks = stored(_marks(located(docs, "doc_id", "text"), line, window), "marks")
    ranks = stored(number_rows(marks.select(*KEY, "doc_id", "n_words"), F.col("doc_id").asc_nulls_last(), *KEY, name="rank"), "ranks")
    rows, longest = ranks.agg(F.count(F.lit(1)), F.max("n_words")).first()
    span = (longest or 0) + 1
    # addresses are longs; only a corpus whose rows times longest text pass 2^63 needs wider numbers
    kind = "bigint" if (rows + 1) * span < 1 << 63 else "decimal(38,0)"
    address = F.col("rank").cast(kind) * F.lit(span).cast(kind) + F.col("place")
    spots = marks.join(ranks.select(*KEY, "rank"), [*KEY]).select("rank", F.inline(F.arrays_zip(F.col("codes").alias("code"), F.col("places").alias("place")))).select(
        "code", address.cast(kind).alias("address"))
    spots = stored(spots, "spots")
    firsts = stored(spots.groupBy("code").agg(F.min("address").alias("source"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "firsts")
    later = spots.join(firsts, "code").filter("address > source")
    doc_of = lambda c: F.floor((F.col(c) - F.col(c) % span) / span).cast("bigint") if kind != "bigint" else F.expr(f"{c} div {span}")
    place_of = lambda c: (F.col(c) % span).cast("bigint")
    later = later.select(doc_of("address").alias("rank"), place_of("address").alias("at"), doc_of("source").alias("from_rank"), place_of("source").alias("from_at"))
    diagonal = Window.partitionBy("rank", "from_rank", "shift").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(diagonal) > line, F.lit(True))
    runs = later.withColumn("shift", F.col("at") - F.col("from_at")).withColumn("opens", apart.cast("int")).withColumn("run", F.sum("opens").over(diagonal)).groupBy(
        "rank", "from_rank", "shift", "run").agg(F.min("at").alias("start"), (F.max("at") + line).alias("stop"))
    # runs that overlap or touch in the text are one island; only runs that end near its ends can make it grow
    along = Window.partitionBy("rank").orderBy("start", "stop")
    fresh = F.coalesce(F.col("start") > F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = Window.partitionBy("rank", "island")
    runs = runs.drop("run").withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(along)).withColumns(
        {"first": F.min("start").over(island), "last": F.max("stop").over(island)})
    at_left, at_right = F.col("start") - window < F.col("first"), F.col("stop") + window > F.col("last")
    runs = stored(runs.filter(at_left | at_right).drop("fresh", "island"), "runs")
    sides = F.inline(F.filter(F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("at"), (F.col(c) - F.col("shift")).alias("from_at"), near.alias("near"))
                                        for side, c, near in ((-1, "start", at_left), (1, "stop", at_right))]), lambda tip: tip["near"]))
    tips = runs.select("rank", "from_rank", sides).drop("near")
    asked = tips.select("rank", "at", "side").union(tips.select("from_rank", "from_at", "side")).groupBy("rank").agg(
        F.collect_set(F.struct("at", "side")).alias("asked"))
    wanted = stored(asked.join(ranks.select("rank", *KEY), "rank"), "wanted")
    near = stored(_around(_asked_texts(docs, wanted), window), "near")
    there = near.select(F.col("rank").alias("from_rank"), F.col("at").alias("from_at"), "side", F.col("near").alias("there"))
    equal = F.zip_with("near", "there", lambda a, b: F.coalesce(a == b, F.lit(False)))
    differ = F.array_position(equal, F.lit(False))
    more = F.when(differ > 0, differ - 1).otherwise(F.size(equal)).cast("bigint")
    grown = tips.join(near, ["rank", "at", "side"]).join(there, ["from_rank", "from_at", "side"]).select("rank", "at", "side", more.alias("more")).filter("more > 0").select(
        "rank", F.when(F.col("side") < 0, F.col("at") - F.col("more")).otherwise(F.col("at")).alias("start"),
        F.when(F.col("side") < 0, F.col("at")).otherwise(F.col("at") + F.col("more")).alias("stop"))
    grown = runs.select("rank", F.col("first").alias("start"), F.col("last").alias("stop")).union(grown)
    ordered = Window.partitionBy("rank").orderBy("start", "stop")
    opens = F.coalesce(F.col("start") > F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = grown.distinct().withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(ordered)).groupBy("rank", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"))
    return ranks, merged.drop("island")


def _per_row(docs: DataFrame, line: int, window: int) -> DataFrame:
    """KEY, doc_id, n_words, spans (array of (start, stop), null for none) of every row."""
    ranks, runs = repeated_runs(docs, line=line, window=window)
    spans = runs.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return ranks.join(spans, "rank", "left").select(*KEY, "doc_id", "n_words", "spans")


def find_repeats(docs: DataFrame, *, line: int = LINE, window: int = WINDOW) -> DataFrame:
    """KEY, doc_id, n_words, n_removed and spans (start:stop of each deleted run, in words) of every row."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["stop"] - s["start"])
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return _per_row(docs, line, window).select(
        *KEY, "doc_id", "n_words", F.coalesce(removed, F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce(listed, F.lit("")).alias("spans"))


def cut(text: bytes, starts: np.ndarray, ends: np.ndarray, spans: list[dict]) -> str:
    """The text without the words of the spans and the blanks after them; a line break after a cut stays where text goes before it."""
    kept, at = [], 0
    for span in spans:
        kept.append(text[at:starts[span["start"]]])
        last = span["stop"] - 1
        at = int(starts[span["stop"]]) if span["stop"] < len(starts) else len(text)
        before = b"".join(kept[-1:])
        if before and not before.endswith(b"\n") and b"\n" in text[ends[last]:at] and span["stop"] < len(starts):
            kept.append(b"\n")
    kept.append(text[at:])
    return b"".join(kept).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, *, line: int = LINE, window: int = WINDOW) -> DataFrame:
    """``docs`` without the later copies of repeated runs. A row all of whose words go is left out."""
    @F.arrow_udf("string")
    def shortened(texts: pa.Array, spans: pa.Array) -> pa.Array:
        table, out = ragged.solid_bytes(), []
        for text, own in zip(texts, spans, strict=True):
            if not own.is_valid:
                out.append(text.as_py())
                continue
            data = text.as_py().encode()
            piece = np.frombuffer(data, np.uint8)
            starts, ends, _ = ragged.word_bounds(piece, np.array([0, len(piece)]), table)
            out.append(cut(data, starts, ends, own.as_py()))
        return pa.array(out, pa.string())

    docs = anchored(docs)
    rows, names = whole_rows(docs)
    found = stored(_per_row(docs, line, window).filter("spans IS NOT NULL"), "spans")
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["stop"] - s["start"]) >= F.col("n_words")
    found = found.select(F.col(KEY[0]).alias("found_file"), F.col(KEY[1]).alias("found_at"), F.struct("spans", gone.alias("gone")).alias("found"))
    joined = rows.join(found.hint("shuffle_hash"), (rows[names[0]] == found["found_file"]) & (rows[names[1]] == found["found_at"]), "left")
    kept = joined.filter(~F.coalesce(found["found"]["gone"], F.lit(False)))
    return kept.select(*[shortened(rows[c], found["found"]["spans"]).alias(c) if c == "text" else rows[c] for c in docs.columns])
