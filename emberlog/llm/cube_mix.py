"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size takes each of its documents floor(r) times and once
more with probability r - floor(r). Those probabilities are moved to 0 or 1 together: three
documents at a time are shifted along the direction that keeps both their expected number of
documents and their expected number of words, as far as the first of them gets to 0 or 1 (the
flight). So the totals stay at their targets while documents are decided, until a few are left,
for which the landing gives up the document total first and then draws.

Flights need no other rows, so a source is cut into blocks by a hash and every block flies alone,
leaving at most two documents open. The open ones of many blocks form the blocks of the next
level, up to one block per source, which lands. A source with a third of all rows is thousands
of blocks. Draws come from the rows' hashes and block numbers: reruns agree.

Targets: sources in code-point order (null last) have the weights in turn and share all words;
a target stops at ``most`` times its source's words and the excess is shared again by weight.

Nulls: a null text has no words and is never taken; a null source is a source; a null ``doc_id`` is
a value like another. Equal rows are drawn one by one. A source without words has target 0. Empty
tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import ragged
from emberlog.llm.rows import KEY, KEY_DDL, anchored, free_name, located, scan, stored, whole_rows
from emberlog.operators.numbering import number_rows

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 17
#: Rows of a first block, and how many blocks of one level make a block of the next.
BLOCK_ROWS = 4096
FAN = 1024
NEAR = 1e-9


def word_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """KEY, the columns ``keep`` and size (words between blanks) of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = ragged.solid_bytes()
        for batch in batches:
            data, offsets = ragged.text_bytes(batch.column("text"))
            parts = [np.zeros(0, np.int64)]
            for low, high in ragged.blocks(offsets):
                first = ragged.word_bounds(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], table)[2]
                parts.append(np.diff(first))
            yield {"size": pa.array(np.concatenate(parts).astype(np.int64))}

    return scan(located(docs, *keep, "text"), "size bigint", work, (*KEY, *keep))


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, source_rows) from rows with source and size."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    turn = (F.col("rank") - 1) % len(weights)
    ranked = number_rows(stored(sums, "sources"), F.col("source").asc_nulls_last(), name="rank")
    rows = stored(ranked.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn)), "weights")
    total, shares = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    unit, stopped = (total / shares if total else 0.0), -1
    while total:  # each pass stops at least one more source, or ends
        over = F.col("weight") * F.lit(unit) > most * F.col("source_size")
        n, full, open_shares = rows.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == stopped:
            break
        stopped, unit = n, (total - full) / open_shares
    return rows.select("source", "source_size", "source_rows",
                       F.least(F.col("weight") * F.lit(float(unit)), (most * F.col("source_size")).cast("double")).alias("target"))


def fly(size: np.ndarray, chance: np.ndarray, draw: np.random.Generator, land: bool) -> np.ndarray:
    """Move the chances of units to 0 or 1, keeping their sum and their sum by size; at most two stay open.

    With ``land`` those are decided too: the sum by size is kept once more, then the last is drawn.
    """
    p, sizes = chance.tolist(), size.tolist()
    draws = iter(draw.random(2 * len(p) + 4).tolist())
    held: list[int] = []

    def move(units: list[int], way: tuple[float, ...]) -> None:
        up = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in zip(units, way, strict=True) if u)
        down = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in zip(units, way, strict=True) if u)
        step = up if next(draws) * (up + down) < down else -down
        for i, u in zip(units, way, strict=True):
            p[i] += step * u
            p[i] = 0.0 if p[i] < NEAR else 1.0 if p[i] > 1 - NEAR else p[i]

    for unit in range(len(p)):
        held.append(unit)
        while len(held) == 3:
            a, b, c = (sizes[i] for i in held)
            top = max(abs(b - c), abs(c - a), abs(a - b))
            move(held, ((b - c) / top, (c - a) / top, (a - b) / top) if top else (1.0, -1.0, 0.0))
            held = [i for i in held if 0 < p[i] < 1]
    while land and (held := [i for i in held if 0 < p[i] < 1]):
        if len(held) == 2:
            a, b = (sizes[i] for i in held)
            move(held, (b / max(a, b), -a / max(a, b)))
        else:
            p[held[0]] = float(next(draws) < p[held[0]])
    return np.array(p)


UNIT_DDL = f"{KEY_DDL}, source string, block bigint, draw bigint, size bigint, chance double"


def _flight(seed: int, level: int, last: bool):
    def flight(rows: pd.DataFrame) -> pd.DataFrame:
        # the order of a block is by a hash of what the rows are; equal rows by where they lie
        rows = rows.iloc[np.lexsort((rows["row_file"], rows["row_at"], rows["size"], rows["draw"]))]
        source = rows["source"].iloc[0]
        name = [] if source is None else [1, *str(source).encode()]
        draw = np.random.default_rng([seed, level, int(rows["block"].iloc[0]), *name])
        return rows.assign(chance=fly(rows["size"].to_numpy(), rows["chance"].to_numpy(), draw, last))

    return flight


def decide(units: DataFrame, blocks: int, *, seed: int = SEED) -> DataFrame:
    """Units (KEY, source, block, draw, size, chance strictly between 0 and 1) to KEY and picked (0 or 1).

    ``blocks`` is the largest number of blocks that a source has.
    """
    done, level = [], 0
    while True:
        last = blocks <= 1
        flown = stored(units.groupBy("source", "block").applyInPandas(_flight(seed, level, last), UNIT_DDL), "flown")
        open_ones = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(flown.filter(~open_ones).select(*KEY, F.col("chance").cast("int").alias("picked")))
        if last:
            break
        units = flown.filter(open_ones).withColumn("block", F.expr(f"block div {FAN}"))
        blocks, level = -(-blocks // FAN), level + 1
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """KEY, doc_id, source, size, source_size, target, copies and taken (copies times size) of every row."""
    sizes = stored(word_counts(docs, "doc_id", "source"), "sizes")
    goals = stored(targets(sizes, weights=weights, most=most), "targets").withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.join(goals, sizes["source"].eqNullSafe(goals["of_source"])).drop("of_source").withColumns(
        {"whole": F.floor(rate).cast("bigint"), "chance": rate - F.floor(rate)})
    blocks = F.ceil(F.col("source_rows") / block_rows)
    units = rows.filter(f"size > 0 AND chance > {NEAR} AND chance < 1 - {NEAR}").select(
        *KEY, "source", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "row_at"), blocks).cast("bigint").alias("block"),
        F.xxhash64(F.lit(seed), "doc_id", "size").alias("draw"), "size", "chance")
    most_rows = goals.agg(F.max("source_rows")).first()[0] or 0
    picked = decide(units, -(-most_rows // block_rows), seed=seed)
    drawn = F.coalesce("picked", F.when(F.col("chance") >= 1 - NEAR, F.lit(1)), F.lit(0))
    copies = F.when(F.col("size") > 0, F.col("whole") + drawn).otherwise(F.lit(0)).cast("bigint")
    return rows.join(picked, [*KEY], "left").withColumn("copies", copies).select(
        *KEY, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, *, copy: str = "copy", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with a column that numbers its copies from 1
    (``copy``, with underscores behind it where ``docs`` has a column of that name)."""
    docs = anchored(docs)
    mixed = mix(docs, weights=weights, most=most, seed=seed).filter("copies > 0")
    picked = stored(mixed.select(*[F.col(k).alias(f"of_{k}") for k in KEY], F.col("copies").alias("of_copies")), "taken")
    rows, names = whole_rows(docs)
    joined = rows.join(picked.hint("shuffle_hash"), [rows[n] == picked[f"of_{k}"] for n, k in zip(names, KEY, strict=True)])
    return joined.select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("of_copies").cast("int"))).alias(free_name(docs, copy)))
