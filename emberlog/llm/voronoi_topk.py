"""Exact search for the largest inner products by a Voronoi join.

Queries and data are grouped by the nearest of a few pivots. Of every group of data a summary is kept: its size, the range
of its two coordinates about the pivot (along the pivot, and the length of the rest), and its members nearest to the
pivot. From these follow, without looking at the data again,

* for each query a score that its k-th best partner reaches at least: the k-th best of the members in the summaries,
* for each group of queries and each group of data the highest score that a vector can reach by its two coordinates
  (Cauchy-Schwarz on the part beside the pivot).

A vector is sent only to those groups of queries where it can reach the score of some query, and there every pair is
scored in whole numbers. What the bounds rule out can't be among the best, so the result is exact; how much they
rule out depends on the data (little where vectors point in all directions).

Spread: small groups of queries are put together with their neighbours, a group of many queries is dealt out into
blocks, and the data of each block into slices, both by the key of the row. A copy of one vector in a third of all
rows therefore fills many slices. A task holds the queries of one block and reads its slice in turn.

Vectors are whole numbers: floor(256 * component). Vectors that are null or hold null, NaN or infinite components take
no part, nor do rows without ``vec_id``. Vectors meet only vectors of their length; those of length 0 score 0. Components
and scores stay within 64 bits (beyond, they are cut off there). Rows are named by their place in the input: of
repeated rows each is a candidate of its own, and each that asks gets its own answer. Other columns are not read. An
empty table has no answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.ragged import mixed
from emberlog.llm.rows import KEY, KEY_DDL, bound_batches, located, stored

PIVOTS = 128
#: Rows of which the pivots are taken.
SAMPLE = 1024
#: Least and most queries of a block, and vectors of a slice; between them a share of all.
BLOCK = (512, 1 << 16)
SLICE = (2048, 1 << 20)
SHARE = (16, 64)
#: Scores worked on at a time.
TILE = 1 << 21
EXACT = float(1 << 53)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices, within 64 bits."""
    if a.shape[1] == 0 or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    found = a.astype(object) @ b.astype(object).T
    return np.clip(found, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def coordinates(vectors: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Along each pivot, and the length of the rest: two arrays of vectors by pivots."""
    length = np.sqrt((pivot * pivot).sum(axis=1))
    along = (vectors @ pivot.T) / np.where(length > 0, length, 1)
    return along, np.sqrt(np.maximum((vectors * vectors).sum(axis=1)[:, None] - along * along, 0))


class Cells:
    """The pivots by length of vector, numbered through. A length without a pivot has the zero vector."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots, self.first, total = pivots, {}, 0
        for dim in sorted(pivots):
            self.first[dim], total = total, total + len(pivots[dim])

    def place(self, vectors: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest pivot of each vector and the coordinates about it."""
        pivot, x = self.pivots[dim], vectors.astype(np.float64)
        own = (((pivot * pivot).sum(axis=1))[None] - 2 * (x @ pivot.T)).argmin(axis=1)
        along, aside = coordinates(x, pivot)
        at = np.arange(len(x))
        return own + self.first[dim], along[at, own], aside[at, own]


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each length of vector."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


def whole_numbers(vectors: DataFrame, asks: Column) -> DataFrame:
    """KEY, vec_id, v (whole numbers), dim and whether the row asks; rows that take no part are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = located(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return stored(rows.select(*KEY, F.col("vec_id").cast("bigint"), v.alias("v"), F.size("embedding").alias("dim"), asks.alias("asks")), "whole")


def choose_cells(rows: DataFrame, pivots: int, sample: int) -> Cells:
    """Pivots from a sample by the hash of the row key; at most ``sample`` vectors and one row per length come to the driver."""
    picked = rows.orderBy(F.xxhash64(*KEY), *KEY).limit(sample).select("dim", "v").collect()
    some: dict[int, dict[tuple, None]] = {}
    for r in picked:
        some.setdefault(r.dim, {})[tuple(r.v)] = None
    total = sum(map(len, some.values()))
    found = {}
    for dim, vectors in some.items():
        share = list(vectors)[:max(1, round(pivots * len(vectors) / total))]
        found[dim] = np.array(share, np.float64).reshape(len(share), dim)
    for r in rows.select("dim").distinct().collect():
        found.setdefault(r.dim, np.zeros((1, r.dim)))
    return Cells(found)


def assigned(rows: DataFrame, cells: Cells) -> DataFrame:
    """``rows`` with their cell and coordinates, written."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)
    names = [*KEY, "vec_id", "v", "dim", "asks"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_dim(batch):
                cell, along, aside = sent.value.place(matrix(part.column("v"), dim), dim)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(cell), pa.array(along), pa.array(aside)], [*names, "cell", "along", "aside"])

    return stored(rows.select(names).mapInArrow(work, f"{KEY_DDL}, vec_id bigint, v array<bigint>, dim int, asks boolean, cell bigint, along double, aside double"), "placed")


class Bounds:
    """Summaries of the groups of data: a row per cell, and its members nearest to the pivot."""

    def __init__(self, rows: DataFrame, cells: Cells, k: int):
        self.cells, self.k = cells, k
        told = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("aside").alias("aside")).collect()
        size = sum(len(p) for p in cells.pivots.values())
        self.n, self.low, self.high, self.aside = (np.zeros(size) for _ in range(4))
        for r in told:
            self.n[r.cell], self.low[r.cell], self.high[r.cell], self.aside[r.cell] = r.n, r.low, r.high, r.aside
        # one more than k, since a query may find itself
        near = W.partitionBy("cell").orderBy("aside", F.desc("along"), *KEY)
        members = rows.select(*KEY, "dim", "v", "cell", "along", "aside").withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k + 1).collect()
        self.members = {}
        for dim, (begin, pivot) in {d: (cells.first[d], p) for d, p in cells.pivots.items()}.items():
            own = [r for r in members if begin <= r.cell < begin + len(pivot)]
            self.members[dim] = (np.array([r.v for r in own], np.int64).reshape(len(own), dim), np.array([r.row_file for r in own]), np.array([r.row_at for r in own]))

    def reached(self, v: np.ndarray, file: np.ndarray, at: np.ndarray, dim: int) -> np.ndarray:
        """The score that the k-th best partner of each query reaches at least."""
        members, of_file, of_at = self.members[dim]
        floor = np.full(len(v), np.iinfo(np.int64).min)
        if len(members) <= self.k:
            return floor
        for low in range(0, len(v), step := max(1, TILE // len(members))):
            part = slice(low, low + step)
            scores = inner(v[part], members)
            scores[(of_file[None] == file[part, None]) & (of_at[None] == at[part, None])] = np.iinfo(np.int64).min
            floor[part] = np.partition(scores, len(members) - self.k, axis=1)[:, len(members) - self.k]
        return floor


def ask_summaries(queries: DataFrame, bounds: Bounds, groups: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The queries with their group and ``reached``, written; and for each group of queries and cell of data the ranges
    of the coordinates of the queries about the pivot and the least score to reach."""
    sent = queries.sparkSession.sparkContext.broadcast((bounds, groups))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, of_cell = sent.value
        for batch in batches:
            for dim, part in by_dim(batch):
                reached = limits.reached(matrix(part.column("v"), dim), part.column(KEY[0]).to_numpy(), part.column(KEY[1]).to_numpy(), dim)
                names = [*KEY, "vec_id", "v", "dim"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(of_cell[part.column("cell").to_numpy()]), pa.array(reached)], [*names, "unit", "reached"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, _ = sent.value
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for dim, part in by_dim(batch):
                along, aside = coordinates(matrix(part.column("v"), dim).astype(np.float64), limits.cells.pivots[dim])
                units, reached = part.column("unit").to_numpy(), part.column("reached").to_numpy().astype(np.float64)
                for unit in np.unique(units).tolist():
                    own = units == unit
                    new = [along[own].min(axis=0), along[own].max(axis=0), aside[own].max(axis=0), np.full(along.shape[1], reached[own].min())]
                    old = held.get((unit, dim), new)
                    held[unit, dim] = [np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), np.maximum(old[2], new[2]), np.minimum(old[3], new[3])]
        for (unit, dim), arrays in held.items():
            first = limits.cells.first[dim]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(arrays[0]), unit)), pa.array(np.arange(first, first + len(arrays[0]))), *map(pa.array, arrays)],
                                             ["unit", "cell", "low", "high", "aside", "reached"])

    scored = stored(queries.select(*KEY, "vec_id", "v", "dim", "cell").mapInArrow(score, f"{KEY_DDL}, vec_id bigint, v array<bigint>, dim int, unit bigint, reached bigint"), "asking")
    found = scored.mapInArrow(ranges, "unit bigint, cell bigint, low double, high double, aside double, reached double")
    return scored, found.groupBy("unit", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("aside").alias("aside"), F.min("reached").alias("reached"))


def units_of(cells: Cells, counts: np.ndarray, block: int) -> np.ndarray:
    """The group of each cell's queries: along a chain of nearest pivots, cells are put together up to ``block`` queries."""
    of_cell, unit = np.zeros(len(counts), np.int64), -1
    for dim, pivot in cells.pivots.items():
        left, at, held = set(range(len(pivot))), 0, block + 1
        while left:
            left.remove(at)
            cell = cells.first[dim] + at
            if held + counts[cell] > block:
                unit, held = unit + 1, 0
            of_cell[cell], held = unit, held + counts[cell]
            if left:
                rest = np.array(sorted(left))
                at = int(rest[((pivot[rest] - pivot[at]) ** 2).sum(axis=1).argmin()])
    return of_cell


class Plan:
    """Where vectors must go: per group of queries the bounds by cell, its blocks and its slices."""

    def __init__(self, bounds: Bounds, told: list, counts: np.ndarray, of_cell: np.ndarray, block: int, slice_rows: int):
        self.units = np.unique([r.unit for r in told])
        size, cells = len(self.units), len(counts)
        self.low, self.high, self.aside = (np.zeros((cells, size)) for _ in range(3))
        self.reached = np.full((cells, size), np.inf)  # nothing goes to queries of another length
        index = {u: i for i, u in enumerate(self.units.tolist())}
        for r in told:
            i = index[r.unit]
            self.low[r.cell, i], self.high[r.cell, i], self.aside[r.cell, i], self.reached[r.cell, i] = r.low, r.high, r.aside, r.reached
        most = np.maximum.reduce([self.low * x[:, None] for x in (bounds.low, bounds.high)] + [self.high * x[:, None] for x in (bounds.low, bounds.high)])
        open_cells = self._over(most + self.aside * bounds.aside[:, None], self.reached)
        asked = np.array([counts[of_cell == u].sum() for u in self.units])
        self.blocks = np.maximum(1, -(-asked // block)).astype(np.int64)
        self.slices = np.maximum(1, -(-(open_cells * bounds.n[:, None]).sum(axis=0) // slice_rows)).astype(np.int64)

    @staticmethod
    def _over(most: np.ndarray, reached: np.ndarray) -> np.ndarray:
        """Whether the bound reaches the score, with room for rounding. Scores end at 64 bits, bounds don't."""
        most = np.maximum(most, -2.0 ** 63)
        return most + 1e-9 * np.abs(most) + 1e-3 >= reached

    def goes_to(self, cell: np.ndarray, along: np.ndarray, aside: np.ndarray) -> np.ndarray:
        """Vectors by groups of queries: whether the vector can be among the best of one of them."""
        most = np.maximum(self.low[cell] * along[:, None], self.high[cell] * along[:, None]) + self.aside[cell] * aside[:, None]
        return self._over(most, self.reached[cell])


DEALT_DDL = f"unit bigint, block bigint, slice bigint, kind int, dim int, {KEY_DDL}, vec_id bigint, v array<bigint>, reached bigint"
DEALT = ["unit", "block", "slice", "kind", "dim", *KEY, "vec_id", "v", "reached"]


def spread_of(file: np.ndarray, at: np.ndarray, turn: int) -> np.ndarray:
    """A number for each row key that deals rows out evenly."""
    return mixed(mixed(file.view(np.uint64) + np.uint64(turn)) ^ at.view(np.uint64)) >> np.uint64(1)


def deal(rows: DataFrame, queries: DataFrame, plan: Plan) -> DataFrame:
    """Queries to every slice of their block, vectors to one slice of every block of the groups that need them."""
    sent = rows.sparkSession.sparkContext.broadcast(plan)

    def rows_of(part: pa.RecordBatch, who: np.ndarray, unit: np.ndarray, block: np.ndarray, piece: np.ndarray, kind: int, reached: pa.Array) -> pa.RecordBatch:
        take = pa.array(who)
        fixed = [pa.array(np.full(len(who), kind, np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(sent.value.units[unit]), pa.array(block), pa.array(piece), *fixed,
                                           *(part.column(c).take(take) for c in ("dim", *KEY, "vec_id", "v")), reached], DEALT)

    def copies(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who = np.repeat(np.arange(len(counts)), counts)
        return who, np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)

    def data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = sent.value
        for batch in batches:
            file, at = batch.column(KEY[0]).to_numpy(), batch.column(KEY[1]).to_numpy()
            row, unit = np.nonzero(where.goes_to(batch.column("cell").to_numpy(), batch.column("along").to_numpy(), batch.column("aside").to_numpy()))
            piece = (spread_of(file, at, 1)[row] % where.slices[unit].astype(np.uint64)).astype(np.int64)
            again, block = copies(where.blocks[unit])
            for low in range(0, len(again), 4096):
                part = again[low:low + 4096]
                yield rows_of(batch, row[part], unit[part], block[low:low + 4096], piece[part], 1, pa.nulls(len(part), pa.int64()))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = sent.value
        for batch in batches:
            file, at = batch.column(KEY[0]).to_numpy(), batch.column(KEY[1]).to_numpy()
            unit = np.searchsorted(where.units, batch.column("unit").to_numpy())
            block = (spread_of(file, at, 2) % where.blocks[unit].astype(np.uint64)).astype(np.int64)
            again, piece = copies(where.slices[unit])
            for low in range(0, len(again), 4096):
                part = again[low:low + 4096]
                yield rows_of(batch, part, unit[part], block[part], piece[low:low + 4096], 0, batch.column("reached").take(pa.array(part)))

    every = rows.select(*KEY, "vec_id", "v", "dim", "cell", "along", "aside").mapInArrow(data, DEALT_DDL)
    return every.union(queries.mapInArrow(asking, DEALT_DDL))


class Best:
    """The best partners of the queries of one block so far."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int, k: int):
        self.k, self.dim = k, dim
        self.v = np.concatenate([matrix(p.column("v"), dim) for p in parts])
        self.file, self.at, self.ids, reached = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (*KEY, "vec_id", "reached"))
        self.floor = reached.copy()
        self.found = np.zeros((0, 3), np.int64)  # query, score, vec_id

    def see(self, part: pa.RecordBatch) -> None:
        v = matrix(part.column("v"), self.dim)
        file, at, ids = (part.column(c).to_numpy() for c in (*KEY, "vec_id"))
        step = max(1, TILE // max(1, len(self.v)))
        for low in range(0, len(v), step):
            scores = inner(self.v, v[low:low + step])
            width = scores.shape[1]
            if width > self.k + 1:  # the query itself may be among them
                self.floor = np.maximum(self.floor, np.partition(scores, width - self.k - 1, axis=1)[:, width - self.k - 1])
            who, other = np.nonzero(scores >= self.floor[:, None])
            apart = (self.file[who] != file[low + other]) | (self.at[who] != at[low + other])
            who, other = who[apart], other[apart]
            self._keep(np.stack([who, scores[who, other], ids[low + other]], axis=1))

    def _keep(self, new: np.ndarray) -> None:
        rows = np.concatenate([self.found, new])
        rows = rows[np.lexsort((rows[:, 2], ~rows[:, 1], rows[:, 0]))]  # ~ turns the order of whole numbers round
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        self.found = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.floor[last[:, 0]] = np.maximum(self.floor[last[:, 0]], last[:, 1])

    def rows(self) -> pa.RecordBatch:
        who = self.found[:, 0]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.file[who], self.at[who], self.ids[who], self.found[:, 1], self.found[:, 2])],
                                          [*KEY, "query_id", "score", "vec_id"])


def solve(dealt: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every query within each slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asking, best = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("unit", "block", "slice", "kind")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                *now, kind = keys[low].tolist()
                part = batch.slice(low, high - low)
                if now != group:
                    if best is not None:
                        yield best.rows()
                    group, asking, best = now, [], None
                if kind == 0:
                    asking.append(part)
                elif asking or best is not None:
                    best = best or Best(asking, part.column("dim")[0].as_py(), k)
                    best.see(part)
        if best is not None:
            yield best.rows()

    near = dealt.repartition("unit", "block", "slice").sortWithinPartitions("unit", "block", "slice", "kind")
    return near.mapInArrow(work, f"{KEY_DDL}, query_id bigint, score bigint, vec_id bigint")


def top_k(vectors: DataFrame, asks: Column, *, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE, block: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best partners of every row of ``vectors`` for which ``asks`` holds."""
    spark = vectors.sparkSession
    bound_batches(spark)
    whole = whole_numbers(vectors, asks)
    n, n_asking = whole.agg(F.count(F.lit(1)), F.count_if(F.col("asks"))).first()
    if not n_asking:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    block = block or min(max(BLOCK[0], n_asking // SHARE[0]), BLOCK[1])
    slice_rows = slice_rows or min(max(SLICE[0], n // SHARE[1]), SLICE[1])
    cells = choose_cells(whole, pivots, sample)
    rows = assigned(whole, cells)
    bounds = Bounds(rows, cells, k)
    counts = np.zeros(len(bounds.n))
    for r in rows.filter("asks").groupBy("cell").count().collect():  # a row per cell
        counts[r["cell"]] = r["count"]
    of_cell = units_of(cells, counts, block)
    queries, told = ask_summaries(rows.filter("asks"), bounds, of_cell)
    plan = Plan(bounds, told.collect(), counts, of_cell, block, slice_rows)  # at most cells times cells
    partial = solve(deal(rows, queries, plan), k)
    order = W.partitionBy(*KEY).orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
