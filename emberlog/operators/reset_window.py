"""Reset-window rules over data of any size, in one lazy plan.

The rows of an address, in order, are cut at fixed places of the order key (blocks of lines of a file, or rows of one
moment), never by their number, so that every part of the plan cuts alike. Each block becomes a ``Chunk``
(``functions/reset_scan``), the chunks of a larger block are put together to one, and an address is walked over its larger
blocks only. On the way back each block learns the times that are held before it, and its rows are run. Every step
reads its groups in order and holds one chunk or the held times of one address, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import reset_scan
from emberlog.functions.reset_scan import Chunk

#: Lines of a file in one block; a larger block has as many blocks.
BLOCK_LINES = 1 << 14
FAN = 1 << 10
CHUNK_DDL = "marks array<bigint>, leaves array<bigint>, alone bigint, tail array<bigint>, top bigint"
CHUNK = Chunk._fields
ROW, STATE = 1, 0


class Order:
    """How rows of an address follow each other, and where they are cut: a fine and a coarse key, both in this order."""

    def __init__(self, keys: list[str], fine: dict[str, Column], coarse: dict[str, Column]):
        self.keys, self.fine, self.coarse = keys, fine, coarse


def order_of(name: str, window_us: int, block_lines: int) -> Order:
    """``file``: files by name, lines by number. ``event_time``: by time, then file and line."""
    line = F.coalesce("line_number", F.lit(0))
    block, many = F.floor(line / block_lines), F.floor(line / (block_lines * FAN))
    if name == "file":
        return Order(["log_file", "line_number"], {"f_file": F.col("log_file"), "f_block": block}, {"c_file": F.col("log_file"), "c_block": many})
    if name == "event_time":
        return Order(["t", "log_file", "line_number"], {"f_t": F.col("t"), "f_file": F.col("log_file"), "f_block": block}, {"c_t": F.floor(F.col("t") / (window_us + 1))})
    raise ValueError(f"unknown order {name!r}")


def _grouped(df: DataFrame, by: list[str], order: list[str], work: Callable, ddl: str) -> DataFrame:
    """Groups kept together and read in order."""
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(work, ddl)


def _columns(batch: pa.RecordBatch, names: list[str] | tuple[str, ...]) -> list[list]:
    return [batch.column(c).to_pylist() for c in names]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


_LIST = pa.list_(pa.int64())
_CHUNK_TYPES = [_LIST, _LIST, pa.int64(), _LIST, pa.int64()]
READY = 4096
#: Rows of an address that one task walks; an address with more is taken apart.
ADDRESS_ROWS = 1 << 16


class _Scan:
    """The steps of one rule; the names and types of its block keys."""

    def __init__(self, rows: DataFrame, order: Order, window: int, threshold: int):
        self.rows, self.order, self.window, self.threshold = rows, order, window, threshold
        self.fine, self.coarse = list(order.fine), list(order.coarse)
        self.kinds = dict(rows.dtypes)

    def _ddl(self, names: list[str]) -> str:
        return ", ".join(f"{n} {self.kinds[n]}" for n in names)

    def _types(self, names: list[str]) -> list[pa.DataType]:
        known = {"string": pa.string(), "bigint": pa.int64()}
        return [known[self.kinds[n]] for n in names]

    def blocks(self) -> DataFrame:
        """A chunk for each block of rows of an address."""
        group = ["source_ip", *self.coarse, *self.fine]
        window, threshold, types = self.window, self.threshold, [*self._types(group), *_CHUNK_TYPES]
        names = [*group, *CHUNK]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, times, out = None, [], []
            for batch in batches:
                *keys, ts = _columns(batch, [*group, "t"])
                for now, t in zip(zip(*keys, strict=True), ts, strict=True):
                    if now != key:
                        if times:
                            out.append((*key, *reset_scan.summarise(times, window, threshold)))
                        key, times = now, []
                    times.append(t)
                if len(out) >= READY:
                    yield _batch(out, names, types)
                    out = []
            if times:
                out.append((*key, *reset_scan.summarise(times, window, threshold)))
            if out:
                yield _batch(out, names, types)

        by = ["source_ip", *self.fine]
        return _grouped(self.rows.select(*dict.fromkeys([*group, "t", *self.order.keys])), by, self.order.keys, work, f"{self._ddl(group)}, {CHUNK_DDL}")

    def put_together(self, chunks: DataFrame) -> DataFrame:
        """A chunk for each larger block."""
        group = ["source_ip", *self.coarse]
        window, threshold, types, names = self.window, self.threshold, [*self._types(group), *_CHUNK_TYPES], [*group, *CHUNK]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, out = None, None, []
            for batch in batches:
                columns = _columns(batch, names)
                for row in zip(*columns, strict=True):
                    now, chunk = row[:len(group)], Chunk(*row[len(group):])
                    if now == key:
                        held = reset_scan.join(held, chunk, window, threshold)
                        continue
                    if key is not None:
                        out.append((*key, *held))
                    key, held = now, chunk
                if len(out) >= READY:
                    yield _batch(out, names, types)
                    out = []
            if key is not None:
                out.append((*key, *held))
            if out:
                yield _batch(out, names, types)

        return _grouped(chunks.select(names), group, self.fine_of(chunks), work, f"{self._ddl(group)}, {CHUNK_DDL}")

    def fine_of(self, chunks: DataFrame) -> list[str]:
        return [c for c in self.fine if c in chunks.columns]

    def walk(self, chunks: DataFrame, entering: DataFrame, group: list[str], step: list[str]) -> DataFrame:
        """Through the chunks of each ``group`` in the order of ``step``, from the times that enter it (none where there is no
        row of ``entering``): per chunk the times held before it (``held``) and how many after it (``n_after``); per group
        one row without ``step`` with what is held at its end."""
        names, window, threshold = [*group, *step], self.window, self.threshold
        types, out_names = [*self._types(names), _LIST, pa.int64()], [*names, "held", "n_after"]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, out, size = None, [], [], len(group)
            for batch in batches:
                columns = _columns(batch, [*names, "kind", "held", *CHUNK])
                for row in zip(*columns, strict=True):
                    if row[:size] != key:
                        if key is not None:
                            out.append((*key, *[None] * len(step), held, len(held)))
                        key, held = row[:size], []
                    kind, before = row[len(names):len(names) + 2]
                    if kind == STATE:
                        held = list(before or [])
                        continue
                    after = reset_scan.enter(Chunk(*row[len(names) + 2:]), held, window, threshold)
                    out.append((*row[:len(names)], held, len(after)))
                    held = after
                if len(out) >= READY:
                    yield _batch(out, out_names, types)
                    out = []
            if key is not None:
                out.append((*key, *[None] * len(step), held, len(held)))
            if out:
                yield _batch(out, out_names, types)

        nothing = lambda names, kinds: [F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)]
        chunk_kinds = [part.rsplit(" ", 1)[1] for part in CHUNK_DDL.split(", ")]
        every = chunks.select(*names, F.lit(ROW).alias("kind"), F.lit(None).cast("array<bigint>").alias("held"), *CHUNK).union(
            entering.select(*group, *nothing(step, [self.kinds[s] for s in step]), F.lit(STATE), "held", *nothing(CHUNK, chunk_kinds)))
        return _grouped(every, group, ["kind", *step], work, f"{self._ddl(names)}, held array<bigint>, n_after bigint")

    def fires(self, entering: DataFrame, payload: list[str]) -> DataFrame:
        """The rows that fire, each block run from the times held before it."""
        window, threshold = self.window, self.threshold
        group, names = ["source_ip", *self.fine], list(dict.fromkeys(["source_ip", "t", "log_file", "line_number", *payload]))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []
            for batch in batches:
                columns = _columns(batch, [*group, "kind", "held", "t"])
                keys = list(zip(*columns[:len(group)], strict=True))
                kinds, states, times = columns[len(group):]
                fired, at = [], 0
                while at < len(keys):
                    if keys[at] != key:
                        key, held = keys[at], []
                    if kinds[at] == STATE:
                        held, at = states[at], at + 1
                        continue
                    end = at
                    while end < len(keys) and keys[end] == key:
                        end += 1
                    found, held = reset_scan.run(held, times[at:end], window, threshold)
                    fired += [at + f for f in found]
                    at = end
                if fired:
                    yield batch.select(names).take(pa.array(fired))

        own = [c for c in self.rows.columns if c not in self.coarse]
        rest = [c for c in own if c not in group]
        every = self.rows.select(*group, F.lit(ROW).alias("kind"), F.lit(None).cast("array<bigint>").alias("held"), *rest).union(
            entering.select(*group, F.lit(STATE), "held", *[F.lit(None).cast(self.kinds[c]) for c in rest]))
        ddl = ", ".join(f"`{n}` {self.kinds[n]}" for n in names)
        return _grouped(every, group, ["kind", *self.order.keys], work, ddl)


def _scan(rows: DataFrame, window_us: int, threshold: int, order: str, payload: list[str], block_lines: int) -> _Scan:
    way = order_of(order, window_us, block_lines)
    base = rows.select(*dict.fromkeys(["source_ip", "t", "log_file", "line_number", *payload])).filter("source_ip is not null")
    return _Scan(base.withColumns({**way.fine, **way.coarse}), way, window_us, threshold)


def _no_state(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], "source_ip string, held array<bigint>")


def reset_window(rows: DataFrame, *, window_us: int, threshold: int, order: str = "file", payload: list[str] | None = None,
                 block_lines: int = BLOCK_LINES, entering: DataFrame | None = None) -> DataFrame:
    """Fires and leftovers of a reset-window rule.

    ``rows`` has ``source_ip``, ``t`` (microseconds), ``log_file``, ``line_number`` and the ``payload`` columns. A row leaves
    the window when it is more than ``window_us`` older than the current one. Result: ``kind`` is ``fire`` (one row per
    fire, of the firing line) or ``held`` (one per address that still holds rows at the end, the times in ``times``);
    ``count`` is the number of rows held at that moment. ``entering`` (``source_ip``, ``held``) are the times held before
    the first row. Nothing runs until the result is read.
    """
    payload = payload or []
    scan = _scan(rows, window_us, threshold, order, payload, block_lines)
    chunks = scan.blocks()
    walked = scan.walk(scan.put_together(chunks), entering if entering is not None else _no_state(rows), ["source_ip"], scan.coarse)
    last = F.col(scan.coarse[-1]).isNull()
    inside = scan.walk(chunks, walked.filter(~last).select("source_ip", *scan.coarse, "held"), ["source_ip", *scan.coarse], scan.fine)
    fired = scan.fires(inside.filter(F.col(scan.fine[-1]).isNotNull()).select("source_ip", *scan.fine, "held"), payload)
    out = ["t", "log_file", "line_number", *[p for p in payload if p not in ("t", "log_file", "line_number")]]
    fires = fired.select("source_ip", F.lit("fire").alias("kind"), F.lit(threshold).cast("bigint").alias("count"), *out, F.lit(None).cast("array<bigint>").alias("times"))
    held = walked.filter(last & (F.col("n_after") > 0)).select(
        "source_ip", F.lit("held").alias("kind"), F.col("n_after").alias("count"), *[F.lit(None).cast(scan.kinds[c]).alias(c) for c in out], F.col("held").alias("times"))
    return fires.unionByName(held)


def crowded_addresses(rows: DataFrame, most: int = ADDRESS_ROWS) -> DataFrame:
    """(``source_ip``): addresses with more rows than one task should walk; there are no more of them than rows / ``most``."""
    return rows.filter("source_ip is not null").groupBy("source_ip").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("source_ip")


def walk_addresses(rows: DataFrame, *, window_us: int, threshold: int, order: str = "file", payload: list[str] | None = None,
                   entering: DataFrame | None = None) -> DataFrame:
    """What ``reset_window`` gives, with all rows of an address read in order by one task, which holds its held times only.

    Cutting an address into blocks pays for crowded ones. Most have so few rows that nearly every row would be a block.
    """
    payload, keys = payload or [], order_of(order, window_us, BLOCK_LINES).keys
    names = list(dict.fromkeys(["source_ip", "t", "log_file", "line_number", *payload]))
    base = rows.select(names).filter("source_ip is not null")
    kinds, out = dict(base.dtypes), names[1:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, like = None, [], None

        def told(kind: str, ips: pa.Array, counts: list[int], rest: list[pa.Array], times: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [ips, pa.array([kind] * len(ips)), pa.array(counts, pa.int64()), *rest, pa.array(times, _LIST)], ["source_ip", "kind", "count", *out, "times"])

        def left(ended: list[tuple[str, list[int]]]) -> pa.RecordBatch:
            return told("held", pa.array([ip for ip, _ in ended], like.field("source_ip").type), [len(times) for _, times in ended],
                        [pa.nulls(len(ended), like.field(c).type) for c in out], [times for _, times in ended])

        for batch in batches:
            like = batch.schema
            ips, states, kind, ts = _columns(batch, ["source_ip", "held", "kind", "t"])
            fired, ended, at = [], [], 0
            while at < len(ips):
                if ips[at] != key:
                    if held:
                        ended.append((key, held))
                    key, held = ips[at], []
                if kind[at] == STATE:
                    held, at = list(states[at] or []), at + 1
                    continue
                end = at + 1
                while end < len(ips) and ips[end] == key:
                    end += 1
                found, held = reset_scan.run(held, ts[at:end], window_us, threshold)
                fired += [at + f for f in found]
                at = end
            if fired:
                rows_of = batch.take(pa.array(fired))
                yield told("fire", rows_of.column("source_ip"), [threshold] * len(fired), [rows_of.column(c) for c in out], [None] * len(fired))
            if ended:
                yield left(ended)
        if held:
            yield left([(key, held)])

    every = base.select("source_ip", F.lit(ROW).alias("kind"), F.lit(None).cast("array<bigint>").alias("held"), *out)
    if entering is not None:
        every = every.union(entering.select("source_ip", F.lit(STATE), "held", *[F.lit(None).cast(kinds[c]) for c in out]))
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in out)
    return _grouped(every, ["source_ip"], ["kind", *keys], work, f"source_ip {kinds['source_ip']}, kind string, count bigint, {ddl}, times array<bigint>")


def held_after_files(rows: DataFrame, files: DataFrame, *, window_us: int, threshold: int, at_least: int = 1, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(``log_file``, ``source_ip``, ``count``): what each address holds when the last line of each of the ``files`` has been read.

    An address holds on to its rows until one of its own rows pushes them out, so it shows in every later file too,
    whether it is in there or not. ``files`` has a row per ``log_file``; they are read in the order of their names.
    """
    scan = _scan(rows, window_us, threshold, "file", [], block_lines)
    walked = scan.walk(scan.put_together(scan.blocks()), _no_state(rows), ["source_ip"], scan.coarse)
    ends = walked.filter(F.col("c_file").isNotNull()).groupBy("source_ip", F.col("c_file").alias("log_file")).agg(F.max_by("n_after", "c_block").alias("count"))
    # a row per file of the run
    every = W.orderBy("log_file")
    listed = files.select("log_file").distinct().withColumns({
        "place": F.row_number().over(every), "n_files": F.count(F.lit(1)).over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    following = F.lead("place").over(W.partitionBy("source_ip").orderBy("place"))
    spans = ends.join(listed, "log_file").withColumn("until", F.coalesce(following - 1, F.col("n_files"))).filter(F.col("count") >= at_least)
    spans = spans.select("source_ip", "count", F.explode(F.sequence(F.col("place").cast("bigint"), F.col("until").cast("bigint"))).alias("place"))
    return spans.join(listed, "place").select("log_file", "source_ip", "count")
