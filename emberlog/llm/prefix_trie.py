"""The trie of conversations that share their first turns, with totals of every subtree.

Conversations are first rebuilt: conversation c takes over the first h turns of conversation c - c % 20 (all if there are
fewer, none if it is absent; % as in SQL, h = crc32 of its decimal id, modulo 4) and goes on with its own turns from
turn h + 1 on. Each different sequence of first turns is a node. A node is named by 128 bits: the exclusive or of
hashes of its turns, each taken together with its depth.

Subtree totals by time-forward processing:

1. Nodes with more than ``crowd`` members are *heavy*. They stand above all others, and as each of them holds more than
   ``crowd`` rows there are at most rows / crowd; ``crowd`` grows with the table, so that these are at most ``HEAVY`` (65,536).
2. The rest falls into shards: the subtree below a heavy node, cut again at every depth that is a multiple of ``band``
   (a conversation of very many turns makes many shards). A shard is read in reverse level order, sorted outside of memory
   by Spark; each node takes from a priority queue what its children have sent and sends its own totals to its parent.
   A queue that grows beyond ``ROOM`` messages goes to disk as a sorted run. What is left at the end is the message
   of the shard's root to a node of another shard.
3. The shard roots that others hang below and the heavy nodes make a tree of bounded size, which goes through the
   same process once; what it finds for inner nodes of cut shards is sent into a second run over these shards.

Null role or text is empty. Turns are ordered by ``turn`` (null first); equal turn numbers go by the hash of role and
text, so repeated rows stand beside each other and each counts as a turn. Rows without ``conv_id`` belong to no conversation
and take no part. A table without conversations has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.rows import bound_batches, stored

FAMILY = 20
MOST_SHARED = 4
#: A node with more members than this is heavy; grows with the rows so that there are at most HEAVY of them.
CROWD = 64
HEAVY = 1 << 16
#: Depths in a shard; grows with the rows for the same reason.
BAND = 4096
#: Messages that a queue holds before it writes a run.
ROOM = 1 << 18
#: Bytes of one piece of a list of ids.
PIECE = 1 << 16

NODE = ("n1", "n2")
UP = ("u1", "u2")
SUMS = ("n_children", "n_leaves", "saved_tokens")


class SpillingQueue:
    """A priority queue of (key, sums) that keeps ``room`` messages in memory and the rest in sorted runs on disk.

    Runs are unnamed files of the task, gone when it ends in whatever way. Messages to one key are added up when a run is
    written. Each run is read a block at a time.
    """

    WIDTH = 6  # the three numbers of a key, three sums
    BLOCK = 4096

    def __init__(self, room: int = ROOM):
        self.room, self.heap, self.runs = room, [], []

    def push(self, key: tuple, sums: tuple) -> None:
        heapq.heappush(self.heap, (*key, *sums))
        if len(self.heap) > self.room:
            self._spill()

    def _spill(self) -> None:
        rows = np.array(sorted(self.heap), np.int64)
        first = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
        rows = np.concatenate([rows[first, :3], np.add.reduceat(rows[:, 3:], first)], axis=1)
        run = tempfile.TemporaryFile()
        run.write(rows.tobytes())
        run.seek(0)
        self.heap = []
        self._read(run, len(self.runs))

    def _read(self, run, number: int) -> None:
        block = np.frombuffer(run.read(8 * self.WIDTH * self.BLOCK), np.int64).reshape(-1, self.WIDTH).tolist()
        held = [run, block, 0]
        if number == len(self.runs):
            self.runs.append(held)
        else:
            self.runs[number] = held
        if not block:
            run.close()

    def peek(self) -> tuple | None:
        """The lowest key."""
        if not self.runs:
            return self.heap[0][:3] if self.heap else None
        found = [tuple(held[1][held[2]][:3]) for held in self.runs if held[1]]
        if self.heap:
            found.append(self.heap[0][:3])
        return min(found) if found else None

    def take(self, key: tuple) -> tuple[int, int, int]:
        """The sums of all messages to ``key``, which must be the lowest."""
        a = b = c = 0
        while self.heap and self.heap[0][:3] == key:
            message = heapq.heappop(self.heap)
            a, b, c = a + message[3], b + message[4], c + message[5]
        for number, (run, block, at) in enumerate(self.runs):
            while block and tuple(block[at][:3]) == key:
                message = block[at]
                a, b, c = a + message[3], b + message[4], c + message[5]
                at += 1
                self.runs[number][2] = at
                if at == len(block):
                    self._read(run, number)
                    run, block, at = self.runs[number]
        if self.runs and not any(held[1] for held in self.runs):
            self.runs = []
        return a, b, c


# --- rebuilt conversations ---------------------------------------------------------

def shared_turns() -> Column:
    """How many turns a conversation takes over."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), two hashes of role and text, and the words of the text; sorted outside of one task.

    The sorted rows are written with their place; what a conversation has in earlier partitions is added to the
    places of its rows in later ones, so a conversation of any length may span tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint"), F.col("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "h1", "h2"]
    place = F.monotonically_increasing_id()
    placed = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "h1", "h2", "words", place.alias("place"), F.shiftright(place, 33).alias("part")), "turns")
    runs = placed.groupBy("conv_id", "part").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("low") + 1).alias("shift"))
    return stored(placed.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("shift")).alias("pos"), "h1", "h2", "words"), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (conv_id, depth, length, h1, h2, words), and conv_id with length of each."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns({"base": base, "h": shared_turns()})
    there = convs.filter("conv_id = base").select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    taken = F.least("h", F.coalesce("of_base", F.lit(0)))
    convs = stored(convs.join(there, "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    own = turns.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "length", "h1", "h2", "words")
    heads = turns.filter((F.col("pos") < MOST_SHARED) & (F.col("conv_id") == base)).withColumnRenamed("conv_id", "base")
    over = convs.filter("taken > 0").join(heads, "base").filter("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "length", "h1", "h2", "words")
    return own.union(over), convs.select("conv_id", "length")


def named(turns: DataFrame, band: int) -> DataFrame:
    """conv_id, depth, ends (this is the last turn), words, the node of each turn and its parent, and the band of depths."""
    turns = turns.select("conv_id", "depth", "length", "words", F.floor(F.col("depth") / band).alias("band"),
                         F.xxhash64("depth", "h1", "h2").alias("g1"), F.xxhash64(F.lit(2), "h2", "depth", "h1").alias("g2"))
    so_far = W.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = turns.withColumns({f"x{i}": F.bit_xor(f"g{i}").over(so_far) for i in "12"})
    # what the bands above hold; only conversations that reach a second band have a row here
    totals = turns.filter(F.col("length") >= band).groupBy("conv_id", "band").agg(*[F.bit_xor(f"g{i}").alias(f"t{i}") for i in "12"])
    above = W.partitionBy("conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "band", *[F.coalesce(F.bit_xor(f"t{i}").over(above), F.lit(0)).alias(f"o{i}") for i in "12"]).filter("band > 0")
    whole = inside.join(offsets, ["conv_id", "band"], "left")
    node = [F.col(f"x{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0))) for i in "12"]
    return whole.select("conv_id", "band", "depth", (F.col("depth") == F.col("length")).alias("ends"), "words",
                        *[n.alias(c) for n, c in zip(node, NODE, strict=True)],
                        *[n.bitwiseXOR(F.col(f"g{i}")).alias(c) for n, c, i in zip(node, UP, "12", strict=True)])


# --- time-forward processing -------------------------------------------------------

SHARD = ("q_depth", "q1", "q2")
SWEPT = ("depth", *NODE, "u_depth", *UP)
SWEEP_DDL = ", ".join(f"{c} bigint" for c in (*SHARD, "kind", *SWEPT, *SUMS))
MESSAGE, TREE_NODE, ROOT_MESSAGE = 0, 1, 2


def sweep(rows: DataFrame, room: int = ROOM) -> DataFrame:
    """Subtree totals of nodes within shards.

    ``rows`` have SHARD, kind, SWEPT and SUMS: nodes with what is theirs alone (n_children 0) and messages to nodes of
    the shard (key in depth and NODE). They must be grouped by shard. Gives the nodes with their totals, and for each shard
    one ROOT_MESSAGE to each node of another shard (its key in u_depth and UP).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*SHARD, "kind", *SWEPT, *SUMS]
        queue, shard, out = SpillingQueue(room), None, []

        def left() -> None:
            while (key := queue.peek()) is not None:
                sums = queue.take(key)
                out.append((*shard, ROOT_MESSAGE, 0, 0, 0, -key[0], *key[1:], *sums))

        for batch in batches:
            for q0, q1, q2, kind, depth, n1, n2, u0, u1, u2, children, leaves, saved in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (q0, q1, q2) != shard:
                    left()
                    shard = (q0, q1, q2)
                key = (-depth, n1, n2)
                if kind == MESSAGE:
                    queue.push(key, (children, leaves, saved))
                    continue
                if queue.peek() == key:
                    sent = queue.take(key)
                    children, leaves, saved = children + sent[0], leaves + sent[1], saved + sent[2]
                if u0 >= 0:  # the root of all sends nothing
                    queue.push((-u0, u1, u2), (1, leaves, saved))
                out.append((q0, q1, q2, TREE_NODE, depth, n1, n2, u0, u1, u2, children, leaves, saved))
            while len(out) >= 1 << 15:
                ready, out[:] = out[:1 << 15], out[1 << 15:]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ready, strict=True)], names)
        left()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    ordered = rows.select(*SHARD, "kind", *SWEPT, *SUMS).sortWithinPartitions(*SHARD, F.desc("depth"), *NODE, "kind")
    return ordered.mapInArrow(work, SWEEP_DDL)


def _whole(kind: int, **columns: Column) -> list[Column]:
    """All columns of a row for ``sweep``; those not given are 0."""
    given = {"kind": F.lit(kind), **columns}
    return [given.get(c, F.lit(0)).cast("bigint").alias(c) for c in (*SHARD, "kind", *SWEPT, *SUMS)]


def _key(prefix: str, depth: Column, first: Column, second: Column) -> dict[str, Column]:
    names = {"n": ("depth", *NODE), "u": ("u_depth", *UP), "q": SHARD}[prefix]
    return dict(zip(names, (depth, first, second), strict=True))


def totals(nodes: DataFrame, *, room: int = ROOM) -> DataFrame:
    """(depth, NODE, SUMS) of every subtree. ``nodes``: depth, NODE, UP, heavy, SHARD (not of heavy ones), leaves, saved."""
    up = _key("u", F.col("depth") - 1, F.col("u1"), F.col("u2"))
    own = {**_key("n", F.col("depth"), F.col("n1"), F.col("n2")), **up, "n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")}
    light = nodes.filter("not heavy").select(*_whole(TREE_NODE, **own, **_key("q", *map(F.col, SHARD))))
    first = stored(sweep(light.repartition(*SHARD), room), "shards")
    sent = first.filter(F.col("kind") == ROOT_MESSAGE).select(*SHARD, "u_depth", *UP, *SUMS)

    heavy = stored(nodes.filter("heavy").select(*_whole(TREE_NODE, **own)), "heavy")
    is_heavy = F.broadcast(heavy.select(F.col("n1").alias("u1"), F.col("n2").alias("u2"), F.lit(True).alias("to_heavy")))  # at most HEAVY rows
    sent = stored(sent.join(is_heavy, list(UP), "left"), "sent")
    # Shards below other shards begin at a multiple of the band: no more of them than rows / band.
    cut = sent.filter("to_heavy IS NULL")
    asked = cut.select(F.col("u1").alias("n1"), F.col("u2").alias("n2")).distinct()
    homes = stored(nodes.filter("not heavy").join(F.broadcast(asked), list(NODE)).select(*[F.col(c).alias(f"home_{c}") for c in SHARD], "n1", "n2"), "homes")
    inner = cut.select(*SHARD).union(homes.select(*[F.col(f"home_{c}") for c in SHARD])).distinct()

    # The tree of the shard roots: heavy nodes, and as nodes of their own the shards that others hang below or that hang below others.
    shards = sent.join(F.broadcast(inner.withColumn("inner", F.lit(True))), list(SHARD), "left")
    simple = shards.filter("inner IS NULL").groupBy("u_depth", *UP).agg(*[F.sum(c).alias(c) for c in SUMS]).select(
        *_whole(MESSAGE, **_key("n", F.col("u_depth"), F.col("u1"), F.col("u2")), **{c: F.col(c) for c in SUMS}))
    at_home = F.broadcast(homes.select(*[f"home_{c}" for c in SHARD], F.col("n1").alias("u1"), F.col("n2").alias("u2")))
    hanging = shards.filter("inner").join(at_home, list(UP), "left").select(
        *_whole(TREE_NODE, **_key("n", *map(F.col, SHARD)), **{u: F.coalesce(f"home_{q}", u) for u, q in zip(("u_depth", *UP), SHARD, strict=True)},
                n_leaves=F.col("n_leaves"), saved_tokens=F.col("saved_tokens")))
    top = stored(sweep(heavy.union(simple).union(hanging).coalesce(1), room), "roots").filter(F.col("kind") == TREE_NODE)

    # Totals of cut shards go to the node they hang below, within its shard.
    below = top.join(F.broadcast(cut.select(F.col("q_depth").alias("depth"), F.col("q1").alias("n1"), F.col("q2").alias("n2"), F.col("u_depth").alias("to_depth"),
                                            F.col("u1").alias("to1"), F.col("u2").alias("to2"))), ["depth", *NODE])
    messages = below.join(F.broadcast(homes.withColumnsRenamed({"n1": "to1", "n2": "to2"})), ["to1", "to2"]).select(
        *_whole(MESSAGE, **_key("n", F.col("to_depth"), F.col("to1"), F.col("to2")), **_key("q", *[F.col(f"home_{c}") for c in SHARD]),
                n_children=F.lit(1), n_leaves=F.col("n_leaves"), saved_tokens=F.col("saved_tokens")))
    affected = F.broadcast(homes.select(*[F.col(f"home_{c}").alias(c) for c in SHARD]).distinct())
    again = sweep(light.join(affected, list(SHARD), "left_semi").union(messages).repartition(*SHARD), room)
    settled = first.join(affected, list(SHARD), "left_anti")
    heavy_keys = F.broadcast(heavy.select("depth", *NODE))
    result = ["depth", *NODE, *SUMS]
    return settled.filter(F.col("kind") == TREE_NODE).select(result).union(
        again.filter(F.col("kind") == TREE_NODE).select(result)).union(top.join(heavy_keys, ["depth", *NODE], "left_semi").select(result))


# --- lists of members that end at a node -------------------------------------------

def end_digests(ends: DataFrame) -> DataFrame:
    """(NODE, conv_id) to (NODE, ends_sha256): the digest of the ids of each node, ascending, joined by commas.

    The rows are sorted over all tasks. A node whose rows lie within a task is digested there; the others leave text in pieces,
    which are then read in turn, so that no list is held whole.
    """
    texts = "n1 bigint, n2 bigint, low bigint, piece string, digest string"
    names = ["n1", "n2", "low", "piece", "digest"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, low, held, size, first, spilled, out = None, 0, [], 0, True, False, []

        def close(last: bool) -> None:
            nonlocal spilled
            if first or last or spilled:  # may go on in another task, or has left text behind
                out.append((*node, low, ",".join(held), None))
            else:
                out.append((*node, low, None, hashlib.sha256(",".join(held).encode()).hexdigest()))
            spilled = False

        for batch in batches:
            for n1, n2, conv in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "conv_id")), strict=True):
                if node != (n1, n2):
                    if node is not None:
                        close(False)
                        first = False
                    node, low, held, size = (n1, n2), conv, [], 0
                elif size > PIECE:
                    out.append((*node, low, ",".join(held), None))
                    low, held, size, spilled = conv, [], 0, True
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 3 + (pa.string(),) * 2, strict=True)], names)
                out.clear()
        if node is not None:
            close(True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 3 + (pa.string(),) * 2, strict=True)], names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []
        for batch in batches:
            for n1, n2, piece in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "piece")), strict=True):
                if node != (n1, n2):
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (n1, n2), hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
        if node is not None:
            out.append((*node, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["n1", "n2", "digest"])

    order = (*NODE, "conv_id")
    found = stored(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, texts), "pieces")
    rest = found.filter("digest IS NULL").select(*NODE, "low", "piece").repartition(*NODE).sortWithinPartitions(*NODE, "low")
    return found.filter("digest IS NOT NULL").select(*NODE, "digest").union(rest.mapInArrow(joined, "n1 bigint, n2 bigint, digest string")).withColumnRenamed("digest", "ends_sha256")


def prefix_trie(conversations: DataFrame, *, crowd: int = CROWD, band: int = BAND, room: int = ROOM) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    bound_batches(conversations.sparkSession)
    turns = numbered_turns(conversations)
    count = turns.count()
    # a rebuilt conversation has at most three turns more than its own
    crowd, band = (max(least, -(-MOST_SHARED * count // HEAVY)) for least in (crowd, band))
    found, convs = rebuilt(turns)
    rows = stored(named(found, band), "rows")

    members = rows.groupBy(*NODE).count()
    heavy = stored(members.filter(F.col("count") > crowd).select(*NODE, F.lit(True).alias("heavy")), "crowds")  # at most HEAVY rows
    rows = rows.join(F.broadcast(heavy), list(NODE), "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    of_node = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("ends")).alias("n_ends"), F.max("words").alias("words")]
    # the first node below the heavy ones, or else the first of the band, names the shard
    path = W.partitionBy("conv_id", "band").orderBy("depth")
    light = rows.filter("not heavy").withColumns({q: F.first(c).over(path) for q, c in zip(SHARD, ("depth", *NODE), strict=True)})
    same = ["depth", *NODE, *UP, "heavy"]
    light = light.groupBy(*same, *SHARD).agg(*of_node)
    dense = rows.filter("heavy").groupBy(*same).agg(*of_node).select(*same, *[F.lit(0).cast("bigint").alias(q) for q in SHARD], "conv_id", "n_convs", "n_ends", "words")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends")).filter("n_convs > 0").select(
        *[F.lit(0).cast("bigint").alias(c) for c in ("depth", *NODE, *UP)], F.lit(True).alias("heavy"), *[F.lit(0).cast("bigint").alias(q) for q in SHARD],
        "conv_id", "n_convs", "n_ends", F.lit(0).cast("bigint").alias("words"))
    nodes = stored(light.union(dense).union(root).withColumns({
        "leaves": (F.col("n_ends") == F.col("n_convs")).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "nodes")

    sums = totals(nodes, room=room).select(*NODE, *SUMS)
    ends = rows.filter("ends").select(*NODE, "conv_id").union(convs.filter("length = 0").select(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), "conv_id"))
    digests = end_digests(stored(ends, "ends"))
    # parents: the heavy ones are few, the children of any other are at most ``crowd``
    parent = nodes.select(F.col("n1").alias("u1"), F.col("n2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), "heavy")
    above = F.broadcast(parent.filter("heavy").select(*UP, F.col("parent_conv_id").alias("heavy_parent")))
    linked = nodes.join(above, list(UP), "left")
    near = linked.filter("depth = 0 OR heavy_parent IS NOT NULL").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("heavy_parent")))
    deep = linked.filter("depth > 0 AND heavy_parent IS NULL").join(parent.filter("not heavy").drop("heavy"), list(UP))
    columns = [*NODE, "conv_id", "depth", "parent_conv_id", "n_convs"]
    return near.select(columns).union(deep.select(columns)).join(sums, list(NODE)).join(digests, list(NODE), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *SUMS, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
