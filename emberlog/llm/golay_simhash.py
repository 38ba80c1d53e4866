"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint has 64 bits; fingerprints with at most two differing bits are linked. It is cut
into three segments of 22, 21 and 21 bits. Two errors leave at least one segment untouched
(pigeonhole), and no segment has more than two. A segment, filled up to 23 bits, is decoded by
the perfect (23, 12) Golay code: of each vector within one bit of it, the index of the nearest
codeword. Segments that differ in up to two bits have a vector within one bit of both, so they
share an index. A key is one segment as it is and one index of the next: about 16 a fingerprint.

1. Fingerprints of all documents, made distinct: exact copies meet here.
2. Keys with few members: members are joined and their 64 bits compared.
3. Keys with many members (near copies crowd together): no pairs. Each member names the vectors
   within one bit of it outside the untouched segment; members that name the same vector differ
   in at most two bits, and each is linked to the smallest of them. At most 65 fingerprints can
   name a vector. Both ways find exactly the links of the key; the bound only picks the cheaper.
4. Components of the links; the smallest ``doc_id`` of each.

Nulls: a null text has no words and, like every text without words, fingerprint zero. A null
``doc_id`` never names a component unless the component has no other. Equal rows are members
like any other. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import ragged
from emberlog.llm.components import components
from emberlog.llm.rows import KEY, anchored, chosen_rows, located, scan, stored

SHINGLE = 3
SEED = 42
#: Keys with more members than this go by shared vectors instead of pairs.
CROWD = 48
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the (23, 12) Golay code.
GENERATOR = 0b110001110101


# --- fingerprints -----------------------------------------------------------------

def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many short stretches of ``data``; those of 32 bytes and more by the library."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    view = ragged.eights(data)
    total = lengths.astype(np.uint64) + (np.uint64(seed) + p5)
    at = starts.copy()
    left = np.where(lengths < 32, lengths, 0)
    for _ in range(3):
        who = np.flatnonzero(left >= 8)
        piece = turned(view[at[who]] * p2, 31) * p1
        total[who] = turned(total[who] ^ piece, 27) * p1 + p4
        at[who] += 8
        left[who] -= 8
    who = np.flatnonzero(left >= 4)
    total[who] = turned(total[who] ^ ((view[at[who]] & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3
    at[who] += 4
    left[who] -= 4
    for _ in range(3):
        who = np.flatnonzero(left >= 1)
        total[who] = turned(total[who] ^ (data[at[who]] * p5), 11) * p1
        at[who] += 1
        left[who] -= 1
    total = (total ^ (total >> np.uint64(33))) * p2
    total = (total ^ (total >> np.uint64(29))) * p3
    total ^= total >> np.uint64(32)
    long = np.flatnonzero(lengths >= 32)
    raw = data.tobytes() if len(long) else b""
    if len(long):
        total[long] = [xxhash.xxh64_intdigest(raw[s:s + n], seed) for s, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)]
    return total


def majority(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row (codes ``first[i]`` to ``first[i + 1]``) the bits set in over half of its codes; zero for none.

    The eight bits of equal place in the eight bytes of a code are counted at once, in runs of
    at most 255 codes so that no count leaves its byte.
    """
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    found = np.zeros(len(counts), np.uint64)
    if not len(full):
        return found
    runs = -(-counts[full] // 255)
    run_row = np.cumsum(runs) - runs
    begin = np.repeat(first[full], runs) + 255 * (np.arange(runs.sum()) - np.repeat(run_row, runs))
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        part = np.add.reduceat((codes >> np.uint64(bit)) & lanes, begin)
        each = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), run_row, axis=0)
        won = 2 * each > counts[full][:, None]
        found[full] |= (won.astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return found


def block_fingerprints(piece: np.ndarray, rows: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Fingerprints of the (lower-cased) texts of one block."""
    table = ragged.solid_bytes()
    starts, ends, first = ragged.word_bounds(piece, rows, table)
    lengths, inside = ends - starts, table[piece]
    # the words with one space after each: every shingle is one stretch of these bytes
    spaced = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    word_of = np.repeat(np.arange(len(lengths)), lengths)
    spaced[np.arange(len(word_of)) + word_of] = piece[inside]
    at = np.cumsum(lengths + 1) - (lengths + 1)
    n_words = np.diff(first)
    n_grams = np.where(n_words == 0, 0, np.maximum(1, n_words - size + 1))
    gram_first = np.concatenate([[0], np.cumsum(n_grams)])
    head = np.repeat(first[:-1] - gram_first[:-1], n_grams) + np.arange(gram_first[-1])
    last = np.minimum(head + size, np.repeat(first[1:], n_grams)) - 1
    return majority(xxh64(spaced, at[head], at[last] + lengths[last] - at[head], seed), gram_first)


def fingerprints(docs: DataFrame, *, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """KEY, doc_id and fp (64 bits as a long) of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        lower = ragged.lower_bytes()
        for batch in batches:
            data, offsets = ragged.text_bytes(batch.column("text"))
            parts = [np.zeros(0, np.uint64)]
            for low, high in ragged.blocks(offsets):
                parts.append(block_fingerprints(lower[data[offsets[low]:offsets[high]]], offsets[low:high + 1] - offsets[low], size, seed))
            yield {"fp": pa.array(ragged.signed(np.concatenate(parts)))}

    return scan(located(docs, "doc_id", "text"), "fp bigint", work, (*KEY, "doc_id"))


# --- keys -------------------------------------------------------------------------

def syndromes() -> list[np.ndarray]:
    """Remainders by the generator, for each of the three bytes of a vector; they add up by XOR."""
    def remainder(v: int) -> int:
        for bit in range(v.bit_length() - 1, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    return [np.array([remainder(b << 8 * i) if b << 8 * i < 1 << 23 else 0 for b in range(256)], np.int64) for i in range(3)]


def error_patterns(tables: list[np.ndarray]) -> np.ndarray:
    """The pattern of at most three bits for each of the 2^11 remainders: the code is perfect."""
    bits = [0] + [1 << i for i in range(23)]
    errors = np.unique([a | b | c for a in bits for b in bits for c in bits]).astype(np.int64)
    found = np.zeros(1 << 11, np.int64)
    found[tables[0][errors & 255] ^ tables[1][(errors >> 8) & 255] ^ tables[2][errors >> 16]] = errors
    return found


def golay_indices(vectors: np.ndarray, tables: list[np.ndarray], errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices of the codewords nearest to the vectors within one bit of each: (which vector, index), distinct."""
    near = vectors[:, None] ^ np.array([0] + [1 << i for i in range(23)], np.int64)
    rest = tables[0][near & 255] ^ tables[1][(near >> 8) & 255] ^ tables[2][near >> 16]
    found = np.sort((near ^ errors[rest]) >> 11, axis=1)
    own = np.ones(found.shape, bool)
    own[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(own)[0], found[own]


def fuzzy_keys(prints: DataFrame) -> DataFrame:
    """``prints`` (fp) to (code, fp, whole): ``code`` names the segment taken whole, its bits and an index of the next."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = syndromes()
        errors = error_patterns(tables)
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for low in range(0, len(fps), 1 << 15):
                own = fps[low:low + (1 << 15)].view(np.uint64)
                for whole, (at, width) in enumerate(SEGMENTS):
                    cut = lambda a, w: ((own >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64)  # noqa: B023, E731
                    who, index = golay_indices(cut(*SEGMENTS[(whole + 1) % 3]), tables, errors)
                    code = (np.int64(whole) << 34) | (cut(at, width)[who] << 12) | index
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(ragged.signed(own)[who]), pa.array(np.full(len(who), whole, np.int32))],
                                                     ["code", "fp", "whole"])

    return prints.select("fp").mapInArrow(work, "code bigint, fp bigint, whole int")


def links(prints: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that join all pairs with at most two differing bits."""
    keys = stored(fuzzy_keys(prints), "keys")
    crowds = stored(keys.groupBy("code").count().filter(F.col("count") > crowd).select("code"), "crowds")
    few = keys.join(crowds, "code", "left_anti").select("code", "fp")
    pairs = few.select("code", F.col("fp").alias("a")).join(few.select("code", F.col("fp").alias("b")), "code").filter(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    packed = keys.join(crowds, "code", "left_semi").select("fp", "whole").distinct()
    masks = [[0] + [1 << i if i < 63 else -(1 << 63) for i in range(64) if not at <= i < at + width] for at, width in SEGMENTS]
    flips = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in row]) for row in masks])
    near = packed.select("fp", F.explode(F.get(flips, F.col("whole"))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("vector"))
    lowest = near.groupBy("vector").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top").drop("top")
    shared = near.join(lowest, "vector").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(shared).distinct()


def groups(docs: DataFrame, *, size: int = SHINGLE, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """KEY, doc_id, fp, root (the smallest fingerprint of the component) of every row."""
    prints = stored(fingerprints(docs, size=size, seed=seed), "fingerprints")
    roots = components(links(prints.select("fp").distinct(), crowd=crowd))
    return prints.join(roots, prints["fp"] == roots["node"], "left").select(*KEY, "doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """KEY, doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component) of every row."""
    found = stored(groups(docs, size=size, seed=seed, crowd=crowd), "groups")
    # written, so that neither side of the join is bound to its keys and a large component can be split
    lowest = stored(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")
    return found.join(lowest, "root").select(
        *KEY, "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_copies(docs: DataFrame, *, size: int = SHINGLE, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """``docs`` with one row of each component: the first by (doc_id, null last, KEY)."""
    docs = anchored(docs)
    found = groups(docs, size=size, seed=seed, crowd=crowd)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("first"))
    return chosen_rows(docs, stored(first.select(*[f"first.{k}" for k in KEY]), "kept"), "left_semi", many=True)
