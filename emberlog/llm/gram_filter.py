"""A bit map of fixed size that keeps the rolling hashes of a text that can't join from leaving the task.

It only lets too much through, never too little, and the join decides; its size does not depend on
the codes put into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import ragged

#: Bits of the map: 8 MB.
MAP_BITS = 26


def bit_map(codes: DataFrame) -> np.ndarray:
    """The lowest MAP_BITS of every ``code`` as bits of an array; at most 2^20 numbers come to the driver."""
    place = F.col("code").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = codes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(code & 63 AS INT))")).alias("bits"))
    found = words.toPandas()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def passing_grams(texts: pa.Array, sizes: list[int], bits: np.ndarray) -> Iterator[tuple]:
    """For each block its rows, bytes and words and, by size, the places and codes that the map lets through."""
    lower, table = ragged.lower_bytes(), ragged.letter_bytes()
    data, offsets = ragged.text_bytes(texts)
    for low, high in ragged.blocks(offsets):
        piece, rows = lower[data[offsets[low]:offsets[high]]], offsets[low:high + 1] - offsets[low]
        starts, ends, first = ragged.word_bounds(piece, rows, table)
        codes, stop = ragged.word_hashes(piece, starts, ends), ragged.row_ends(first)
        found = []
        for size in sizes:
            grams = ragged.gram_hashes(codes, size)
            at = (grams & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
            passed = (bits[at >> 6] >> (grams & np.uint64(63))) & np.uint64(1)
            places = np.flatnonzero((passed == 1) & (np.arange(len(grams)) + size <= stop[:len(grams)]))
            found.append((size, places, grams[places]))
        yield low, high, piece, starts, ends, first, stop, found
