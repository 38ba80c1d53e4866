"""Words and rolling hashes of many texts at once, as numpy arrays.

An Arrow text column already is one run of UTF-8 bytes with offsets. Words are found by
a table over byte values, so no text is decoded and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at a time; bounds the temporaries. A longer text is one block.
BLOCK = 1 << 21


def solid_bytes() -> np.ndarray:
    """Words as everything between blanks: space, tab, LF, VT, FF, CR."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def letter_bytes() -> np.ndarray:
    """Words of ASCII digits, lower-case letters and every character outside ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_bytes() -> np.ndarray:
    """A table that lower-cases A-Z and leaves all other bytes."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry: the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), places


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``size`` bytes, or one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1
        high = min(rows, max(low + 1, high))
        yield low, high
        low = high


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in ``data``, and the first word of each row (one more entry: the count).

    ``offsets`` begin at 0 and end at ``len(data)``; a word never crosses rows.
    """
    inside = table[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    finishes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as little-endian numbers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word, from its bytes and length alone."""
    tails = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
    view, left = eights(data), ends - starts
    found = mixed(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    found = mixed(found ^ (view[starts] & tails[np.minimum(left, 8)]))
    step, who = 8, np.flatnonzero(left > 8)
    while len(who):  # eight more bytes of the words that have them
        piece = view[starts[who] + step] & tails[np.minimum(left[who] - step, 8)]
        found[who] = mixed(found[who] ^ piece)
        step += 8
        who = who[left[who] > step]
    return found


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64 bits for the ``size`` words from every place on; the last ``size - 1`` places are left out."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    odd, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
    if size <= 6:
        total = np.zeros(count, np.uint64)
        for i in range(size):
            total = total * np.uint64(odd) + words[i:i + count]
        return mixed(total + np.uint64(size))
    powers = np.full(len(words), odd, np.uint64)
    back = np.full(count, inverse, np.uint64)
    powers[0] = back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(powers), dtype=np.uint64)])
    return mixed((sums[size:] - sums[:count]) * np.cumprod(back) + np.uint64(size))


def row_ends(first: np.ndarray) -> np.ndarray:
    """For every word the number of the first word after its row."""
    return np.repeat(first[1:], np.diff(first))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """One list per row, from the lengths and all values in turn."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
