"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a block of texts are made distinct and held as one array of symbols with
the pre-token each symbol belongs to. In every round each pre-token takes its own lowest-rank
pair and applies it at all its places at once; pre-tokens without a pair leave the array, and
the number of symbols they have left is their number of tokens. No pre-token waits for another,
and a text's count is the sum over its pre-tokens.

The vocabulary is one of lower-cased words with an end-of-word mark and byte symbols. Its file is
read on the driver; the merge table, which is as large as the vocabulary, is broadcast. Special
strings inside a text are one token each, as the tokenizers library has it by default.

Nulls: a null text counts as empty (0 bytes, 0 tokens). Equal rows each get their count. Other
columns are not read. The table of known pre-tokens is emptied when it is full; counts don't depend on it.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.rows import scan

#: Characters of texts that are cut into pre-tokens before one merging run.
BLOCK_CHARS = 1 << 21
#: Pre-tokens whose counts a task remembers.
KNOWN = 300_000
NO_RANK = np.int64(1 << 40)
#: Left symbols times this, plus the right one, name a pair.
SIDE = np.int64(1 << 20)


@dataclass
class Merges:
    """Pairs in order of their key, the rank and the new symbol of each; ``first``: the merge of any two
    byte symbols, or -1; the symbol of each byte within and at the end of a word."""

    pairs: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    first: np.ndarray
    inner: np.ndarray
    final: np.ndarray
    specials: list[str]
    pattern: str


def _byte_names() -> list[str]:
    """The character that stands for each byte: itself where it is visible, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def load_merges(path: str) -> Merges:
    """Read a vocabulary file of the tokenizers library: lower-casing, one split pattern, byte symbols, word ends."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, names = spec["model"], _byte_names()
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    rows = [(vocab[a] * int(SIDE) + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])]
    table = np.array(sorted(rows), np.int64)
    split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    first = np.full((2 * 256, 2 * 256), -1, np.int32)  # byte symbols come first in such a vocabulary
    left, right = table[:, 0] // SIDE, table[:, 0] % SIDE
    of_bytes = np.flatnonzero((left < 512) & (right < 512))
    first[left[of_bytes], right[of_bytes]] = of_bytes
    return Merges(table[:, 0], table[:, 1], table[:, 2], first, np.array([vocab[n] for n in names], np.int64),
                  np.array([vocab[n + suffix] for n in names], np.int64), [t["content"] for t in spec["added_tokens"]], split)


def count_symbols(words: list[bytes], merges: Merges) -> np.ndarray:
    """How many symbols each of the (non-empty) words has when no pair is left."""
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths)
    symbols = merges.inner[data]
    symbols[ends - 1] = merges.final[data[ends - 1]]

    def pairs_at(places: np.ndarray) -> np.ndarray:
        """The merge (its place in the table) of each symbol with the next one, or -1."""
        key = symbols[places] * SIDE + symbols[places + 1]
        at = np.minimum(np.searchsorted(merges.pairs, key), len(merges.pairs) - 1)
        return np.where(merges.pairs[at] == key, at, -1)

    merge = np.full(len(symbols), -1, np.int64)
    merge[:-1] = merges.first[symbols[:-1], symbols[1:]]
    left = np.zeros(len(words), np.int64)
    who = np.arange(len(words))  # the words still at work, in order
    while len(who):
        merge[ends - 1] = -1  # a pair does not cross words
        rank = np.where(merge >= 0, merges.ranks[merge], NO_RANK)
        best = np.minimum.reduceat(rank, ends - lengths)
        over = best == NO_RANK
        left[who[over]] = lengths[over]
        spots = np.flatnonzero((rank == np.repeat(best, lengths)) & (merge >= 0))
        # in a run of overlapping places (x x x) every second one from the left merges
        order = np.arange(len(spots))
        fresh = np.diff(spots, prepend=-2) > 1
        spots = spots[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
        symbols[spots] = merges.results[merge[spots]]
        stays = np.repeat(~over, lengths)
        stays[spots + 1] = False
        place = np.concatenate([[0], np.cumsum(stays)])
        lengths = (place[ends] - place[ends - lengths])[~over]
        changed = place[spots]
        symbols, merge, who = symbols[stays], merge[stays], who[~over]
        ends = np.cumsum(lengths)
        changed = np.concatenate([changed, changed[changed > 0] - 1])
        changed = changed[changed < len(symbols) - 1]
        merge[changed] = pairs_at(changed)
    return left


class Counter:
    """Counts the tokens of texts; keeps what it knows of pre-tokens from block to block."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        self.split = regex.compile(merges.pattern)
        self.special = regex.compile("|".join(map(regex.escape, merges.specials))) if merges.specials else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and the number of special strings in it."""
        parts = self.special.split(text) if self.special and any(s in text for s in self.merges.specials) else [text]
        found: list[str] = []
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # each letter alone: no final sigma
            found += self.split.findall(part.lower())
        return found, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list({w for words, _ in cut for w in words}.difference(self.known))
        if new:
            self.known.update(zip(new, count_symbols([w.encode("utf-8", "replace") for w in new], self.merges).tolist(), strict=True))
        known = self.known.__getitem__
        return [sum(map(known, words)) + specials for words, specials in cut]


def count_tokens(docs: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",), limit: int = 2048) -> DataFrame:
    """The columns ``keep`` of each row with n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    merges = docs.sparkSession.sparkContext.broadcast(load_merges(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counter = Counter(merges.value)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            counts: list[int] = []
            block: list[str] = []
            held = 0
            for text in texts:
                block.append(text.as_py())
                held += len(block[-1])
                if held >= BLOCK_CHARS:
                    counts += counter.count(block)
                    block, held = [], 0
            counts += counter.count(block)
            yield {"n_bytes": pa.array(sizes), "n_tokens": pa.array(counts, pa.int64())}

    counted = scan(docs.select(*keep, "text"), "n_bytes bigint, n_tokens bigint", work, keep)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
