"""Two tokenizers over the same bytes: where both cut, which tokens overlap, and which partner is the usual one.

Tokenizer A is a byte-level BPE of ``tokenizers``, B a ``sentencepiece`` model that puts a blank before a text; both see
a blank and the text. The spans that the libraries give are the coarse cuts: character offsets for A, the spans of the
immutable proto for B. They are whole characters, so a character that several tokens share (parts of it in A, byte pieces in B) is
refined by the bytes that the tokens decode to. Between two neighbouring cuts of either tokenizer lies exactly one pair
of overlapping tokens (a link); where both cut, a group ends.

How it runs:

1. A text is taken apart before each blank that follows a character that is not white space, and before a mark between a
   letter and such a blank. Neither tokenizer joins tokens across such a place (A by its pattern of words, B because no piece
   has a blank behind another character or the mark behind a letter, which is checked; else texts stay whole). Each different part is tokenized once per stretch of rows and kept in a
   cache of bounded size, so common words cost a lookup.
2. The links of the parts and the parts of every text are written, a row for a stretch of texts.
3. Pairs of ids are counted within each task and added up. The table of counts goes to the tasks in pieces of at most
   ``PAIRS`` rows, one pass over the written rows each; sums over links add up across pieces.

Texts that are null, empty, or that either tokenizer does not give back byte by byte have no tokens: zeros and an empty
``groups_sha256``. Rows are named by their place in the input, so equal rows and null ids stay apart; other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.ragged import lists
from emberlog.llm.rows import KEY, KEY_DDL, located, stored

#: Pairs of ids whose counts are sent to the tasks at a time.
PAIRS = 1 << 20
#: Parts that a worker keeps, and their bytes.
CACHED = 200_000
CACHED_BYTES = 1 << 24
#: New parts that are tokenized together.
AT_ONCE = 8192
#: Marks that are cut off behind a letter, where the tokenizers allow it: a word is then one part with and without them.
TAILS = ",.;:!?"
#: Bytes of text in one written row (a longer text is one row).
STRETCH = 1 << 20
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: A written row has some MB. Row groups of 16 MB, looked at after every row, bound what a reader holds.
ROW_GROUPS = {"parquet.block.size": str(1 << 24), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "2"}
BLANK = "▁"

_ODD_BLANK = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def split_parts(text: str, tails: frozenset[str] = frozenset()) -> list:
    """``" " + text`` in parts that begin with a blank, each without that blank.

    A part that ends in a letter and one of ``tails`` is cut before it; the character alone is (character,).
    """
    if _ODD_BLANK.search(text) is None and text[:1] != " ":
        parts = text.split(" ")
    else:
        parts = [part[1:] for part in _CUT.split(" " + text)]
    if not tails:
        return parts
    out: list = []
    for part in parts:
        if part[-1:] in tails and part[-2:-1].isalpha():
            out += (part[:-1], (part[-1],))
        else:
            out.append(part)
    return out


class Pair:
    """Both tokenizers, made from the bytes of their files, and what they give for single parts."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        back = byte_alphabet()
        vocabulary = self.a.get_vocab(True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        is_byte = [self.b.is_byte(i) for i in range(len(pieces))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if raw else p.replace(BLANK, " ").encode() for p, raw in zip(pieces, is_byte, strict=True)]
        self.b_is_byte = np.array(is_byte)
        self.a_text, self.b_text = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]
        self.b_blank = self.b.piece_to_id(BLANK)
        self.splits = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.tails: dict[str, tuple] = {}
        for mark in TAILS if self.splits else "":
            self._learn_tail(mark, pieces)
        self.tail_marks = frozenset(self.tails)
        self.forget()

    def _learn_tail(self, mark: str, pieces: list[str]) -> None:
        """A mark behind a letter, if it is a token of its own there: A's words end before it, and no piece of B has it behind a letter."""
        if any(p[i] == mark and p[i - 1].isalpha() for p in pieces for i in range(1, len(p))):
            return
        short, long = self.align(["a"]), self.align(["a" + mark])
        grown = long[0] - short[0]
        if long[1].all() and (grown == 1).all() and long[2][0].startswith(short[2][0] + ";"):
            self.tails[mark] = (grown, long[1], [long[2][0].rsplit(";", 1)[1]], np.array([0, 1]), long[4][-1:])

    def forget(self) -> None:
        """Empty the cache."""
        self.number: dict = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int32)
        self.valid = np.zeros(0, bool)
        self.first = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)
        self.held = 0
        for mark, found in self.tails.items():
            self._add([(mark,)], [mark], found)

    def _spans(self, parts: list[str]) -> list[tuple[list, list]]:
        """Ids and ends (in bytes) of B's tokens, from the spans of its immutable proto."""
        if hasattr(self.b, "_resolve_return_type"):  # newer libraries hand them out as a mapping
            found = self.b.encode(parts, return_type="offset_mapping", return_bytes=True, num_threads=1)
            return [(x["ids"], [end for _, end in x["offsets"]]) for x in found]
        found = self.b.encode(parts, out_type="immutable_proto", num_threads=1)
        return [([q.id for q in x.pieces], [q.end for q in x.pieces]) for x in found]

    def _ends(self, raw: list[bytes], a_ids: list, a_spans: list, b_ids: list, b_spans: list) -> tuple[np.ndarray, ...]:
        """Ids and byte ends of all tokens of ``raw`` in turn: coarse cuts from the spans, the rest from decoded bytes."""
        data = np.frombuffer(b"".join(raw), np.uint8)
        base = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
        first_char = np.searchsorted(heads, base[:-1])

        a = np.fromiter(chain.from_iterable(a_ids), np.int64)
        of = np.repeat(np.arange(len(raw)), [len(x) for x in a_ids])
        end = np.fromiter((e for spans in a_spans for _, e in spans), np.int64, len(a)) + first_char[of]
        shared = np.zeros(len(a), bool)  # the next token begins inside this one's last character
        if len(heads) <= len(data):  # in ASCII alone no tokens share a character
            begin = np.fromiter((b for spans in a_spans for b, _ in spans), np.int64, len(a)) + first_char[of]
            shared[:-1] = begin[1:] < end[:-1]
        decoded = np.cumsum(self.a_size[a])
        a_end = np.where(shared, decoded, heads[np.minimum(end, len(heads) - 1)])

        b = np.fromiter(chain.from_iterable(b_ids), np.int64)
        of = np.repeat(np.arange(len(raw)), [len(x) for x in b_ids])
        coarse = np.fromiter(chain.from_iterable(b_spans), np.int64, len(b)) + base[of] + 1  # behind the blank that B adds
        b_decoded = np.cumsum(self.b_size[b])
        b_end = np.where(self.b_is_byte[b], b_decoded, coarse)
        for found, bytes_say in ((a_end, decoded), (b_end, b_decoded)):
            apart = found != bytes_say  # a library that trims blanks from its spans or counts them in other units
            found[apart] = bytes_say[apart]
        return a, a_end, b, b_end

    def align(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each part (a blank goes before it) its counts, whether both give its bytes back, its groups as text, and
        the codes of its links (a * size of B + b), all in turn, with the first link of each part."""
        a_found = self.a.encode_batch([" " + p for p in parts], add_special_tokens=False)
        a_ids = [x.ids for x in a_found]
        # a part of nothing but the blank before it is a token of B only inside a text
        b_found = [found if p else ([self.b_blank], [0]) for p, found in zip(parts, self._spans(parts), strict=True)]
        raw = [b" " + p.encode() for p in parts]
        valid = np.array([self._same(x, y[0], r) for x, y, r in zip(a_ids, b_found, raw, strict=True)], bool)
        good = np.flatnonzero(valid).tolist()
        counts, groups, first = np.zeros((len(parts), 4), np.int64), [""] * len(parts), np.zeros(len(parts) + 1, np.int64)
        if not good:
            return counts, valid, groups, first, np.zeros(0, np.int64)
        base = np.concatenate([[0], np.cumsum([len(raw[i]) for i in good])])
        ends = self._ends([raw[i] for i in good], [a_ids[i] for i in good], [a_found[i].offsets for i in good], *zip(*[b_found[i] for i in good], strict=True))
        counts[good], texts, links = self._groups(*ends, base)
        for i, text in zip(good, texts, strict=True):
            groups[i] = text
        first[1:] = np.cumsum(counts[:, 3])
        return counts, valid, groups, first, links

    def align_joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray] | None:
        """The same for parts that end in a character that is not white space, as one text: both cut before its blanks.
        None if the text does not come back byte by byte."""
        text = " ".join(parts)
        raw = b" " + text.encode()
        a_found, (b_ids, b_ends) = self.a.encode(" " + text, add_special_tokens=False), self._spans([text])[0]
        base = np.concatenate([[0], np.cumsum([len(p.encode()) + 1 for p in parts])])
        a_ids = a_found.ids
        if not self._same(a_ids, b_ids, raw):
            return None
        a, a_end, b, b_end = self._ends([raw], [a_ids], [a_found.offsets], [b_ids], [b_ends])
        if not (np.isin(base[1:], a_end, assume_unique=True).all() and np.isin(base[1:], b_end, assume_unique=True).all()):
            return None
        counts, groups, links = self._groups(a, a_end, b, b_end, base)
        return counts, np.ones(len(parts), bool), groups, np.concatenate([[0], np.cumsum(counts[:, 3])]), links

    def _same(self, a_ids: list[int], b_ids: list[int], raw: bytes) -> bool:
        """Whether both give the bytes back."""
        return b"".join(map(self.a_bytes.__getitem__, a_ids)) == raw and b"".join(map(self.b_bytes.__getitem__, b_ids)) == raw

    def _groups(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Counts and groups of the parts between the places ``base``, and the links of all parts in turn."""
        ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")  # two sorted runs: merged
        again = ends[1:] == ends[:-1]
        either, both = ends[np.append(True, ~again)], ends[1:][again]
        links = a[np.searchsorted(a_end, either)] * len(self.b_bytes) + b[np.searchsorted(b_end, either)]
        counts = np.stack([np.diff(np.searchsorted(e, base, "right")) for e in (a_end, b_end, both, either)], axis=1)
        a_text, b_text = list(map(self.a_text.__getitem__, a.tolist())), list(map(self.b_text.__getitem__, b.tolist()))
        a_cut, b_cut = (np.searchsorted(a_end, both) + 1).tolist(), (np.searchsorted(b_end, both) + 1).tolist()
        texts = [(a_text[i] if k - i == 1 else ",".join(a_text[i:k])) + "|" + (b_text[j] if m - j == 1 else ",".join(b_text[j:m]))
                 for i, k, j, m in zip([0, *a_cut[:-1]], a_cut, [0, *b_cut[:-1]], b_cut, strict=True)]
        at = np.searchsorted(both, base, "right").tolist()
        return counts, [";".join(texts[low:high]) for low, high in zip(at[:-1], at[1:], strict=True)], links

    def learn(self, parts: list[str]) -> None:
        """Put new parts into the cache, a few thousand at a time."""
        plain = [p for p in parts if p and not p[-1].isspace()]
        for group, joined in ((plain, True), ([p for p in parts if not p or p[-1].isspace()], False)):
            for low in range(0, len(group), AT_ONCE):
                some = group[low:low + AT_ONCE]
                self._add(some, some, (self.align_joined(some) if joined else None) or self.align(some))

    def learn_whole(self, text: str) -> None:
        """Put a text that holds parts which don't come back byte by byte into the cache as one part, its bytes judged as a whole."""
        self._add([(text, None)], [text], self.align([text]))
        self.valid[-1] = True

    def _add(self, names: list, parts: list[str], found: tuple) -> None:
        counts, valid, groups, first, links = found
        for name, part in zip(names, parts, strict=True):
            self.number[name] = len(self.number)
            self.held += len(part)
        self.groups += groups
        self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
        self.valid = np.concatenate([self.valid, valid])
        self.first = np.concatenate([self.first, first[1:] + self.first[-1]])
        self.links = np.concatenate([self.links, links])

    def stretch(self, texts: list[str]) -> dict:
        """Counts and digests of ``texts`` (not null, not empty), their parts by number, and the links of these numbers."""
        if len(self.number) > CACHED or self.held > CACHED_BYTES:
            self.forget()
        gc.disable()  # millions of short-lived spans and no cycles: the collector would only look through the cache
        try:
            return self._stretch(texts)
        finally:
            gc.enable()

    def _stretch(self, texts: list[str]) -> dict:
        split = [split_parts(t, self.tail_marks) if self.splits else [t] for t in texts]
        self.learn([p for p in dict.fromkeys(chain.from_iterable(split)) if p not in self.number])
        found = [np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts)) for parts in split]
        for i, own in enumerate(found):
            if not self.valid[own].all():  # whether the bytes agree is asked of the whole text
                if (texts[i], None) not in self.number:
                    self.learn_whole(texts[i])
                found[i] = np.array([self.number[(texts[i], None)]])
        counts = np.array([self.counts[own].sum(axis=0, dtype=np.int64) for own in found]).reshape(-1, 4)
        digests = [hashlib.sha256(";".join(map(self.groups.__getitem__, own.tolist())).encode()).hexdigest() if n else "" for own, n in zip(found, counts[:, 0], strict=True)]
        flat = np.concatenate([np.zeros(0, np.int64), *found])
        seen = np.zeros(len(self.number), bool)
        seen[flat] = True
        used, place = np.flatnonzero(seen), (np.cumsum(seen) - 1)[flat]
        sizes = self.counts[used, 3].astype(np.int64)
        take = np.repeat(self.first[used] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(used) else np.zeros(0, np.int64)
        return {"counts": counts, "digests": digests, "parts": place, "part_counts": np.array([len(x) for x in found]), "links": self.links[take], "link_counts": sizes}


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a_file: bytes, b_file: bytes) -> Pair:
    """The tokenizers of this worker, made once."""
    key = (hashlib.sha256(a_file).hexdigest(), hashlib.sha256(b_file).hexdigest())
    if key not in _pairs:
        _pairs[key] = Pair(a_file, b_file)
    return _pairs[key]


def forget_all() -> None:
    """Free what a reused worker has kept from tokenizing."""
    for pair in _pairs.values():
        pair.forget()


DOC_ARRAYS = (*KEY, "doc_id", *COUNTS)
STRETCH_DDL = (", ".join(f"{c} array<bigint>" for c in DOC_ARRAYS)
               + ", digests array<string>, part_counts array<int>, parts array<int>, link_counts array<int>, links array<bigint>")


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Stretches of texts, written: per text its key and counts, the parts it has, and the links of the parts."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:  # of the size of a vocabulary
        files = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(*files.value)
        schema = pa.schema([*((c, pa.list_(pa.int64())) for c in DOC_ARRAYS), ("digests", pa.list_(pa.string())), ("part_counts", pa.list_(pa.int32())),
                            ("parts", pa.list_(pa.int32())), ("link_counts", pa.list_(pa.int32())), ("links", pa.list_(pa.int64()))])
        for batch in batches:
            texts = batch.column("text").to_pylist()
            edges, size = [0], 0
            for i, t in enumerate(texts):
                if size and size + len(t or "") > STRETCH:
                    edges.append(i)
                    size = 0
                size += len(t or "")
            for low, high in zip(edges, [*edges[1:], len(texts)], strict=True):
                own = [i for i in range(low, high) if texts[i]]
                got = pair.stretch([texts[i] for i in own])
                at = np.array(own, np.int64) - low
                counts, digests, part_counts = np.zeros((high - low, 4), np.int64), [""] * (high - low), np.zeros(high - low, np.int64)
                counts[at], part_counts[at] = got["counts"], got["part_counts"]
                for i, d in zip(at.tolist(), got["digests"], strict=True):
                    digests[i] = d
                rows = [*(batch.column(c).slice(low, high - low).to_pylist() for c in (*KEY, "doc_id")), *counts.T, digests, part_counts, got["parts"], got["link_counts"], got["links"]]
                yield pa.RecordBatch.from_arrays([lists(np.array([len(x)]), pa.array(x, f.type.value_type)) for x, f in zip(rows, schema, strict=True)], schema=schema)

    return stored(located(docs, "doc_id", "text").mapInArrow(work, STRETCH_DDL), "aligned", **ROW_GROUPS)


def _weights(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the links of a written row and how often each part's links occur in its texts."""
    column = lambda name: batch.column(name)[row].values.to_numpy()
    sizes = column("link_counts")
    return column("links"), np.repeat(np.bincount(column("parts"), minlength=len(sizes)), sizes)


def count_pairs(rows: DataFrame, b_size: int) -> DataFrame:
    """(code, n, top): how many links hold each pair of ids, and whether that is the most of all pairs with its B id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(back, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)

        held, size = [], 0
        forget_all()
        for batch in batches:
            for row in range(batch.num_rows):
                held.append(_weights(batch, row))
                size += len(held[-1][0])
                if size > 1 << 20:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["code", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(held)], ["code", "n"])

    partial = rows.select("parts", "link_counts", "links").mapInArrow(work, "code bigint, n bigint")
    pairs = stored(partial.groupBy("code").agg(F.sum("n").alias("n")), "pairs").withColumn("b", F.col("code") % F.lit(b_size))
    best = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return stored(pairs.join(best, "b").select("code", "n", (F.col("n") == F.col("most")).alias("top")), "counted")


def _sums(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Per text the links among ``codes`` (at most ``PAIRS`` rows) that are their B id's best, and the sum of counts."""
    table = codes.orderBy("code").toPandas()
    known = rows.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("code", "n", "top")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, top = known.value
        forget_all()
        for batch in batches:
            for row in range(batch.num_rows):
                column = lambda name: batch.column(name)[row].values  # noqa: B023, E731
                links, sizes, parts = column("links").to_numpy(), column("link_counts").to_numpy(), column("parts").to_numpy()
                at = np.minimum(np.searchsorted(keys, links), max(len(keys) - 1, 0))
                here = keys[at] == links if len(keys) else np.zeros(len(links), bool)
                edge = np.concatenate([[0], np.cumsum(sizes)])
                both = []
                for value in (here & top[at] if len(keys) else here, np.where(here, n[at], 0) if len(keys) else here):
                    per_part = np.diff(np.concatenate([[0], np.cumsum(value.astype(np.int64))])[edge])
                    run = np.concatenate([[0], np.cumsum(per_part[parts])])
                    both.append(pa.array(np.diff(run[np.concatenate([[0], np.cumsum(column("part_counts").to_numpy())])])))
                yield pa.RecordBatch.from_arrays([*(column(c) for c in DOC_ARRAYS), column("digests"), *both], [*DOC_ARRAYS, "groups_sha256", "n_best", "count_sum"])

    ddl = f"{KEY_DDL}, doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", groups_sha256 string, n_best bigint, count_sum bigint"
    return rows.select(*DOC_ARRAYS, "digests", "part_counts", "parts", "link_counts", "links").mapInArrow(work, ddl)


def bridge(docs: DataFrame, a_path: str, b_path: str, *, pairs: int = PAIRS) -> DataFrame:
    """KEY, doc_id, ``COUNTS``, groups_sha256, n_best and count_sum of every row."""
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    rows = aligned(docs, a_path, b_path)
    counted = count_pairs(rows, b_size)
    pieces = max(1, -(-counted.count() // pairs))
    if pieces == 1:
        return _sums(rows, counted)
    cut = stored(counted.withColumn("piece", F.pmod(F.xxhash64("code"), F.lit(2 * pieces))), "cut")  # half full, so that chance can't overfill one
    parts = [_sums(rows, cut.filter(F.col("piece") == i)) for i in range(2 * pieces)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    same = [*KEY, "doc_id", *COUNTS, "groups_sha256"]
    return whole.groupBy(*same).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
