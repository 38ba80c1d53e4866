"""Toxicity by a subsequence string kernel and a support vector machine on Nyström features.

The kernel of two words sums over all sequences of three letters that both contain in order, each
weighted by ``decay`` to the power of the stretch it takes in either word; a letter put in or left
out lowers it but does not end it. It is divided by the root of both words' own kernels. Landmarks
are the words that mark toxic texts. A sentence is described by its largest kernel with each
landmark, times the inverse root of the landmarks' own kernel matrix (Nyström), and a linear support
vector machine judges it. A text is as toxic as its worst sentence.

Words are what stands between blanks, letters only, so that ``id.iot`` is ``idiot``; three or more
single letters in a row (``i d i o t``) are one word more. Words of more than 48 letters are cut into
overlapping pieces. A word that shares no three letters in order with a landmark has kernel zero with it; a
bit-parallel longest common subsequence finds those, so that the sums run over few words.

Learning: labelled rows up to ``sample`` (a documented bound, picked by a hash), copies of a text once.
Landmarks: for each word, in how many different pairs of neighbours it stands in toxic and in other
texts, so that near copies of one text count once; the words whose two counts differ most by the
G statistic, if they differ at all surely. The machine is trained on sentences, up to
four of each text that are nearest to the landmarks, with the label of their text, and a logistic curve
over the values of whole texts gives the score.

Nulls: a null text is empty; rows with a null label or ``doc_id`` teach nothing; of several labels of a
row the largest holds. Equal rows get equal scores. With nothing to learn from, every score is 0.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm import ragged
from emberlog.llm.rows import KEY, located, scan, stored

ORDER = 3
DECAY = 0.6
SAMPLE = 20_000
SENTENCES = 4
LANDMARKS = 64
#: The words among which landmarks are picked.
CANDIDATES = 256
#: A landmark's counts differ by at least this G statistic, and it is this many times as frequent in toxic texts.
LEAST_G = 20.0
LEAST_RATIO = 8.0
LONGEST = 48
BLOCK = 1 << 21
#: Common subsequences of less than this share of a landmark count as nothing in common.
LEAST_COMMON = 0.6
#: Landmarks closer to each other than this tell the same.
ALIKE = 0.9
POWER = 2
PENALTY = 1e-4
#: Stands before the letters of a word, so that beginnings tell more than the middle.
BEGIN = 0x3C
#: Words are handled up to these lengths together.
WIDTHS = (8, 12, 20)


# --- words ------------------------------------------------------------------------

@dataclass
class Words:
    """Letters of all words of a block, where each word starts and how long it is, its sentence, and the first sentence of each row."""

    letters: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    sentence: np.ndarray
    rows: np.ndarray  # the row of each sentence


def letter_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x61:0x7B] = table[0x80:] = True
    return table


def cut_words(piece: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the lower-cased texts of a block. A sentence ends with a line or with a full stop, '!' or '?' at the end of a word."""
    starts, ends, first = ragged.word_bounds(piece, offsets, ragged.solid_bytes())
    table = letter_table()
    count = np.concatenate([[0], np.cumsum(table[piece])])
    letters = piece[table[piece]]
    begin, length = count[starts], count[ends] - count[starts]
    stops = np.isin(piece[ends - 1], np.frombuffer(b".!?", np.uint8)) & (length > 1) if len(ends) else np.zeros(0, bool)
    lines = np.concatenate([[0], np.cumsum(piece == 0x0A)])
    fresh = np.zeros(len(starts), bool)
    if len(starts):
        fresh[1:] = stops[:-1] | (lines[starts[1:]] > lines[starts[:-1]])
        fresh[first[:-1][np.diff(first) > 0]] = True
    sentence = np.cumsum(fresh) - 1
    rows = np.searchsorted(first, np.flatnonzero(fresh), "right") - 1
    single = np.flatnonzero(length == 1)
    more: list[tuple[int, int, int]] = []
    if len(single):  # runs of three or more single letters, within a row
        row = np.searchsorted(first, single, "right")
        breaks = np.flatnonzero((np.diff(single, prepend=-2) > 1) | (np.diff(row, prepend=-1) != 0))
        for low, high in zip(breaks.tolist(), [*breaks[1:].tolist(), len(single)], strict=True):
            if high - low >= 3:
                more.append((int(begin[single[low]]), high - low, int(sentence[single[low]])))
    keep = length >= ORDER
    begin, length, sentence = begin[keep], length[keep], sentence[keep]
    long = np.flatnonzero(length > LONGEST)
    for i in long.tolist():
        more += [(int(begin[i]) + at, min(LONGEST, int(length[i]) - at), int(sentence[i])) for at in range(0, int(length[i]) - LONGEST // 2, LONGEST // 2)]
    length[long] = 0  # stands for its pieces
    if more:
        added = np.array(more, np.int64)
        cuts = added[added[:, 1] > LONGEST]
        pieces = [(b + at, min(LONGEST, n - at), s) for b, n, s in cuts.tolist() for at in range(0, n - LONGEST // 2, LONGEST // 2)]
        added = np.concatenate([added[added[:, 1] <= LONGEST], np.array(pieces, np.int64).reshape(-1, 3)])
        begin, length, sentence = (np.concatenate([a, added[:, k]]) for k, a in enumerate((begin, length, sentence)))
    keep = length >= ORDER
    return Words(letters, begin[keep], length[keep], sentence[keep], rows)


# --- kernel -----------------------------------------------------------------------

def padded(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One row per word: a mark for its beginning, its letters, and zeros to the common width."""
    width = int(lengths.max()) if len(lengths) else 0
    steps = np.arange(width)
    spots = starts[:, None] + steps
    rows = np.where(steps < lengths[:, None], letters[np.minimum(spots, max(len(letters) - 1, 0))], 0).astype(np.uint8)
    return np.hstack([np.full((len(rows), 1), BEGIN, np.uint8), rows])


def kernels(words: np.ndarray, others: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The subsequence kernel of each word with its other word; rows of letters, zeros after the end of either.

    ``before[j]``: over the letters of the word so far and the first j letters of the other, the sum
    over common sequences of each length up to ``order - 1``, weighted up to the present ends.
    """
    count, width = others.shape
    before = [np.ones((width + 1, count))] + [np.zeros((width + 1, count)) for _ in range(order - 1)]
    total = np.zeros(count)
    for i in range(words.shape[1]):
        x = words[:, i]
        live = x > 0
        if not live.any():
            break
        equal = (others.T == x) & live
        for size in range(order - 1, -1, -1):
            if size == order - 1:
                total += decay * decay * (before[size][:-1] * equal).sum(axis=0)
            if size:
                grown = np.zeros(count)
                for j in range(width):
                    grown = decay * grown + decay * decay * before[size - 1][j] * equal[j]
                    before[size][j + 1] = np.where(live, decay * before[size][j + 1] + grown, before[size][j + 1])
    return total


def packs(landmarks: list[bytes]) -> list[tuple[np.ndarray, np.uint64, list[tuple[int, np.uint64]]]]:
    """Landmarks side by side in 64-bit words, a free bit after each: letter masks, all bits, and each one's place and bits."""
    out, used, masks, fields = [], 0, np.zeros(256, np.uint64), []

    def close() -> None:
        nonlocal used, masks, fields
        if fields:
            out.append((masks, np.uint64(sum(int(f) for _, f in fields)), fields))
        used, masks, fields = 0, np.zeros(256, np.uint64), []

    for k, word in enumerate(landmarks):
        if used + len(word) + 1 > 64:
            close()
        for i, letter in enumerate(word):
            masks[letter] |= np.uint64(1 << (used + i))
        fields.append((k, np.uint64(((1 << len(word)) - 1) << used)))
        used += len(word) + 1
    close()
    return out


def common_lengths(words: np.ndarray, packed: list, n_landmarks: int) -> np.ndarray:
    """The length of the longest common subsequence of each word and each landmark."""
    found = np.zeros((len(words), n_landmarks), np.uint8)
    for masks, every, fields in packed:
        state = np.full(len(words), every)
        for i in range(words.shape[1]):
            met = state & masks[words[:, i]]
            state = ((state + met) | (state ^ met)) & every
        for k, field in fields:
            found[:, k] = np.bitwise_count(~state & field)
    return found


class Kernel:
    """Normed kernels with a list of landmarks (bytes of letters), to a power that favours the near ones."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        sizes = np.array([len(w) for w in landmarks], np.int64)
        self.matrix = padded(np.frombuffer(b"".join(landmarks), np.uint8), np.cumsum(sizes) - sizes, sizes)
        self.lengths = sizes + 1
        self.norms = kernels(self.matrix, self.matrix)
        self.least = np.maximum(ORDER, np.ceil(LEAST_COMMON * self.lengths))
        self.packed = packs([bytes([BEGIN]) + w for w in landmarks])

    def against(self, words: np.ndarray) -> np.ndarray:
        """Rows of letters to one column per landmark."""
        out = np.zeros((len(words), len(self.landmarks)))
        lengths = (words > 0).sum(axis=1)
        who, which = np.nonzero(common_lengths(words, self.packed, len(self.landmarks)) >= self.least)
        some = np.unique(who)
        own = np.zeros(len(words))
        for low, high in zip((0, *WIDTHS), (*WIDTHS, LONGEST + 1), strict=True):  # rows of like length together
            mine = some[(lengths[some] > low) & (lengths[some] <= high)]
            own[mine] = kernels(words[mine, :high], words[mine, :high])
            band = (lengths[who] > low) & (lengths[who] <= high)
            for size in np.unique(self.lengths[which[band]]):
                pair = np.flatnonzero(band & (self.lengths[which] == size))
                out[who[pair], which[pair]] = kernels(words[who[pair], :high], self.matrix[which[pair], :size])
        out[who, which] /= np.sqrt(own[who] * self.norms[which])
        return out ** POWER

    def sentences(self, words: Words) -> np.ndarray:
        """For each sentence the largest kernel of its words with each landmark."""
        found = np.zeros((len(words.rows), len(self.landmarks)))
        if not len(words.starts):
            return found
        codes = ragged.word_hashes(words.letters, words.starts, words.starts + words.lengths)
        _, sample, which = np.unique(codes, return_index=True, return_inverse=True)
        each = np.zeros((len(sample), len(self.landmarks)))
        order = np.argsort(words.lengths[sample], kind="stable")
        for low in range(0, len(order), 1 << 14):  # words of like length together
            some = sample[order[low:low + (1 << 14)]]
            each[order[low:low + (1 << 14)]] = self.against(padded(words.letters, words.starts[some], words.lengths[some]))
        touched = np.flatnonzero(each.any(axis=1)[which])
        np.maximum.at(found, words.sentence[touched], each[which[touched]])
        return found


def sentence_blocks(column: pa.Array, kernel: Kernel) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, row of each sentence, features of each sentence) for blocks of texts."""
    lower = ragged.lower_bytes()
    data, offsets = ragged.text_bytes(column)
    for low, high in ragged.blocks(offsets, BLOCK):
        words = cut_words(lower[data[offsets[low]:offsets[high]]], offsets[low:high + 1] - offsets[low])
        yield low, high, words.rows, kernel.sentences(words)


# --- learning ---------------------------------------------------------------------

@dataclass
class Model:
    """Landmarks, their Nyström map, the machine's weights and offset, and the curve of the score."""

    landmarks: list[bytes]
    root: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def values(self, features: np.ndarray) -> np.ndarray:
        return features @ (self.root @ self.weights) + self.offset


def context_counts(rows: DataFrame) -> DataFrame:
    """(text, toxic) to (word, pos, neg): in how many pairs of neighbours each word stands, by label."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = ragged.lower_bytes()
        for batch in batches:
            data, offsets = ragged.text_bytes(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for low, high in ragged.blocks(offsets, BLOCK):
                words = cut_words(lower[data[offsets[low]:offsets[high]]], offsets[low:high + 1] - offsets[low])
                if not len(words.starts):
                    continue
                codes = ragged.word_hashes(words.letters, words.starts, words.starts + words.lengths)
                row = words.rows[words.sentence]
                left, right = np.roll(codes, 1), np.roll(codes, -1)
                left[np.roll(row, 1) != row], right[np.roll(row, -1) != row] = 0, 0
                around = ragged.mixed(left * np.uint64(3) + right)
                raw = words.letters.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raw[s:s + n] for s, n in zip(words.starts.tolist(), words.lengths.tolist(), strict=True)], pa.binary()),
                     pa.array(ragged.signed(around)), pa.array(toxic[low:high][row].astype(np.int32))], ["word", "around", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(work, "word binary, around bigint, toxic int").distinct()
    return seen.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") != 1).alias("neg"))


def pick_landmarks(rows: DataFrame, limit: int = LANDMARKS) -> list[bytes]:
    counts = stored(context_counts(rows), "contexts")
    pos, neg = counts.agg(F.sum("pos"), F.sum("neg")).first()
    if not pos or not neg:
        return []
    share = F.lit(pos / (pos + neg))
    seen = F.col("pos") + F.col("neg")
    part = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(F.lit(0.0))
    g = 2 * (part(F.col("pos"), seen * share) + part(F.col("neg"), seen * (1 - share)))
    ratio = (F.col("pos") + 0.5) / pos / ((F.col("neg") + 0.5) / neg)
    best = counts.withColumns({"g": g, "ratio": ratio}).filter((F.col("g") >= LEAST_G) & (F.col("ratio") >= LEAST_RATIO) & (F.length("word") <= LONGEST))
    found: list[bytes] = []
    for row in best.orderBy(F.desc("g"), "word").limit(CANDIDATES).collect():
        kernel = Kernel([*found, bytes(row["word"])])
        if len(found) < limit and not (kernel.against(kernel.matrix[-1:])[0, :-1] >= ALIKE ** POWER).any():
            found.append(bytes(row["word"]))
    return found


def labelled_sentences(rows: DataFrame, landmarks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels: of each row the SENTENCES nearest to the landmarks, those at least half as near as the first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(landmarks)
        for batch in batches:
            labels = batch.column("toxic").to_numpy(zero_copy_only=False)
            for low, high, row, features in sentence_blocks(batch.column("text"), kernel):
                near = features.max(axis=1)
                order = np.lexsort((-near, row))
                rank = np.arange(len(row)) - np.searchsorted(row, row[order])
                first = np.zeros(high - low)
                np.maximum.at(first, row, near)
                picked = order[(rank < SENTENCES) & (near[order] >= first[row[order]] / 2)]
                yield pa.RecordBatch.from_arrays([pa.array(features[picked].tolist(), pa.list_(pa.float64())), pa.array(labels[low + row[picked]].astype(np.int32))],
                                                 ["features", "toxic"])

    # at most ``sample`` times SENTENCES rows of numbers
    found = rows.select("toxic", "text").mapInArrow(work, "features array<double>, toxic int").toPandas()
    features, labels = np.array(found["features"].tolist()).reshape(-1, len(landmarks)), found["toxic"].to_numpy()
    order = np.lexsort((*features.T, labels))  # sums don't depend on the order of the tasks
    return features[order], labels[order]


def train(features: np.ndarray, labels: np.ndarray, landmarks: list[bytes], penalty: float = PENALTY, steps: int = 50) -> Model:
    """A linear machine with squared hinge loss."""
    kernel = Kernel(landmarks)
    gram = kernel.against(kernel.matrix)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    x = np.hstack([features @ root, np.ones((len(features), 1))])
    sign = np.where(labels == 1, 1.0, -1.0)
    weight = np.full(len(x), 1 / max(1, len(x)))
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 0.0
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton: the loss is quadratic while the same rows fall short of the margin
        short = sign * (x @ w) < 1
        own = x[short] * weight[short][:, None]
        last, w = w, np.linalg.solve(np.diag(ridge + 1e-9) + 2 * own.T @ x[short], 2 * own.T @ sign[short])
        if np.abs(w - last).max() < 1e-9:
            break
    return Model(landmarks, root, w[:-1], float(w[-1]), 1.0, 0.0)


def curve(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the labels best (Newton steps)."""
    slope, shift = 1.0, 0.0
    hit, miss = (labels == 1).sum(), (labels != 1).sum()
    aim = np.where(labels == 1, (hit + 1) / (hit + 2), 1 / (miss + 2))
    z = np.stack([values, np.ones(len(values))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * values + shift, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (aim - p))
        slope, shift = slope + np.clip(step[0], -5, 5), shift + np.clip(step[1], -5, 5)
    return float(slope), float(shift)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row is kept from learning: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """Learn from at most ``sample`` labelled rows, picked by a hash of doc_id; None if they can't teach."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = stored(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "picked").withColumnRenamed("doc_id", "of_id")
    rows = docs.select("doc_id", "text").join(picked, docs["doc_id"] == picked["of_id"])
    rows = stored(rows.filter("text IS NOT NULL").select("text", "toxic", F.xxhash64("text").alias("copy")).dropDuplicates(["copy"]), "taught")
    landmarks = pick_landmarks(rows)
    if not landmarks:
        return None
    model = train(*labelled_sentences(rows, landmarks), landmarks)
    found = text_values(rows.select("toxic", "text"), model, ("toxic",)).toPandas().sort_values(["toxic", "value"])  # at most ``sample`` rows of numbers
    model.slope, model.shift = curve(found["value"].to_numpy(), found["toxic"].to_numpy())
    return model


def text_values(texts: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and the machine's value of the worst sentence of each text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        kernel = Kernel(model.landmarks)
        for batch in batches:
            worst = np.full(batch.num_rows, model.offset)
            for low, _, row, features in sentence_blocks(batch.column("text"), kernel):
                some = np.flatnonzero(features.any(axis=1))
                np.maximum.at(worst, low + row[some], model.values(features[some]))
            yield {"value": pa.array(worst)}

    return scan(texts, "value double", work, keep)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """KEY, doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every row."""
    texts = located(docs, "doc_id", "text")
    if model is None:
        return texts.select(*KEY, "doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    value = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("value") * model.slope + model.shift))
    scored = text_values(texts, model, (*KEY, "doc_id")).select(*KEY, "doc_id", (1 / (1 + F.exp(-value))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
