"""Cross-tokenizer alignment against whole texts, character by character and pair by pair."""

import collections
import hashlib
import random

import public_tokenizers
import pytest

from emberlog.llm import token_bridge

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def files():
    with open(A, "rb") as a, open(B, "rb") as b:
        return a.read(), b.read()


def plain_tokens(pair, text):
    """(id, begin, end) of all tokens of both tokenizers over the whole text, or none."""
    want = (" " + (text or "")).encode()
    a = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids
    b = pair.b.encode(text or "", return_type=int)
    out = []
    for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
        if not text or b"".join(table[i] for i in ids) != want:
            return [], []
        at, found = 0, []
        for i in ids:
            found.append((i, at, at + len(table[i])))
            at += len(table[i])
        out.append(found)
    return out


def plain(pair, texts):
    """Per text: counts, digest, n_best and count_sum, by comparing all tokens with all."""
    per, total = [], collections.Counter()
    for text in texts:
        a, b = plain_tokens(pair, text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        total.update(links)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [(",".join(str(i) for i, s, e in a if low <= s and e <= high), ",".join(str(i) for i, s, e in b if low <= s and e <= high))
                  for low, high in zip([0, *cuts], cuts)]
        told = ";".join(f"{x}|{y}" for x, y in groups)
        per.append((len(a), len(b), len(cuts), links, hashlib.sha256(told.encode()).hexdigest() if a else ""))
    best = collections.Counter()
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    return [(na, nb, ng, len(links), sum(total[k] == best[k[1]] for k in links), sum(total[k] for k in links), told) for na, nb, ng, links, told in per]


ODD = ["", None, " ", "  ", "a", "a ", " a", "a  b", "a\n b", "a \n", "\n", "x b  c", "x　y z", "Été ñandú — ΑΣ 日本語 \U0001f600\U0001f600 fin", "a▁b c", "▁", "ok ▁ ok",
       "<|endoftext|> <s> </s> <unk> <0x41>", "\x00 a\x00", "ﬁ ½ ǆ", "é o", "don't I'll  we're", "x" * 3000, "a " * 700, "tab\tand\x0bvt \x1c fs", "  x \u0085 y", "1234 5678.90 %$#", " ​ zero"]


def row(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


@pytest.mark.parametrize("pairs", [token_bridge.PAIRS, 40])
def test_all_texts_agree_with_whole_texts(make, files, pairs):
    texts = [*ODD, "a  b", None]
    docs = make([(i, t) for i, t in enumerate(texts)]).repartition(3)
    got = {r.doc_id: row(r) for r in token_bridge.bridge(docs, A, B, pairs=pairs).collect()}
    assert got == dict(enumerate(plain(token_bridge.Pair(*files), texts)))


def test_random_texts_split_like_whole_ones(files):
    draw, pair = random.Random(5), token_bridge.Pair(*files)
    assert pair.tail_marks >= set(",.;!?")
    alphabet = ["a", "b", "the", "ing", ".", ",", "; ", "x. ", "é, ", "²., ", "!! ", "'s", " ", " ", "  ", "\n", "\t", "é", "日", "\U0001f469‍\U0001f680", "▁", " ", "　", "7", "A", "<s>", "\x1f", "\u0085"]
    for _ in range(1500):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 14)))
        a, b = plain_tokens(pair, text)
        got = pair.stretch([text])["counts"][0].tolist()
        ends = ({x[2] for x in a}, {y[2] for y in b})
        assert got == [len(a), len(b), len(ends[0] & ends[1]), len(ends[0] | ends[1])], text


def test_coarse_cuts_are_the_spans_of_the_libraries(files):
    pair = token_bridge.Pair(*files)
    found, (b_ids, b_spans) = pair.a.encode(" été 漢"), pair._spans(["été 漢"])[0]
    a, a_end, b, b_end = pair._ends([" été 漢".encode()], [found.ids], [found.offsets], [b_ids], [b_spans])
    assert a_end.tolist()[-1] == b_end.tolist()[-1] == 10
    assert [pair.a_bytes[i] for i in a] == [" été 漢".encode()[s:e] for s, e in zip([0, *a_end], a_end)]
    assert [pair.b_bytes[i] for i in b] == [" été 漢".encode()[s:e] for s, e in zip([0, *b_end], b_end)]


def test_joined_parts_agree_with_single_ones(files):
    draw, pair = random.Random(8), token_bridge.Pair(*files)
    for _ in range(60):
        parts = ["".join(draw.choice(["a", "the", "ing", "é", "日", ".", "'s", "  ", "\n", "9", "\U0001f600"]) for _ in range(draw.randrange(1, 9))) + "x" for _ in range(40)]
        one, many = pair.align(parts), pair.align_joined(parts)
        assert many is not None and one[2] == many[2] and all((x == y).all() for x, y in ((one[i], many[i]) for i in (0, 1, 3, 4)))
    assert pair.align_joined(["a", "▁b"]) is None


def test_the_cache_is_bounded_and_forgets(files, monkeypatch):
    monkeypatch.setattr(token_bridge, "CACHED", 5)
    pair = token_bridge.Pair(*files)
    texts = ["one two three four", "five six seven eight nine", "one two ten"]
    again = [pair.stretch([t])["digests"][0] for t in texts]
    assert again == token_bridge.Pair(*files).stretch(texts)["digests"] and len(pair.number) < 12


def test_null_ids_equal_rows_and_empty_tables(make):
    rows = token_bridge.bridge(make([(None, "same text"), (1, "same text"), (1, "same text")]), A, B).collect()
    assert len(rows) == 3 and len({row(r) for r in rows}) == 1 and rows[0].n_best == rows[0].n_links
    assert token_bridge.bridge(make([]), A, B).count() == 0
