"""Conversation prefix trie against a trie built turn by turn."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from emberlog.llm import prefix_trie
from emberlog.llm.prefix_trie import SpillingQueue

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "conv_id bigint, turn bigint, role string, text string, depth int, words int, q1 string, heavy string, length int, n1 int, kind int"
EXTRA = (None,) * 7


def plain(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = collections.defaultdict(set)
    for path in nodes:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) if children[path] else 1
        own_words = (len(nodes[path]) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        saved[path] = own_words + sum(saved[x] for x in children[path])
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def got(spark, rows, **how):
    frame = spark.createDataFrame([(*r, *EXTRA) for r in rows], DDL).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame, **how).collect()), key=lambda r: (r[1], r[0]))


def talk(seed, convs, texts, longest):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant"]), draw.choice(texts)) for c in convs for t in range(draw.randrange(1, longest))]


ODD = [*talk(1, range(0, 90), ["a b", "c", "", None, "a  b\n c"], 6), *talk(2, [-45, -40, -20, 5000, 10 ** 15], ["a b", "c"], 5),
       (200, None, "user", "hi"), (200, None, "user", "hi"), (200, 1, None, None), (200, 2, None, ""), (201, 1, "user", "a"), (201, 2, "user", "a"), (None, 1, "user", "lost"),
       (220, 0, "user", "x y z " * 4000), (223, 0, "user", "only one"), *[(c, t, "user", "same") for c in range(300, 420) for t in range(4)]]


@pytest.mark.parametrize("how", [{}, {"crowd": 3}, {"crowd": 2, "band": 2}, {"crowd": 1000, "band": 3, "room": 2}, {"crowd": 5, "band": 1}])
def test_trie_agrees_with_a_plain_one(spark, how):
    assert got(spark, ODD, **how) == plain(ODD)


def test_a_conversation_of_very_many_turns_is_cut(spark):
    rows = [*[(c, t, "user", f"t{t % 7}") for c in (0, 1, 40, 41) for t in range(300 if c in (0, 41) else 120)], *talk(3, range(60, 80), ["t0", "t1"], 8)]
    assert got(spark, rows, crowd=2, band=16, room=8) == plain(rows)


def test_small_bounds_pieces_of_member_lists(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    assert got(spark, ODD, crowd=4) == plain(ODD)


def test_empty_and_turnless(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "x")]) == []
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1)
    assert got(spark, [(lone, 0, "user", "x")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_queue_spills_and_adds_up():
    draw, queue, want = random.Random(4), SpillingQueue(room=10), collections.Counter()
    for _ in range(20_000):
        key = (draw.randrange(50), draw.randrange(100), draw.randrange(2))
        queue.push(key, (1, 2, key[0]))
        want[key] += 1
    assert len(queue.runs) > 1000
    seen = []
    while (key := queue.peek()) is not None:
        seen.append(key)
        assert queue.take(key) == (want[key], 2 * want[key], key[0] * want[key])
    assert seen == sorted(want)
