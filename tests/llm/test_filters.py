"""Quality rules, repeated runs, near duplicates, decontamination: against plain Python."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from conftest import words
from pyspark.sql import functions as F

from emberlog.llm import bench_prefix, golay_simhash, line_winnow, quality_fences
from emberlog.llm.components import components

SOLID = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


# --- quality ----------------------------------------------------------------------

def plain_measures(text):
    text = text or ""
    found = SOLID.findall(text)
    lines = [line for line in text.split("\n") if SOLID.search(line)]
    seen = collections.Counter(tuple(found[i:i + 8]) for i in range(len(found) - 7))
    repeated = {p for i in range(len(found) - 7) if seen[tuple(found[i:i + 8])] > 1 for p in range(i, i + 8)}
    return len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_quality_measures(make, odd_rows):
    rows = odd_rows + [(20, "x y z w v u t s " * 3 + "end"), (21, "# a\n# a\n\nb | c"), (22, words(9, 50) + "\x0b" + words(9, 50))]
    got = quality_fences.rate(make(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for doc_id, text in rows:
        m = plain_measures(text)
        want.append((doc_id, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert counted(got) == counted(want)


def test_quality_bounds_follow_each_group(make):
    """A habit of one source is no fault there, and is one elsewhere; small groups use the sketch of all."""
    rows = [(i, words(i, 60) + " #" * (25 if i % 2 else 0), "en", f"s{i % 2}") for i in range(400)]
    rows += [(1000, words(5000, 60) + " #" * 25, "en", "s0"), (1001, words(5001, 60) + " #" * 25, "en", "s1"),
             (1002, words(5002, 60), "xx", None), (1003, words(5003, 60), None, "s1"), (1004, words(5004, 10), "yy", "s9")]
    kept = {r["doc_id"]: r["kept"] for r in quality_fences.rate(make(rows), least_rows=100).collect()}
    assert not kept[1000] and kept[1001] and kept[1002] and kept[1003] and not kept[1004]
    assert all(kept[i] for i in range(400))
    out = quality_fences.keep_good(make(rows), least_rows=100)
    assert out.columns == make(rows).columns and {r["doc_id"] for r in out.collect()} == {d for d, k in kept.items() if k}


def test_quality_plan_is_native(make, odd_rows):
    plan = quality_fences.measured(make(odd_rows), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- repeated runs ----------------------------------------------------------------

def check_runs(rows, got, line, window):
    """Every removed word lies in a line seen earlier; every run of the guaranteed length lost a word."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    lines, runs = set(), set()
    for i in order:
        own, gone = SOLID.findall(lower(rows[i][1])), set()
        assert got[i][1] == len(own)
        for a, b in got[i][3]:
            gone.update(range(a, b))
        assert got[i][2] == len(gone)
        covered = set()
        for j in range(len(own) - line + 1):
            if (gram := tuple(own[j:j + line])) in lines:
                covered.update(range(j, j + line))
            lines.add(gram)
        assert gone <= covered
        for j in range(len(own) - line - window + 2):
            if (run := tuple(own[j:j + line + window - 1])) in runs:
                assert gone & set(range(j, j + line + window - 1))
            runs.add(run)


def repeats(frame, rows, **sizes):
    """One result per row of ``rows``; equal rows in the order of the table."""
    found = collections.defaultdict(list)
    for r in sorted(line_winnow.find_repeats(frame, **sizes).collect(), key=lambda r: (r["row_file"], r["row_at"])):
        spans = [tuple(map(int, s.split(":"))) for s in r["spans"].split(",")] if r["spans"] else []
        found[r["doc_id"], r["n_words"]].append((r["doc_id"], r["n_words"], r["n_removed"], spans))
    out = []
    for doc_id, text in rows:
        options = found[doc_id, len(SOLID.findall(text or ""))]
        options.sort(key=lambda o: o[2])
        out.append(options.pop(0))
    assert not any(found.values())
    return out


def test_repeats_of_odd_rows(make, odd_rows):
    got = repeats(make(odd_rows), odd_rows)
    check_runs(odd_rows, got, line_winnow.LINE, line_winnow.WINDOW)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r[0]].append(r)
    assert sorted(r[2] for r in by_id[5]) == [0, 0, 80]  # the first of the equal rows keeps its text
    assert by_id[6][0][3] == [(30, 110)]  # the whole passage, no word beside it
    assert by_id[7][0][2] >= 4900


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_pasted_texts(make, seed):
    draw = random.Random(seed)
    stock = [words(100 + i, draw.randrange(5, 40)) for i in range(25)]
    rows = [(i, "\n".join(draw.choice(stock) if draw.random() < 0.6 else words(1000 * seed + 10 * i + k, 12) for k in range(draw.randrange(1, 9)))) for i in range(60)]
    check_runs(rows, repeats(make(rows), rows, line=8, window=7), 8, 7)


def test_texts_without_repeats(make, odd_rows):
    rows = odd_rows + [(30, words(50, 20) + "\n" + words(51, 100) + "\n" + words(52, 20)), (31, "Start of it.\n" + words(51, 100) + "\nthe end of it")]
    out = line_winnow.remove_repeats(make(rows))
    assert out.columns == make(rows).columns
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[31] == "Start of it.\nthe end of it" and text[30] == rows[-2][1] and text[2] is None and text[3] == ""
    assert out.filter("doc_id = 5").count() == 2


# --- near duplicates --------------------------------------------------------------

def plain_print(text):
    own = SOLID.findall(lower(text))
    if not own:
        return 0
    codes = [xxhash.xxh64_intdigest(" ".join(own[i:i + 3]).encode(), 42) for i in range(max(1, len(own) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def plain_components(prints):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_near_duplicates(make, odd_rows):
    base = words(77, 300).split(" ")
    near = [(100 + i, " ".join(base[:i * 7] + ["CHANGED"] + base[i * 7 + 1:])) for i in range(20)] + [(200, "w" * 40 + " x " + "é" * 50)]
    rows = odd_rows + near
    got = golay_simhash.near_duplicates(make(rows)).select("doc_id", "fingerprint", "component_id").collect()
    prints = [plain_print(t) for _, t in rows]
    group = plain_components(prints)
    lowest = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    assert counted(got) == counted((d, f"{prints[i]:016x}", lowest[group[i]]) for i, (d, _) in enumerate(rows))
    kept = golay_simhash.drop_copies(make(rows))
    assert kept.columns == make(rows).columns and kept.count() == len(set(group))


@pytest.mark.parametrize("crowd", [0, 1000])
def test_links_of_close_fingerprints(spark, crowd):
    """Balls of close fingerprints, by pairs and by shared vectors: the same components as all pairs give."""
    draw = random.Random(5)
    prints = set()
    for _ in range(12):
        center = draw.getrandbits(64)
        prints |= {center ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(0, 4))) for _ in range(25)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    edges = golay_simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), crowd=crowd)
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 2 for r in edges.collect())
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for f, g in zip(signed, plain_components(prints), strict=True):
        got[roots.get(f, f)].add(f)
        want[g].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000), (500, 700), (700, 600)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert roots == {**{i: 0 for i in range(301)}, 500: 500, 600: 500, 700: 500}


def test_golay_code_is_perfect():
    tables = golay_simhash.syndromes()
    errors = golay_simhash.error_patterns(tables)
    assert len(set(errors.tolist())) == 2048 and max(bin(e).count("1") for e in errors.tolist()) == 3


def test_hashes_of_all_lengths():
    draw = random.Random(3)
    data = bytes(draw.randrange(256) for _ in range(4000))
    spots = [(draw.randrange(3900), n) for n in range(100) for _ in range(3)]
    got = golay_simhash.xxh64(np.frombuffer(data, np.uint8), np.array([s for s, _ in spots]), np.array([n for _, n in spots]))
    assert got.tolist() == [xxhash.xxh64_intdigest(data[s:s + n], 42) for s, n in spots]


# --- decontamination --------------------------------------------------------------

def plain_hits(text, items, window=13):
    own, hit, met = LETTERS.findall(lower(text)), set(), set()
    for item_id, item in items:
        theirs = LETTERS.findall(lower(item))
        n = min(window, len(theirs))
        grams = {tuple(theirs[i:i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for j in range(len(own) - n + 1 if n else 0):
            if tuple(own[j:j + n]) in grams:
                hit.update(range(j, j + n))
                met.add(item_id)
    return len(own), len(hit), len(met), len(hit) > 0 and 20 * len(hit) >= len(own)


def test_decontamination(spark, make, odd_rows):
    passage, short = words(300, 40), "shorter than a window"
    items = [(1, passage), (2, short), (3, None), (4, ""), (5, "One!"), (6, passage), (7, words(301, 13)), (8, "  ... "), (9, "a a a a a a a a a a a a a a a")]
    rows = odd_rows + [(40, words(310, 30) + " " + passage.upper().replace(" ", ", ") + "\n" + words(311, 10)), (41, "x " + short + " y " + short),
                       (42, " ".join(passage.split()[:12])), (43, words(312, 2000) + " " + " ".join(passage.split()[5:20])), (44, words(301, 13))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = bench_prefix.decontaminate(make(rows), bench).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()
    want = [(d, *plain_hits(t, items)) for d, t in rows]
    assert counted(got) == counted(want)
    out = bench_prefix.drop_contaminated(make(rows), bench)
    assert out.columns == make(rows).columns and out.count() == sum(not w[-1] for w in want)
    none = bench_prefix.decontaminate(make(rows), bench.limit(0))
    assert none.filter("n_hit > 0 OR contaminated").count() == 0 and none.count() == len(rows)


# --- empty tables -----------------------------------------------------------------

def test_empty_tables(spark, make):
    none = make([])
    assert quality_fences.rate(none).count() == 0 and quality_fences.keep_good(none).count() == 0
    assert line_winnow.find_repeats(none).count() == 0 and line_winnow.remove_repeats(none).count() == 0
    assert golay_simhash.near_duplicates(none).count() == 0 and golay_simhash.drop_copies(none).count() == 0
    bench = spark.createDataFrame([(1, "some words here")], "item_id bigint, text string")
    assert bench_prefix.decontaminate(none, bench).count() == 0
    assert bench_prefix.drop_contaminated(none, bench.filter(F.lit(False))).count() == 0
