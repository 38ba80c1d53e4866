"""The pipeline over a whole small table, every stage against plain Python on its own input."""

import collections
import os
import sys

import numpy as np
from test_filters import LETTERS, SOLID, lower, plain_components, plain_hits, plain_measures, plain_print
from test_scoring import plain_targets

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402

from emberlog.llm import cube_mix  # noqa: E402
from emberlog.llm.rows import read, stored  # noqa: E402

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def bucket(v):
    shift = max(0, max(1, int(v).bit_length()) - 7)
    return v >> shift << shift


def plain_quality(rows, least_rows=200, reach=3):
    """doc_ids kept: quartiles of bucketed ratios by language and source, else language, else all."""
    measured = []
    for r in rows:
        n, chars, symbols, dups, repeats = plain_measures(r["text"])
        own, lines = SOLID.findall(r["text"] or ""), sum(bool(SOLID.search(x)) for x in (r["text"] or "").split("\n"))
        echoes = sum(a == b for a, b in zip(own, own[1:], strict=False))
        ratios = [100 * chars // n if n else 0, 10_000 * symbols // chars if chars else 0, 1000 * dups // lines if lines else 0,
                  1000 * repeats // n if n else 0, 1000 * echoes // n if n else 0]
        measured.append((r, n < 20 or 100 * repeats > 30 * n, ratios))
    kept = set()
    for r, failed, ratios in measured:
        if failed:
            continue
        for group in (("lang", "source"), ("lang",), ()):
            like = [m[2] for m in measured if not m[1] and all(m[0][g] == r[g] for g in group)]
            if len(like) >= least_rows:
                break
        good = True
        for k, (least, both) in enumerate(((100, True), (200, False), (200, False), (100, False), (100, False))):
            values = sorted(bucket(x[k]) for x in like)
            q1, q3 = (values[-(-len(values) * q // 4) - 1] for q in (1, 3))
            span = reach * max(q3 - q1, least)
            good &= ratios[k] <= q3 + span and not (both and ratios[k] < q1 - span)
        if good:
            kept.add(r["doc_id"])
    return kept


def test_stages(spark):
    docs, kept = read(spark, SMALL, "documents"), {}
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
        kept[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == COLUMNS
    ids = {name: {r["doc_id"] for r in found} for name, found in kept.items()}
    assert ids["quality_rules"] == plain_quality(rows)
    # line dedup: what is left of each text is its words in order, and the first copies of everything stay
    before = {r["doc_id"]: SOLID.findall(lower(r["text"])) for r in kept["quality_rules"]}
    after = {r["doc_id"]: SOLID.findall(lower(r["text"])) for r in kept["line_dedup"]}
    lines, runs = set(), set()
    for i in sorted(before):
        own = before[i]
        left = iter(own)
        assert all(any(w == x for x in left) for w in after.get(i, []))
        new = [j for j in range(len(own) - 25) if tuple(own[j:j + 26]) not in lines]
        if len(new) == max(0, len(own) - 25):
            assert after[i] == own  # nothing in it was seen before
        repeated = any(tuple(own[j:j + 50]) in runs for j in range(len(own) - 49))
        assert not repeated or len(after.get(i, [])) < len(own)
        lines.update(tuple(own[j:j + 26]) for j in range(len(own) - 25))
        runs.update(tuple(own[j:j + 50]) for j in range(len(own) - 49))
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"])
    prints = [plain_print(r["text"]) for r in kept["line_dedup"]]
    group = plain_components(prints)
    first = collections.defaultdict(list)
    for r, g in zip(kept["line_dedup"], group, strict=True):
        first[g].append(r["doc_id"])
    assert ids["near_duplicates"] == {min(g) for g in first.values()}
    items = [tuple(r) for r in read(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    assert ids["decontamination"] == {r["doc_id"] for r in kept["near_duplicates"] if not plain_hits(r["text"], items)[-1]}
    sizes, taken, copies = collections.Counter(), collections.Counter(), collections.Counter()
    size = {r["doc_id"]: len(SOLID.findall(r["text"])) for r in kept["decontamination"]}
    for r in kept["decontamination"]:
        sizes[r["source"]] += size[r["doc_id"]]
    for r in kept["mixing"]:
        taken[r["source"]] += size[r["doc_id"]]
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 3
    for source, goal in plain_targets(sizes).items():
        assert abs(taken[source] - goal) <= max(size[r["doc_id"]] for r in kept["decontamination"] if r["source"] == source)
    whole = entry.queries()["pipeline"](spark, SMALL)
    assert collections.Counter(r["doc_id"] for r in whole.collect()) == copies
    assert np.all([LETTERS.findall(lower(r["text"])) != [] for r in kept["mixing"]])


def test_the_copy_column_stands_beside_one_of_that_name(spark, make):
    taken = stored(cube_mix.take(make([(i, "a few words of text", "en", f"s{i % 3}") for i in range(60)])), "taken")
    assert taken.columns[-1] == "copy_" and taken.agg({"copy_": "min"}).first()[0] == 1


def test_all_queries_are_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None
