"""Exact top-k search against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import voronoi_topk

DDL = "vec_id bigint, embedding array<float>, label int, cell string, v string, rank int, score int, asks int, unit int"
EXTRA = (None,) * 7


def plain(rows, every=50, k=5):
    held = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(float(np.float32(x))) for x in v)]
    out = []
    for n, (i, q) in enumerate(held):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(held) if m != n and len(v) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def got(spark, rows, every=50, **how):
    frame = spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], DDL).repartition(3)
    return sorted(tuple(r) for r in voronoi_topk.top_k(frame, F.col("vec_id") % every == 0, **how).collect())


def cloud(seed, n, dim, first=0, copies=0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    made = [(first + i, [x + draw.gauss(0, 0.05) for x in draw.choice(centres)]) for i in range(n)]
    return made + [(first + n + i, made[0][1]) for i in range(copies)]


ODD = [*cloud(1, 300, 8, copies=60), (1000, None), (1001, []), (1050, []), (1002, [0.1] * 7 + [None]), (1003, [0.1] * 7 + [float("nan")]), (1004, [0.1] * 7 + [float("inf")]),
       (None, [0.5] * 8), (50, [0.5] * 8), (50, [0.5] * 8), (7, [0.5] * 8), (1100, [0.0] * 8), (1150, [1.0, 2.0]), (1151, [3.0, -1.0]), (-50, [-0.3] * 8), (1200, [3.0])]


@pytest.mark.parametrize("how", [{}, {"pivots": 7, "sample": 40, "block": 2, "slice_rows": 30}, {"pivots": 1, "k": 3}, {"pivots": 64, "block": 1, "slice_rows": 10, "every": 5}])
def test_agrees_with_all_products(spark, how):
    assert got(spark, ODD, **how) == plain(ODD, **{x: how[x] for x in ("k", "every") if x in how})


def test_bounds_leave_out_most_vectors_of_far_groups(spark):
    rows = cloud(3, 600, 16)
    frame = spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], DDL)
    seen = []
    plan_of, solve = voronoi_topk.Plan.goes_to, voronoi_topk.solve
    try:
        voronoi_topk.solve = lambda dealt, k: (seen.append(dealt.filter("kind = 1").count()), solve(dealt, k))[1]
        assert sorted(tuple(r) for r in voronoi_topk.top_k(frame, F.col("vec_id") % 50 == 0, block=1, slice_rows=50).collect()) == plain(rows)
    finally:
        voronoi_topk.solve = solve
    assert plan_of and seen[0] < 0.5 * 600 * 12


def test_large_components_are_exact(spark):
    rows = [(0, [3e10, -1e9]), (1, [2e10, 5.0]), (2, [2e10, 5.5]), (3, [-1.0, 1e10]), (50, [1e38, 1.0]), (51, [1e38, 1.0])]
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    held = {i: [clip(math.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows}
    want = sorted((q, rank, j, -s) for q in (0, 50) for rank, (s, j) in enumerate(sorted((-clip(sum(a * b for a, b in zip(held[q], v))), j) for j, v in held.items() if j != q)[:5], 1))
    assert got(spark, rows) == want


def test_empty_tables_and_no_queries(spark):
    assert got(spark, []) == [] and got(spark, [(1, [0.5])]) == [] and got(spark, [(0, [0.5])]) == []
