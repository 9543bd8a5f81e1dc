import math
import random

import numpy as np

from dyadscope.llm import topk


def _brute(rows, k):
    sound = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sound:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in sound if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def _got(spark, rows, k=10, **options):
    vectors = topk.integer_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, score int"))
    return sorted(map(tuple, topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, k, **options).collect()))


def test_equals_brute_force_with_ties_signs_and_copies(spark):
    rng = random.Random(2)
    rows = [(i, [round(rng.uniform(-1, 1) * 4) / 4 for _ in range(6)]) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(40)] + [(1000, [0.0] * 6), (1001, [1.0, 2.0]), (1100, []), (5, rows[5][1])]
    rows += [(1200, None), (1201, [1.0, None, 0.0]), (1300, [float("nan")] * 6), (1301, [float("inf"), 0.0]), (None, [9.0] * 6)]
    want = _brute(rows, 10)
    assert _got(spark, rows) == want
    assert _got(spark, rows, pass_queries=3) == want


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.25]), (100, [-1.0, 0.0])]
    assert _got(spark, rows) == _brute(rows, 10) and _got(spark, rows[1:2]) == [] and _got(spark, []) == []


def test_the_threshold_stops_early(spark):
    rng = np.random.default_rng(1)
    vectors = np.rint(rng.normal(0, 10, (20_000, 3))).astype(np.int64)
    vectors[:20, 0] = 5000
    ids, best = np.arange(20_000), topk.Best(10)
    orders = np.argsort(vectors, axis=0).T
    scored = topk.search_block(-1, np.array([100, 1, -1]), ids, vectors, orders, best)
    assert scored < 2000
    order = np.lexsort((ids, -(vectors @ np.array([100, 1, -1]))))[:10]
    assert list(best.ids) == list(order)


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**9, 3.0]), (2, [2.0**9, 3.5]), (3, [-(2.0**9), 0.0])]
    top = (1 << 63) - 1
    assert _got(spark, rows) == [(q, r, j, max(-top - 1, min(top, s))) for q, r, j, s in _brute(rows, 10)]
