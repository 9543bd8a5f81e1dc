import random

import numpy as np
import pytest

from dyadscope.operators.selection import quantiles

PROBS = [0.0, 0.025, 0.5, 0.975, 1.0]


def _check(spark, rows, **options):
    df = spark.createDataFrame(rows, "k string, v double, u double").repartition(5).cache()
    got = {r["k"]: (r["v_q"], r["u_q"]) for r in quantiles(df, ["k"], {"v": PROBS, "u": [0.5]}, **options).collect()}
    df.unpersist()
    keys = {r[0] for r in rows}
    assert set(got) == keys
    for k in keys:
        v, u = ([r[c] for r in rows if r[0] == k and r[c] is not None] for c in (1, 2))
        if v:
            assert got[k][0] == pytest.approx(np.quantile(v, PROBS).tolist(), rel=1e-12, abs=1e-12)
        else:
            assert got[k][0] is None or got[k][0] == [None] * len(PROBS)
        if u:
            assert got[k][1] == pytest.approx([float(np.median(u))])


def test_one_key_with_all_rows_and_all_values_distinct(spark):
    rng = random.Random(1)
    _check(spark, [("hot", rng.gauss(0, 1) * 10 ** rng.randint(-3, 3), float(i)) for i in range(6000)], limit=40, grid=8)


def test_many_keys_ties_nulls_and_null_keys(spark):
    rng = random.Random(2)
    rows = [(f"k{i % 7}", float(rng.choice([1, 1, 1, 2, 3, 50])), rng.random()) for i in range(1500)]
    rows += [("one", 3.5, None), ("none", None, None), ("equal", None, 1.0)] + [("equal", 2.0, None)] * 300 + [(None, rng.random(), 2.0) for _ in range(200)]
    for limit in (1, 25, 10**6):
        _check(spark, rows, limit=limit, grid=4)


def test_rounds_do_not_depend_on_the_spread_of_values(spark):
    rows = [("a", 1e300, None), ("a", -1e300, None)] + [("a", 1.0 + i * 1e-15, None) for i in range(500)]
    _check(spark, rows, limit=3, grid=4)


def test_weights_count_like_repeated_rows(spark):
    rng = random.Random(3)
    rows = [(f"k{i % 3}", rng.choice([1.0, 2.0, 5.5, 9.0, 9.5]) + rng.randrange(3), rng.randrange(4)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, n int").cache()
    for limit in (5, 10**6):
        got = {r["k"]: r["v_q"] for r in quantiles(df, ["k"], {"v": PROBS}, weight="n", limit=limit, grid=4).collect()}
        for k in got:
            assert got[k] == pytest.approx(np.quantile([v for key, v, n in rows if key == k for _ in range(n)], PROBS).tolist())
    df.unpersist()


def test_few_values_with_large_counts_are_a_plain_percentile(spark, monkeypatch):
    """What a percentile holds is bounded by different values: weights alone need no refinement."""
    from dyadscope.operators import selection

    def refined(*_):
        raise AssertionError("refined, though a key has few values")

    monkeypatch.setattr(selection, "_large", refined)
    df = spark.createDataFrame([("k", 1.0, 500), ("k", 2.0, 499), ("k", 4.0, 1)], "k string, v double, n bigint")
    found = selection.quantiles(df, ["k"], {"v": [0.5, 1.0]}, weight="n", limit=100).first()
    assert list(found["v_q"]) == [1.5, 4.0]
