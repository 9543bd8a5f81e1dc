import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dyadscope.operators import distributed_fit as dist
from dyadscope.operators import fit
from dyadscope.settings import AdamSettings


def sample(n=300, k=2, seed=1):
    rng = np.random.default_rng(seed)
    chosen, other = rng.normal(size=(n, k)), rng.normal(size=(n, k))
    beta = np.array([0.8, -0.5, 0.3][:k])
    flip = rng.random(n) > fit.sigmoid((chosen - other) @ beta)
    chosen[flip], other[flip] = other[flip].copy(), chosen[flip].copy()
    return chosen, other, np.array([f"c{i % 40:02d}" for i in range(n)])


def test_newton_reaches_a_zero_gradient():
    chosen, other, _ = sample()
    d = chosen - other
    beta, llf, ok = fit.newton(d, np.ones((len(d), 1)))
    grad = d.T @ (1 - fit.sigmoid(d @ beta[0]))
    assert ok[0] and np.abs(grad).max() < 1e-6
    assert llf[0] == pytest.approx(fit.log_sigmoid(d @ beta[0]).sum())


def test_weights_equal_repeated_rows():
    chosen, other, _ = sample(n=80)
    d = chosen - other
    w = np.random.default_rng(0).integers(0, 4, size=len(d))
    weighted, _, _ = fit.newton(d, w[:, None].astype(float))
    repeated, _, _ = fit.newton(np.repeat(d, w, axis=0), np.ones((w.sum(), 1)))
    assert weighted == pytest.approx(repeated, abs=1e-8)


def test_constant_control_keeps_zero():
    chosen, other, _ = sample(k=1)
    d = np.hstack([chosen - other, np.zeros((len(chosen), 1))])
    beta, _, ok = fit.newton(d, np.ones((len(d), 1)))
    assert ok[0] and beta[0, 1] == 0.0


def test_separated_sample_stays_finite():
    d = np.abs(np.random.default_rng(2).normal(size=(30, 1))) + 0.1
    beta, llf, ok = fit.newton(d, np.ones((30, 1)))
    assert ok[0] and np.isfinite(beta).all() and beta[0, 0] > 5 and llf[0] > -1e-2


def test_adam_agrees_in_sign_with_newton():
    chosen, other, _ = sample()
    d = chosen - other
    a, _, ok = fit.adam(d, np.ones((len(d), 1)), AdamSettings())
    b, _, _ = fit.newton(d, np.ones((len(d), 1)))
    assert ok[0] and np.sign(a[0]).tolist() == np.sign(b[0]).tolist()
    assert a[0] == pytest.approx(b[0], abs=0.05)


def test_bootstrap_draws_follow_the_generator():
    """Multiplicities are those of drawing the sorted cluster ids with the same generator."""
    ids = np.array(sorted(f"c{i}" for i in range(7)))
    codes = np.arange(7)
    w = fit.draw_multiplicities(codes, 7, 3, np.random.default_rng(99))
    rng = np.random.default_rng(99)
    for b in range(3):
        drawn = rng.choice(ids, size=7, replace=True)
        assert [int((drawn == c).sum()) for c in ids] == w[:, b].astype(int).tolist()


def test_sample_fit_counts_replicates_and_clusters():
    chosen, other, clusters = sample(n=240)
    out = fit.fit_sample(chosen, other, clusters, [(5, 11), (6, 12)], 25, "none", AdamSettings())
    assert [r["fit_id"] for r in out] == [5, 6]
    assert len(out[0]["boot_betas"]) == 25 and out[0]["boot_attempted"] == 25
    assert out[0]["beta"] > 0 and out[0]["beta"] == out[1]["beta"] and out[0]["boot_betas"] != out[1]["boot_betas"]


def test_rank_and_unknown_mode():
    chosen, other, clusters = sample(n=60, k=1)
    doubled = fit.fit_sample(np.hstack([chosen, 2 * chosen]), np.hstack([other, 2 * other]), clusters, [(1, 1)], 5, "none", AdamSettings())
    assert doubled[0]["design_rank"] == 1 and doubled[0]["beta"] is None
    wrong = fit.fit_sample(chosen, other, clusters, [(1, 1)], 5, "sgd", AdamSettings())
    assert wrong[0]["fit_error"] == "fit_failed:unsupported_optimizer_mode:sgd"


def test_poisson_weights_have_the_right_law():
    h = np.arange(200_000, dtype=np.int64) * 2654435761
    w = fit.poisson_weights(h, 7, np.array([0, 1]))
    assert w.mean() == pytest.approx(1.0, abs=0.02) and w.var() == pytest.approx(1.0, abs=0.03)
    assert abs(np.corrcoef(w.T)[0, 1]) < 0.01
    assert (fit.poisson_weights(h[:10], 7, np.array([1])) == w[:10, [1]]).all()


def event_sample(spark, chosen, other, clusters, mixed=True):
    """Events whose chosen row sits in the high or the low slot, beside events no design may use."""
    rows = []
    for i, (c, o, b) in enumerate(zip(chosen, other, clusters)):
        up = not mixed or i % 2 == 0
        hi, lo = (c, o) if up else (o, c)
        rows.append(("t", "discovery", 2, b, ([float(not up)], lo.tolist(), 0.0), ([float(up)], hi.tolist(), 0.0)))
    k = chosen.shape[1]
    rows.append(("t", "discovery", 2, "cx", ([0.0], [None] * k, 0.0), ([1.0], [1.0] * k, 0.0)))  # null regressor
    rows.append(("t", "discovery", 2, "cx", ([1.0], [2.0] * k, 0.0), ([1.0], [1.0] * k, 0.0)))  # two chosen
    rows.append(("t", "discovery", 2, "cx", ([0.0], [1.0] * k, 0.0), ([1.0], [1.0] * k, 0.0)))  # key does not vary
    side = "struct<ys array<double>, xs array<double>, place double>"
    events = spark.createDataFrame(rows, f"track string, split_role string, n int, boot string, lo {side}, hi {side}").repartition(3)
    return dist.Sample(dist.fit_rows(events, None, ("track", "split_role")), {("t", "discovery"): [(0, 0, list(range(k)))]})


@pytest.mark.parametrize("mode", ["none", "adam_lite"])
def test_distributed_fit_matches_the_grouped_fit(spark, mode):
    from dyadscope.session import ship_package

    ship_package(spark)
    chosen, other, clusters = sample(n=600)
    clusters = np.array([f"c{i % 200}" for i in range(600)])
    opts = AdamSettings(max_iter=40, min_iter=40)
    here = fit.fit_sample(chosen, other, clusters, [(1, 3)], 60, mode, opts)[0]
    there = dist.distributed_fit(event_sample(spark, chosen, other, clusters), {("t", "discovery", 0): [(1, 3)]}, 60, mode, opts).first()
    assert there["beta"] == pytest.approx(here["beta"], abs=1e-6)
    assert there["llf"] == pytest.approx(here["llf"], abs=1e-6)
    assert len(there["boot_betas"]) == 60
    assert there["boot_betas"] == pytest.approx(here["boot_betas"], abs=1e-6)


def test_cluster_hashes_are_sparks(spark):
    ids = ["a", "", None, "cluster é", "a"]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "c string").select(fit.cluster_hash(F.col("c"))).collect()]
    assert fit.cluster_hashes(np.array(ids, dtype=object)).tolist() == want


def test_distributed_rank(spark):
    from dyadscope.session import ship_package

    ship_package(spark)
    chosen, other, clusters = sample(n=60, k=1)
    twice = event_sample(spark, np.hstack([chosen, 3 * chosen]), np.hstack([other, 3 * other]), clusters)
    out = dist.distributed_fit(twice, {("t", "discovery", 0): [(1, 3)]}, 5, "none", AdamSettings()).collect()
    assert out[0]["design_rank"] == 1 and out[0]["beta"] is None


def test_many_designs_and_slots_go_on_as_a_table(spark):
    """200 designs of 500 slots: the state is never at the driver, and every replicate equals the grouped fit's."""
    from dyadscope.session import ship_package

    ship_package(spark)
    chosen, other, clusters = sample(n=60, k=1)
    one = event_sample(spark, chosen, other, clusters)
    designs = [(i, 0, [0]) for i in range(200)]
    many = dist.Sample(one.rows, {("t", "discovery"): designs})
    rows = dist.distributed_fit(many, {("t", "discovery", i): [(i, 3 + i % 2)] for i in range(200)}, 499, "none", AdamSettings()).collect()
    assert len(rows) == 200 and {r["boot_attempted"] for r in rows} == {499}
    for seed in (3, 4):
        here = fit.fit_sample(chosen, other, clusters, [(1, seed)], 499, "none", AdamSettings())[0]
        for r in (r for r in rows if 3 + r["fit_id"] % 2 == seed):
            near = dict(zip(here["boot_reps"], here["boot_betas"], strict=True))
            assert r["beta"] == pytest.approx(here["beta"], abs=1e-8)
            # A replicate that the regressor separates ends where its iterations end.
            assert all(b == pytest.approx(near[i], abs=1e-5) for i, b in zip(r["boot_reps"], r["boot_betas"], strict=True) if abs(b) < 8)


def test_settled_slots_leave_the_state(spark):
    from dyadscope.session import ship_package

    ship_package(spark)
    chosen, other, clusters = sample(n=200)
    one = event_sample(spark, chosen, other, clusters)
    tasks = {("t", "discovery", 0): [fit.Task(1, 3)]}
    state = dist.initial_state(one, tasks, {("t", "discovery", 0): np.ones(2)}, 20)
    last = dist.iterate(one, state)
    assert state.count() == last.count() == 21 and last.select("slot").distinct().count() == 21 and last.where("active").count() == 0
    known = dist.initial_state(one, {("t", "discovery", 0): [fit.Task(1, 3, 15, True)]}, {("t", "discovery", 0): np.ones(2)}, 20)
    assert sorted(r["rep"] for r in known.collect()) == [15, 16, 17, 18, 19]


@pytest.mark.parametrize("hashed", [True, False])
def test_grouped_fit_costs_a_samples_numbers_only(hashed):
    """The task takes Arrow columns as they are: no object for an event, and the values of the plain fit."""
    chosen, other, clusters = sample(n=40_000)
    at = np.random.default_rng(3).permutation(len(chosen))
    ids = np.array([f"e{i:06d}" for i in range(len(chosen))], dtype=object)
    boot = fit.cluster_hashes(clusters) if hashed else clusters.astype(object)
    lists = pa.list_(pa.float64())
    rows = pa.table({
        "track": ["t"] * len(at), "split_role": ["discovery"] * len(at), "design_id": pa.array([7] * len(at), pa.int32()), "event_id": ids[at], "boot": boot[at],
        "chosen": pa.array(list(chosen[at]), lists), "other": pa.array(list(other[at]), lists)})
    tasks = pa.table({"fit_id": pa.array([5], pa.int32()), "seed": [11], "start": pa.array([0], pa.int32()), "known": [False]})
    run = fit.grouped_fit(3, "none", AdamSettings())
    tracemalloc.start()
    out = run(rows, tasks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = fit.fit_sample(chosen, other, clusters, [(5, 11)], 3, "none", AdamSettings())[0]
    got = out.to_pylist()[0]
    assert {k: got[k] for k in want} == want and (got["track"], got["split_role"], got["design_id"]) == ("t", "discovery", 7)
    if hashed:
        assert peak < 400 * len(at)


def test_batches_of_passes_are_arrow_columns():
    """A pass takes Arrow batches as they come; a null regressor leaves the designs that need it only."""
    batch = pa.RecordBatch.from_pydict({
        "track": ["t", "t", "u"], "split_role": ["d", "d", "d"], "only": [-1, -1, -1], "cluster_hash": [1, 2, 3], "lo_ys": [[1.0], [0.0], [1.0]], "hi_ys": [[0.0], [1.0], [0.0]],
        "lo_xs": [[1.0, None], [2.0, 5.0], [0.0, 0.0]], "hi_xs": [[3.0, 4.0], [1.0, 6.0], [1.0, 1.0]], "lo_place": [0.0, 0.0, 0.0], "hi_place": [0.0, 0.0, 0.0]})
    found = {key: (pairs.chosen.tolist(), pairs.other.tolist(), pairs.cluster_hash.tolist()) for key, pairs in dist.batch_pairs(batch, {("t", "d"): [(0, 0, [0]), (1, 0, [0, 1])]}, True)}
    assert found == {("t", "d", 0): ([[1.0], [1.0]], [[3.0], [2.0]], [1, 2]), ("t", "d", 1): ([[1.0, 6.0]], [[2.0, 5.0]], [2])}
