import numpy as np
import pytest

from dyadscope.operators import distributed_fit as dist
from dyadscope.operators import fit, folding
from dyadscope.settings import AdamSettings
from tests.test_fit import event_sample, sample


def test_points_have_the_sums_of_their_events():
    rng = np.random.default_rng(5)
    d, w = rng.normal(size=3000) * 1.5, rng.integers(0, 4, size=(3000, 3)).astype(float)
    into = np.zeros((3, folding.cells(np.abs(d).max()) * folding.NODES))
    for rows in np.array_split(np.arange(3000), 4):
        folding.fold(into, d[rows], lambda at, part, rows=rows: w[rows[at]][:, part])
    x = folding.points(into.shape[1] // folding.NODES)
    for beta in (-folding.BETA, -0.3, 0.0, 2.0, folding.BETA):
        for f in (lambda z: fit.log_sigmoid(z * beta), lambda z: z * fit.sigmoid(-z * beta)):
            assert into @ f(x) == pytest.approx(w.T @ f(d), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("mode", ["none", "adam_lite"])
def test_one_regressor_needs_no_pass_a_step(spark, monkeypatch, mode):
    from dyadscope.session import ship_package

    ship_package(spark)
    chosen, other, _ = sample(n=16_000, k=1)
    clusters = np.array([f"c{i % 900}" for i in range(len(chosen))])

    def passes(*_):
        raise AssertionError("events were read again for every step")

    monkeypatch.setattr(dist, "slot_sums", passes)
    opts = AdamSettings(max_iter=60, min_iter=10)
    here = fit.fit_sample(chosen, other, clusters, [(1, 3), (2, 4)], 20, mode, opts)
    there = dist.distributed_fit(event_sample(spark, chosen, other, clusters), {("t", "discovery", 0): [(1, 3), (2, 4)]}, 20, mode, opts).orderBy("fit_id").collect()
    for a, b in zip(here, there, strict=True):
        assert b["beta"] == pytest.approx(a["beta"], abs=1e-10) and b["llf"] == pytest.approx(a["llf"], rel=1e-12)
        assert b["boot_reps"] == a["boot_reps"] and b["boot_betas"] == pytest.approx(a["boot_betas"], abs=1e-10)


def test_coefficients_out_of_reach_are_summed_by_event(spark):
    """A separated sample ends beyond the bound: folding hands all of its slots on."""
    from dyadscope.session import ship_package

    ship_package(spark)
    chosen = np.random.default_rng(2).uniform(0.1, 1.1, size=(16_000, 1))
    one = event_sample(spark, chosen, np.zeros_like(chosen), np.array([f"c{i % 900}" for i in range(len(chosen))]))
    key = ("t", "discovery", 0)
    moments, tasks = dist.sample_moments(one), {key: [fit.Task(1, 3)]}
    state = dist.initial_state(one, tasks, {key: moments[key].scale}, 5)
    settled, rest = dist.folded_fits(one, state, moments, tasks, 5, "none", AdamSettings())
    assert settled.count() == 0 and rest.count() == 6 and rest.where("active").count() == 6


def test_slots_of_a_pass_are_bounded():
    key, wide = ("t", "discovery", 0), ("t", "discovery", 1)
    own = dist.Moments(10**7, np.zeros(1), np.ones(1), 1, np.array([4.0]))
    far = dist.Moments(10**7, np.zeros(1), np.ones(1), 1, np.array([400.0]))
    turns = dist._folded_turns({key: own, wide: far}, {key: [fit.Task(i, i) for i in range(40)], wide: [fit.Task(9, 9)]}, 499)
    n = 8 * folding.cells(4.0) * folding.NODES
    assert all(wide not in t and n * (t[key][1] - t[key][0]) <= dist.FOLD_BYTES for t in turns)
    assert [t[key][0] for t in turns][1:] == [t[key][1] for t in turns][:-1] and turns[-1][key][1] == 1 + 40 * 499


def test_points_are_added_up_as_they_come():
    """Rows of many folding tasks: what is held is a row for each slot, and the fits are those of the sums."""
    import tracemalloc

    import pandas as pd

    n_points, n_slots, n_tasks = folding.cells(4.0) * folding.NODES, 4, 400
    rng = np.random.default_rng(1)
    total = np.zeros((n_slots, n_points))

    def batches():
        for _ in range(n_tasks):
            own = rng.uniform(0, 1, size=(n_slots, n_points))
            total[:] += own
            yield pd.DataFrame({"track": "t", "split_role": "discovery", "design_id": 0, "slot": np.arange(n_slots), "part": 0, "sums": list(own)})

    run = dist._point_fits("none", AdamSettings())
    tracemalloc.start()
    found = pd.concat(run(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    beta, _, _ = fit.newton(folding.points(n_points // folding.NODES)[:, None], total.T)
    assert found["f_beta"].to_numpy() == pytest.approx(beta[:, 0], abs=1e-10) and found["slot"].tolist() == list(range(n_slots))
    assert peak < n_tasks * n_slots * n_points * 8 / 4


def test_moments_are_found_once_for_the_same_rows(spark, monkeypatch):
    from dyadscope.session import ship_package

    ship_package(spark)
    chosen, other, _ = sample(n=400, k=2)
    one, seen = event_sample(spark, chosen, other, np.array([f"c{i % 40}" for i in range(400)])), {}
    found = dist.sample_moments(one, seen)[("t", "discovery", 0)]
    x = np.vstack([chosen, other])
    assert found.n_events == 400 and found.scale == pytest.approx(x.std(axis=0)) and found.reach == pytest.approx(np.abs(chosen - other).max(axis=0) / found.scale)
    monkeypatch.setattr(dist, "_moments", lambda *_: pytest.fail("read again"))
    assert dist.sample_moments(one, seen)[("t", "discovery", 0)] is found
