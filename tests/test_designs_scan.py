import itertools

import numpy as np
import pytest

from dyadscope.operators import candidates as cand
from dyadscope.operators.designs import Design, DesignSet, design_bits, design_counts, design_pairs, design_stats, event_table, gate_stats, row_table
from dyadscope.plans import passes
from dyadscope.plans.scan import plan_candidates, run_scan
from dyadscope.settings import AdamSettings, Need, ScanSettings, resolve_base_controls, resolve_stage_gates

SCHEMA = "track string, split_role string, event_id string, pair_id string, policy_document_id string, y int, a double, b double"


def brute_force(rows, exog, vary=True):
    """(track, role, event) -> difference of the chosen and the other row, by direct reading of the rules."""
    at = {"a": 6, "b": 7}
    out = {}
    for key, group in itertools.groupby(sorted(rows, key=lambda r: r[:3]), key=lambda r: r[:3]):
        usable = [r for r in group if all(r[at[x]] is not None for x in exog)]
        if len(usable) == 2 and usable[0][5] + usable[1][5] == 1:
            pos, neg = sorted(usable, key=lambda r: -r[5])
            if not vary or pos[at[exog[0]]] != neg[at[exog[0]]]:
                out[key] = [pos[at[x]] - neg[at[x]] for x in exog]
    return out


def random_rows(seed=0, n_events=120):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(n_events):
        size = int(rng.integers(1, 6)) if e else 40  # the first event is far larger than the others
        for _ in range(size):
            a, b = (None if rng.random() < 0.35 else float(rng.integers(0, 3)) for _ in range(2))
            rows.append((f"t{e % 2}", ("discovery", "validation")[e % 3 == 0], f"e{e}", f"p{e}", f"d{e % 20}", int(rng.random() < 0.5), a, b))
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_null_rows_are_dropped_before_the_two_row_test(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    designs = DesignSet((Design(0, "y", ("a",)), Design(1, "y", ("b", "a")), Design(2, "y", ("b",))))
    table = row_table(df, designs)
    long = design_pairs(table, event_table(table, designs), designs)
    got = {}
    for r in long.collect():
        got[(r.design_id, r.track, r.split_role, r.event_id)] = [c - o for c, o in zip(r.chosen, r.other)]
    want = {}
    for d in designs.designs:
        want.update({(d.design_id, *k): v for k, v in brute_force(rows, d.exog).items()})
    assert want and got == want
    assert any(len([r for r in rows if r[2] == k[3]]) > 2 for k in got)
    stats = {(r.design_id, r.track, r.split_role): r.n_informative for r in design_stats(long).collect()}
    for key, n in stats.items():
        assert n == sum(k[:3] == key for k in want)


def test_gates_from_bitmaps_equal_gates_from_pairs(spark):
    """Counts of 130 designs, over three words, with events that only nulls make usable; no row for an event and a design."""
    rows = random_rows(5, n_events=150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    regressors = (("a",), ("b",), ("a", "b"), ("b", "a"))
    designs = DesignSet(tuple(Design(i, "y", regressors[i % 4]) for i in range(130)))
    table = row_table(df, designs)
    events = event_table(table, designs)
    want = {r[:3]: r[3:] for r in map(tuple, design_stats(design_pairs(table, events, designs)).collect())}
    got = gate_stats(table, events, designs).select("track", "split_role", "design_id", "n_informative", "n_docs", "top1_share")
    assert {r[:3]: r[3:] for r in map(tuple, got.collect())} == want and len({k[2] for k in want}) == 130


def choice_frame(spark, n_events=90, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(n_events):
        role = "validation" if e % 3 == 0 else "discovery"
        x = rng.normal(size=2)
        first = rng.random() < 1 / (1 + np.exp(-1.5 * (x[0] - x[1])))
        z = rng.normal(size=2)
        for i in range(2):
            rows.append(("primary_strict", "s", role, f"e{e}", f"p{e}", f"d{e % 30 if role == 'discovery' else 100 + e % 30}", int((i == 0) == first), int((i == 0) == first), float(x[i]), float(z[i]), float(z[i])))
    return spark.createDataFrame(
        rows,
        "track string, split_id string, split_role string, event_id string, pair_id string, policy_document_id string, y_all int, y_evidence int, x_feat double, anchor double, copy double",
    )


def small(**changes):
    base = dict(
        replicates=25, discovery=Need(5, 3), validation=Need(5, 3), use_base=False,
        spec_mode="key_only",
    )
    return ScanSettings.of(**{**base, **changes})


def test_scan_validates_a_real_effect(spark):
    result = run_scan(choice_frame(spark), ["x_feat", "anchor"], small(replicates=99, contexts=(("all_contexts", "y_all"),)))
    top = {r.key_factor: r for r in result.top.collect()}
    assert top["x_feat"].candidate_tier == "validated_candidate" and top["x_feat"].beta_validation > 0
    assert top["anchor"].candidate_tier == "support_candidate"
    scan = result.scan.collect()
    assert len(scan) == 4 and sorted(r.candidate_eval_order for r in scan) == [1, 2, 3, 4]
    assert all(r.candidate_eval_order <= 2 for r in scan if r.split_role == "discovery")
    assert all(r.q_value is None for r in scan if r.split_role == "discovery")


def test_contexts_are_checked_and_logged(spark):
    settings = small(contexts=(("all_contexts", "y_all"), ("gone", "y_none"), ("all_contexts", "y_all"), ("", "y_all")))
    log = run_scan(choice_frame(spark), ["x_feat"], settings).log
    skips = {r.reason_code for r in log.where("status = 'skipped_context'").collect()}
    assert skips == {"missing_context_y_column", "duplicate_context_definition", "invalid_context_definition"}
    assert log.where("status = 'search_governance_contract'").count() == 2
    with pytest.raises(ValueError, match="no valid contexts"):
        run_scan(choice_frame(spark), ["x_feat"], small(contexts=(("gone", "y_none"),)))


def test_gates_differ_by_outcome_and_split(spark):
    settings = small(contexts=(("all", "y_all"), ("evidence", "y_evidence")), validation_by_outcome={"y_evidence": Need(1000, 3)})
    rows = {(r.y_col, r.split_role): r for r in run_scan(choice_frame(spark), ["x_feat"], settings).scan.collect()}
    assert rows[("y_all", "validation")].status == "ok"
    blocked = rows[("y_evidence", "validation")]
    assert blocked.status == "not_validated_out_of_sample" and blocked.reason_code == "validation_low_informative_events"
    assert blocked.reason_detail == "30 < 1000" and blocked.beta is None
    assert rows[("y_evidence", "discovery")].status == "ok"


def test_leakage_settings_raise(spark):
    for bad in ({"validation_steers": True}, {"pool_locked": False}, {"spec_mode": "all"}):
        with pytest.raises(ValueError):
            run_scan(choice_frame(spark), ["x_feat"], small(**bad))


def test_anchored_spec_and_degenerate_design(spark):
    settings = small(contexts=(("all_contexts", "y_all"),), fixed=("anchor",))
    rows = run_scan(choice_frame(spark), ["x_feat", "copy"], settings).scan.where("split_role = 'discovery'").collect()
    by_key = {r.key_factor: r for r in rows}
    import re

    assert re.fullmatch(r"clogit_key_only__anchored_anchor_h[0-9a-f]{8}", by_key["x_feat"].spec_id)
    assert by_key["x_feat"].control_set == "x_feat+anchor" and by_key["x_feat"].status == "ok"
    assert by_key["copy"].status == "not_estimable_degenerate_design_matrix"
    with pytest.raises(ValueError, match="fixed regressors missing"):
        run_scan(choice_frame(spark), ["x_feat"], small(fixed=("nowhere",)))


def test_pool_size_is_the_product_minus_skips(spark):
    df = choice_frame(spark)
    settings = ScanSettings.of(contexts=(("all", "y_all"), ("ev", "y_evidence")), base=("anchor",)).checked()
    pool, skipped = plan_candidates(df, ["x_feat", "anchor"], settings)
    assert pool.count() == 1 * 2 * 2 * 2
    # anchor with the base control anchor is the key-only specification again, once per context
    assert pool.where("duplicate_of is not null").count() == 2 == skipped.where("status = 'skipped_equivalent_spec'").count()


@pytest.mark.parametrize("mode", ["none", "adam_lite", "sgd"])
def test_the_answer_does_not_depend_on_where_a_sample_is_fitted(spark, mode):
    df = choice_frame(spark)
    args = dict(contexts=(("all_contexts", "y_all"),), replicates=9, method=mode, adam=AdamSettings(max_iter=30, min_iter=10))
    names = ("status", "reason_code", "beta", "se_boot", "p_boot", "q_value", "candidate_tier", "bootstrap_success")
    near, far = (
        {(r.candidate_id, r.split_role): tuple(r[n] for n in names) for r in run_scan(df, ["x_feat", "anchor"], small(**args, one_task_events=m)).scan.collect()}
        for m in (100_000, 0)
    )
    assert near.keys() == far.keys() and {v[0] for v in near.values()} == ({"fit_failed"} if mode == "sgd" else {"ok"})
    for key, row in near.items():
        assert all(a == b if not isinstance(a, float) else a == pytest.approx(b, abs=1e-6) for a, b in zip(row, far[key])), (key, row, far[key])


def test_fixed_size_resampling_is_a_choice_and_refused_over_the_bound(spark):
    df = choice_frame(spark)
    args = dict(contexts=(("all_contexts", "y_all"),), replicates=9, law="fixed_size")
    assert {r.status for r in run_scan(df, ["x_feat"], small(**args)).scan.collect()} == {"ok"}
    with pytest.raises(ValueError, match="fixed_size"):
        run_scan(df, ["x_feat"], small(**args, one_task_events=0))
    with pytest.raises(ValueError, match="unsupported law"):
        run_scan(df, ["x_feat"], small(law="other"))


def test_restarts_share_fits_and_differ_in_draws(spark):
    result, rows, stability = passes.run_restarts(choice_frame(spark), ["x_feat"], small(contexts=(("all_contexts", "y_all"),), restarts=3))
    betas = {r.beta for r in result.scan.where("split_role = 'validation'").collect()}
    assert len(betas) == 1
    assert rows.first().n_restarts_present == 3 and stability.first().stability_score == pytest.approx(1.0)


def test_second_passes(spark):
    df = choice_frame(spark)
    settings = small(contexts=(("all_contexts", "y_all"),))
    top = run_scan(df, ["x_feat", "anchor"], settings).top
    again = passes.refine(df, top, settings, n_bootstrap=9, max_features=1)
    assert {r.key_factor for r in again.top.collect()} == {"x_feat"}
    assert passes.escalate(df, top, settings, p_margin=0.0, q_margin=0.0, max_candidates=8) is None


def test_gate_and_control_settings():
    plain, source = resolve_stage_gates(ScanSettings(), events=40, docs=15)
    assert (plain.gates.discovery, plain.gates.validation) == (Need(40, 15), Need(100, 30))
    assert source == "split_gate_with_legacy_estimable_override"
    synced, source = resolve_stage_gates(ScanSettings(), events=40, docs=15, sync_validation=True)
    assert synced.gates.validation == Need(40, 15) and source == "legacy_single_gate_synced"
    assert resolve_stage_gates(ScanSettings()) == (ScanSettings(), "split_gate_explicit")
    with pytest.raises(TypeError, match="no_such"):
        ScanSettings.of(no_such=1)
    assert resolve_base_controls(["pub_year_alt"], override="pub_year_alt, x,pub_year_alt") == (["pub_year_alt"], ["x"])
    with pytest.raises(ValueError):
        resolve_base_controls([], strict=True)
    assert cand.anchor_token(["b", "a"]).startswith("anchored_n2_h")


def test_large_path_handles_null_patterns(spark):
    """Samples with rows dropped by nulls give the same fits on both paths."""
    rows = random_rows(3, n_events=400)
    df = spark.createDataFrame(rows, SCHEMA)
    args = dict(contexts=(("all", "y"),), replicates=5, fixed=("b",), converged_share=0.0, largest_document_share=1.0)
    near = {(r.candidate_id, r.split_role): r for r in run_scan(df, ["a"], small(**args)).scan.collect()}
    far = run_scan(df, ["a"], small(**args, one_task_events=0)).scan.collect()
    assert any(r.status == "ok" for r in far)
    for r in far:
        other = near[(r.candidate_id, r.split_role)]
        assert r.status == other.status and r.n_single_choice_informative == other.n_single_choice_informative
        assert (r.beta is None and other.beta is None) or r.beta == pytest.approx(other.beta, abs=1e-6)


def _fits(result):
    return {(r.track, r.split_role, tuple(r.exog), r.seed): r for r in result.fits.collect()}


@pytest.mark.parametrize("limit", [0, 100_000])
def test_escalation_runs_only_the_new_replicates(spark, limit):
    """From 9 to 25 replicates 16 are run and no point fit; the result is that of a scan of 25."""
    df = choice_frame(spark)
    settings = small(replicates=9, contexts=(("all_contexts", "y_all"),), one_task_events=limit)
    first = run_scan(df, ["x_feat", "anchor"], settings)
    more = passes.refine(df, first.top, settings, n_bootstrap=25, first=first, max_features=2)
    fresh = _fits(run_scan(df, ["x_feat", "anchor"], small(contexts=(("all_contexts", "y_all"),), one_task_events=limit)))
    got = _fits(more)
    assert set(got) == set(fresh) and len(got) == 4
    assert all(r.new_attempted == 9 and r.point_fitted for r in _fits(first).values())
    for key, r in got.items():
        assert (r.new_attempted, r.point_fitted, r.boot_attempted) == (16, False, 25)
        assert [b.rep for b in r.boot] == [b.rep for b in fresh[key].boot]
        assert [b.beta for b in r.boot] == pytest.approx([b.beta for b in fresh[key].boot], abs=1e-7)
        assert (r.beta, r.llf) == pytest.approx((fresh[key].beta, fresh[key].llf), abs=1e-7)
    less = _fits(run_scan(df, ["x_feat"], small(replicates=4, contexts=(("all_contexts", "y_all"),), one_task_events=limit), prepared=first.prepared, prior=first.fits))
    assert all((r.new_attempted, r.boot_attempted, len(r.boot)) == (0, 4, 4) for r in less.values())


def test_a_ladder_shares_point_fits_and_replicates(spark, tmp_path):
    settings = small(run_id="night", contexts=(("all_contexts", "y_all"),))
    done = passes.run_ladder(choice_frame(spark), ["x_feat"], settings, seeds=[1, 2], ladder=[5, 9], attempts_path=str(tmp_path / "attempts"))
    ran = {r.job_key: (r.replicates_run, r.point_fits_run) for r in done.collect()}
    assert ran == {"s1_b5": (10, 2), "s2_b5": (10, 0), "s1_b9": (8, 0), "s2_b9": (8, 0)}


def test_failed_fits_are_not_tried_again(spark):
    """Regressors that are copies of each other stay degenerate in a second pass, without a new fit."""
    df = choice_frame(spark)
    settings = small(replicates=5, contexts=(("all_contexts", "y_all"),), fixed=("copy",))
    first = run_scan(df, ["anchor", "x_feat"], settings)
    again = run_scan(df, ["anchor", "x_feat"], small(replicates=9, contexts=(("all_contexts", "y_all"),), fixed=("copy",)), prepared=first.prepared, prior=first.fits)
    status = {(r.key_factor, r.split_role): r.status for r in again.scan.collect()}
    assert status["anchor", "discovery"] == "not_estimable_degenerate_design_matrix" and status["x_feat", "discovery"] == "ok"
    assert sum(r.new_attempted for r in _fits(again).values()) == 2 * 4


def test_ladder_resumes_and_refuses_other_grids(spark, tmp_path):
    df, path = choice_frame(spark), str(tmp_path / "attempts")
    settings = small(run_id="night", contexts=(("all_contexts", "y_all"),))
    args = dict(settings=settings, seeds=[1, 2], ladder=[9], attempts_path=path)
    assert {r.job_key for r in passes.run_ladder(df, ["x_feat"], **args).collect()} == {"s1_b9", "s2_b9"}
    assert passes.run_ladder(df, ["x_feat"], **args).count() == 2
    with pytest.raises(ValueError, match="resume mismatch"):
        passes.run_ladder(df, ["x_feat"], **{**args, "ladder": [9, 19]})


def test_pattern_table_stands_for_the_rows(spark):
    """Null patterns written once give the sparse pairs of the rows themselves, and hold only events that need them."""
    from dyadscope.operators import designs as d

    rows = [("t", "discovery", f"e{i}", f"d{i % 3}", int(j == i % 3), None if (i + j) % 3 == 0 else float(i * j), float(j)) for i in range(30) for j in range(2 + i % 3)]
    df = spark.createDataFrame(rows, "track string, split_role string, event_id string, policy_document_id string, y int, a double, b double")
    two = DesignSet((Design(0, "y", ("a",)), Design(1, "y", ("b", "a"))))
    table = row_table(df, two)
    events = event_table(table, two)
    patterns = d.pattern_table(table, two)
    keys = ("track", "split_role")
    own, other = (sorted(map(str, d.sparse_pairs(x, events, two, two.as_column(), keys).select("event_id", "design", "doc", "lo", "hi").collect())) for x in (table, patterns))
    assert own and own == other
    needed = {r[0] for r in events.where("n > 2 and n_full <= 2").select("event_id").collect()}
    assert {r[0] for r in patterns.select("event_id").collect()} == needed


def test_folding_choices_by_event_moves_nothing(spark):
    """The lines of an event meet in the last join of the view: its fold needs no exchange of its own."""
    from dyadscope.plans import workload as w

    one = DesignSet((Design(0, "y_all", ("l_quantity",)),))
    plan = event_table(row_table(w.choices(spark, "/root/testdata/sf0.001"), one), one)._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("SortMergeJoin")]
    assert "HashAggregate" in top and "Exchange" not in top


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """A fact table is dealt to more tasks as it grows; a small one stays with the session's number."""
    from dyadscope.plans import workload as w

    rows = spark.range(0, 4000, 1, 2)
    monkeypatch.setattr(w, "ROWS_PER_TASK", 100)
    assert w.spread(rows, 4000, "id").rdd.getNumPartitions() == 41
    monkeypatch.setattr(w, "ROWS_PER_TASK", 5000)
    assert w.spread(rows, 4000, "id").rdd.getNumPartitions() == 2


def test_counts_of_many_designs_stay_small_methods(spark):
    """The JVM compiles no method of 8,000 bytes or more: it would run step by step for every event."""
    features = [f"f{i}" for i in range(8)]
    schema = "track string, split_role string, event_id string, pair_id string, policy_document_id string, y int, " + ", ".join(f"{f} double" for f in features)
    rows = [("t", "discovery", f"e{e}", f"p{e}", f"d{e}", k, *[float(e * k + i) for i in range(8)]) for e in range(6) for k in range(2)]
    designs = DesignSet(tuple(Design(i, "y", tuple(x)) for i, x in enumerate([(f,) for f in features] + [(f, features[0]) for f in features[1:]])))
    table = row_table(spark.createDataFrame(rows, schema), designs)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = design_counts(design_bits(table, event_table(table, designs), designs, sparse=False), len(designs.designs))
        made = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(counts._jdf.queryExecution().executedPlan())
        assert 0 < max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.length())) < 8000
        assert counts.first()["n"] == [5] * 15  # the rows of the first event do not differ
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_passes_read_narrow_rows_written_once(spark, monkeypatch):
    """Rows of large samples are read from their own table, not made from the events again in every pass."""
    from dyadscope.plans import scan

    seen = []
    fit = scan.distributed_fit
    monkeypatch.setattr(scan, "distributed_fit", lambda sample, *args: seen.append(sample.rows) or fit(sample, *args))
    df = spark.createDataFrame(random_rows(5, 200), SCHEMA)
    run_scan(df, ["a", "b"], ScanSettings.of(
        contexts=(("all", "y"),), replicates=3, spec_mode="key_only", one_task_events=0, discovery=Need(5, 2), validation=Need(5, 2), largest_document_share=1.0)).scan.collect()
    assert len(seen) == 1 and seen[0]._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
