import pytest
from pyspark.sql import functions as F

from dyadscope.operators import bootstrap, explore, inference, review, runs, shortlist

TOP = (
    "candidate_id string, restart_id int, candidate_tier string, track string, context_scope string, y_col string, spec_id string, key_factor string, "
    "control_set string, fdr_family_id string, status_discovery string, status_validation string, p_boot_discovery double, p_boot_validation double, "
    "q_value_validation double, beta_discovery double, beta_validation double, score_discovery double, score_validation double"
)


def top(spark, *rows):
    names = [c.split()[0] for c in TOP.split(", ")]
    base = dict(track="primary_strict", context_scope="all", y_col="y_all", spec_id="s", fdr_family_id="fam", status_discovery="ok", status_validation="ok", candidate_tier="support_candidate", restart_id=1)
    return spark.createDataFrame([tuple({**base, "control_set": r.get("key_factor"), **r}.get(c) for c in names) for r in rows], TOP)


def bh(values):
    """Textbook step-up procedure."""
    order = sorted(range(len(values)), key=lambda i: values[i])
    out, running = [0.0] * len(values), 1.0
    for rank in range(len(values), 0, -1):
        running = min(running, values[order[rank - 1]] * len(values) / rank)
        out[order[rank - 1]] = running
    return out


def test_bh_matches_the_step_up_procedure_with_ties(spark):
    values = [0.01, 0.04, 0.04, 0.2, 0.9, 0.01, 0.5, 0.04]
    rows = [(i, "a", v) for i, v in enumerate(values)] + [(90, "a", None), (91, " ", 0.01), (92, "b", 0.7)]
    got = {r.id: r.q_value for r in inference.bh_qvalues(spark.createDataFrame(rows, "id int, fam string, p double"), "p", "fam").collect()}
    assert [got[i] for i in range(len(values))] == pytest.approx(bh(values))
    assert got[90] is None and got[91] is None and got[92] == 0.7


def test_bootstrap_summary_small(spark):
    df = spark.createDataFrame([("k", v) for v in (0.1, 0.2, 0.3, 0.4)], "k string, beta double")
    r = bootstrap.bootstrap_summary(df, ["k"]).first()
    assert r.p_boot == pytest.approx(0.4) and r.se_boot == pytest.approx(0.12909944487)
    assert (r.ci95_lower, r.ci95_upper) == pytest.approx((0.1075, 0.3925))
    assert bootstrap.bootstrap_summary(df.limit(1), ["k"]).first().se_boot == 0.0


def test_stability_scores(spark):
    rows = top(
        spark,
        dict(candidate_id="c1", restart_id=1, key_factor="a", candidate_tier="validated_candidate", beta_validation=0.4, beta_discovery=0.3),
        dict(candidate_id="c1", restart_id=2, key_factor="a", candidate_tier="support_candidate", beta_validation=0.2, beta_discovery=0.1),
        dict(candidate_id="c2", restart_id=1, key_factor="b", candidate_tier="exploratory", beta_validation=-0.2, beta_discovery=-0.1),
    )
    out = {r.candidate_id: r for r in inference.restart_stability(rows, n_restarts=2).collect()}
    assert out["c1"].stability_score == pytest.approx(0.35 + 0.35 + 0.20 * 0.5 + 0.10)
    assert out["c1"].modal_tier == "validated_candidate"
    assert out["c2"].stability_score == pytest.approx(0.475)


def test_nonconfirmatory_outcomes_are_capped(spark):
    rows = top(
        spark,
        dict(candidate_id="yes", key_factor="a", y_col="y_5y", fdr_family_id="f1", p_boot_validation=0.2),
        dict(candidate_id="no", key_factor="a", y_col="y_10y", fdr_family_id="f2", p_boot_validation=0.2),
    )
    out = {r.candidate_id: r for r in inference.restart_inference(rows, n_restarts=1, confirmatory_y=["y_5y"], nonconfirmatory_max_tier="exploratory").collect()}
    assert (out["yes"].confirmatory_eligible, out["yes"].candidate_tier, out["yes"].confirmatory_policy_demoted) == (1, "support_candidate", 0)
    assert (out["no"].confirmatory_eligible, out["no"].candidate_tier, out["no"].confirmatory_policy_demoted) == (0, "exploratory", 1)
    assert out["no"].confirmatory_policy_reason == "nonconfirmatory_y_tier_capped"


def test_median_p_over_fitted_restarts(spark):
    rows = top(
        spark,
        *[dict(candidate_id="c", restart_id=i, key_factor="a", p_boot_validation=p, status_validation=s) for i, (p, s) in enumerate([(0.01, "ok"), (0.03, "ok"), (0.9, "fit_failed")], 1)],
    )
    r = inference.restart_inference(rows, n_restarts=3).first()
    assert r.p_boot_validation == pytest.approx(0.02) and r.n_validation_ok_restarts == 2 and r.candidate_tier == "validated_candidate"


def test_consensus_demotes_without_the_anchor(spark):
    rows = top(
        spark,
        dict(candidate_id="x1", track="broad", key_factor="a", candidate_tier="validated_candidate"),
        dict(candidate_id="x2", key_factor="a", candidate_tier="exploratory"),
        dict(candidate_id="x3", track="broad", key_factor="b", candidate_tier="validated_candidate"),
        dict(candidate_id="x4", key_factor="b", candidate_tier="support_candidate"),
    )
    out = {r.candidate_id: r for r in inference.track_consensus(rows, anchor_track="primary_strict").collect()}
    assert out["x1"].candidate_tier == "support_candidate" and out["x1"].track_consensus_status == "anchor_below_threshold"
    assert out["x3"].candidate_tier == "validated_candidate" and out["x3"].track_consensus_status == "pass"


def test_shortlist_keeps_the_best_per_atom(spark):
    rows = top(
        spark,
        dict(candidate_id="c1", key_factor="ext__impact_index", candidate_tier="validated_candidate", q_value_validation=0.01, p_boot_validation=0.01, p_boot_discovery=0.01, beta_validation=0.2),
        dict(candidate_id="c2", key_factor="ext__impact_index__sq", candidate_tier="validated_candidate", q_value_validation=0.02, p_boot_validation=0.02, p_boot_discovery=0.02, beta_validation=0.5),
        dict(candidate_id="c3", key_factor="pa__log1p_author_count", p_boot_discovery=0.04, beta_discovery=0.1),
    )
    out = shortlist.shortlist(rows, max_features=3).orderBy("shortlist_rank").collect()
    assert [(r.feature_name, r.shortlist_rank) for r in out] == [("ext__impact_index", 1), ("pa__log1p_author_count", 3)]
    assert shortlist.shortlist(rows, max_features=3, dedupe_mode="feature").count() == 3
    assert shortlist.shortlist(rows, max_features=0).count() == 0


def test_borderline_zero_margins(spark):
    rows = top(
        spark,
        dict(candidate_id="near", key_factor="a", p_boot_validation=0.05, q_value_validation=0.15),
        dict(candidate_id="pass", key_factor="b", p_boot_validation=0.05, q_value_validation=0.10),
        dict(candidate_id="later", restart_id=2, key_factor="c", p_boot_validation=0.05, q_value_validation=0.15),
    )
    assert [r.candidate_id for r in shortlist.borderline(rows, p_threshold=0.05, q_threshold=0.1, p_margin=0, q_margin=0.1).collect()] == ["near"]
    assert shortlist.borderline(rows, p_threshold=0.05, q_threshold=0.1, p_margin=0, q_margin=0).count() == 0


def edges_to_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_on_a_long_chain_and_islands(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)] + [("z1", "z2"), ("z3", "z2")]
    got = {r.node: r.component for r in explore.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == edges_to_components(edges)


def test_blank_status_counts_as_fitted_in_reviews_only(spark):
    rows = spark.createDataFrame(
        [("r", "c1", "", "validated_candidate", 0.001, 0.01), ("r", "c2", "ok", "support_candidate", 0.05, 0.09), ("r", "c3", "failed", "validated_candidate", 0.0, 0.0)],
        "run_id string, candidate_id string, status_validation string, candidate_tier string, p_boot_validation double, q_value_validation double",
    ).withColumns({"track": F.lit("primary_strict"), "y_col": F.lit("y")})
    r = review.run_review(rows).first()
    assert (r.best_p_candidate_id, r.validated_candidate_count) == ("c1", 1)
    b = review.branch_metrics(rows).first()
    assert (b.best_candidate_id, b.min_p_validation, b.min_q_validation, b.n_validated_rows_primary) == ("c2", 0.05, 0.09, 2)


def test_ladder_rates_and_provenance(spark):
    rows = spark.createDataFrame(
        [(0, 1, 49, "s1_b49", "ok", 0, 1, 0.2), (1, 2, 49, "s2_b49", "failed", 1, 0, 0.12)],
        "position int, seed int, n_bootstrap int, job_key string, status string, returncode int, gate_pass int, nooption_best_q_validation double",
    )
    r = review.ladder_summary(rows, ("nooption_best_q_validation",)).first()
    assert (r.primary_objective_gate_pass_rate, r.nooption_best_q_validation, r.nooption_best_q_validation_job_key) == (0.5, 0.12, "s2_b49")
    jobs = review.ladder_jobs(spark, [1, 2, 3], [49])
    assert [x.job_key for x in review.pending_jobs(jobs, rows).collect()] == ["s3_b49"]


def test_modes_states_and_pairs(spark):
    ids = ["A__singlex_hypothesis_panel", "b__nooption_baseline", "x_openexplore_autorefine", "plain"]
    df = spark.createDataFrame([(i,) for i in ids], "run_id string")
    got = df.select(runs.infer_mode(F.col("run_id")).alias("m"), runs.paired_ids(F.col("run_id")).alias("p")).collect()
    assert [r.m for r in got] == ["singlex_hypothesis_panel", "nooption_baseline", "openexplore_autorefine", "nooption_baseline"]
    assert got[0].p.nooption == "A__nooption_hypothesis_panel" and got[3].p.singlex == "plain__singlex"
    assert spark.range(1).select(runs.infer_state(F.lit("Partial_Failure"))).first()[0] == "failed"


def test_bh_of_a_family_with_half_its_p_missing(spark):
    rows = [(i, "f", None if i % 2 else (i % 10) / 20 + 0.01) for i in range(2000)] + [(5000, None, 0.2), (5001, " ", 0.2)]
    got = {r.id: r.q_value for r in inference.bh_qvalues(spark.createDataFrame(rows, "id int, fam string, p double"), "p", "fam").collect()}
    assert len(got) == len(rows) and all(got[i] is None for i, _, p in rows if p is None or i >= 5000)
    ps = sorted(p for i, _, p in rows if p is not None and i < 5000)
    for i, _, p in rows[:40:2]:
        assert got[i] == pytest.approx(min(q * len(ps) / sum(x <= q for x in ps) for q in set(ps) if q >= p))
