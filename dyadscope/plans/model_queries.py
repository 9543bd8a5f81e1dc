"""Queries that fit models or profile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadscope.operators import equation, events, inference, profile
from dyadscope.operators.candidates import KEY_ONLY, PLUS_BASE, anchor_token
from dyadscope.plans import passes, search
from dyadscope.plans import workload as w
from dyadscope.plans.model_sql import draw_views, p_view, sample_views, scan_sql, scan_view
from dyadscope.plans.oracle import CHOICES, sql, top_views
from dyadscope.plans.registry_of_queries import query
from dyadscope.plans.result_queries import CONSENSUS_VIEWS
from dyadscope.plans.scan import run_scan
from dyadscope.settings import Need, ScanSettings
from dyadscope.sources import readers

ONE_CONTEXT = (("all_contexts", "y_all"),)


def _settings(**changes) -> ScanSettings:
    base = dict(
        run_id="choices", contexts=ONE_CONTEXT, base=("recency_years_alt",), spec_mode="key_only", replicates=49,
        discovery=Need(*GATES), validation=Need(*GATES),
    )
    return ScanSettings.of(**{**base, **changes})


GATES = (10, 5)
#: A coefficient beyond this belongs to a sample that its regressor separates: it ends where the iterations end.
SEPARATED = 8


def _beta_sql(c: str, name: str, digits: int = 5) -> str:
    return f"CASE WHEN abs({c}) < {SEPARATED} THEN round({c}, {digits}) + 0.0::DOUBLE END AS {name}"


def _beta(c: str, name: str, digits: int = 5):
    return F.when(F.abs(c) < SEPARATED, F.round(c, digits) + F.lit(0.0)).alias(name)


def _model_sql(n_boot: int, select: str, *, restarts: int = 1, more: str = "", features=w.FEATURES) -> str:
    views = [scan_sql(features, n_boot, restarts), p_view("boot", n_boot), scan_view("scan", "boot", *GATES)]
    return f"WITH {', '.join(views).strip()},{top_views()}{more}\n{select.strip()}"


@query("key_factor_scan", _model_sql(49, f"""
SELECT track, key_factor, status_discovery, status_validation, {_beta_sql('beta_discovery', 'beta_discovery')}, {_beta_sql('beta_validation', 'beta_validation')}, round(p_boot_discovery, 9) AS p_boot_discovery,
       round(p_boot_validation, 9) AS p_boot_validation, round(q_value_validation, 9) AS q_value_validation, round(score_validation, 4) AS score_validation, candidate_tier, candidate_id FROM top"""))
def key_factor_scan(spark, sf):
    """Which features move the choice, with hold-out and FDR."""
    top = run_scan(w.choices(spark, sf), w.FEATURES, _settings()).top
    return inference.rank_candidates(top).select(
        "track", "key_factor", "status_discovery", "status_validation", _beta("beta_discovery", "beta_discovery"), _beta("beta_validation", "beta_validation"),
        *[F.round(c, 9).alias(c) for c in ("p_boot_discovery", "p_boot_validation", "q_value_validation")], F.round("score_validation", 4).alias("score_validation"),
        "candidate_tier", "candidate_id",
    )


def _two_newton_sql(designs, steps: int = 12) -> str:
    """Fits of (spec id, key, second regressor or none) with a 2x2 solve a step; rows that pass the gates are ok."""
    pairs = " UNION ALL ".join(
        f"SELECT '{spec}' AS spec, '{key}' AS key_factor, {int(second is not None)} AS two, track, split_role, any_value(policy_document_id) AS doc, "
        f"max({key}) FILTER (y_all = 1) AS xp, max({key}) FILTER (y_all = 0) AS xn, {f'max({second}) FILTER (y_all = 1)' if second else '0.0::DOUBLE'} AS cp, "
        f"{f'max({second}) FILTER (y_all = 0)' if second else '0.0::DOUBLE'} AS cn FROM choices GROUP BY track, split_role, event_id "
        f"HAVING count(*) = 2 AND sum(y_all) = 1 AND min({key}) <> max({key})"
        for spec, key, second in designs
    )
    keys = "spec, key_factor, track, split_role"
    views = [
        f"pairs AS ({pairs})",
        f"per_doc AS (SELECT {keys}, doc, count(*) AS n FROM pairs GROUP BY ALL)",
        f"size AS (SELECT {keys}, sum(n) AS n_events, count(*) AS n_docs, max(n) / sum(n) AS top1 FROM per_doc GROUP BY ALL)",
        f"levels AS (SELECT {keys}, xp AS x, cp AS c FROM pairs UNION ALL SELECT {keys}, xn, cn FROM pairs)",
        f"spread AS (SELECT {keys}, CASE WHEN count(DISTINCT x) > 2 THEN stddev_pop(x) ELSE 1.0::DOUBLE END AS sx, CASE WHEN count(DISTINCT c) > 2 THEN stddev_pop(c) ELSE 1.0::DOUBLE END AS sc FROM levels GROUP BY ALL)",
        f"z AS (SELECT {keys}, two, (xp - xn) / sx AS d, (cp - cn) / sc AS e FROM pairs JOIN spread USING ({keys}))",
        f"b0 AS (SELECT DISTINCT {keys}, 0.0::DOUBLE AS b, 0.0::DOUBLE AS g FROM z)",
    ]
    for i in range(steps):
        views.append(
            f"h{i} AS (SELECT {keys}, any_value(b) AS b, any_value(g) AS g, sum(q * d) AS g1, sum(q * e) AS g2, sum(q * (1 - q) * d * d) AS h11, sum(q * (1 - q) * d * e) AS h12, "
            f"CASE WHEN max(two) = 1 THEN sum(q * (1 - q) * e * e) ELSE 1.0 END AS h22 FROM (SELECT z.*, b, g, 1 / (1 + exp(b * d + g * e)) AS q FROM z JOIN b{i} USING ({keys})) GROUP BY {keys})"
        )
        views.append(f"b{i + 1} AS (SELECT {keys}, b + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS b, g + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS g FROM h{i})")
    views.append(
        f"fit AS (SELECT {keys}, track || '|all_contexts|y_all|' || spec || '|' || key_factor AS candidate_id, n_events, n_events >= 10 AND n_docs >= 5 AND top1 <= 0.2 AS ok, "
        f"b, any_value(two) + 1 AS k, sum(-ln(1 + exp(-b * d - g * e))) AS llf FROM z JOIN b{steps} USING ({keys}) JOIN size USING ({keys}) GROUP BY {keys}, n_events, n_docs, top1, b)"
    )
    return CHOICES + ", " + ", ".join(views)


LOGIT_DESIGNS = [(KEY_ONLY, f, None) for f in w.FEATURES] + [(PLUS_BASE, f, "recency_years_alt") for f in w.FEATURES if f != "recency_years_alt"]


@query("logit_fit", "WITH " + (_two_newton_sql(LOGIT_DESIGNS) + """
SELECT candidate_id, split_role, ok AS fitted, CASE WHEN ok AND abs(b) < 8 THEN round(b, 5) + 0.0::DOUBLE END AS beta, CASE WHEN ok AND abs(b) < 8 THEN round(llf - 0.01::DOUBLE * k, 4) END AS score, n_events AS n_single_choice_informative FROM fit""").strip())
def logit_fit(spark, sf):
    settings = _settings(spec_mode="both", replicates=0, converged_share=0.0)
    scan = run_scan(w.choices(spark, sf), w.FEATURES, settings).scan
    return scan.select(
        "candidate_id", "split_role", (F.col("status") == "ok").alias("fitted"), _beta("beta", "beta"), F.when(F.abs("beta") < SEPARATED, F.round("score", 4)).alias("score"),
        "n_single_choice_informative",
    )


FIT_FEATURES = w.FEATURES


def _newton_sql(steps: int = 9) -> str:
    """Newton steps of the key-only logit, one WITH view per step."""
    pairs = " UNION ALL ".join(
        f"SELECT '{f}' AS key_factor, track, split_role, event_id, max({f}) FILTER (y_all = 1) AS xp, max({f}) FILTER (y_all = 0) AS xn "
        f"FROM choices GROUP BY ALL HAVING count(*) = 2 AND sum(y_all) = 1 AND count({f}) = 2 AND min({f}) <> max({f})"
        for f in FIT_FEATURES
    )
    views = [
        f"pairs AS ({pairs})",
        "levels AS (SELECT key_factor, track, split_role, xp AS x FROM pairs UNION ALL SELECT key_factor, track, split_role, xn FROM pairs)",
        "spread AS (SELECT key_factor, track, split_role, CASE WHEN count(DISTINCT x) > 2 THEN stddev_pop(x) ELSE 1.0::DOUBLE END AS sd FROM levels GROUP BY ALL)",
        "z AS (SELECT key_factor, track, split_role, (xp - xn) / sd AS d FROM pairs JOIN spread USING (key_factor, track, split_role))",
        "b0 AS (SELECT DISTINCT key_factor, track, split_role, 0.0::DOUBLE AS beta FROM z)",
    ]
    for i in range(steps):
        views.append(
            f"b{i + 1} AS (SELECT key_factor, track, split_role, any_value(beta) + sum(d / (1 + exp(beta * d))) / sum(d * d / ((1 + exp(beta * d)) * (1 + exp(-beta * d)))) AS beta "
            f"FROM z JOIN b{i} USING (key_factor, track, split_role) GROUP BY ALL)"
        )
    return CHOICES + ", " + ", ".join(views) + (
        f" SELECT key_factor, track, split_role, count(*) AS n_events, round(any_value(beta), 6) + 0.0::DOUBLE AS beta, round(sum(-ln(1 + exp(-beta * d))) - 0.01::DOUBLE, 5) AS score "
        f"FROM z JOIN b{steps} USING (key_factor, track, split_role) GROUP BY ALL"
    )


@query("logit_fit_key_only", "WITH " + _newton_sql().strip())
def logit_fit_key_only(spark, sf):
    settings = _settings(
        replicates=0, converged_share=0.0, discovery=Need(1, 1), validation=Need(1, 1),
        largest_document_share=1.0,
    )
    scan = run_scan(w.choices(spark, sf), FIT_FEATURES, settings).scan
    return scan.select(
        "key_factor", "track", "split_role", F.col("n_single_choice_informative").alias("n_events"), (F.round("beta", 6) + F.lit(0.0)).alias("beta"), F.round("score", 5).alias("score")
    )


def _bootstrap_sql(features, n_boot: int, steps: int = 16) -> str:
    """Views up to `fitted` (per sample and replicate, -1 the point fit) and `found` (the summary of a sample)."""
    views = [
        *sample_views(features), *draw_views(n_boot),
        "zw AS (SELECT key_factor, track, split_role, r, d, w FROM z JOIN weighed USING (key_factor, track, split_role, doc) WHERE w > 0 "
        "UNION ALL SELECT key_factor, track, split_role, -1, d, 1 FROM z)",
        "b0 AS (SELECT DISTINCT key_factor, track, split_role, r, 0.0::DOUBLE AS beta FROM zw)",
    ]
    for i in range(steps):
        views.append(
            f"b{i + 1} AS (SELECT key_factor, track, split_role, r, any_value(beta) + sum(w * d / (1 + exp(beta * d))) / sum(w * d * d / ((1 + exp(beta * d)) * (1 + exp(-beta * d)))) AS beta "
            f"FROM zw JOIN b{i} USING (key_factor, track, split_role, r) GROUP BY ALL)"
        )
    views += [
        # A gradient that vanishes at 0 leaves the coefficient at 0; sums in another order leave dust.
        f"fitted AS (SELECT key_factor, track, split_role, r, CASE WHEN abs(beta) < 1e-9 THEN 0 ELSE beta END AS beta FROM b{steps})",
        "boot AS (SELECT key_factor, track, split_role, count(*) AS n, coalesce(stddev_samp(beta), 0) AS se, quantile_cont(beta, 0.025) AS lo, quantile_cont(beta, 0.975) AS hi, "
        f"bool_or(abs(beta) >= {SEPARATED}) AS separated, "
        "least(1.0, 2.0 * least((count(*) FILTER (beta <= 0) + 1)::DOUBLE / (count(*) + 1), (count(*) FILTER (beta >= 0) + 1)::DOUBLE / (count(*) + 1))) AS p FROM fitted WHERE r >= 0 GROUP BY ALL)",
        "found AS (SELECT candidate_id, split_role, track, key_factor, n_events, beta, se, lo, hi, p, n, separated, n_events >= 10 AND n_docs >= 5 AND top1 <= 0.2 AS ok "
        "FROM size JOIN ids USING (key_factor, track, split_role) JOIN (SELECT * FROM fitted WHERE r = -1) USING (key_factor, track, split_role) LEFT JOIN boot USING (key_factor, track, split_role))",
    ]
    return CHOICES + ", " + ", ".join(views)


def _boot_columns(result):
    """Values to 5 digits, as both sides stop their iterations somewhere; no spread where a replicate is separated."""
    wild = result.fits.groupBy("track", "split_role", F.col("exog")[0].alias("key_factor")).agg(
        F.max(F.coalesce(F.array_max(F.transform("boot.beta", lambda x: F.abs(x))), F.lit(0.0)) >= SEPARATED).alias("wild"))
    rows = result.scan.join(wild, ["track", "split_role", "key_factor"], "left")
    near = {c: (F.round(c, 5) + F.lit(0.0)) for c in ("beta", "se_boot", "ci95_lower", "ci95_upper", "p_boot")}
    spread = [(F.when(~F.col("wild"), x) if c not in ("beta", "p_boot") else x).alias(c) for c, x in near.items()]
    return rows.select("candidate_id", "split_role", *spread, "bootstrap_success", "bootstrap_attempted")


def _boot_answer(n_boot: int) -> str:
    near = ", ".join(f"CASE WHEN ok{' AND NOT separated' if c in ('se', 'lo', 'hi') else ''} THEN round({c}, 5) + 0.0::DOUBLE END AS {name}" for c, name in (
        ("beta", "beta"), ("se", "se_boot"), ("lo", "ci95_lower"), ("hi", "ci95_upper"), ("p", "p_boot")))
    return f" SELECT candidate_id, split_role, {near}, CASE WHEN ok THEN n ELSE 0 END::INT AS bootstrap_success, CASE WHEN ok THEN {n_boot} ELSE 0 END AS bootstrap_attempted FROM found"


BOOT_FEATURES = (*w.FEATURES, "x_nullable")


@query("cluster_bootstrap", "WITH " + (_bootstrap_sql(BOOT_FEATURES, 99) + _boot_answer(99)).strip())
def cluster_bootstrap(spark, sf):
    return _boot_columns(run_scan(w.choices(spark, sf), BOOT_FEATURES, _settings(replicates=99)))


@query("adam_fit")
def adam_fit(spark, sf):
    scan = run_scan(w.choices(spark, sf), w.FEATURES, _settings(method="adam_lite", replicates=49)).scan
    return scan.select("candidate_id", "split_role", "status", "beta", "score")


@query("distributed_fit", "WITH " + (_bootstrap_sql(w.FEATURES, 19) + _boot_answer(19)).strip())
def distributed_fit(spark, sf):
    """The same fits with every sample sent through the distributed sums."""
    return _boot_columns(run_scan(w.choices(spark, sf), w.FEATURES, _settings(replicates=19, one_task_events=0)))


ANCHORED = f"{KEY_ONLY}__{anchor_token(['l_discount'])}"


ANCHOR_FEATURES = tuple(f for f in w.FEATURES if f != "l_discount")


@query("anchored_scan", "WITH " + (_two_newton_sql([(ANCHORED, f, "l_discount") for f in ANCHOR_FEATURES]) + f"""
SELECT candidate_id, spec AS spec_id, key_factor || '+l_discount' AS control_set, split_role, ok AS fitted, CASE WHEN ok AND abs(b) < {SEPARATED} THEN round(b, 5) + 0.0::DOUBLE END AS beta,
       CASE WHEN ok THEN 19 ELSE 0 END AS bootstrap_attempted FROM fit""").strip())
def anchored_scan(spark, sf):
    """Point fits agree with the SQL; the replicates' numbers are not compared, only that all are tried."""
    scan = run_scan(w.choices(spark, sf), ANCHOR_FEATURES, _settings(fixed=("l_discount",), replicates=19)).scan
    return scan.select("candidate_id", "spec_id", "control_set", "split_role", (F.col("status") == "ok").alias("fitted"), _beta("beta", "beta"), "bootstrap_attempted")


@query("search_log")
def search_log(spark, sf):
    settings = _settings(contexts=(*ONE_CONTEXT, ("missing", "y_none"), ("all_contexts", "y_all")), spec_mode="both")
    log = run_scan(w.choices(spark, sf), w.FEATURES, settings).log
    return log.groupBy("status", "reason_stage", "reason_code").agg(F.count(F.lit(1)).alias("n"))


RESTARTS = 5
RESTART_SQL = f""",{CONSENSUS_VIEWS},
agg AS (SELECT candidate_id, min(fdr_family_id) AS fdr_family_id, arg_min(track_consensus_anchor_pass, restart_id) AS anchor_pass, max(CAST(status_discovery = 'ok' AS INTEGER)) AS d_ok,
   count(*) FILTER (status_validation = 'ok' AND p_boot_validation IS NOT NULL) AS n_ok, median(p_boot_validation) FILTER (status_validation = 'ok') AS p_med, count(DISTINCT restart_id) AS np, count(*) AS n,
   count(*) FILTER (candidate_tier = 'validated_candidate') AS nv, count(*) FILTER (candidate_tier = 'support_candidate') AS ns, count(*) FILTER (candidate_tier = 'exploratory') AS ne,
   count(*) FILTER (beta_validation > 0) AS vp, count(*) FILTER (beta_validation < 0) AS vn, count(*) FILTER (beta_discovery > 0) AS dp, count(*) FILTER (beta_discovery < 0) AS dn FROM consensus GROUP BY 1),
c AS (SELECT * FROM agg WHERE n_ok > 0),
raws AS (SELECT candidate_id, fdr_family_id, p_med, p_med * count(*) OVER (PARTITION BY fdr_family_id) / count(*) OVER (PARTITION BY fdr_family_id ORDER BY p_med RANGE UNBOUNDED PRECEDING) AS raw FROM c),
qq AS (SELECT candidate_id, least(1.0::DOUBLE, min(raw) OVER (PARTITION BY fdr_family_id ORDER BY p_med DESC RANGE UNBOUNDED PRECEDING)) AS qm FROM raws),
j AS (SELECT a.*, qm, CASE WHEN n_ok > 0 AND p_med <= 0.05 AND coalesce(qm <= 0.10, false) THEN 'validated_candidate' WHEN d_ok = 1 THEN 'support_candidate' ELSE 'exploratory' END AS tier FROM agg a LEFT JOIN qq USING (candidate_id))"""


@query("multi_restart_inference", _model_sql(49, f"""
SELECT candidate_id, CASE WHEN anchor_pass = 0 AND tier = 'validated_candidate' THEN 'support_candidate' ELSE tier END AS candidate_tier, round(p_med, 9) AS p_boot_validation, round(qm, 9) AS q_value_validation,
       np AS n_restarts_present, round(0.35::DOUBLE * (np / {RESTARTS}.0::DOUBLE) + 0.35::DOUBLE * ((nv + ns) / {RESTARTS}.0::DOUBLE) + 0.20::DOUBLE * (greatest(nv, ns, ne)::DOUBLE / n)
       + 0.10::DOUBLE * greatest(CASE WHEN vp + vn > 0 THEN greatest(vp, vn)::DOUBLE / (vp + vn) ELSE 1 END, CASE WHEN dp + dn > 0 THEN greatest(dp, dn)::DOUBLE / (dp + dn) ELSE 1 END), 6) AS stability_score FROM j""",
    restarts=RESTARTS, more=RESTART_SQL))
def multi_restart_inference(spark, sf):
    _, rows, stability = passes.run_restarts(w.choices(spark, sf), w.FEATURES, _settings(restarts=RESTARTS))
    joined = rows.join(stability.select("candidate_id", "stability_score"), "candidate_id")
    return inference.order_inference(joined).select(
        "candidate_id", "candidate_tier", *[F.round(c, 9).alias(c) for c in ("p_boot_validation", "q_value_validation")], "n_restarts_present", "stability_score"
    )


def _second_pass_sql(n_first: int, n_second: int, picked: str, suffix: str) -> str:
    """The second scan of the features that `picked` selects from the first, or the first where it selects none."""
    views = [
        scan_sql(w.FEATURES, n_second), p_view("boot", n_first), p_view("boot2", n_second), scan_view("scan", "boot", *GATES) + "," + top_views(),
        f"picked AS ({picked})", scan_view("scan2", "boot2", *GATES, where="key_factor IN (SELECT key_factor FROM picked)") + "," + top_views("scan2", "2"),
    ]
    columns = "candidate_id, round(p_boot_validation, 9) AS p_boot_validation, round(q_value_validation, 9) AS q_value_validation, candidate_tier"
    return f"WITH {', '.join(views).strip()} SELECT 'choices__{suffix}' AS run_id, {columns} FROM top2 UNION ALL SELECT 'choices', {columns} FROM top WHERE (SELECT count(*) FROM picked) = 0"


def _second(first, second):
    chosen = second.top if second is not None else first.top
    return chosen.select("run_id", "candidate_id", *[F.round(c, 9).alias(c) for c in ("p_boot_validation", "q_value_validation")], "candidate_tier")


@query("bootstrap_escalation", _second_pass_sql(49, 199, """
SELECT DISTINCT key_factor FROM top WHERE status_validation = 'ok' AND candidate_tier <> 'validated_candidate' AND NOT (p_boot_validation <= 0.05 AND q_value_validation <= 0.10)
  AND p_boot_validation <= 0.05::DOUBLE + 0.4::DOUBLE AND q_value_validation <= 0.10::DOUBLE + 0.6::DOUBLE""", "escalation"))
def bootstrap_escalation(spark, sf):
    """Every borderline feature goes from 49 to 199 replicates; only the 150 new ones are run."""
    df, settings = w.choices(spark, sf), _settings()
    first = run_scan(df, w.FEATURES, settings)
    second = passes.escalate(df, first.top, settings, n_bootstrap=199, first=first, p_margin=0.4, q_margin=0.6, max_candidates=len(w.FEATURES), dedupe_mode="feature")
    return _second(first, second)


@query("shortlist_refinement", _second_pass_sql(49, 199, "SELECT DISTINCT key_factor FROM top WHERE candidate_tier IN ('validated_candidate', 'support_candidate')", "refine"))
def shortlist_refinement(spark, sf):
    df, settings = w.choices(spark, sf), _settings()
    first = run_scan(df, w.FEATURES, settings)
    second = passes.refine(df, first.top, settings, n_bootstrap=199, first=first, max_features=len(w.FEATURES), dedupe_mode="feature")
    return _second(first, second)


@query("equation_path")
def equation_path(spark, sf):
    return equation.equation_steps(
        w.choices(spark, sf), [f for f in w.FEATURES if f != "recency_years_alt"], controls=["recency_years_alt"], n_bootstrap=49
    ).withColumn("contribution_atoms", F.array_join("contribution_atoms", "|"))


PATH_SQL = CHOICES + """,
y AS (SELECT track || '-' || split_role AS path, CAST(CAST(floor(l_quantity) AS BIGINT) % 6 AS INTEGER) AS step, count(*) AS n, avg(l_discount) AS a, avg(l_tax) AS l, stddev_samp(l_discount) AS sa FROM choices GROUP BY ALL),
d AS (SELECT *, a - lag(a) OVER w AS da, l - lag(l) OVER w AS dl, 1.96::DOUBLE * sqrt(sa * sa + coalesce(lag(sa) OVER w, 0) * coalesce(lag(sa) OVER w, 0)) AS band FROM y WINDOW w AS (PARTITION BY path ORDER BY step))
"""
STEP_FACTORS = ("(base_controls)", "pa__a", "expr__ratio__pa__a__over__ext__b", "cat__ext__b__x_h1", "expr__sq__pa__a", "pub_year_alt")


def _paths(spark, sf):
    df = w.choices(spark, sf)
    steps = df.groupBy(
        F.concat_ws("-", "track", "split_role").alias("path"), (F.floor("l_quantity").cast("bigint") % 6).cast("int").alias("step")
    ).agg(
        F.avg("l_discount").alias("accuracy_mean"), F.stddev_samp("l_discount").alias("accuracy_std"), F.avg("l_tax").alias("llf_per_event_mean"),
        F.lit(0.0).alias("llf_per_event_std"),
    )
    named = F.element_at(F.array(*[F.lit(f) for f in STEP_FACTORS]), F.col("step") + 1)
    from dyadscope.functions.names import contribution_atoms

    labelled = steps.withColumns({"added_factor": named, "is_baseline": (F.col("step") == 0).cast("int"), "contribution_atoms": contribution_atoms(named)})
    return equation.step_deltas(labelled, keys=("path",))


@query("step_deltas", sql(PATH_SQL, """
SELECT path, step, round(da, 9) AS delta_accuracy_mean, round(da - band, 9) AS delta_accuracy_ci_low, round(da + band, 9) AS delta_accuracy_ci_high, round(dl, 9) AS delta_llf_per_event_mean FROM d"""))
def step_deltas(spark, sf):
    return _paths(spark, sf).select(
        "path", "step", *[F.round(c, 9).alias(c) for c in ("delta_accuracy_mean", "delta_accuracy_ci_low", "delta_accuracy_ci_high", "delta_llf_per_event_mean")]
    )


@query("contribution_groups", sql(PATH_SQL, """

, atoms AS (SELECT path, step, da, dl, unnest(CASE step WHEN 1 THEN ['pa__a'] WHEN 2 THEN ['pa__a', 'ext__b'] WHEN 3 THEN ['ext__b'] WHEN 4 THEN ['pa__a'] ELSE ['pub_year_alt'] END) AS feature_atom,
   CASE step WHEN 2 THEN 2 ELSE 1 END AS k FROM d WHERE step > 0 AND da IS NOT NULL),
g AS (SELECT path, feature_atom, sum(da / k) AS s, sum(abs(da / k)) AS sa, sum(dl / k) AS sl, count(*) AS n_steps FROM atoms GROUP BY ALL)
SELECT path, feature_atom, round(s, 9) AS contribution_accuracy_sum, round(sa, 9) AS contribution_accuracy_abs_sum, round(sl, 9) AS contribution_llf_per_event_sum, n_steps,
   round(sa / sum(sa) OVER (PARTITION BY path), 7) AS contribution_accuracy_share_abs FROM g"""))
def contribution_groups(spark, sf):
    out = equation.contribution_groups(_paths(spark, sf), keys=("path",))
    return out.select(
        "path", "feature_atom", "n_steps", F.round("contribution_accuracy_sum", 9).alias("contribution_accuracy_sum"),
        F.round("contribution_accuracy_abs_sum", 9).alias("contribution_accuracy_abs_sum"),
        F.round("contribution_llf_per_event_sum", 9).alias("contribution_llf_per_event_sum"),
        F.round("contribution_accuracy_share_abs", 7).alias("contribution_accuracy_share_abs"),
    )


# ---- profile --------------------------------------------------------------------------------

PROFILE_SQL = """
base AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_acctbal, c_nationkey, c_mktsegment,
   CAST(o_orderstatus = 'F' AS INTEGER) AS is_final, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive_balance FROM orders JOIN customer ON o_custkey = c_custkey)"""
PROFILE_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "c_acctbal", "c_nationkey", "c_mktsegment", "is_final", "positive_balance")


def _orders(spark, sf):
    orders = w.table(spark, sf, "orders")
    customer = w.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.withColumns(
        {
            "is_final": (F.col("o_orderstatus") == "F").cast("int"),
            "positive_balance": F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")),
        }
    ).select(*PROFILE_COLUMNS)


def _profile_sql():
    numeric = {"o_orderkey", "o_custkey", "o_totalprice", "c_acctbal", "c_nationkey", "is_final", "positive_balance"}
    rows = []
    for c in PROFILE_COLUMNS:
        kind = "numeric" if c in numeric else "datetime_like" if c == "o_orderdate" else "string"
        stats = (
            f"min({c})::DOUBLE, max({c})::DOUBLE, round(avg({c}), 4), round(stddev_pop({c}), 4), round(avg(CAST({c} = 0 AS INTEGER)), 6), "
            f"CAST(bool_and({c} IN (0, 1)) AND count(DISTINCT {c}) <= 2 AS INTEGER), CAST(bool_and({c} >= 0 AND abs(round({c}) - {c}) < 1e-12) AS INTEGER)"
            if c in numeric
            else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0, 0"
        )
        rows.append(
            f"SELECT '{c}' AS name, '{kind}' AS dtype_group, count({c}) AS nonmissing_count, round(count({c})::DOUBLE / count(*), 6) AS nonmissing_share, "
            f"count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c})::DOUBLE / count({c}), 6) AS unique_share, {stats} FROM base"
        )
    names = "name, dtype_group, nonmissing_count, nonmissing_share, unique_count, unique_share, min_value, max_value, mean_value, std_value, zero_share, is_binary_numeric, is_nonnegative_integer"
    return sql(PROFILE_SQL, f", p({names}) AS ({' UNION ALL '.join(rows)}) SELECT * FROM p")


@query("column_profile", _profile_sql())
def column_profile(spark, sf):
    out = profile.column_profile(_orders(spark, sf))
    return out.select(
        "name", "dtype_group", "nonmissing_count", F.round("nonmissing_share", 6).alias("nonmissing_share"), "unique_count",
        F.round("unique_share", 6).alias("unique_share"), "min_value", "max_value", F.round("mean_value", 4).alias("mean_value"),
        F.round("std_value", 4).alias("std_value"), F.round("zero_share", 6).alias("zero_share"), "is_binary_numeric", "is_nonnegative_integer",
    )


@query("target_candidates", sql(PROFILE_SQL, """
, n AS (SELECT count(*)::DOUBLE AS n, count(positive_balance)::DOUBLE AS pb FROM base)
SELECT 'is_final' AS name, 'binary' AS y_type, round(4.0::DOUBLE, 6) AS priority FROM n UNION ALL SELECT 'c_nationkey', 'count', 3.0 FROM n
UNION ALL SELECT 'o_custkey', 'count', 3.0 FROM n UNION ALL SELECT 'o_totalprice', 'continuous', 2.0 FROM n
UNION ALL SELECT 'c_acctbal', 'continuous', 2.0 FROM n UNION ALL SELECT 'positive_balance', 'continuous', round(1 + pb / n, 6) FROM n WHERE pb / n >= 0.6"""))
def target_candidates(spark, sf):
    out = profile.target_candidates(profile.column_profile(_orders(spark, sf)))
    return out.select("name", "y_type", F.round("priority", 6).alias("priority"))


@query("regressor_candidates", sql(PROFILE_SQL, """
, n AS (SELECT count(*)::DOUBLE AS n, count(positive_balance)::DOUBLE AS pb FROM base)
SELECT 'c_acctbal' AS name, 'numeric' AS x_type, round(3.0::DOUBLE, 6) AS priority FROM n UNION ALL SELECT 'c_nationkey', 'numeric', 3.0 FROM n UNION ALL SELECT 'o_custkey', 'numeric', 3.0 FROM n
UNION ALL SELECT 'positive_balance', 'numeric', round(2 + pb / n, 6) FROM n WHERE pb / n >= 0.6 UNION ALL SELECT 'o_orderdate', 'time', 2.7 FROM n
UNION ALL SELECT 'o_orderstatus', 'categorical', 2.4 FROM n UNION ALL SELECT 'c_mktsegment', 'categorical', 2.4 FROM n"""))
def regressor_candidates(spark, sf):
    out = profile.regressor_candidates(profile.column_profile(_orders(spark, sf)), targets=["is_final", "o_totalprice"], exclude=["o_orderpriority"])
    return out.select("name", "x_type", F.round("priority", 6).alias("priority"))


SCORES_SQL = PROFILE_SQL + """,
s AS (
  SELECT 'is_final' AS y_col, 'c_acctbal' AS x_col, abs(avg(c_acctbal) FILTER (is_final = 1) - avg(c_acctbal) FILTER (is_final = 0)) / (stddev_pop(c_acctbal) + 1e-12) AS score, count(*) AS support_rows, 'low' AS risk_level, 0.0::DOUBLE AS pen, '' AS risk_flags FROM base
  UNION ALL SELECT 'is_final', 'positive_balance', abs(avg(positive_balance) FILTER (is_final = 1) - avg(positive_balance) FILTER (is_final = 0)) / (stddev_pop(positive_balance) + 1e-12), count(positive_balance), 'low', 0.0, '' FROM base
  UNION ALL SELECT 'is_final', 'o_orderdate', abs(avg(epoch_us(o_orderdate)::DOUBLE) FILTER (is_final = 1) - avg(epoch_us(o_orderdate)::DOUBLE) FILTER (is_final = 0)) / (stddev_pop(epoch_us(o_orderdate)::DOUBLE) + 1e-12), count(*), 'low', 0.0, '' FROM base
  UNION ALL SELECT 'is_final', 'c_mktsegment', max(m) - min(m), CAST(sum(k) AS BIGINT), 'medium', 0.12, 'x_categorical_binary_screen_only' FROM (SELECT c_mktsegment, avg(is_final) AS m, count(*) AS k FROM base GROUP BY 1)
  UNION ALL SELECT 'o_totalprice', 'c_acctbal', abs(corr(o_totalprice, c_acctbal)), count(*), 'low', 0.0, '' FROM base
  UNION ALL SELECT 'o_totalprice', 'positive_balance', abs(corr(o_totalprice, positive_balance)), count(positive_balance), 'low', 0.0, '' FROM base
  UNION ALL SELECT 'o_totalprice', 'o_orderdate', abs(corr(o_totalprice, epoch_us(o_orderdate)::DOUBLE)), count(*), 'low', 0.0, '' FROM base
  UNION ALL SELECT 'o_totalprice', 'c_mktsegment', (max(m) - min(m)) / (max(sd) + 1e-12), CAST(sum(k) AS BIGINT), 'low', 0.0, '' FROM (SELECT c_mktsegment, avg(o_totalprice) AS m, count(*) AS k, (SELECT stddev_pop(o_totalprice) FROM base) AS sd FROM base GROUP BY 1)
)"""
TARGETS = [("is_final", "binary"), ("o_totalprice", "continuous")]
REGRESSORS = [("c_acctbal", "numeric"), ("positive_balance", "numeric"), ("o_orderdate", "time"), ("c_mktsegment", "categorical")]


@query("pair_scores", sql(SCORES_SQL, "SELECT y_col, x_col, round(score, 7) AS score, round(score * (1 - pen), 7) AS score_adjusted, support_rows, risk_level, risk_flags FROM s"))
def pair_scores(spark, sf):
    out = profile.pair_scores(_orders(spark, sf), TARGETS, REGRESSORS)
    return out.select(
        "y_col", "x_col", F.round("score", 7).alias("score"), F.round("score_adjusted", 7).alias("score_adjusted"), "support_rows", "risk_level", "risk_flags"
    )


@query("question_seeds", sql(SCORES_SQL, """
SELECT CAST(row_number() OVER (ORDER BY score * (1 - pen) DESC, score DESC, support_rows DESC, y_col, x_col) AS INTEGER) AS rank, y_col || ' ~ ' || x_col AS label FROM s ORDER BY 1 LIMIT 5"""))
def question_seeds(spark, sf):
    return profile.question_seeds(profile.pair_scores(_orders(spark, sf), TARGETS, REGRESSORS), 5).select("rank", "label")


@query("profile_report")
def profile_report(spark, sf):
    docs = w.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labelled = w.table(spark, sf, "labels").join(docs, "doc_id")
    out = profile.profile_table(labelled)
    return profile.profile_highlights(out["columns"], out["question_seeds"])


@query("head_sample", sql(PROFILE_SQL, ", head AS (SELECT * FROM base ORDER BY o_orderkey LIMIT 1200) " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS nonmissing_count, count(DISTINCT {c}) AS unique_count FROM head" for c in PROFILE_COLUMNS)))
def head_sample(spark, sf):
    """A profile of the first rows by key: the head is the feature."""
    head = readers.head_rows(_orders(spark, sf), 1200, ["o_orderkey"])
    return profile.column_profile(head).select("name", "nonmissing_count", "unique_count")


@query("all_track_slice", sql(CHOICES, "SELECT split_role, count(*) AS n FROM choices WHERE split_role = 'discovery' GROUP BY 1"))
def all_track_slice(spark, sf):
    return events.slice_rows(w.choices(spark, sf), "any", "discovery").groupBy("split_role").agg(F.count(F.lit(1)).alias("n"))


@query("full_search")
def full_search(spark, sf):
    """The composed search with windows, expressions and levels, all features, over two restarts."""
    settings = _settings(restarts=2, validation=Need(100, 30))
    options = search.SearchOptions(windows=(3,), expression_mode="ms_benchmark_lite", expression_bases=("l_quantity", "l_tax", "pa__p_size"), categories=("pa__p_type",))
    row_id = F.xxhash64("event_id", "l_extendedprice", "l_discount", "recency_years_alt", "pa__p_retailprice", "ext__s_acctbal")
    done = search.run_search(w.choices(spark, sf), w.FEATURES, settings, options, row_id=row_id)
    return done.scan.select(
        "restart_id", "track", "context_scope", "split_role", "key_factor", "n_choice_situations_total", "n_single_choice_informative", "status", "reason_code",
        "beta", "p_boot", "q_value", "candidate_tier", "data_hash", "config_hash", "feature_registry_hash",
    )
