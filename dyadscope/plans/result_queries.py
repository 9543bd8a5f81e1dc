"""Queries on stored results: FDR, tiers, restarts, shortlists, explorer, review."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dyadscope.operators import bootstrap, explore, inference, review, shortlist
from dyadscope.plans import workload as w
from dyadscope.plans.oracle import INFERENCE, SCAN, TOP, sql
from dyadscope.plans.registry_of_queries import query

SIX = 6


def _round(df, *cols, digits=SIX):
    # Adding zero turns -0.0 into 0.0.
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


@query("bootstrap_summary", sql(SCAN, """
, d AS (SELECT candidate_id, split_role, beta FROM scan WHERE beta IS NOT NULL)
SELECT candidate_id, split_role, count(*) AS n_boot, round(avg(beta), 9) + 0.0::DOUBLE AS boot_mean, round(quantile_cont(beta, 0.025), 9) + 0.0::DOUBLE AS ci95_lower,
       round(quantile_cont(beta, 0.975), 9) + 0.0::DOUBLE AS ci95_upper, round(coalesce(stddev_samp(beta), 0), 9) AS se_boot,
       round(least(1.0::DOUBLE, 2.0::DOUBLE * least((count(*) FILTER (beta <= 0) + 1)::DOUBLE / (count(*) + 1), (count(*) FILTER (beta >= 0) + 1)::DOUBLE / (count(*) + 1))), 9) AS p_boot
FROM d GROUP BY ALL"""))
def bootstrap_summary(spark, sf):
    draws = w.scan_rows(spark, sf).where("beta is not null")
    out = bootstrap.bootstrap_summary(draws, ["candidate_id", "split_role"])
    return _round(out, "boot_mean", "ci95_lower", "ci95_upper", "se_boot", "p_boot", digits=9)


@query("bh_qvalues", sql(TOP, "SELECT restart_id, candidate_id, round(q_value, 9) AS q_value FROM q"))
def bh_qvalues(spark, sf):
    out = inference.attach_validation_q(w.scan_rows(spark, sf), keys=("restart_id",))
    return out.where("split_role = 'validation' and status = 'ok'").select("restart_id", "candidate_id", F.round("q_value", 9).alias("q_value"))


@query("bh_qvalues_hot_family", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'all' AS family, CAST((CAST(round(l_extendedprice * 100) AS BIGINT) % 499) + 1 AS DOUBLE) / 500.0::DOUBLE AS p FROM lineitem),
raw AS (SELECT DISTINCT p, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM r),
q AS (SELECT p, least(1.0::DOUBLE, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q_value FROM raw)
SELECT round(q_value, 9) AS q_value, count(*) AS n_rows FROM r JOIN q USING (p) GROUP BY 1""")
def bh_qvalues_hot_family(spark, sf):
    p = (F.round(F.col("l_extendedprice") * 100).cast("bigint") % 499 + 1) / F.lit(500.0)
    rows = w.table(spark, sf, "lineitem").select(F.lit("all").alias("family"), p.alias("p"))
    out = inference.bh_qvalues(rows, "p", "family")
    return out.groupBy(F.round("q_value", 9).alias("q_value")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("split_pairing", sql(TOP, """
SELECT restart_id, candidate_id, key_factor, status_discovery, status_validation, round(p_boot_discovery, 9) AS p_boot_discovery,
       round(p_boot_validation, 9) AS p_boot_validation, beta_discovery, beta_validation FROM paired"""))
def split_pairing(spark, sf):
    scan = inference.attach_validation_q(w.scan_rows(spark, sf), keys=("restart_id",))
    out = inference.pair_splits(scan, ("restart_id", "candidate_id"), ("key_factor",), ("status", "p_boot", "beta"))
    return _round(out, "p_boot_discovery", "p_boot_validation", digits=9).drop("q_value_validation")


TIER_COLUMNS = ("restart_id", "candidate_id", "validation_pass_p", "validation_pass_q", "candidate_tier")


@query("candidate_tiers", sql(TOP, "SELECT restart_id, candidate_id, validation_pass_p, validation_pass_q, candidate_tier FROM top"))
def candidate_tiers(spark, sf):
    return w.top_rows(spark, sf).select(*TIER_COLUMNS)


@query("ranked_candidates", sql(TOP, """
SELECT restart_id, candidate_id, candidate_tier, round(q_value_validation, 9) AS q_value_validation, score_validation, CAST(row_number() OVER (PARTITION BY restart_id
ORDER BY CASE candidate_tier WHEN 'validated_candidate' THEN 0 WHEN 'support_candidate' THEN 1 ELSE 2 END, q_value_validation ASC NULLS LAST, score_validation DESC NULLS LAST, candidate_id) AS INTEGER) AS position FROM top"""))
def ranked_candidates(spark, sf):
    place = F.row_number().over(Window.partitionBy("restart_id").orderBy(*inference.rank_order()))
    return w.top_rows(spark, sf).select(
        "restart_id", "candidate_id", "candidate_tier", F.round("q_value_validation", 9).alias("q_value_validation"), "score_validation", place.alias("position")
    )


@query("status_counts", sql(SCAN, "SELECT status, count(*) AS n FROM scan GROUP BY 1"))
def status_counts(spark, sf):
    return inference.count_by(w.scan_rows(spark, sf), "status")


CONSENSUS_VIEWS = """
anchored AS (SELECT *, max(candidate_tier) FILTER (track = 'primary_strict') OVER (PARTITION BY restart_id, context_scope, y_col, spec_id, key_factor, control_set) AS anchor FROM top),
cons AS (SELECT * EXCLUDE (candidate_tier), candidate_tier AS candidate_tier_raw,
   CASE WHEN anchor IS NULL THEN 'no_anchor_track' WHEN anchor IN ('validated_candidate', 'support_candidate') THEN 'pass' ELSE 'anchor_below_threshold' END AS track_consensus_status FROM anchored),
consensus AS (SELECT *, CAST(track_consensus_status = 'pass' AS INTEGER) AS track_consensus_anchor_pass,
   CAST(candidate_tier_raw = 'validated_candidate' AND track_consensus_status <> 'pass' AS INTEGER) AS track_consensus_demoted,
   CASE WHEN candidate_tier_raw = 'validated_candidate' AND track_consensus_status <> 'pass' THEN 'support_candidate' ELSE candidate_tier_raw END AS candidate_tier FROM cons)"""
CONSENSUS = f"{TOP},{CONSENSUS_VIEWS}"


def _consensus(spark, sf):
    return inference.track_consensus(w.top_rows(spark, sf), anchor_track="primary_strict")


@query("track_consensus", sql(CONSENSUS, """
SELECT restart_id, candidate_id, candidate_tier_raw, track_consensus_status, track_consensus_demoted, candidate_tier FROM consensus"""))
def track_consensus(spark, sf):
    return _consensus(spark, sf).select(
        "restart_id", "candidate_id", "candidate_tier_raw", "track_consensus_status", "track_consensus_demoted", "candidate_tier"
    )


@query("track_consensus_summary", sql(CONSENSUS, """
, g AS (SELECT max(track_consensus_anchor_pass) AS ok, sum(track_consensus_demoted) AS dem FROM consensus GROUP BY restart_id, context_scope, y_col, spec_id, key_factor, control_set)
SELECT count(*) AS n_groups, CAST(sum(ok) AS BIGINT) AS n_groups_pass_anchor, CAST(sum(dem) AS BIGINT) AS n_rows_demoted_from_validated FROM g"""))
def track_consensus_summary(spark, sf):
    return inference.consensus_summary(_consensus(spark, sf))


@query("restart_inference", sql(CONSENSUS, """
, agg AS (SELECT candidate_id, min(y_col) AS y_col, min(fdr_family_id) AS fdr_family_id, arg_min(track_consensus_anchor_pass, restart_id) AS anchor_pass,
   max(CAST(status_discovery = 'ok' AS INTEGER)) AS d_ok, count(*) FILTER (status_validation = 'ok' AND p_boot_validation IS NOT NULL) AS n_ok,
   median(p_boot_validation) FILTER (status_validation = 'ok') AS p_med, median(beta_validation) AS b_med,
   max(p_boot_validation) FILTER (status_validation = 'ok') AS p_max, count(DISTINCT restart_id) AS n_present,
   count(*) FILTER (candidate_tier = 'validated_candidate') AS nv, count(*) FILTER (candidate_tier IN ('validated_candidate', 'support_candidate')) AS ns FROM consensus GROUP BY 1),
c AS (SELECT * FROM agg WHERE n_ok > 0),
raw AS (SELECT candidate_id, fdr_family_id, p_med, p_med * count(*) OVER (PARTITION BY fdr_family_id) / count(*) OVER (PARTITION BY fdr_family_id ORDER BY p_med RANGE UNBOUNDED PRECEDING) AS raw FROM c),
qq AS (SELECT candidate_id, least(1.0::DOUBLE, min(raw) OVER (PARTITION BY fdr_family_id ORDER BY p_med DESC RANGE UNBOUNDED PRECEDING)) AS q FROM raw),
j AS (SELECT a.*, q, n_ok > 0 AND p_med <= 0.05 AS pp, coalesce(q <= 0.10, false) AS qp, y_col = 'y_all' AS el FROM agg a LEFT JOIN qq USING (candidate_id)),
t AS (SELECT *, CASE WHEN pp AND qp AND el THEN 'validated_candidate' WHEN d_ok = 1 THEN 'support_candidate' ELSE 'exploratory' END AS base FROM j),
f AS (SELECT *, CASE WHEN NOT el THEN 'exploratory' ELSE base END AS raw_tier FROM t)
SELECT candidate_id, n_ok AS n_validation_ok_restarts, round(p_med, 9) AS p_boot_validation, round(p_max, 9) AS p_boot_validation_max, round(b_med, 9) AS beta_validation,
   round(q, 9) AS q_value_validation, n_present AS n_restarts_present, round(n_present / 5.0::DOUBLE, 6) AS presence_rate, round(nv / 5.0::DOUBLE, 6) AS validated_rate_restart,
   round(ns / 5.0::DOUBLE, 6) AS support_or_better_rate_restart, CAST(coalesce(pp, false) AS INTEGER) AS validation_pass_p_raw, CAST(coalesce(pp AND el, false) AS INTEGER) AS validation_pass_p,
   CAST(el AS INTEGER) AS confirmatory_eligible, CAST(raw_tier <> base AS INTEGER) AS confirmatory_policy_demoted, raw_tier AS candidate_tier_raw,
   CASE WHEN anchor_pass = 0 AND raw_tier = 'validated_candidate' THEN 'support_candidate' ELSE raw_tier END AS candidate_tier FROM f"""))
def restart_inference(spark, sf):
    out = inference.restart_inference(_consensus(spark, sf), n_restarts=5, confirmatory_y=("y_all",), nonconfirmatory_max_tier="exploratory")
    return _round(out, "p_boot_validation", "p_boot_validation_max", "beta_validation", "q_value_validation", digits=9).select(
        "candidate_id", "n_validation_ok_restarts", "p_boot_validation", "p_boot_validation_max", "beta_validation", "q_value_validation",
        "n_restarts_present", "presence_rate", "validated_rate_restart", "support_or_better_rate_restart",
        F.coalesce("validation_pass_p_raw", F.lit(0)).alias("validation_pass_p_raw"), F.coalesce("validation_pass_p", F.lit(0)).alias("validation_pass_p"),
        "confirmatory_eligible", "confirmatory_policy_demoted", "candidate_tier_raw", "candidate_tier",
    )


@query("restart_stability", sql(TOP, """
, a AS (SELECT candidate_id, count(DISTINCT restart_id) AS np, count(*) AS n, count(*) FILTER (candidate_tier = 'validated_candidate') AS nv,
   count(*) FILTER (candidate_tier = 'support_candidate') AS ns, count(*) FILTER (candidate_tier = 'exploratory') AS ne,
   count(*) FILTER (beta_validation > 0) AS vp, count(*) FILTER (beta_validation < 0) AS vn, count(*) FILTER (beta_discovery > 0) AS dp, count(*) FILTER (beta_discovery < 0) AS dn FROM top GROUP BY 1),
tc AS (SELECT candidate_id, candidate_tier, count(*) AS k, min(restart_id) AS seen FROM top GROUP BY ALL),
m AS (SELECT candidate_id, first(candidate_tier ORDER BY k DESC, seen) AS modal_tier, max(k) AS mk FROM tc GROUP BY 1),
r AS (SELECT a.*, modal_tier, mk, np / 5.0::DOUBLE AS pr, (nv + ns) / 5.0::DOUBLE AS sr, mk::DOUBLE / n AS mr,
   CASE WHEN vp + vn > 0 THEN greatest(vp, vn)::DOUBLE / (vp + vn) ELSE 1.0::DOUBLE END AS sv, CASE WHEN dp + dn > 0 THEN greatest(dp, dn)::DOUBLE / (dp + dn) ELSE 1.0::DOUBLE END AS sd FROM a JOIN m USING (candidate_id))
SELECT candidate_id, np AS n_restarts_present, nv AS n_validated, nv + ns AS n_support_or_better, round(pr, 6) AS presence_rate, modal_tier, round(mr, 6) AS modal_tier_rate,
   round(sv, 6) AS beta_validation_sign_consistency, round(0.35::DOUBLE * pr + 0.35::DOUBLE * sr + 0.20::DOUBLE * mr + 0.10::DOUBLE * greatest(sv, sd), 6) AS stability_score FROM r"""))
def restart_stability(spark, sf):
    out = inference.restart_stability(w.top_rows(spark, sf), n_restarts=5)
    return out.select(
        "candidate_id", "n_restarts_present", "n_validated", "n_support_or_better", "presence_rate", "modal_tier", "modal_tier_rate",
        "beta_validation_sign_consistency", "stability_score",
    )


@query("restart_summary", sql(TOP, """
, p AS (SELECT candidate_id, count(DISTINCT restart_id) AS seen, count(DISTINCT candidate_tier) AS t,
   count(*) FILTER (candidate_tier IN ('validated_candidate', 'support_candidate')) AS s, count(*) FILTER (candidate_tier = 'validated_candidate') AS v FROM top GROUP BY 1)
SELECT count(*) FILTER (t = 1 AND seen = 5) AS n_tier_consistent_all_restarts, count(*) FILTER (s = 5 AND seen = 5) AS n_support_or_better_all_restarts,
   count(*) FILTER (v > 0) AS n_validated_any_restart FROM p"""))
def restart_summary(spark, sf):
    return inference.restart_summary(w.top_rows(spark, sf), n_restarts=5)


@query("top_validated", sql(TOP, """
SELECT restart_id, candidate_id, round(q_value_validation, 9) AS q_value_validation, round(p_boot_validation, 9) AS p_boot_validation FROM top
WHERE candidate_tier = 'validated_candidate' ORDER BY q_value_validation, p_boot_validation, candidate_id, restart_id LIMIT 10"""))
def top_validated(spark, sf):
    out = inference.top_validated(w.top_rows(spark, sf), 10)
    return out.select("restart_id", "candidate_id", F.round("q_value_validation", 9).alias("q_value_validation"), F.round("p_boot_validation", 9).alias("p_boot_validation"))


SHORT_ORDER = """CASE candidate_tier WHEN 'validated_candidate' THEN 0 ELSE 1 END, coalesce(q_value_validation, 'inf'::DOUBLE), coalesce(p_boot_validation, 'inf'::DOUBLE),
   coalesce(p_boot_discovery, 'inf'::DOUBLE), -abs(coalesce(beta_validation, beta_discovery, 0)), candidate_id, restart_id"""


@query("shortlist", sql(TOP, f"""
, e AS (SELECT *, row_number() OVER (ORDER BY {SHORT_ORDER}) AS pos, str_split(key_factor, '__') AS p FROM top WHERE candidate_tier <> 'exploratory'),
s AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN p[i] IN ('pa', 'ext') THEN p[i] || '__' || p[i + 1] END FOR i IN range(1, len(p))], lambda x: x IS NOT NULL))), '|') AS sig FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY pos) AS rn FROM s)
SELECT pos AS shortlist_rank, sig AS shortlist_signature, key_factor AS feature_name, candidate_tier, candidate_id FROM f WHERE rn = 1 ORDER BY pos LIMIT 8"""))
def shortlist_query(spark, sf):
    out = shortlist.shortlist(w.top_rows(spark, sf), max_features=8, tie_break=("restart_id",))
    return out.select("shortlist_rank", "shortlist_signature", "feature_name", "candidate_tier", "candidate_id")


@query("escalation_shortlist", sql(TOP, """
, b AS (SELECT *, greatest(greatest(0.0::DOUBLE, p_boot_validation - 0.05::DOUBLE) / 0.30::DOUBLE, greatest(0.0::DOUBLE, q_value_validation - 0.10::DOUBLE) / 0.40::DOUBLE) AS closeness FROM top
   WHERE restart_id = (SELECT min(restart_id) FROM top) AND status_validation = 'ok' AND candidate_tier <> 'validated_candidate'
     AND NOT (p_boot_validation <= 0.05 AND q_value_validation <= 0.10) AND p_boot_validation <= 0.05::DOUBLE + 0.30::DOUBLE AND q_value_validation <= 0.10::DOUBLE + 0.40::DOUBLE),
e AS (SELECT *, row_number() OVER (ORDER BY closeness, q_value_validation, p_boot_validation, -abs(coalesce(beta_validation, 0)), candidate_id) AS pos,
   array_to_string(list_sort(list_distinct(regexp_extract_all(key_factor, '(?:pa|ext)__[a-zA-Z0-9_]+'))), '|') AS sig FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY pos) AS rn FROM e)
SELECT pos AS shortlist_rank, sig AS shortlist_signature, key_factor AS feature_name, candidate_id, round(closeness, 9) AS closeness FROM f WHERE rn = 1 ORDER BY pos LIMIT 6"""))
def escalation_shortlist(spark, sf):
    out = shortlist.escalation_shortlist(w.top_rows(spark, sf), p_margin=0.30, q_margin=0.40, max_candidates=6)
    return out.select("shortlist_rank", "shortlist_signature", "feature_name", "candidate_id", F.round("closeness", 9).alias("closeness"))


@query("borderline_candidates", sql(TOP, """
SELECT restart_id, candidate_id, round(greatest(greatest(0.0::DOUBLE, p_boot_validation - 0.05::DOUBLE) / 0.30::DOUBLE, greatest(0.0::DOUBLE, q_value_validation - 0.10::DOUBLE) / 0.40::DOUBLE), 9) AS closeness
FROM top WHERE restart_id = (SELECT min(restart_id) FROM top) AND status_validation = 'ok' AND candidate_tier <> 'validated_candidate'
  AND NOT (p_boot_validation <= 0.05 AND q_value_validation <= 0.10) AND p_boot_validation <= 0.05::DOUBLE + 0.30::DOUBLE AND q_value_validation <= 0.10::DOUBLE + 0.40::DOUBLE"""))
def borderline_candidates(spark, sf):
    out = shortlist.borderline(w.top_rows(spark, sf), p_threshold=0.05, q_threshold=0.10, p_margin=0.30, q_margin=0.40)
    return out.select("restart_id", "candidate_id", F.round("closeness", 9).alias("closeness"))


# ---- explorer -------------------------------------------------------------------------------

COMBO_SQL = INFERENCE + """,
combos AS (SELECT concat_ws('|', track, context_scope, y_col, spec_id, key_factor) AS combo_id, track, context_scope, y_col, spec_id, key_factor,
   count(*) AS n_rows, count(DISTINCT run_id) AS n_runs, min(q) AS q_best, median(q) AS q_median, min(p) AS p_best, median(p) AS p_median, avg(restart_rate) AS restart_mean,
   count(*) FILTER (q <= 0.1)::DOUBLE / count(*) AS strong_share_q, count(*) FILTER (tier = 'validated_candidate')::DOUBLE / count(*) AS validated_share,
   count(*) FILTER (tier IN ('validated_candidate', 'support_candidate'))::DOUBLE / count(*) AS support_or_better_share FROM fitted GROUP BY ALL),
factors AS (SELECT key_factor, count(*) AS n_rows, count(DISTINCT run_id) AS n_runs, min(q) AS q_best, median(q) AS q_median, min(p) AS p_best,
   count(*) FILTER (q <= 0.1)::DOUBLE / count(*) AS strong_share_q, count(*) FILTER (tier = 'validated_candidate')::DOUBLE / count(*) AS validated_share FROM fitted GROUP BY 1),
runs AS (SELECT run_id, mode, min(q) AS best_q_validation, min(p) AS best_p_validation, count(*) FILTER (tier = 'validated_candidate') AS validated_candidate_count,
   count(*) FILTER (tier IN ('validated_candidate', 'support_candidate')) AS support_candidate_count, count(*) FILTER (q <= 0.1) AS strong_row_count_q,
   count(DISTINCT key_factor) AS key_factor_count FROM fitted GROUP BY ALL)"""
COMBO_NUMBERS = ("q_best", "q_median", "p_best", "p_median", "restart_mean", "strong_share_q", "validated_share", "support_or_better_share")


def _rows(spark, sf, q=0.10):
    return explore.usable_rows(w.inference_rows(spark, sf), q_threshold=q)


@query("explorer_combos", sql(COMBO_SQL, "SELECT combo_id, track, context_scope, y_col, spec_id, key_factor, n_rows, n_runs, " + ", ".join(f"round({c}, 9) AS {c}" for c in COMBO_NUMBERS) + " FROM combos"))
def explorer_combos(spark, sf):
    return _round(explore.combinations(_rows(spark, sf)), *COMBO_NUMBERS, digits=9)


@query("explorer_factors", sql(COMBO_SQL, "SELECT key_factor, n_rows, n_runs, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("q_best", "q_median", "p_best", "strong_share_q", "validated_share")) + " FROM factors"))
def explorer_factors(spark, sf):
    return _round(explore.factors(_rows(spark, sf)), "q_best", "q_median", "p_best", "strong_share_q", "validated_share", digits=9)


@query("explorer_top_factors", sql(COMBO_SQL, "SELECT key_factor, n_runs FROM factors ORDER BY coalesce(q_best, 9.99), n_runs DESC, strong_share_q DESC, key_factor LIMIT 15"))
def explorer_top_factors(spark, sf):
    return explore.best_first(explore.factors(_rows(spark, sf)), 15, "key_factor").select("key_factor", "n_runs")


@query("explorer_runs", sql(COMBO_SQL, "SELECT run_id, mode, round(best_q_validation, 9) AS best_q_validation, round(best_p_validation, 9) AS best_p_validation, validated_candidate_count, support_candidate_count, strong_row_count_q, key_factor_count FROM runs"))
def explorer_runs(spark, sf):
    return _round(explore.runs(_rows(spark, sf)), "best_q_validation", "best_p_validation", digits=9)


@query("explorer_totals", sql(COMBO_SQL, """
, s AS (SELECT count(DISTINCT run_id) AS strong_runs FROM fitted WHERE q <= 0.1),
a AS (SELECT count(DISTINCT run_id) AS r, count(*) AS n FROM inference)
SELECT a.r AS runs_with_inference, a.n AS candidate_rows, (SELECT count(*) FROM fitted) AS validation_ok_rows, (SELECT count(*) FROM fitted WHERE q <= 0.1) AS strong_rows_q,
   a.r - (SELECT count(best_q_validation) FROM runs) AS best_q_missing_runs, a.r - (SELECT count(best_p_validation) FROM runs) AS best_p_missing_runs,
   (SELECT count(*) FROM factors) AS distinct_key_factors, (SELECT count(*) FROM combos) AS distinct_combinations, strong_runs FROM a, s"""))
def explorer_totals(spark, sf):
    return explore.totals(w.inference_rows(spark, sf), _rows(spark, sf))


@query("explorer_mode_scope", sql(INFERENCE, "SELECT run_id, count(*) AS n FROM inference WHERE mode LIKE '%singlex%' GROUP BY 1"))
def explorer_mode_scope(spark, sf):
    rows = w.inference_rows(spark, sf)
    return rows.where(explore.mode_in_scope(F.col("mode"), "singlex")).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("combination_search", sql(COMBO_SQL, """
SELECT combo_id, n_runs, round(q_best, 9) AS q_best FROM combos WHERE lower(key_factor) LIKE '%promo%' OR lower(track || ' ' || context_scope || ' ' || spec_id) LIKE '%promo%'
ORDER BY n_runs DESC, coalesce(q_best, 9.99), combo_id LIMIT 12"""))
def combination_search(spark, sf):
    out = explore.search_combinations(explore.combinations(_rows(spark, sf)), "promo", "n_runs_desc", 12)
    return out.select("combo_id", "n_runs", F.round("q_best", 9).alias("q_best"))


@query("probability_histogram", sql(INFERENCE, """
, bins AS (SELECT * FROM (VALUES (0, '<=0.01', -1e9, 0.01), (1, '0.01-0.05', 0.01, 0.05), (2, '0.05-0.10', 0.05, 0.10), (3, '0.10-0.20', 0.10, 0.20), (4, '0.20-0.50', 0.20, 0.50), (5, '0.50-1.00', 0.50, 1.00), (6, '>1.00', 1.00, 1e9)) v(position, bin, lo, hi))
SELECT CAST(position AS INTEGER) AS position, bin, (SELECT count(*) FROM fitted WHERE q > lo::DOUBLE AND q <= hi::DOUBLE) AS n FROM bins"""))
def probability_histogram(spark, sf):
    return explore.probability_histogram(_rows(spark, sf), "q")


STRONG = INFERENCE + """,
strong AS (SELECT DISTINCT run_id, key_factor FROM fitted WHERE q <= 0.10::DOUBLE),
base AS (SELECT count(DISTINCT run_id) AS n FROM strong),
sup AS (SELECT key_factor, count(*) AS n FROM strong GROUP BY 1),
co AS (SELECT a.key_factor AS fa, b.key_factor AS fb, count(*) AS co_runs FROM strong a JOIN strong b ON a.run_id = b.run_id AND a.key_factor < b.key_factor GROUP BY ALL),
pairs AS (SELECT fa, fb, co_runs, x.n AS sa, y.n AS sb, base.n AS base, co_runs::DOUBLE / (x.n + y.n - co_runs) AS jaccard FROM co JOIN sup x ON fa = x.key_factor JOIN sup y ON fb = y.key_factor, base)"""


@query("affinity_pairs", sql(STRONG, """
SELECT fa AS key_factor_a, fb AS key_factor_b, co_runs, round(co_runs::DOUBLE / base, 9) AS run_share, round(jaccard, 9) AS jaccard,
   round(CAST(co_runs * base AS DOUBLE) / (sa * sb), 9) AS lift, sa AS support_a_runs, sb AS support_b_runs, base AS base_runs FROM pairs"""))
def affinity_pairs(spark, sf):
    out = explore.affinity_pairs(explore.strong_factors(_rows(spark, sf)))
    return _round(out, "run_share", "jaccard", "lift", digits=9)


@query("factor_clusters", "WITH RECURSIVE" + sql(STRONG, """
, edges AS (SELECT fa, fb FROM pairs WHERE co_runs >= CASE WHEN base >= 5 THEN 2 ELSE 1 END AND jaccard >= 0.35),
both_ways AS (SELECT fa, fb FROM edges UNION SELECT fb, fa FROM edges),
reach AS (SELECT fa AS node, fa AS other FROM both_ways UNION SELECT r.node, b.fb FROM reach r JOIN both_ways b ON r.other = b.fa),
comp AS (SELECT node, min(other) AS c FROM reach GROUP BY 1),
mem AS (SELECT c, s.key_factor, count(*) AS n FROM strong s JOIN comp ON s.key_factor = node GROUP BY ALL),
lists AS (SELECT c, count(*) AS n_factors, list(key_factor ORDER BY n DESC, key_factor) AS fs FROM mem GROUP BY 1),
supp AS (SELECT c, count(DISTINCT run_id) AS run_support FROM strong s JOIN comp ON s.key_factor = node GROUP BY 1)
SELECT array_to_string(fs[1:3], ' | ') AS cluster_signature, n_factors, run_support, array_to_string(fs, '|') AS factors FROM lists JOIN supp USING (c)""")[4:])
def factor_clusters(spark, sf):
    strong = explore.strong_factors(_rows(spark, sf))
    return explore.factor_clusters(strong, explore.affinity_pairs(strong))


@query("similar_combos", sql(COMBO_SQL, """
, b AS (SELECT * FROM combos WHERE combo_id = 'primary_strict|all_contexts|y_all|spec_r|pa__promo')
SELECT c.combo_id, round((c.key_factor = b.key_factor)::INT * 2.0::DOUBLE + (c.track = b.track)::INT * 0.6::DOUBLE + (c.context_scope = b.context_scope)::INT * 0.5::DOUBLE + (c.spec_id = b.spec_id)::INT * 0.4::DOUBLE
   + greatest(0.0::DOUBLE, 1 - coalesce(abs(b.q_best - c.q_best), 1.0::DOUBLE) * 4.0::DOUBLE) + greatest(0.0::DOUBLE, 1 - coalesce(abs(b.strong_share_q - c.strong_share_q), 1.0::DOUBLE) * 2.0::DOUBLE), 9) AS similarity
FROM combos c, b WHERE c.combo_id <> b.combo_id ORDER BY 2 DESC, 1 LIMIT 6"""))
def similar_combos(spark, sf):
    out = explore.similar_combinations(explore.combinations(_rows(spark, sf)), "primary_strict|all_contexts|y_all|spec_r|pa__promo")
    return _round(out, "similarity", digits=9)


POINTS = COMBO_SQL + """,
rm AS (SELECT run_id, mode, avg(q) AS best_q_validation, avg(p) AS best_p_validation FROM fitted GROUP BY ALL),
points AS (SELECT run_id, mode, greatest(0, best_q_validation) AS q, greatest(0, best_p_validation) AS p FROM rm WHERE best_q_validation IS NOT NULL AND best_p_validation IS NOT NULL)"""


def _points(spark, sf):
    means = _rows(spark, sf).groupBy("run_id", "mode").agg(F.avg("q").alias("best_q_validation"), F.avg("p").alias("best_p_validation"))
    return explore.joint_points(means)


@query("similar_runs", sql(POINTS, """
, b AS (SELECT * FROM points WHERE run_id = 'r0__nooption_baseline')
SELECT x.run_id, round(1.0::DOUBLE / (1.0::DOUBLE + sqrt(power(x.q - b.q, 2) + power(x.p - b.p, 2)) * 12), 9) AS similarity FROM points x, b WHERE x.run_id <> b.run_id ORDER BY 2 DESC, 1 LIMIT 6"""))
def similar_runs(spark, sf):
    return _round(explore.similar_runs(_points(spark, sf), "r0__nooption_baseline"), "similarity", digits=9)


@query("nearest_run", sql(POINTS, "SELECT arg_min(run_id, abs(q - 0.3::DOUBLE)) AS run_id FROM points"))
def nearest_run(spark, sf):
    return explore.nearest_run(_points(spark, sf), 0.3)


@query("joint_marginals", sql(POINTS, """
, e AS (SELECT greatest(0.10::DOUBLE, least(1.0::DOUBLE, greatest(greatest(max(q), 1e-9::DOUBLE) * 1.05::DOUBLE, 0.10::DOUBLE * 1.2::DOUBLE))) AS xq,
        greatest(0.10::DOUBLE, least(1.0::DOUBLE, greatest(greatest(max(p), 1e-9::DOUBLE) * 1.05::DOUBLE, 0.05::DOUBLE * 1.2::DOUBLE))) AS xp FROM points),
b AS (SELECT CAST(least(9, floor(least(xq, q) / xq * 10)) AS INTEGER) AS qb, CAST(least(9, floor(least(xp, p) / xp * 10)) AS INTEGER) AS pb FROM points, e)
SELECT 'q' AS axis, qb AS bin, count(*) AS n FROM b WHERE pb = 9 GROUP BY ALL UNION ALL SELECT 'p', pb, count(*) FROM b GROUP BY ALL"""))
def joint_marginals(spark, sf):
    return explore.marginal_counts(explore.joint_bins(_points(spark, sf)), p_bin=9)


# ---- review ---------------------------------------------------------------------------------

@query("run_review", sql(INFERENCE, """
SELECT run_id, count(*) FILTER (tier = 'validated_candidate') AS validated_candidate_count, count(*) FILTER (tier = 'support_candidate') AS support_candidate_count,
   count(*) FILTER (tier = 'exploratory') AS exploratory_count, round(min(p), 9) AS best_p_validation, round(min(q), 9) AS best_q_validation,
   coalesce(first(candidate_id ORDER BY p, candidate_id) FILTER (p IS NOT NULL), '') AS best_p_candidate_id FROM fitted GROUP BY 1"""))
def run_review(spark, sf):
    return _round(review.run_review(w.inference_rows(spark, sf)), "best_p_validation", "best_q_validation", digits=9)


BRANCH = INFERENCE + """,
metrics AS (SELECT run_id, count(*) AS n_rows, count(*) FILTER (status_validation = 'ok') AS n_ok, count(*) FILTER (candidate_tier = 'validated_candidate') AS nv,
   count(*) FILTER (candidate_tier = 'validated_candidate' AND track = 'primary_strict') AS nvp, count(*) FILTER (candidate_tier = 'support_candidate') AS ns,
   min(p) FILTER (status_validation = 'ok') AS mp, min(q) FILTER (status_validation = 'ok') AS mq,
   coalesce(first(candidate_id ORDER BY coalesce(q, 1e9), coalesce(p, 1e9), candidate_id) FILTER (status_validation = 'ok' AND (q IS NOT NULL OR p IS NOT NULL)), '') AS best FROM inference GROUP BY 1),
stab AS (SELECT run_id, candidate_id, avg(restart_rate) AS vr, max(restart_rate) AS sr FROM inference GROUP BY ALL)"""


def _stability(spark, sf):
    # Nearly every line is a candidate of its own in its run: little combines before the shuffle, so the fold comes after it.
    rows = w.spread(w.inference_rows(spark, sf).select("run_id", "candidate_id", "validated_rate_restart"), w.n_lines(spark, sf), "run_id", "candidate_id")
    return rows.groupBy("run_id", "candidate_id").agg(
        F.round(F.avg("validated_rate_restart"), 9).alias("validated_rate"), F.round(F.max("validated_rate_restart"), 9).alias("support_or_better_rate")
    )


@query("branch_metrics", sql(BRANCH, """
SELECT run_id, n_rows, n_ok AS n_validation_ok_rows, nv AS n_validated_rows, nvp AS n_validated_rows_primary, ns AS n_support_rows, round(mp, 9) AS min_p_validation, round(mq, 9) AS min_q_validation, best AS best_candidate_id FROM metrics"""))
def branch_metrics(spark, sf):
    out = _round(review.branch_metrics(w.inference_rows(spark, sf)), "min_p_validation", "min_q_validation", digits=9)
    return out.drop("n_exploratory_rows", "best_track", "best_y_col")


@query("stability_metrics", sql(BRANCH, """
, r AS (SELECT run_id, candidate_id, round(vr, 9) AS vr, round(sr, 9) AS sr FROM stab)
SELECT run_id, count(*) AS n_candidates, max(vr) AS max_validated_rate, max(sr) AS max_support_or_better_rate, first(candidate_id ORDER BY vr DESC, candidate_id) AS top_validated_candidate_id,
   first(candidate_id ORDER BY sr DESC, candidate_id) AS top_support_candidate_id FROM r GROUP BY 1"""))
def stability_metrics(spark, sf):
    return review.stability_metrics(_stability(spark, sf))


@query("restart_review", sql(BRANCH, """
SELECT run_id, count(*) AS restart_rows, round(max(round(vr, 9)), 6) AS restart_validated_rate_max, round(avg(round(vr, 9)), 6) AS restart_validated_rate_mean FROM stab GROUP BY 1"""))
def restart_review(spark, sf):
    return _round(review.restart_review(_stability(spark, sf)), "restart_validated_rate_max", "restart_validated_rate_mean")


def _pair_id():
    return F.regexp_extract("run_id", r"^(r\d+)__", 1)


@query("direction_review", sql(BRANCH, """
, sm AS (SELECT run_id, count(*) AS nc, max(round(vr, 9)) AS mv FROM stab GROUP BY 1),
br AS (SELECT regexp_extract(run_id, '^(r\\d+)__', 1) AS pair_id, CASE WHEN run_id LIKE '%nooption_baseline' THEN 'nooption' ELSE 'singlex' END AS branch, m.*, nc, mv,
   CASE WHEN n_rows % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM metrics m JOIN sm USING (run_id) WHERE run_id LIKE '%__nooption_baseline' OR run_id LIKE '%__singlex'),
g AS (SELECT pair_id, min(CAST(status = 'ok' AS INTEGER)) AS ao, coalesce(min(CAST(n_rows > 0 AND (mp IS NOT NULL OR mq IS NOT NULL) AND nc > 0 AS INTEGER)) FILTER (status = 'ok'), 0) AS rf,
   coalesce(max(CAST(nv + ns > 0 AND n_rows % 2 = 0 AS INTEGER)) FILTER (branch = 'singlex'), 0) AS co, coalesce(max(CAST(nvp > 0 AS INTEGER)) FILTER (branch = 'nooption'), 0) AS pv,
   coalesce(max(CAST(mq <= 0.1 AS INTEGER)) FILTER (branch = 'nooption'), 0) AS qg, coalesce(max(CAST(mv >= 0.5 AS INTEGER)) FILTER (branch = 'nooption'), 0) AS rg FROM br GROUP BY 1)
SELECT pair_id, ao AS all_children_ok, rf AS required_fields_present, co AS singlex_track_consensus_check_pass, pv AS nooption_primary_validated_gate_pass, qg AS nooption_q_gate_pass,
   rg AS nooption_restart_validated_rate_gate_pass, least(pv, qg, rg) AS nooption_promotion_gate_pass, least(ao, rf, co, pv, qg, rg) AS primary_objective_gate_pass FROM g"""))
def direction_review(spark, sf):
    rows = w.inference_rows(spark, sf).where("run_id like '%\\_\\_nooption_baseline' or run_id like '%\\_\\_singlex'")
    stab = review.stability_metrics(_stability(spark, sf)).select("run_id", "n_candidates", "max_validated_rate")
    branches = review.branch_metrics(rows).join(stab, "run_id").withColumns(
        {
            "pair_id": _pair_id(),
            "branch": F.when(F.endswith("run_id", F.lit("nooption_baseline")), "nooption").otherwise("singlex"),
            "status": F.when(F.col("n_rows") % 5 == 0, "failed").otherwise("ok"),
            "top_rows_inference": F.col("n_rows"),
            "consensus_enforced": (F.col("n_rows") % 2 == 0).cast("int"),
        }
    )
    return review.direction_review(branches)


@query("branch_compare", sql(BRANCH, """
, sm AS (SELECT run_id, max(round(vr, 9)) AS mv FROM stab GROUP BY 1),
fit AS (SELECT run_id, count(*) FILTER (tier = 'validated_candidate') AS fv, min(q) AS fq FROM fitted GROUP BY 1),
br AS (SELECT regexp_extract(run_id, '^(r\\d+)__', 1) AS pair_id, run_id, fv, fq, mv, n_rows FROM metrics JOIN sm USING (run_id) JOIN fit USING (run_id)),
j AS (SELECT n.pair_id, n.fv, n.fq, n.mv, n.n_rows % 3 <> 0 AS ng, s.n_rows % 3 <> 0 AS sg, s.n_rows % 2 = 0 AS cons, n.n_rows % 4 <> 0 AS nst, s.n_rows % 4 <> 0 AS sst FROM br n JOIN br s USING (pair_id) WHERE n.run_id LIKE '%\\_\\_nooption_baseline' ESCAPE '\\' AND s.run_id LIKE '%\\_\\_singlex' ESCAPE '\\')
SELECT pair_id, CAST(nst AND sst AS INTEGER) AS both_succeeded, CAST(ng AND sg AS INTEGER) AS all_governance_pass, CAST(fv > 0 AS INTEGER) AS nooption_primary_validated_gate_pass, CAST(fq <= 0.1 AS INTEGER) AS nooption_q_gate_pass,
   CAST(mv >= 0.5 AS INTEGER) AS nooption_restart_validated_rate_gate_pass, CAST(ng AND sg AND fv > 0 AND fq <= 0.1 AND mv >= 0.5 AS INTEGER) AS nooption_promotion_gate_pass,
   CAST(nst AND sst AND ng AND sg AND cons AND fv > 0 AND fq <= 0.1 AND mv >= 0.5 AS INTEGER) AS primary_objective_gate_pass FROM j"""))
def branch_compare(spark, sf):
    rows = w.inference_rows(spark, sf)
    n = F.col("n_rows")
    reviews = (
        review.run_review(rows)
        .join(rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows")), "run_id")
        .join(review.restart_review(_stability(spark, sf)), "run_id")
        .select(
            _pair_id().alias("pair_id"), "run_id", "validated_candidate_count", "best_q_validation", "restart_validated_rate_max",
            F.when(n % 4 == 0, "failed").otherwise("succeeded").alias("state"), (n % 3 != 0).cast("int").alias("validation_used_for_search_false"),
            (n % 3 != 0).cast("int").alias("candidate_pool_locked_true"), (n % 2 == 0).cast("int").alias("track_consensus_enforced"),
        )
    )

    def side(suffix, prefix):
        part = reviews.where(F.endswith("run_id", F.lit(suffix)))
        return part.select("pair_id", *[F.col(c).alias(f"{prefix}_{c}") for c in part.columns if c != "pair_id"])

    pairs = side("__nooption_baseline", "no").join(side("__singlex", "sx"), "pair_id")
    return review.compare_branches(pairs).drop("nooption_governance_pass", "singlex_governance_pass", "singlex_track_consensus_check_pass")


@query("branch_deltas", sql(BRANCH, """
, br AS (SELECT regexp_extract(run_id, '^(r\\d+)__', 1) AS pair_id, CASE WHEN run_id LIKE '%nooption_baseline' THEN 'nooption' ELSE 'singlex' END AS branch, m.* FROM metrics m WHERE run_id LIKE '%__nooption_baseline' OR run_id LIKE '%__singlex')
SELECT pair_id, count(*) AS children_count,
   CAST(coalesce(max(n_rows) FILTER (branch = 'nooption'), 0) - coalesce(max(n_rows) FILTER (branch = 'singlex'), 0) AS BIGINT) AS scan_rows_delta_nooption_minus_singlex,
   CAST(coalesce(max(n_ok) FILTER (branch = 'nooption'), 0) - coalesce(max(n_ok) FILTER (branch = 'singlex'), 0) AS BIGINT) AS top_rows_delta_nooption_minus_singlex,
   CAST(coalesce(max(nv) FILTER (branch = 'nooption'), 0) - coalesce(max(nv) FILTER (branch = 'singlex'), 0) AS BIGINT) AS validated_inference_delta_nooption_minus_singlex,
   CAST(coalesce(max(nv) FILTER (branch = 'singlex'), 0) + coalesce(max(ns) FILTER (branch = 'singlex'), 0) AS BIGINT) AS singlex_support_or_better_inference,
   min(CAST(n_rows % 7 <> 0 AS INTEGER)) AS all_branches_validation_used_for_search_false, min(CAST(n_rows % 5 <> 0 AS INTEGER)) AS all_branches_candidate_pool_locked_pre_validation FROM br GROUP BY 1"""))
def branch_deltas(spark, sf):
    rows = w.inference_rows(spark, sf).where("run_id like '%\\_\\_nooption_baseline' or run_id like '%\\_\\_singlex'")
    n = F.col("n_rows")
    branches = review.branch_metrics(rows).select(
        _pair_id().alias("pair_id"), F.when(F.endswith("run_id", F.lit("nooption_baseline")), "nooption").otherwise("singlex").alias("branch"),
        n.alias("scan_rows"), F.col("n_validation_ok_rows").alias("top_rows"), F.col("n_validated_rows").alias("validated_inference"),
        F.col("n_support_rows").alias("support_inference"), F.when(n % 7 == 0, "Yes").otherwise("0").alias("validation_used_for_search"),
        F.when(n % 5 == 0, "no").when(n % 2 == 0, "maybe").otherwise("true").alias("candidate_pool_locked_pre_validation"),
    )
    return review.branch_deltas(branches)


@query("evidence_signals", sql(BRANCH, """
, f AS (SELECT run_id, avg(q) AS q, count(*) FILTER (tier = 'validated_candidate') AS v FROM fitted GROUP BY 1),
r AS (SELECT run_id, avg(round(vr, 9)) * 1.2::DOUBLE AS m FROM stab GROUP BY 1)
SELECT run_id, CASE WHEN q IS NULL THEN 'unknown' WHEN q <= 0.1 THEN 'strong' WHEN q <= 0.2 THEN 'borderline' ELSE 'weak' END AS q_signal,
   CASE WHEN m IS NULL THEN 'unknown' WHEN m >= 0.6 THEN 'stable' WHEN m >= 0.4 THEN 'watch' ELSE 'unstable' END AS restart_signal,
   CAST(v >= 1 AND q <= 0.1 AS INTEGER) AS evidence_ok, CAST(m >= 0.6 AS INTEGER) AS stability_ok FROM f JOIN r USING (run_id)"""))
def evidence_signals(spark, sf):
    rows = _rows(spark, sf).groupBy("run_id").agg(
        F.avg("q").alias("best_q_validation"), F.count_if(F.col("tier") == "validated_candidate").alias("validated_candidate_count")
    )
    means = _stability(spark, sf).groupBy("run_id").agg((F.avg("validated_rate") * 1.2).alias("restart_validated_rate_mean"))
    return review.evidence_signals(rows.join(means, "run_id"))


@query("composite_scores", sql(BRANCH, """
, f AS (SELECT run_id, min(q) AS q, min(p) AS p, count(*) FILTER (tier = 'validated_candidate') AS v FROM fitted GROUP BY 1),
r AS (SELECT run_id, avg(round(vr, 9)) * 1.3::DOUBLE AS m FROM stab GROUP BY 1),
s AS (SELECT regexp_extract(run_id, '^(r\\d+)__', 1) AS pair_id, run_id, CASE WHEN v % 3 <> 0 THEN 4 ELSE -4 END + CASE WHEN q <= 0.1 THEN 2 ELSE 0 END + CASE WHEN p <= 0.05 THEN 1 ELSE 0 END + CASE WHEN v > 0 THEN 1 ELSE 0 END + CASE WHEN m >= 0.6 THEN 1 ELSE 0 END AS score FROM f JOIN r USING (run_id))
SELECT n.pair_id, CAST(n.score AS INTEGER) AS nooption_score, CAST(x.score AS INTEGER) AS singlex_score, CASE WHEN x.score - n.score >= 2 THEN 'singlex' WHEN x.score - n.score <= -2 THEN 'nooption' ELSE 'no clear winner' END AS winner
FROM s n JOIN s x USING (pair_id) WHERE n.run_id LIKE '%\\_\\_nooption_baseline' ESCAPE '\\' AND x.run_id LIKE '%\\_\\_singlex' ESCAPE '\\'"""))
def composite_scores(spark, sf):
    rows = review.run_review(w.inference_rows(spark, sf))
    means = _stability(spark, sf).groupBy("run_id").agg((F.avg("validated_rate") * 1.3).alias("m"))
    v = F.col("validated_candidate_count")
    scored = rows.join(means, "run_id").select(
        _pair_id().alias("pair_id"), "run_id",
        review.composite_score(v % 3 != 0, F.col("best_q_validation"), F.col("best_p_validation"), v, F.col("m")).alias("score"),
    )
    no = scored.where(F.endswith("run_id", F.lit("__nooption_baseline"))).select("pair_id", F.col("score").alias("nooption_score"))
    sx = scored.where(F.endswith("run_id", F.lit("__singlex"))).select("pair_id", F.col("score").alias("singlex_score"))
    return no.join(sx, "pair_id").withColumn("winner", review.pick_winner(F.col("nooption_score"), F.col("singlex_score")))


@query("ordered_inference", sql(TOP, """
SELECT candidate_id, restart_id, candidate_tier, CAST(row_number() OVER (PARTITION BY restart_id
ORDER BY CASE candidate_tier WHEN 'validated_candidate' THEN 0 WHEN 'support_candidate' THEN 1 ELSE 2 END, q_value_validation ASC NULLS LAST, p_boot_validation ASC NULLS LAST, abs(coalesce(beta_validation, 0)) DESC, candidate_id) AS INTEGER) AS position FROM top"""))
def ordered_inference(spark, sf):
    place = F.row_number().over(Window.partitionBy("restart_id").orderBy(*inference.inference_order()))
    return w.top_rows(spark, sf).select("candidate_id", "restart_id", "candidate_tier", place.alias("position"))


@query("ordered_stability", sql(TOP, """
, a AS (SELECT candidate_id, count(*) FILTER (candidate_tier = 'validated_candidate') AS nv, count(*) FILTER (candidate_tier <> 'exploratory') AS ns, count(DISTINCT restart_id) AS np, count(*) AS n,
   count(*) FILTER (candidate_tier = 'exploratory') AS ne, count(*) FILTER (beta_validation > 0) AS vp, count(*) FILTER (beta_validation < 0) AS vn, count(*) FILTER (beta_discovery > 0) AS dp, count(*) FILTER (beta_discovery < 0) AS dn FROM top GROUP BY 1),
r AS (SELECT candidate_id, nv, round(0.35::DOUBLE * (np / 5.0::DOUBLE) + 0.35::DOUBLE * (ns / 5.0::DOUBLE) + 0.20::DOUBLE * (greatest(nv, ns - nv, ne)::DOUBLE / n)
   + 0.10::DOUBLE * greatest(CASE WHEN vp + vn > 0 THEN greatest(vp, vn)::DOUBLE / (vp + vn) ELSE 1 END, CASE WHEN dp + dn > 0 THEN greatest(dp, dn)::DOUBLE / (dp + dn) ELSE 1 END), 6) AS s, round(ns / 5.0::DOUBLE, 6) AS sr FROM a)
SELECT candidate_id, s AS stability_score, CAST(row_number() OVER (ORDER BY s DESC, round(nv / 5.0::DOUBLE, 6) DESC, sr DESC, candidate_id) AS INTEGER) AS position FROM r"""))
def ordered_stability(spark, sf):
    out = inference.restart_stability(w.top_rows(spark, sf), n_restarts=5)
    # One row a candidate of the plan.
    place = F.row_number().over(Window.orderBy(*inference.stability_order()))
    return out.select("candidate_id", "stability_score", place.alias("position"))


@query("distribution_summary", sql(INFERENCE, """
SELECT key_factor, count(q) AS n, round(avg(q), 9) AS mean, round(quantile_cont(q, 0.025), 9) AS ci_low, round(quantile_cont(q, 0.975), 9) AS ci_high, round(coalesce(stddev_samp(q), 0), 9) AS std FROM fitted GROUP BY 1"""))
def distribution_summary(spark, sf):
    return _round(bootstrap.distribution_summary(_rows(spark, sf), ["key_factor"], "q"), "mean", "ci_low", "ci_high", "std", digits=9)


@query("explorer_top_runs", sql(COMBO_SQL, "SELECT run_id, validated_candidate_count FROM runs ORDER BY coalesce(best_q_validation, 9.99), validated_candidate_count DESC, strong_row_count_q DESC, run_id LIMIT 10"))
def explorer_top_runs(spark, sf):
    return explore.order_runs(explore.runs(_rows(spark, sf)), 10).select("run_id", "validated_candidate_count")


@query("explorer_top_pairs", sql(STRONG, """
SELECT fa AS key_factor_a, fb AS key_factor_b, co_runs FROM pairs ORDER BY co_runs DESC, jaccard DESC, CAST(co_runs * base AS DOUBLE) / (sa * sb) DESC, fa, fb LIMIT 15"""))
def explorer_top_pairs(spark, sf):
    out = explore.affinity_pairs(explore.strong_factors(_rows(spark, sf)))
    return explore.order_pairs(out, 15).select("key_factor_a", "key_factor_b", "co_runs")


@query("cluster_search")
def cluster_search(spark, sf):
    strong = explore.strong_factors(_rows(spark, sf))
    clusters = explore.factor_clusters(strong, explore.affinity_pairs(strong))
    return explore.search_clusters(clusters, "pa__", min_support=1, sort="factors_desc", n=10)


@query("consensus_written_back", sql(CONSENSUS, """
SELECT s.restart_id, s.candidate_id, s.split_role, c.candidate_tier FROM scan s JOIN consensus c USING (restart_id, candidate_id)"""))
def consensus_written_back(spark, sf):
    tiers = _consensus(spark, sf).select("restart_id", "candidate_id", "candidate_tier")
    scan = w.scan_rows(spark, sf).select("restart_id", "candidate_id", "split_role")
    return scan.join(tiers, ["restart_id", "candidate_id"])
