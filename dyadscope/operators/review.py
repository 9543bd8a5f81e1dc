"""Review of finished runs: evidence per run, comparison of two branches, promotion gates, ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.functions.numeric import as_flag, as_number
from dyadscope.operators.explore import validation_ok
from dyadscope.operators.inference import EXPLORATORY, SUPPORT, VALIDATED

Q_GATE, RESTART_GATE = 0.10, 0.50
NO_VALUE = 1e9  # where a missing q or p ranks


def _tier(name: str) -> Column:
    return F.count_if(F.lower(F.trim(F.coalesce("candidate_tier", F.lit("")))) == name)


def run_review(inference: DataFrame) -> DataFrame:
    """Per run, over fitted rows: tier counts, best p with its candidate, best q."""
    p, q = as_number("p_boot_validation"), as_number("q_value_validation")
    return inference.where(validation_ok(F.col("status_validation"))).groupBy("run_id").agg(
        _tier(VALIDATED).alias("validated_candidate_count"),
        _tier(SUPPORT).alias("support_candidate_count"),
        _tier(EXPLORATORY).alias("exploratory_count"),
        F.min(p).alias("best_p_validation"),
        F.min(q).alias("best_q_validation"),
        F.coalesce(F.min_by(F.trim("candidate_id"), F.when(p.isNotNull(), F.struct(p.alias("p"), F.trim("candidate_id").alias("c")))), F.lit("")).alias("best_p_candidate_id"),
    )


def restart_review(stability: DataFrame) -> DataFrame:
    rate = as_number("validated_rate")
    return stability.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("restart_rows"), F.max(rate).alias("restart_validated_rate_max"), F.avg(rate).alias("restart_validated_rate_mean")
    )


def branch_metrics(inference: DataFrame, primary_track: str = "primary_strict") -> DataFrame:
    """Per run: rows, fitted rows (status exactly ok), tiers, primary-track validations, best (q, p) row."""
    p, q = as_number("p_boot_validation"), as_number("q_value_validation")
    ok = F.lower(F.trim(F.coalesce("status_validation", F.lit("")))) == "ok"
    tier = F.trim(F.coalesce("candidate_tier", F.lit("")))
    rank = F.struct(F.coalesce(q, F.lit(NO_VALUE)).alias("q"), F.coalesce(p, F.lit(NO_VALUE)).alias("p"), F.col("candidate_id").alias("c"))
    usable = ok & (q.isNotNull() | p.isNotNull())
    best = F.min_by(F.struct("candidate_id", "track", "y_col"), F.when(usable, rank))
    out = inference.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(ok).alias("n_validation_ok_rows"),
        F.count_if(tier == VALIDATED).alias("n_validated_rows"),
        F.count_if((tier == VALIDATED) & (F.trim("track") == primary_track)).alias("n_validated_rows_primary"),
        F.count_if(tier == SUPPORT).alias("n_support_rows"),
        F.count_if(tier == EXPLORATORY).alias("n_exploratory_rows"),
        F.min(F.when(ok, p)).alias("min_p_validation"),
        F.min(F.when(ok, q)).alias("min_q_validation"),
        best.alias("_b"),
    )
    return out.select(
        *[c for c in out.columns if c != "_b"],
        *[F.coalesce(f"_b.{c}", F.lit("")).alias(f"best_{c}") for c in ("candidate_id", "track", "y_col")],
    )


def stability_metrics(stability: DataFrame) -> DataFrame:
    """Per run: candidates, best rates and the candidates that hold them."""
    v, s = as_number("validated_rate"), as_number("support_or_better_rate")

    def holder(rate: Column) -> Column:
        # Highest rate; among equals the smallest id.
        return F.coalesce(F.min_by("candidate_id", F.when(rate.isNotNull(), F.struct((-rate).alias("r"), F.col("candidate_id").alias("c")))), F.lit(""))

    return stability.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.max(v).alias("max_validated_rate"),
        F.max(s).alias("max_support_or_better_rate"),
        holder(v).alias("top_validated_candidate_id"),
        holder(s).alias("top_support_candidate_id"),
    )


def compare_branches(pairs: DataFrame) -> DataFrame:
    """Gates on paired runs. Columns come in two sets, prefixed no_ (no option) and sx_ (single x)."""

    def flag(c: str) -> Column:
        return F.coalesce(F.col(c).cast("int") == 1, F.lit(False))

    governed = {b: flag(f"{b}_validation_used_for_search_false") & flag(f"{b}_candidate_pool_locked_true") for b in ("no", "sx")}
    both_done = (F.lower("no_state") == "succeeded") & (F.lower("sx_state") == "succeeded")
    validated = F.coalesce("no_validated_candidate_count", F.lit(0)) > 0
    q_gate = F.coalesce(F.col("no_best_q_validation") <= Q_GATE, F.lit(False))
    restart = F.coalesce(F.col("no_restart_validated_rate_max") >= RESTART_GATE, F.lit(False))
    consensus = flag("sx_track_consensus_enforced")
    all_gov = governed["no"] & governed["sx"]
    promoted = all_gov & validated & q_gate & restart
    checks = {
        "both_succeeded": both_done,
        "nooption_governance_pass": governed["no"],
        "singlex_governance_pass": governed["sx"],
        "all_governance_pass": all_gov,
        "singlex_track_consensus_check_pass": consensus,
        "nooption_primary_validated_gate_pass": validated,
        "nooption_q_gate_pass": q_gate,
        "nooption_restart_validated_rate_gate_pass": restart,
        "nooption_promotion_gate_pass": promoted,
        "primary_objective_gate_pass": both_done & consensus & promoted,
    }
    return pairs.select("pair_id", *[c.cast("int").alias(n) for n, c in checks.items()])


def direction_review(branches: DataFrame) -> DataFrame:
    """Promotion checks per paired run from its branch rows (one row per pair and branch).

    Needs pair_id, branch ('nooption' or 'singlex'), status, top_rows_inference, consensus_enforced,
    the branch metrics and max_validated_rate / n_candidates of the stability table.
    """
    ok = F.lower(F.trim("status")) == "ok"
    complete = (
        (F.coalesce("top_rows_inference", F.lit(0)) > 0)
        & (F.col("min_p_validation").isNotNull() | F.col("min_q_validation").isNotNull())
        & (F.coalesce("n_candidates", F.lit(0)) > 0)
    )
    no, sx = F.col("branch") == "nooption", F.col("branch") == "singlex"

    def any_of(cond: Column) -> Column:
        return F.coalesce(F.max(cond.cast("int")), F.lit(0)) == 1

    retained = (F.coalesce("n_validated_rows", F.lit(0)) + F.coalesce("n_support_rows", F.lit(0))) > 0
    per = branches.groupBy("pair_id").agg(
        F.min(ok.cast("int")).alias("all_ok"),
        F.coalesce(F.min(F.when(ok, complete.cast("int"))), F.lit(0)).alias("fields"),
        any_of(sx & (F.coalesce("consensus_enforced", F.lit(0)) == 1) & retained).alias("consensus"),
        any_of(no & (F.col("n_validated_rows_primary") > 0)).alias("primary"),
        any_of(no & (F.col("min_q_validation") <= Q_GATE)).alias("q"),
        any_of(no & (F.col("max_validated_rate") >= RESTART_GATE)).alias("restart"),
    )
    promoted = F.col("primary") & F.col("q") & F.col("restart")
    done = (F.col("all_ok") == 1) & (F.col("fields") == 1) & F.col("consensus") & promoted
    return per.select(
        "pair_id",
        F.col("all_ok").alias("all_children_ok"),
        F.col("fields").alias("required_fields_present"),
        F.col("consensus").cast("int").alias("singlex_track_consensus_check_pass"),
        F.col("primary").cast("int").alias("nooption_primary_validated_gate_pass"),
        F.col("q").cast("int").alias("nooption_q_gate_pass"),
        F.col("restart").cast("int").alias("nooption_restart_validated_rate_gate_pass"),
        promoted.cast("int").alias("nooption_promotion_gate_pass"),
        done.cast("int").alias("primary_objective_gate_pass"),
    )


def branch_deltas(branches: DataFrame) -> DataFrame:
    """No-option minus single-x counts per pair, and the governance roll-up over both branches."""
    no, sx = F.col("branch") == "nooption", F.col("branch") == "singlex"

    def side(cond: Column, c: str) -> Column:
        return F.coalesce(F.max(F.when(cond, F.col(c))), F.lit(0))

    def delta(c: str) -> Column:
        return (side(no, c) - side(sx, c)).alias(f"{c}_delta_nooption_minus_singlex")

    used = F.coalesce(as_flag(F.col("validation_used_for_search")), F.lit(False))
    locked = F.coalesce(as_flag(F.col("candidate_pool_locked_pre_validation")), F.lit(True))
    return branches.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("children_count"),
        delta("scan_rows"),
        delta("top_rows"),
        delta("validated_inference"),
        (side(sx, "validated_inference") + side(sx, "support_inference")).alias("singlex_support_or_better_inference"),
        F.min((~used).cast("int")).alias("all_branches_validation_used_for_search_false"),
        F.min(locked.cast("int")).alias("all_branches_candidate_pool_locked_pre_validation"),
    )


def evidence_signals(reviews: DataFrame) -> DataFrame:
    """Signal classes per run: q strong/borderline/weak, restarts stable/watch/unstable, overall flags."""
    q, r = F.col("best_q_validation"), F.col("restart_validated_rate_mean")
    q_signal = F.when(q.isNull(), "unknown").when(q <= 0.10, "strong").when(q <= 0.20, "borderline").otherwise("weak")
    r_signal = F.when(r.isNull(), "unknown").when(r >= 0.60, "stable").when(r >= 0.40, "watch").otherwise("unstable")
    evidence = F.coalesce((F.col("validated_candidate_count") >= 1) & (q <= 0.10), F.lit(False))
    return reviews.select(
        "run_id",
        q_signal.alias("q_signal"),
        r_signal.alias("restart_signal"),
        evidence.cast("int").alias("evidence_ok"),
        F.coalesce(r >= 0.60, F.lit(False)).cast("int").alias("stability_ok"),
    )


def composite_score(governance_ok: Column, q: Column, p: Column, validated: Column, restart_mean: Column, q_threshold: float = 0.10) -> Column:
    """Governance +-4, q pass 2, p pass 1, any validated 1, stable restarts 1."""

    def point(cond: Column, n: int) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)

    return (
        F.when(governance_ok, 4).otherwise(-4)
        + point(q <= q_threshold, 2)
        + point(p <= 0.05, 1)
        + point(validated > 0, 1)
        + point(restart_mean >= 0.6, 1)
    )


def pick_winner(nooption_score: Column, singlex_score: Column) -> Column:
    diff = singlex_score - nooption_score
    return F.when(diff >= 2, "singlex").when(diff <= -2, "nooption").otherwise("no clear winner")


def job_key(seed: Column, n_bootstrap: Column) -> Column:
    return F.concat(F.lit("s"), seed.cast("string"), F.lit("_b"), n_bootstrap.cast("string"))


def ladder_jobs(spark, seeds: list[int], ladder: list[int]) -> DataFrame:
    """Every (seed, bootstrap size), ladder step by ladder step. The grid is configuration."""
    rows = [(i, int(s), int(b)) for i, (b, s) in enumerate((b, s) for b in ladder for s in seeds)]
    jobs = spark.createDataFrame(rows, "position int, seed bigint, n_bootstrap int")
    return jobs.withColumn("job_key", job_key(F.col("seed"), F.col("n_bootstrap")))


def pending_jobs(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Jobs without a finished attempt, in order; a blank key is rebuilt from seed and size."""
    key = F.trim(F.coalesce("job_key", F.lit("")))
    done = attempts.where(F.lower(F.trim("status")).isin("ok", "failed", "partial_failure")).select(
        F.when(key != "", key).otherwise(job_key(F.col("seed"), F.col("n_bootstrap"))).alias("job_key")
    )
    return jobs.join(done, "job_key", "left_anti").orderBy("position")


def ladder_summary(attempts: DataFrame, metrics: tuple[str, ...] = ("nooption_best_q_validation", "singlex_best_q_validation", "nooption_best_p_validation", "singlex_best_p_validation")) -> DataFrame:
    """Ladder totals in one row: outcomes, gate pass rate, and each best metric with its origin."""
    reviewed = F.col("gate_pass").isNotNull()
    n_review = F.count_if(reviewed)
    passed = F.count_if(F.coalesce(F.col("gate_pass") == 1, F.lit(False)))
    best = []
    for m in metrics:
        order = F.when(F.col(m).isNotNull(), F.struct(F.col(m).alias("v"), "position"))
        best += [F.min(m).alias(f"{m}"), F.coalesce(F.min_by("job_key", order), F.lit("")).alias(f"{m}_job_key")]
    return attempts.agg(
        F.count(F.lit(1)).alias("n_attempts_total"),
        F.count_if(F.coalesce("returncode", F.lit(1)) == 0).alias("n_attempts_returncode_zero"),
        n_review.alias("n_attempts_with_direction_review"),
        passed.alias("n_primary_objective_gate_pass"),
        F.when(n_review > 0, passed / n_review).alias("primary_objective_gate_pass_rate"),
        F.count_distinct(F.when(F.trim("job_key") != "", F.trim("job_key"))).alias("n_unique_job_keys_completed"),
        *best,
    )
