"""From fitted rows to evidence: FDR, tiers, track consensus, restarts, stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.functions.names import tier_order

#: Ways in which rows with one p value are dealt out to meet their q.
JOIN_SALTS = 16
VALIDATED, SUPPORT, EXPLORATORY = "validated_candidate", "support_candidate", "exploratory"
SCAN_VALUES = ("status", "p_boot", "beta", "score", "bootstrap_success", "candidate_eval_order")


def bh_qvalues(df: DataFrame, p: str, family: str, out: str = "q_value", keys: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg q within each family (and extra keys); null p or blank family gives null.

    q depends on the distinct p values and their counts only. Bootstrap p values take at most
    replicates + 1 values, so each family shrinks to that many rows, combined on the map side,
    before anything is ordered; a family holding most rows is no larger than any other.
    """
    groups = [*keys, family]
    usable = df.where(F.col(p).isNotNull() & (F.trim(F.coalesce(F.col(family), F.lit(""))) != ""))
    steps = usable.groupBy(*groups, p).agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*groups).orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*groups).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_n").over(Window.partitionBy(*groups))
    raw = steps.withColumn("_raw", F.col(p) * total / F.sum("_n").over(up))
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("_raw").over(down)))
    table = raw.select(*groups, p, q.alias(out))
    # Rows without q do not enter the join: all of a family's null p would meet under one key. The
    # rest can crowd on few p values too, so they are spread over salts that the small table repeats.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(JOIN_SALTS)).cast("int")
    fits = F.col(p).isNotNull() & (F.trim(F.coalesce(F.col(family), F.lit(""))) != "")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    columns = [*groups, p, *[c for c in df.columns if c not in (*groups, p)]]
    with_q = df.where(fits).withColumn("_salt", salt).join(salted, [*groups, p, "_salt"], "left").select(*columns, out)
    return with_q.unionByName(df.where(~fits).select(*columns, F.lit(None).cast("double").alias(out)))


def attach_validation_q(scan: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """q over validation rows that were fitted; every other row keeps null."""
    counted = (F.col("split_role") == "validation") & (F.col("status") == "ok")
    marked = scan.withColumn("_p", F.when(counted, F.col("p_boot")))
    return bh_qvalues(marked, "_p", "fdr_family_id", "q_value", keys).drop("_p")


def pair_splits(scan: DataFrame, keys: Sequence[str], identity: Sequence[str], values: Sequence[str] = SCAN_VALUES) -> DataFrame:
    """One row per candidate with discovery and validation values side by side."""

    def side(role: str, c: str) -> Column:
        return F.max(F.when(F.col("split_role") == role, F.col(c)))

    return scan.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in identity],
        *[side(role, c).alias(f"{c}_{role}") for c in values for role in ("discovery", "validation")],
        side("validation", "q_value").alias("q_value_validation"),
    )


def assign_tiers(paired: DataFrame, *, p_threshold: float = 0.05, q_threshold: float = 0.10) -> DataFrame:
    ok = F.coalesce(F.col("status_validation") == "ok", F.lit(False))
    passed_p = ok & F.coalesce(F.col("p_boot_validation") <= p_threshold, F.lit(False))
    passed_q = ok & F.coalesce(F.col("q_value_validation") <= q_threshold, F.lit(False))
    tier = (
        F.when(passed_p & passed_q, VALIDATED)
        .when(F.col("status_discovery") == "ok", SUPPORT)
        .otherwise(EXPLORATORY)
    )
    return paired.withColumns(
        {"validation_pass_p": passed_p.cast("int"), "validation_pass_q": passed_q.cast("int"), "candidate_tier": tier}
    )


def rank_order() -> list[Column]:
    """Tier, then q (missing last), then score descending (missing last), then id."""
    return [tier_order(F.col("candidate_tier")), F.asc_nulls_last("q_value_validation"), F.desc_nulls_last("score_validation"), F.col("candidate_id").asc()]


def rank_candidates(top: DataFrame) -> DataFrame:
    return top.orderBy(*rank_order())


def tier_rank(tier: Column) -> Column:
    return F.when(tier == VALIDATED, 2).when(tier == SUPPORT, 1).otherwise(0)


def track_consensus(
    top: DataFrame, *, anchor_track: str, min_anchor_tier: str = SUPPORT, enforce: bool = True
) -> DataFrame:
    """Compare each candidate with the same candidate on the anchor track; demote when enforced.

    A window holds one candidate's tracks within one restart, so partitions are tiny.
    """
    same = Window.partitionBy("restart_id", "context_scope", "y_col", "spec_id", "key_factor", "control_set")
    anchor = F.max(F.when(F.col("track") == anchor_track, F.col("candidate_tier"))).over(same)
    need = {VALIDATED: 2, SUPPORT: 1}.get(min_anchor_tier, 0)
    status = (
        F.when(F.col("_anchor").isNull(), "no_anchor_track")
        .when(tier_rank(F.col("_anchor")) >= need, "pass")
        .otherwise("anchor_below_threshold")
    )
    passed = (status == "pass").cast("int")
    demoted = F.lit(enforce) & (F.col("candidate_tier") == VALIDATED) & (passed == 0)
    return (
        top.withColumn("_anchor", anchor)
        .withColumns(
            {
                "candidate_tier_raw": F.col("candidate_tier"),
                "track_consensus_anchor_tier": F.coalesce("_anchor", F.lit("")),
                "track_consensus_anchor_pass": passed,
                "track_consensus_status": status,
                "track_consensus_enforced": F.lit(int(enforce)),
                "track_consensus_demoted": demoted.cast("int"),
                "candidate_tier": F.when(demoted, SUPPORT).otherwise(F.col("candidate_tier")),
            }
        )
        .drop("_anchor")
    )


def consensus_summary(consensus: DataFrame) -> DataFrame:
    group = F.struct("restart_id", "context_scope", "y_col", "spec_id", "key_factor", "control_set")
    per_group = consensus.groupBy(group.alias("g")).agg(
        F.max("track_consensus_anchor_pass").alias("ok"), F.sum("track_consensus_demoted").alias("demoted")
    )
    return per_group.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("ok").alias("n_groups_pass_anchor"),
        F.sum("demoted").alias("n_rows_demoted_from_validated"),
    )


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def _n_present(n_restarts: int) -> Column:
    seen = F.count_distinct(F.when(F.col("restart_id") > 0, F.col("restart_id")))
    return F.greatest(seen, F.count(F.lit(1))) if n_restarts <= 1 else seen


def _tier_count(*tiers: str) -> Column:
    return F.count_if(F.col("candidate_tier").isin(*tiers))


def restart_inference(
    top: DataFrame,
    *,
    n_restarts: int,
    p_threshold: float = 0.05,
    q_threshold: float = 0.10,
    confirmatory_y: Sequence[str] = (),
    nonconfirmatory_max_tier: str = SUPPORT,
) -> DataFrame:
    """One row per candidate over all restarts: medians over fitted restarts, q on the median p.

    Outcomes outside the confirmatory list lose their passes and are capped; a candidate whose
    anchor track failed is demoted when consensus is enforced.
    """
    if nonconfirmatory_max_tier not in (SUPPORT, EXPLORATORY):
        raise ValueError("nonconfirmatory_max_tier must be one of: support_candidate, exploratory")
    denominator = float(max(n_restarts, 1))
    ok_p = F.when(F.col("status_validation") == "ok", _finite("p_boot_validation"))

    def filled(c: str) -> Column:
        return F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))

    first = F.struct(F.when(F.col("restart_id") > 0, F.col("restart_id")).otherwise(10_000_000), "track", "spec_id", "key_factor")
    carried = [c for c in ("track", "context_scope", "y_col", "spec_id", "key_factor", "control_set", "fdr_family_id",
                           "track_consensus_enforced", "track_consensus_anchor_pass") if c in top.columns]
    modal_n = F.greatest(*[_tier_count(t) for t in (VALIDATED, SUPPORT, EXPLORATORY)])
    agg = top.groupBy("candidate_id").agg(
        F.min_by(F.struct(*carried), first).alias("ref"),
        F.max((F.col("status_discovery") == "ok").cast("int")).alias("disc_ok"),
        F.mode(filled("status_discovery"), True).alias("disc_mode"),
        F.mode(filled("status_validation"), True).alias("val_mode"),
        F.count(ok_p).alias("n_validation_ok_restarts"),
        F.median(_finite("p_boot_discovery")).alias("p_boot_discovery"),
        F.median(ok_p).alias("p_boot_validation"),
        F.min(ok_p).alias("p_boot_validation_min"),
        F.max(ok_p).alias("p_boot_validation_max"),
        F.avg(ok_p).alias("p_boot_validation_mean"),
        F.median(_finite("beta_discovery")).alias("beta_discovery"),
        F.median(_finite("beta_validation")).alias("beta_validation"),
        F.median(_finite("score_discovery")).alias("score_discovery"),
        F.median(_finite("score_validation")).alias("score_validation"),
        _n_present(n_restarts).alias("n_restarts_present"),
        F.mode(filled("candidate_tier"), True).alias("candidate_tier_modal_restart"),
        F.round(modal_n / F.count(F.lit(1)), 6).alias("candidate_tier_modal_rate_restart"),
        F.round(_tier_count(VALIDATED) / denominator, 6).alias("validated_rate_restart"),
        F.round(_tier_count(VALIDATED, SUPPORT) / denominator, 6).alias("support_or_better_rate_restart"),
    )
    rows = agg.select(
        "candidate_id",
        "ref.*",
        F.when(F.col("disc_ok") == 1, "ok").otherwise(F.coalesce("disc_mode", F.lit(""))).alias("status_discovery"),
        F.when(F.col("n_validation_ok_restarts") > 0, "ok").otherwise(F.coalesce("val_mode", F.lit(""))).alias("status_validation"),
        *[c for c in agg.columns if c not in ("candidate_id", "ref", "disc_ok", "disc_mode", "val_mode")],
        F.round(F.col("n_restarts_present") / denominator, 6).alias("presence_rate"),
        F.lit(int(denominator)).alias("n_restarts_total"),
    )
    marked = rows.withColumn("_p", F.when(F.col("status_validation") == "ok", F.col("p_boot_validation")))
    rows = bh_qvalues(marked, "_p", "fdr_family_id", "q_value_validation").drop("_p")

    val_ok = (F.col("status_validation") == "ok") & F.col("p_boot_validation").isNotNull()
    raw_p = val_ok & (F.col("p_boot_validation") <= p_threshold)
    raw_q = val_ok & F.coalesce(F.col("q_value_validation") <= q_threshold, F.lit(False))
    eligible = F.col("y_col").isin(list(confirmatory_y)) if confirmatory_y else F.lit(True)
    # A non-confirmatory outcome cannot pass, so its best tier here is support already; the
    # stricter cap lowers it once more.
    base = (
        F.when(raw_p & raw_q & eligible, VALIDATED)
        .when(F.col("status_discovery") == "ok", SUPPORT)
        .otherwise(EXPLORATORY)
    )
    capped = F.when(~eligible & F.lit(nonconfirmatory_max_tier == EXPLORATORY), EXPLORATORY).otherwise(base)
    cap_hit = capped != base
    enforced = F.lit(False)
    if "track_consensus_enforced" in carried:
        enforced = (F.coalesce("track_consensus_enforced", F.lit(0)) == 1) & (
            F.coalesce("track_consensus_anchor_pass", F.lit(1)) == 0
        )
    demoted = enforced & (capped == VALIDATED)
    return rows.select(
        "*",
        raw_p.cast("int").alias("validation_pass_p_raw"),
        raw_q.cast("int").alias("validation_pass_q_raw"),
        (raw_p & eligible).cast("int").alias("validation_pass_p"),
        (raw_q & eligible).cast("int").alias("validation_pass_q"),
        eligible.cast("int").alias("confirmatory_eligible"),
        cap_hit.cast("int").alias("confirmatory_policy_demoted"),
        F.when(cap_hit, "nonconfirmatory_y_tier_capped").otherwise("").alias("confirmatory_policy_reason"),
        capped.alias("candidate_tier_raw"),
        F.when(demoted, SUPPORT).otherwise(capped).alias("candidate_tier"),
        demoted.cast("int").alias("restart_consensus_demoted"),
    )


def inference_order() -> list[Column]:
    """Tier, then q and p (missing last), then the size of the coefficient, then id."""
    size = F.abs(F.coalesce("beta_validation", F.lit(0.0)))
    tier = tier_order(F.col("candidate_tier"))
    return [tier, F.asc_nulls_last("q_value_validation"), F.asc_nulls_last("p_boot_validation"), F.desc(size), F.col("candidate_id").asc()]


def order_inference(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*inference_order())


def _sign_consistency(c: str) -> Column:
    up, down = F.count_if(_finite(c) > 0), F.count_if(_finite(c) < 0)
    return F.when(up + down > 0, F.greatest(up, down) / (up + down)).otherwise(F.lit(1.0))


def restart_stability(top: DataFrame, *, n_restarts: int) -> DataFrame:
    """Stability score per candidate: presence, support, modal tier and sign consistency."""
    denominator = float(max(n_restarts, 1))

    def tier_entry(tier: str) -> Column:
        here = F.col("candidate_tier") == tier
        # Most frequent first; on a tie the tier seen at the earliest restart.
        return F.struct(
            F.count_if(here).alias("n"),
            (-F.coalesce(F.min(F.when(here, F.col("restart_id"))), F.lit(1 << 30))).alias("seen"),
            F.lit(tier).alias("tier"),
        )

    modal = F.array_max(F.array(*[tier_entry(t) for t in (VALIDATED, SUPPORT, EXPLORATORY)]))
    agg = top.groupBy("candidate_id").agg(
        *[F.min(c).alias(c) for c in ("track", "context_scope", "y_col", "spec_id", "key_factor") if c in top.columns],
        _n_present(n_restarts).alias("n_restarts_present"),
        F.count(F.lit(1)).alias("_rows"),
        _tier_count(VALIDATED).alias("n_validated"),
        _tier_count(VALIDATED, SUPPORT).alias("n_support_or_better"),
        modal.alias("_modal"),
        _sign_consistency("beta_validation").alias("_sv"),
        _sign_consistency("beta_discovery").alias("_sd"),
    )
    presence = F.col("n_restarts_present") / denominator
    support = F.col("n_support_or_better") / denominator
    modal_rate = F.col("_modal.n") / F.col("_rows")
    score = 0.35 * presence + 0.35 * support + 0.20 * modal_rate + 0.10 * F.greatest("_sv", "_sd")
    return agg.select(
        *[c for c in agg.columns if not c.startswith("_")],
        F.lit(int(denominator)).alias("n_restarts_total"),
        F.round(presence, 6).alias("presence_rate"),
        F.round(F.col("n_validated") / denominator, 6).alias("validated_rate"),
        F.round(support, 6).alias("support_or_better_rate"),
        F.col("_modal.tier").alias("modal_tier"),
        F.round(modal_rate, 6).alias("modal_tier_rate"),
        F.round("_sv", 6).alias("beta_validation_sign_consistency"),
        F.round("_sd", 6).alias("beta_discovery_sign_consistency"),
        F.round(score, 6).alias("stability_score"),
    )


def stability_order() -> list[Column]:
    return [F.desc("stability_score"), F.desc("validated_rate"), F.desc("support_or_better_rate"), F.col("candidate_id").asc()]


def order_stability(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*stability_order())


def restart_summary(top: DataFrame, *, n_restarts: int) -> DataFrame:
    """How many candidates keep their tier, keep support, or are validated, across restarts."""
    per = top.groupBy("candidate_id").agg(
        F.count_distinct(F.when(F.col("restart_id") > 0, F.col("restart_id"))).alias("seen"),
        F.count_distinct("candidate_tier").alias("tiers"),
        _tier_count(VALIDATED, SUPPORT).alias("support"),
        _tier_count(VALIDATED).alias("validated"),
    )
    everywhere = F.col("seen") == n_restarts
    return per.agg(
        F.count_if((F.col("tiers") == 1) & everywhere).alias("n_tier_consistent_all_restarts"),
        F.count_if((F.col("support") == n_restarts) & everywhere).alias("n_support_or_better_all_restarts"),
        F.count_if(F.col("validated") > 0).alias("n_validated_any_restart"),
    )


def top_validated(rows: DataFrame, n: int) -> DataFrame:
    order = [F.asc_nulls_last("q_value_validation"), F.asc_nulls_last("p_boot_validation"), "candidate_id"]
    order += ["restart_id"] if "restart_id" in rows.columns else []
    return rows.where(F.col("candidate_tier") == VALIDATED).orderBy(*order).limit(max(int(n), 1))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key)).agg(F.count(F.lit(1)).alias("n"))
