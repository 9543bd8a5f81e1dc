"""Shortlists for second passes: best candidate per feature family, ranked, capped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.functions.names import lineage_atoms, shortlist_atoms, signature, tier_order
from dyadscope.operators.inference import SUPPORT, VALIDATED

INF = float("inf")


def _distinct_head(eligible: DataFrame, order: Sequence[Column], n: int, payload: Sequence[str]) -> DataFrame:
    """First row per signature, the best n of them, with the position each had among all rows.

    Nothing is ranked globally. The best row per signature is a min_by aggregate, the head is a
    top-n, and positions come from counting, in one pass, how many rows precede each of the n
    chosen keys.
    """
    keyed = eligible.withColumn("_key", F.struct(*order))
    best = keyed.groupBy("signature").agg(
        F.min("_key").alias("_key"), F.min_by(F.struct(*payload), "_key").alias("_row")
    )
    head = best.orderBy("_key").limit(n)
    # Scalars of at most n keys and n + 1 counts.
    cuts = head.agg(F.sort_array(F.collect_list("_key"))).scalar()
    slot = F.size(F.filter("_cuts", lambda c: c <= F.col("_key")))
    counts = keyed.withColumn("_cuts", cuts).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.agg(F.collect_list(F.struct("slot", "n"))).scalar()
    before = F.aggregate(
        F.filter("_ahead", lambda e: e["slot"] < F.col("_place")), F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"]
    )
    placed = head.withColumns({"_cuts": cuts, "_ahead": ahead}).withColumn("_place", slot)
    return placed.select((before + 1).alias("shortlist_rank"), F.col("signature").alias("shortlist_signature"), "_row.*")


def _inf(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(INF))


def shortlist(
    top: DataFrame,
    *,
    tier_mode: str = "validated_or_support",
    max_features: int,
    dedupe_mode: str = "atom",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Features of the best validated (or supported) candidates, one per atom signature."""
    if tier_mode not in ("validated_only", "validated_or_support"):
        raise ValueError("tier_mode must be one of: validated_only, validated_or_support")
    if dedupe_mode not in ("feature", "atom"):
        raise ValueError("dedupe_mode must be one of: feature, atom")
    tiers = [VALIDATED] + ([SUPPORT] if tier_mode == "validated_or_support" else [])
    feature = F.trim(F.coalesce("key_factor", F.lit("")))
    atoms = shortlist_atoms(feature)
    eligible = top.where(F.col("candidate_tier").isin(tiers) & (feature != "")).select(
        "*",
        feature.alias("feature_name"),
        F.array_join(atoms, "|").alias("shortlist_atoms"),
        (feature if dedupe_mode == "feature" else signature(atoms)).alias("signature"),
    )
    beta = F.coalesce(F.col("beta_validation"), F.col("beta_discovery"), F.lit(0.0))
    order = [
        tier_order(F.col("candidate_tier")).alias("a"),
        _inf("q_value_validation").alias("b"),
        _inf("p_boot_validation").alias("c"),
        _inf("p_boot_discovery").alias("d"),
        (-F.abs(beta)).alias("e"),
        F.col("candidate_id").alias("f"),
        *tie_break,
    ]
    payload = ("feature_name", "shortlist_atoms", "candidate_tier", "candidate_id")
    return _distinct_head(eligible, order, max(int(max_features), 0), payload)


def borderline(
    top: DataFrame, *, p_threshold: float, q_threshold: float, p_margin: float, q_margin: float
) -> DataFrame:
    """Fitted, unvalidated rows of the first restart that miss a threshold by no more than a margin."""
    p_margin, q_margin = max(p_margin, 0.0), max(q_margin, 0.0)
    first_restart = top.agg(F.min(F.when(F.col("restart_id") > 0, F.col("restart_id")))).scalar()
    p, q = F.col("p_boot_validation"), F.col("q_value_validation")

    def gap(value: Column, threshold: float, margin: float) -> Column:
        over = F.greatest(F.lit(0.0), value - F.lit(threshold))
        if margin > 0:
            return over / F.lit(max(margin, 1e-12))
        return F.when(over == 0, F.lit(0.0)).otherwise(F.lit(INF))

    keep = (
        (first_restart.isNull() | (F.col("restart_id") == first_restart))
        & (F.col("status_validation") == "ok")
        & (F.col("candidate_tier") != VALIDATED)
        & p.isNotNull()
        & q.isNotNull()
        & ~((p <= p_threshold) & (q <= q_threshold))
        & (p <= p_threshold + p_margin)
        & (q <= q_threshold + q_margin)
        & (F.trim(F.coalesce("key_factor", F.lit(""))) != "")
    )
    closeness = F.greatest(gap(p, p_threshold, p_margin), gap(q, q_threshold, q_margin))
    return top.where(keep).withColumn("closeness", closeness)


def escalation_shortlist(
    top: DataFrame,
    *,
    p_threshold: float = 0.05,
    q_threshold: float = 0.10,
    p_margin: float = 0.05,
    q_margin: float = 0.10,
    max_candidates: int,
    dedupe_mode: str = "atom",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Features worth a larger bootstrap: the rows closest to passing, one per signature."""
    if dedupe_mode not in ("feature", "atom"):
        raise ValueError("escalation dedupe mode must be one of: feature, atom")
    feature = F.trim(F.coalesce("key_factor", F.lit("")))
    atoms = lineage_atoms(feature)
    rows = borderline(top, p_threshold=p_threshold, q_threshold=q_threshold, p_margin=p_margin, q_margin=q_margin).select(
        "*",
        feature.alias("feature_name"),
        (feature if dedupe_mode == "feature" else signature(atoms)).alias("signature"),
    )
    order = [
        F.col("closeness").alias("a"),
        F.col("q_value_validation").alias("b"),
        F.col("p_boot_validation").alias("c"),
        (-F.abs(F.coalesce("beta_validation", F.lit(0.0)))).alias("d"),
        F.col("candidate_id").alias("e"),
        *tie_break,
    ]
    payload = ("feature_name", "candidate_id", "p_boot_validation", "q_value_validation", "closeness")
    return _distinct_head(rows, order, max(int(max_candidates), 0), payload)
