"""The locked candidate pool: tracks x outcome contexts x control specs x features."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.functions.hashing import equivalence_hash
from dyadscope.settings import Controls, ScanSettings

KEY_ONLY = "clogit_key_only"
PLUS_BASE = "clogit_key_plus_base_controls"


def validate_contexts(contexts: DataFrame, available: Sequence[str]) -> DataFrame:
    """Contexts (position, context_scope, y_col) with a reason where one must be skipped.

    The first of equal pairs is found by a map-side combined minimum, not by sorting the group.
    """
    scope = F.trim(F.coalesce("context_scope", F.lit("")))
    y = F.trim(F.coalesce("y_col", F.lit("")))
    named = contexts.select("position", scope.alias("context_scope"), y.alias("y_col"))
    firsts = named.groupBy("context_scope", "y_col").agg(F.min("position").alias("first_position"))
    reason = (
        F.when((F.col("context_scope") == "") | (F.col("y_col") == ""), "invalid_context_definition")
        .when(F.col("position") > F.col("first_position"), "duplicate_context_definition")
        .when(~F.col("y_col").isin(list(available)), "missing_context_y_column")
        .otherwise("")
    )
    joined = named.join(firsts, ["context_scope", "y_col"])
    return joined.select("position", "context_scope", "y_col", reason.alias("skip_reason"))


def anchor_token(fixed: Sequence[str]) -> str:
    """Part of the spec id that names the fixed regressors."""
    names = sorted({c.strip() for c in fixed if c.strip()})
    if not names:
        return ""
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()[:8]
    if len(names) > 1:
        return f"anchored_n{len(names)}_h{digest}"
    readable = re.sub(r"[^a-z0-9]+", "_", names[0].lower()).strip("_") or "unnamed"
    return f"anchored_{readable[:24]}_h{digest}"


def control_specs(controls: Controls, available: Sequence[str]) -> list[tuple[str, list[str]]]:
    """(spec id, control columns) in evaluation order."""
    base = [c for c in controls.base if c in available] if controls.use_base else []
    mode = controls.spec_mode
    if mode == "key_plus_base_controls" and not base:
        raise ValueError("spec_mode=key_plus_base_controls needs base controls present in the data")
    token = anchor_token(controls.fixed)
    suffix = f"__{token}" if token else ""
    specs: list[tuple[str, list[str]]] = []
    if mode in ("both", "key_only"):
        specs.append((KEY_ONLY + suffix, []))
    if mode in ("both", "key_plus_base_controls") and base:
        specs.append((PLUS_BASE + suffix, base))
    return specs


def candidate_pool(
    tracks: DataFrame,
    contexts: Sequence[tuple[str, str]],
    specs: Sequence[tuple[str, Sequence[str]]],
    features: Sequence[str],
    fixed: Sequence[str] = (),
) -> DataFrame:
    """All candidates per track, with identities, equivalence hash and plan order.

    Contexts, specs and features are configuration arrays exploded onto the few track rows.
    """
    plan = json.dumps(
        [
            {"c": ci, "s": si, "f": fi, "scope": scope, "y": y, "spec": spec, "key": feature,
             "exog": list(dict.fromkeys([feature, *fixed, *controls]))}
            for ci, (scope, y) in enumerate(contexts)
            for si, (spec, controls) in enumerate(specs)
            for fi, feature in enumerate(features)
        ]
    )
    shape = "array<struct<c int, s int, f int, scope string, y string, spec string, key string, exog array<string>>>"
    rows = tracks.select("track", F.inline(F.from_json(F.lit(plan), shape)))
    family = F.concat_ws("|", "track", "scope", "y", "spec")
    # Candidates are counted by the plan, so one ordered window over them is small.
    order = F.row_number().over(Window.orderBy("track", "c", "s", "f"))
    return rows.select(
        order.alias("plan_order"),
        "track",
        F.col("scope").alias("context_scope"),
        F.col("y").alias("y_col"),
        F.col("spec").alias("spec_id"),
        F.col("key").alias("key_factor"),
        F.col("exog").alias("exog_cols"),
        F.array_join("exog", "+").alias("control_set"),
        family.alias("fdr_family_id"),
        F.concat_ws("|", family, "key").alias("candidate_id"),
        equivalence_hash(F.col("track"), F.col("scope"), F.col("y"), F.col("exog")).alias("equivalence_hash"),
    )


def mark_equivalents(pool: DataFrame) -> DataFrame:
    """Point every candidate with an earlier equal specification at that candidate."""
    same = Window.partitionBy("equivalence_hash").orderBy("plan_order")
    first = F.first("candidate_id").over(same)
    return pool.withColumn("duplicate_of", F.when(F.row_number().over(same) > 1, first))


def infeasible_track_outcomes(capacity: DataFrame, min_events: int, min_docs: int) -> DataFrame:
    """(track, y_col) whose discovery capacity misses a gate, with the reason text."""
    low_events = F.col("n_informative_events") < min_events
    low_docs = F.col("n_docs_informative") < min_docs
    detail = F.concat_ws(
        "; ",
        F.when(low_events, F.format_string(f"events %d < gate {min_events}", "n_informative_events")),
        F.when(low_docs, F.format_string(f"policy_docs %d < gate {min_docs}", "n_docs_informative")),
    )
    return capacity.where(low_events | low_docs).select(
        "track", "y_col", F.lit("discovery_gate_infeasible_for_track_y").alias("reason_code"), detail.alias("reason_detail")
    )


def base_control_needs(settings: ScanSettings, n_controls: int) -> tuple[int, int]:
    """Events and documents the specification with base controls requires."""
    n_exog = 1 + len(settings.controls.fixed) + n_controls
    return (
        max(settings.gates.discovery.events, n_exog * max(settings.gates.per_regressor.events, 1)),
        max(settings.gates.discovery.docs, n_exog * max(settings.gates.per_regressor.docs, 1)),
    )


def disabled_control_specs(capacity: DataFrame, spec_id: str, need_events: int, need_docs: int) -> DataFrame:
    """(track, y_col) where the specification with base controls is switched off."""
    events, docs = F.col("n_informative_events"), F.col("n_docs_informative")
    detail = F.format_string(f"events %d < {need_events} or policy_docs %d < {need_docs}", events, docs)
    return capacity.where((events < need_events) | (docs < need_docs)).select(
        "track",
        "y_col",
        F.lit(spec_id).alias("spec_id"),
        F.lit("disabled_base_controls_low_discovery_capacity").alias("reason_code"),
        detail.alias("reason_detail"),
    )


def evaluation_order(candidates: DataFrame) -> DataFrame:
    """Every discovery fit comes before the first validation fit."""
    roles = F.explode(F.array(F.lit("discovery"), F.lit("validation"))).alias("split_role")
    both = candidates.select("*", roles)
    return both.withColumn(
        "candidate_eval_order", F.row_number().over(Window.orderBy("split_role", "plan_order"))
    )


def pool_size_estimate(n_features: int, n_tracks: int, n_contexts: int, with_controls: bool) -> int:
    return int(n_features * n_tracks * max(n_contexts, 0) * (2 if with_controls else 1))


def complexity_penalty(requested: Column, pool: Column, events: Column, lo: float, hi: float) -> Column:
    """requested * (1 + min(3, ln(1 + pool/events))), clipped to [lo, hi]."""
    ratio = pool.cast("double") / F.greatest(events, F.lit(1))
    scale = F.lit(1.0) + F.least(F.lit(3.0), F.log1p(F.greatest(ratio, F.lit(0.0))))
    return F.least(F.greatest(requested * scale, F.lit(lo)), F.lit(hi))
