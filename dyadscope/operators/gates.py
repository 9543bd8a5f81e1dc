"""Gates between a candidate and its fit, and the thresholds they use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.functions.numeric import round_by_mode
from dyadscope.operators.events import capacity_by_outcome
from dyadscope.settings import Gates

FIT = "fit"
# The gate grids of the feasibility frontier.
FRONTIER_DOC_GATES = (1, 3, 5, 7, 10, 12, 15, 20, 25, 30)
FRONTIER_EVENT_GATES = (1, 3, 5, 7, 10, 15, 20, 30, 50, 100)


def _by_outcome(y: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(int(default))
    for name, value in table.items():
        out = F.when(y == name, F.lit(int(value))).otherwise(out)
    return out


def gate_cascade(rows: DataFrame, gates: Gates) -> DataFrame:
    """First failing gate per (candidate, split) as status, reason code, detail and stage.

    Needs: split_role, y_col, n_docs_total, n_informative, n_docs, top1_share; optional text
    columns missing_y and missing_exog name columns absent from the data.
    """
    val = F.col("split_role") == "validation"
    y = F.col("y_col")
    need_events = F.when(
        val, _by_outcome(y, {k: n.events for k, n in gates.validation_by_outcome.items()}, gates.validation.events)
    ).otherwise(gates.discovery.events)
    need_docs = F.when(
        val, _by_outcome(y, {k: n.docs for k, n in gates.validation_by_outcome.items()}, gates.validation.docs)
    ).otherwise(gates.discovery.docs)
    limit = F.lit(float(gates.largest_document_share))
    n, docs, top1 = F.col("n_informative"), F.col("n_docs"), F.col("top1_share")

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in rows.columns else F.lit("")

    def outcome(validation_code: str, discovery_status: str, detail: Column) -> Column:
        status = F.when(val, "not_validated_out_of_sample").otherwise(discovery_status)
        code = F.when(val, validation_code).otherwise(discovery_status)
        return F.struct(
            status.alias("status"), code.alias("reason_code"), detail.alias("reason_detail"),
            F.lit("precheck").alias("reason_stage"),
        )

    def fixed(status: str, code: str, detail: Column, stage: str = "precheck") -> Column:
        return F.struct(
            F.lit(status).alias("status"), F.lit(code).alias("reason_code"), detail.alias("reason_detail"),
            F.lit(stage).alias("reason_stage"),
        )

    infeasible = val & (F.col("n_docs_total") < need_docs)
    verdict = (
        F.when(text("missing_y") != "", fixed("failed_rule_checks", "missing_y_column", text("missing_y")))
        .when(text("missing_exog") != "", fixed("failed_rule_checks", "missing_feature_columns", text("missing_exog")))
        .when(
            infeasible,
            fixed(
                "not_validated_out_of_sample",
                "validation_gate_infeasible_policy_docs",
                F.format_string("max_docs_possible=%d < gate=%d", "n_docs_total", need_docs),
            ),
        )
        .when(
            n == 0,
            outcome(
                "validation_no_variation_within_event",
                "not_estimable_low_within_event_variation",
                F.lit("informative variation events = 0"),
            ),
        )
        .when(
            n < need_events,
            outcome("validation_low_informative_events", "not_estimable_low_events", F.format_string("%d < %d", n, need_events)),
        )
        .when(
            docs < need_docs,
            outcome(
                "validation_low_policy_doc_clusters",
                "not_estimable_low_policy_doc_clusters",
                F.format_string("%d < %d", docs, need_docs),
            ),
        )
        .when(
            top1 > limit,
            outcome(
                "validation_high_policy_doc_concentration",
                "not_estimable_high_policy_doc_concentration",
                F.format_string("%.4f > %.4f", top1, limit),
            ),
        )
        .otherwise(fixed(FIT, FIT, F.lit(""), "fit"))
    )
    gated = rows.withColumn("_v", verdict)
    code = F.col("_v.reason_code")
    before_count = code.isin("missing_y_column", "missing_feature_columns", "validation_gate_infeasible_policy_docs")
    zero = F.lit(0).cast("bigint")
    return gated.select(
        *[c for c in rows.columns if c not in ("n_informative", "n_docs", "top1_share")],
        F.when(before_count, zero).otherwise(n).alias("n_informative"),
        # The infeasible gate reports the documents it counted in the whole split.
        F.when(code == "validation_gate_infeasible_policy_docs", F.col("n_docs_total"))
        .when(before_count, zero)
        .otherwise(docs)
        .alias("n_docs"),
        F.when(before_count | (n == 0), None).otherwise(top1).alias("top1_share"),
        "_v.*",
    )


def autoscaled_gates(events: int, docs: int, share: float, floor_events: int, floor_docs: int) -> tuple[int, int]:
    """Validated gates scaled by the validation share, never raised, never under the floor."""
    share = max(share, 0.0)
    return (
        min(events, max(floor_events, int(round(events * share)))),
        min(docs, max(floor_docs, int(round(docs * share)))),
    )


def profiled_gates(
    stats: DataFrame,
    profile: str,
    *,
    events: int,
    docs: int,
    event_ratio: float = 0.5,
    doc_ratio: float = 0.5,
    floor_events: int = 10,
    floor_docs: int = 5,
    rounding: str = "floor",
) -> DataFrame:
    """Gates after the capacity profile, from one row of track capacity statistics.

    `stats` holds min_track_events_validation and min_track_docs_validation.
    """

    def one(cap: Column, requested: int, ratio: float, floor: int) -> Column:
        req = F.lit(requested).cast("bigint")
        if profile == "feasibility_diagnostic":
            capped = F.least(req, cap)
        elif profile == "adaptive_production":
            scaled = round_by_mode(cap * F.lit(min(max(ratio, 0.0), 1.0)), rounding)
            capped = F.least(req, cap, F.greatest(F.lit(floor).cast("bigint"), scaled))
        else:
            capped = req
        return F.when(cap > 0, capped).otherwise(req)

    return stats.select(
        one(F.col("min_track_events_validation"), events, event_ratio, floor_events).alias("gate_events"),
        one(F.col("min_track_docs_validation"), docs, doc_ratio, floor_docs).alias("gate_docs"),
    )


def outcome_gate_map(
    df: DataFrame,
    y_cols: Sequence[str],
    *,
    events: int,
    docs: int,
    auto_scale: bool = True,
    floor_events: int = 10,
    floor_docs: int = 5,
    event_ratio: float = 0.5,
    doc_ratio: float = 0.5,
    rounding: str = "floor",
) -> DataFrame:
    """Per outcome: informative validation capacity, the gate it supports, and a usability label."""
    val = df.where(F.col("split_role") == "validation")
    capacity = capacity_by_outcome(val, y_cols)
    zero = F.lit(0).cast("bigint")
    tracks = val.agg(F.count_distinct("track")).scalar()
    track_rows = F.count_if(F.col("is_total") == 0)
    # A track without any two-alternative event has no row here and counts as zero.
    absent = track_rows < tracks

    def least_track(c: str) -> Column:
        return F.when(absent, zero).otherwise(F.coalesce(F.min(F.when(F.col("is_total") == 0, F.col(c))), zero))

    def total(c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("is_total") == 1, F.col(c))), zero)

    per_y = capacity.groupBy("y_col").agg(
        total("n_informative_events").alias("total_events"),
        total("n_docs_informative").alias("total_docs"),
        least_track("n_informative_events").alias("min_track_events"),
        least_track("n_docs_informative").alias("min_track_docs"),
    )

    def gate(cap: Column, requested: int, ratio: float, floor: int) -> Column:
        req = F.lit(requested).cast("bigint")
        if not auto_scale:
            return req
        scaled = round_by_mode(cap * F.lit(min(max(ratio, 0.0), 1.0)), rounding)
        at_least = F.greatest(F.lit(max(floor, 1)).cast("bigint"), scaled)
        return F.greatest(F.lit(1).cast("bigint"), F.least(req, at_least, F.greatest(cap, F.lit(1).cast("bigint"))))

    te, td = F.col("min_track_events"), F.col("min_track_docs")
    unusable = (F.least("total_events", "total_docs", te, td) <= 0)
    below = (te < max(floor_events, 1)) | (td < max(floor_docs, 1))
    return per_y.select(
        "*",
        gate(te, events, event_ratio, floor_events).alias("gate_events"),
        gate(td, docs, doc_ratio, floor_docs).alias("gate_docs"),
        F.when(unusable, "unusable").when(below, "low_capacity").otherwise("usable").alias("feasibility_label"),
        unusable.cast("int").alias("is_unusable"),
        below.cast("int").alias("is_below_floor"),
    )


def check_outcome_feasibility(gate_map: DataFrame, mode: str = "warn") -> dict[str, list[str]]:
    """Unusable and below-floor outcomes; the fail modes raise. The map has one row per outcome."""
    if mode not in ("warn", "fail_unusable", "fail_below_floor"):
        raise ValueError("y feasibility mode must be one of: warn, fail_unusable, fail_below_floor")
    rows = gate_map.select("y_col", "is_unusable", "is_below_floor").collect()
    unusable = sorted(r.y_col for r in rows if r.is_unusable)
    below = sorted(r.y_col for r in rows if r.is_below_floor)
    if mode == "fail_unusable" and unusable:
        raise ValueError("y feasibility check failed (unusable): " + ", ".join(unusable))
    if mode == "fail_below_floor" and (unusable or below):
        raise ValueError("y feasibility check failed (below floor or unusable): " + ", ".join(sorted({*unusable, *below})))
    return {"unusable": unusable, "below_floor": below}


def feasibility_frontier(
    capacity: DataFrame, *, docs_requested: int, events_requested: int, docs_effective: int, events_effective: int
) -> DataFrame:
    """Gate grid x tracks: which gates every track meets, and which the whole sample meets.

    `capacity` is the validation capacity per track and in total, a handful of rows; the grids
    are small arrays exploded onto it.
    """
    total, per_track = F.col("is_total") == 1, F.col("is_total") == 0
    tracks = F.collect_list(F.when(per_track, F.struct("track", "n_docs_validation", "n_events_validation")))
    summary = capacity.agg(
        F.max(F.when(total, F.col("n_docs_validation"))).alias("docs_total"),
        F.max(F.when(total, F.col("n_events_validation"))).alias("events_total"),
        F.min(F.when(per_track, F.col("n_docs_validation"))).alias("docs_min"),
        F.max(F.when(per_track, F.col("n_docs_validation"))).alias("docs_max"),
        F.min(F.when(per_track, F.col("n_events_validation"))).alias("events_min"),
        F.max(F.when(per_track, F.col("n_events_validation"))).alias("events_max"),
        tracks.alias("tracks"),
    )

    def grid(fixed: Sequence[int], *names: str) -> Column:
        values = [F.lit(v).cast("bigint") for v in fixed] + [F.col(n) for n in names]
        return F.filter(F.array_distinct(F.array_compact(F.array(*values))), lambda v: v > 0)

    docs = grid([*FRONTIER_DOC_GATES, docs_requested, docs_effective], "docs_total", "docs_min", "docs_max")
    events = grid([*FRONTIER_EVENT_GATES, events_requested, events_effective], "events_total", "events_min", "events_max")
    rows = summary.select("*", F.explode(docs).alias("docs_gate")).select("*", F.explode(events).alias("events_gate"))
    failing = F.array_sort(
        F.transform(
            F.filter(
                "tracks",
                lambda t: (t["n_docs_validation"] < F.col("docs_gate")) | (t["n_events_validation"] < F.col("events_gate")),
            ),
            lambda t: t["track"],
        )
    )
    return rows.select(
        F.col("docs_gate").alias("min_docs_gate"),
        F.col("events_gate").alias("min_events_gate"),
        (F.size(failing) == 0).cast("int").alias("strict_track_feasible"),
        ((F.col("docs_total") >= F.col("docs_gate")) & (F.col("events_total") >= F.col("events_gate"))).cast("int").alias("global_feasible"),
        F.size(failing).alias("n_failing_tracks"),
        F.array_join(failing, ",").alias("failing_tracks"),
    )


def bootstrap_gate(success: Column, attempted: Column, min_ratio: float) -> Column:
    """True when too few replicates converged."""
    ratio = F.when(attempted > 0, success / attempted).otherwise(F.lit(0.0))
    return ratio < min_ratio

