"""The composed search: from a prepared, split choice table to audited, restart-checked evidence.

Windows, precheck, gates, registry, derived features, family dedupe, controls, penalty, scan over
restarts, consensus, stability, second passes, writes: each step is the operator of its name, and
what it decides takes effect in the next. Derived columns that the registry accepts are added to the
choice table, so the scan fits them like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.functions.hashing import table_fingerprint
from dyadscope.operators import candidates as cand
from dyadscope.operators import derive, gates, precheck, prepare, registry
from dyadscope.plans import passes
from dyadscope.plans.scan import ScanResult
from dyadscope.plans.workload import spread
from dyadscope.session import cut_lineage
from dyadscope.settings import Need, ScanSettings, resolve_base_controls
from dyadscope.sources import sinks

# The columns of a result row, in the order of the contract.
SCAN_FIELDS = (
    "run_id", "track", "context_scope", "split_id", "split_role", "spec_id", "key_factor", "control_set", "fdr_family_id", "candidate_id",
    "n_choice_situations_total", "n_single_choice_informative", "n_policy_docs_informative", "n_twin_sets", "beta", "ci95_lower",
    "ci95_upper", "se_boot", "p_boot", "q_value", "score", "bootstrap_cluster_unit", "bootstrap_success", "bootstrap_attempted",
    "status", "reason_code", "reason_detail", "reason_stage", "top1_policy_doc_event_share", "support_only",
    "not_replacing_confirmatory_claim", "data_hash", "config_hash", "feature_registry_hash", "git_commit", "timestamp",
    "candidate_tier", "validation_used_for_search", "candidate_pool_locked_pre_validation", "candidate_eval_order",
    "candidate_pool_size", "equivalence_hash", "effective_n_bootstrap",
)


@dataclass(frozen=True)
class SearchOptions:
    """What a search adds to the scan's own settings."""

    windows: tuple[int, ...] = ()
    precheck_mode: str = "warn"
    confirmatory_policy: str = "drop_redundant"
    min_track_positive: int = 10
    auto_scale_gates: bool = True
    feasibility_mode: str = "warn"
    expression_mode: str = ""
    expression_bases: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    min_level_count: int = 20
    family_dedupe: str = "atom"
    anchor_track: str = "primary_strict"
    penalty_bounds: tuple[float, float] = (0.0, 1.0)
    escalate_candidates: int = 0
    refine_features: int = 0
    git_commit: str = ""


@dataclass(frozen=True)
class SearchResult:
    scan: DataFrame
    top: DataFrame
    inference: DataFrame
    stability: DataFrame
    registry: DataFrame
    gate_map: DataFrame
    frontier: DataFrame
    log: DataFrame
    flags: dict
    escalation: ScanResult | None = None
    refinement: ScanResult | None = None

    def tables(self) -> dict[str, DataFrame]:
        found = {n: getattr(self, n) for n in ("scan", "top", "inference", "stability", "registry", "gate_map", "frontier", "log")}
        for name in ("escalation", "refinement"):
            if (second := getattr(self, name)) is not None:
                found |= {f"{name}_scan": second.scan, f"{name}_top": second.top}
        return found


def _hash_of(df: DataFrame) -> str:
    """A table's fingerprint as text; one row comes back."""
    row = table_fingerprint(df).first()
    return f"{row['n_rows']}-{row['hash_xor'] & (1 << 64) - 1 if row['hash_xor'] is not None else 0:016x}-{row['hash_sum'] or 0}"


def derived_features(df: DataFrame, options: SearchOptions, row_id: Column) -> tuple[DataFrame, DataFrame | None]:
    """(table with the accepted expressions and levels as columns, their registry rows)."""
    parts: list[DataFrame] = []
    if options.expression_mode:
        found = cut_lineage(derive.expression_registry(df, options.expression_bases, mode=options.expression_mode, row_id=row_id))
        accepted = {r["feature_name"] for r in found.where("allowed_in_scan = 1").collect()}  # one row an expression
        df = derive.add_expressions(df, [e for e in derive.plan_expressions(options.expression_bases, options.expression_mode) if e.name in accepted])
        parts.append(found.select(
            "feature_name", F.split("expression_inputs", "\\|").alias("expression_input_features"), F.lit(None).cast("string").alias("categorical_source_feature"),
            "share_events_with_variation", "share_events_nonmissing", "allowed_in_scan",
            F.when(F.col("skip_reason") != "", F.array("skip_reason")).otherwise(F.array().cast("array<string>")).alias("block_reasons"),
        ))
    for source in options.categories:
        found = cut_lineage(derive.onehot_registry(df.where("split_role = 'discovery'"), df, source, min_level_count=options.min_level_count))
        if "allowed_in_scan" not in found.columns:
            continue
        for r in found.where("allowed_in_scan = 1").select("feature_name", "categorical_level_value").collect():  # one row a level
            df = df.withColumn(r["feature_name"], derive.onehot_column(source, r["categorical_level_value"]))
        parts.append(found.select(
            "feature_name", F.lit(None).cast("array<string>").alias("expression_input_features"), "categorical_source_feature",
            "share_events_with_variation", "share_events_nonmissing", "allowed_in_scan", "block_reasons",
        ))
    return df, reduce(DataFrame.unionByName, parts) if parts else None


def run_search(
    df: DataFrame, features: Sequence[str], settings: ScanSettings, options: SearchOptions = SearchOptions(), *, row_id: Column | None = None, out: str = ""
) -> SearchResult:
    """Run the whole chain on a split choice table; `features` are the columns that may be key factors.

    `row_id` tells rows apart for the equality of derived columns (default: a hash of all columns).
    With `out`, every table is written below that folder.
    """
    settings = settings.checked()
    row_id = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if row_id is None else row_id
    # Some twenty steps read the rows: they are made once, and a step reads the columns it uses.
    df = cut_lineage(df)
    n_rows = df.count()  # from the files' footers
    data_hash = _hash_of(df)

    # Outcomes: windows become contexts of their own.
    contexts = list(settings.contexts)
    if options.windows:
        df, names = prepare.add_window_outcomes(df, options.windows)
        contexts += [(f"window_{n}", y) for n, y in zip(options.windows, names, strict=True)]
    contexts = [(s, y) for s, y in dict.fromkeys(contexts) if y in df.columns]
    outcomes = list(dict.fromkeys(y for _, y in contexts))

    redundant = cut_lineage(precheck.outcome_redundancy(df, outcomes).where("is_redundant = 1"))
    weak = cut_lineage(precheck.low_support_pairs(df, outcomes, options.min_track_positive))
    flags: dict = precheck.apply_precheck_policy(options.precheck_mode, n_redundant_groups=redundant.count(), n_low_support=weak.count())
    available = df.sparkSession.createDataFrame(list(enumerate(outcomes)), "position int, y_col string")
    confirm = precheck.confirmatory_outcomes(
        available, redundant=redundant.select("y_col"), low_support=weak.select("y_col"), policy=options.confirmatory_policy
    )
    confirmatory = [r["y_col"] for r in confirm.where("is_confirmatory = 1").orderBy("position").collect()]  # one row an outcome

    # Gates of the validated tier follow what each outcome's validation side can carry.
    gate_map = cut_lineage(gates.outcome_gate_map(
        df, outcomes, events=settings.gates.validation.events, docs=settings.gates.validation.docs, auto_scale=options.auto_scale_gates
    ))
    flags |= gates.check_outcome_feasibility(gate_map, options.feasibility_mode)
    by_y = {r["y_col"]: r for r in gate_map.collect()}
    settings = settings.but(contexts=tuple(contexts), validation_by_outcome={y: Need(int(r["gate_events"]), int(r["gate_docs"])) for y, r in by_y.items()})
    frontier = frontier_of(df, outcomes, settings)

    # Features: plain columns, then what is derived from them, then one per family.
    plain = registry.build_registry(df, columns=[f for f in dict.fromkeys(features) if f in df.columns], timing=lambda c: F.lit("pre_treatment"))
    df, derived = derived_features(df, options, row_id)
    everything = plain.select("feature_name", "share_events_with_variation", "share_events_nonmissing", "allowed_in_scan", "block_reasons")
    if derived is not None:
        everything = everything.unionByName(derived, allowMissingColumns=True)
    everything = registry.filter_by_data(cut_lineage(everything), df, [*features, *[c for c in df.columns if c.startswith(("expr__", "cat__"))]])
    found = cut_lineage(registry.family_dedupe(everything, options.family_dedupe))
    chosen = [r["feature_name"] for r in found.where("allowed_in_scan = 1").orderBy("feature_name").collect()]  # one row a feature
    if not chosen:
        raise ValueError("no feature passed the registry")

    used, missing = resolve_base_controls(list(df.columns), include=settings.controls.use_base, override=",".join(settings.controls.base))
    flags |= {"missing_base_controls": missing, "confirmatory_outcomes": confirmatory}
    settings = settings.but(base=tuple(used))
    n_events = max([int(r["total_events"] or 0) for r in by_y.values()], default=0)
    pool = cand.pool_size_estimate(len(chosen), 2, len(contexts), bool(used))
    lo, hi = options.penalty_bounds
    penalty = df.sparkSession.range(1).select(cand.complexity_penalty(F.lit(float(settings.evidence.penalty)), F.lit(pool), F.lit(n_events), lo, hi)).first()[0]

    df = spread(df, n_rows, "event_id")
    result, inference, stability = passes.run_restarts(
        df, chosen, settings, anchor_track=options.anchor_track, confirmatory_y=confirmatory, penalty=float(penalty)
    )
    audit = {
        "data_hash": data_hash, "config_hash": sinks.document_hash({"settings": asdict(settings), "options": asdict(options)}),
        "feature_registry_hash": _hash_of(found.select("feature_name", "allowed_in_scan")), "git_commit": options.git_commit,
    }
    scan = audited(result.scan, audit, df)
    top = cut_lineage(result.top)
    escalation = passes.escalate(df, top, settings, first=result, max_candidates=options.escalate_candidates) if options.escalate_candidates else None
    refinement = passes.refine(df, top, settings, first=result, max_features=options.refine_features) if options.refine_features else None
    done = SearchResult(scan, top, inference, stability, found, gate_map, frontier, result.log, flags, escalation, refinement)
    if out:
        for name, rows in done.tables().items():
            sinks.write_rows(rows, f"{out}/{name}")
        sinks.write_document(df.sparkSession, {"run_id": settings.run_id, **audit, "flags": flags}, f"{out}/summary")
    return done


def audited(scan: DataFrame, audit: dict[str, str], df: DataFrame) -> DataFrame:
    """Result rows with hashes and the split's name, in the order of the contract; restart_id comes last."""
    split_id = df.agg(F.max("split_id")).first()[0] if "split_id" in df.columns else ""
    rows = scan.withColumns({k: F.lit(v) for k, v in audit.items()} | {"split_id": F.lit(split_id or ""), "effective_n_bootstrap": F.col("bootstrap_success")})
    fields = [c for c in SCAN_FIELDS if c in rows.columns]
    return rows.select(*fields, *[c for c in rows.columns if c not in fields])


def frontier_of(df: DataFrame, outcomes: Sequence[str], settings: ScanSettings) -> DataFrame:
    """Which gates the validation side could meet, for the first outcome; capacity is a row a track and one in total."""
    val = df.where("split_role = 'validation'")
    capacity = gates.capacity_by_outcome(val, outcomes[:1]).select(
        "track", "is_total", F.col("n_docs_informative").alias("n_docs_validation"), F.col("n_informative_events").alias("n_events_validation")
    )
    used = settings.gates.validation_by_outcome.get(outcomes[0], settings.gates.validation)
    return gates.feasibility_frontier(
        capacity, docs_requested=settings.gates.validation.docs, events_requested=settings.gates.validation.events,
        docs_effective=used.docs, events_effective=used.events,
    )


def frontier_summary(frontier: DataFrame, *, docs_effective: int, events_effective: int, strict: bool = False) -> dict:
    """Counts of feasible gate pairs, the largest feasible gates, and whether the gates in use are among them."""
    ok = F.col("strict_track_feasible") == 1
    here = (F.col("min_docs_gate") == docs_effective) & (F.col("min_events_gate") == events_effective)
    row = frontier.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(ok).alias("n_track_feasible"), F.count_if(F.col("global_feasible") == 1).alias("n_global_feasible"),
        F.max(F.when(ok, F.col("min_docs_gate"))).alias("max_docs_gate"), F.max(F.when(ok, F.col("min_events_gate"))).alias("max_events_gate"),
        F.max((here & ok).cast("int")).alias("effective_gate_feasible"),
    ).first()
    if strict and not row["effective_gate_feasible"]:
        raise ValueError("the gates in use are not met by every track")
    return row.asDict()
