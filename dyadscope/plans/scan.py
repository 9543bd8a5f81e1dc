"""The key-factor scan: plan, gate, fit, infer; over all restarts at once.

Stages and what they move:
 1. choice rows -> two rows per event (one shuffle of the narrow rows, materialised);
 2. a bitmap of usable designs for each event -> counts per design (combined on the map side) -> gates;
 3. only gated samples are fitted: small ones one per task, large ones by distributed sums;
 4. everything after that has one row per candidate, split and restart.
Restart, replicate and context are columns, so nothing is scheduled in a loop over them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadscope.functions.hashing import stable_seed
from dyadscope.operators import candidates as cand
from dyadscope.operators.bootstrap import bootstrap_summary
from dyadscope.operators.designs import (
    Design,
    DesignSet,
    at_design,
    design_bits,
    design_counts,
    design_pairs,
    event_table,
    has_sparse_events,
    of_designs,
    pattern_table,
    row_table,
    sample_totals,
    sparse_pairs,
)
from dyadscope.operators.distributed_fit import Sample, distributed_fit, fit_rows
from dyadscope.operators.events import DOC, KEYS, event_outcomes, one_chosen
from dyadscope.operators.fit import FIT_SCHEMA, cluster_hash, grouped_fit
from dyadscope.operators.gates import FIT, bootstrap_gate, gate_cascade
from dyadscope.operators.inference import assign_tiers, attach_validation_q, pair_splits
from dyadscope.session import cut_lineage, ship_package
from dyadscope.settings import ScanSettings

SAMPLE = ("track", "split_role", "design_id")
MAX_FIT_PARTITIONS = 8192
IDENTITY = ("track", "context_scope", "y_col", "spec_id", "key_factor", "control_set", "fdr_family_id", "equivalence_hash")


@dataclass(frozen=True)
class Prepared:
    """What choice rows are folded to once: events over the columns of `everything`, and rows, by null pattern where those matter."""

    everything: DesignSet
    rows: DataFrame
    events: DataFrame
    sparse: bool
    cluster: str
    totals: DataFrame
    moments: dict = field(default_factory=dict)  # of large samples, as scans find them

    def covers(self, outcomes: Sequence[str], columns: Sequence[str], cluster: str) -> bool:
        return set(outcomes) <= set(self.everything.y_cols) and set(columns) <= set(self.everything.x_cols) and cluster == self.cluster


def prepare(df: DataFrame, outcomes: Sequence[str], columns: Sequence[str], cluster: str) -> Prepared:
    """Fold and write the events of `df`; scans of the same rows with these or fewer columns can share them."""
    everything = DesignSet(tuple(Design(i, y, tuple(columns)) for i, y in enumerate(dict.fromkeys(outcomes))))
    rows = row_table(df, everything, cluster=cluster)
    events = cut_lineage(event_table(rows, everything))
    sparse = has_sparse_events(events)
    if sparse:
        rows = cut_lineage(pattern_table(rows, everything))
    return Prepared(everything, rows, events, sparse, cluster, cut_lineage(sample_totals(events)))


@dataclass
class ScanResult:
    scan: DataFrame  # one row per candidate, split and restart
    top: DataFrame  # one row per candidate and restart
    log: DataFrame  # governance notes, evaluated rows, skipped items
    fits: DataFrame | None = None  # point fits and replicates by sample, regressors and seed, for later passes
    prepared: Prepared | None = None


def discovery_capacity(df: DataFrame, y_cols: Sequence[str]) -> DataFrame:
    """(track, y_col) -> informative events and documents of the discovery side."""
    events = event_outcomes(df.where(F.col("split_role") == "discovery"), y_cols, ("track",)).where("n_rows = 2")
    good = {y: one_chosen(F.col(f"sum_{y}")) for y in y_cols}
    wide = events.groupBy("track").agg(
        *[F.count_if(good[y]).alias(f"e_{y}") for y in y_cols],
        *[F.count_distinct(F.when(good[y], F.col(DOC))).alias(f"d_{y}") for y in y_cols],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(y).alias("y_col"),
                F.col(f"e_{y}").alias("n_informative_events"),
                F.col(f"d_{y}").alias("n_docs_informative"),
            )
            for y in y_cols
        ]
    )
    return wide.select("track", F.inline(cells))


def plan_candidates(
    df: DataFrame, features: Sequence[str], settings: ScanSettings, tracks: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(candidates with duplicate_of, log of skipped contexts, outcomes, specs and duplicates).

    `tracks` gives the distinct tracks where they are known already.
    """
    spark = df.sparkSession
    _require_fixed(df, settings)
    contexts = spark.createDataFrame(
        [(i, s, y) for i, (s, y) in enumerate(settings.contexts)], "position int, context_scope string, y_col string"
    )
    checked = cand.validate_contexts(contexts, df.columns)
    kept = _valid_contexts(df, settings)
    if not kept:
        raise ValueError("no valid contexts available for scan")
    usable = list(dict.fromkeys(f.strip() for f in features if f.strip() in df.columns))
    usable = usable[: settings.max_features] if settings.max_features > 0 else usable
    specs = cand.control_specs(settings.controls, df.columns)

    if tracks is None:
        tracks = df.where(F.col("track").isNotNull()).select(F.col("track").cast("string")).distinct()
    pool = cand.candidate_pool(tracks, kept, specs, usable, settings.controls.fixed)
    skipped = checked.where("skip_reason <> ''").select(
        F.lit("skipped_context").alias("status"), "context_scope", "y_col", F.col("skip_reason").alias("reason_code"),
        F.lit("plan").alias("reason_stage"),
    )
    y_cols = list(dict.fromkeys(y for _, y in kept))
    if settings.controls.skip_starved_outcomes:
        capacity = discovery_capacity(df, y_cols)
        bad = cand.infeasible_track_outcomes(capacity, settings.gates.discovery.events, settings.gates.discovery.docs)
        pool = pool.join(bad.select("track", "y_col"), ["track", "y_col"], "left_anti")
        skipped = skipped.unionByName(
            bad.select(F.lit("skipped_track_context").alias("status"), "track", "y_col", "reason_code", "reason_detail",
                       F.lit("plan").alias("reason_stage")),
            allowMissingColumns=True,
        )
    with_base = [s for s, controls in specs if controls]
    if settings.controls.drop_starved_base and with_base and settings.controls.spec_mode == "both":
        controls = next(c for s, c in specs if c)
        need_events, need_docs = cand.base_control_needs(settings, len(controls))
        off = cand.disabled_control_specs(discovery_capacity(df, y_cols), with_base[0], need_events, need_docs)
        pool = pool.join(off.select("track", "y_col", "spec_id"), ["track", "y_col", "spec_id"], "left_anti")
        skipped = skipped.unionByName(
            off.select(F.lit("skipped_control_spec").alias("status"), "track", "y_col", "spec_id", "reason_code",
                       "reason_detail", F.lit("plan").alias("reason_stage")),
            allowMissingColumns=True,
        )
    marked = cand.mark_equivalents(pool)
    duplicates = marked.where("duplicate_of is not null").select(
        F.lit("skipped_equivalent_spec").alias("status"), "candidate_id", "track", "context_scope", "y_col", "spec_id",
        "key_factor", "equivalence_hash", F.lit("plan").alias("reason_stage"),
        F.lit("skipped_equivalent_spec").alias("reason_code"),
        F.concat(F.lit("duplicate_of="), "duplicate_of").alias("reason_detail"),
    )
    return marked, skipped.unionByName(duplicates, allowMissingColumns=True)


def _require_fixed(df: DataFrame, settings: ScanSettings) -> None:
    missing = [c for c in settings.controls.fixed if c not in df.columns]
    if missing:
        raise ValueError(f"fixed regressors missing in data: {missing}")


def _valid_contexts(df: DataFrame, settings: ScanSettings) -> list[tuple[str, str]]:
    named = dict.fromkeys((s.strip(), y.strip()) for s, y in settings.contexts)
    return [(s, y) for s, y in named if s and y in df.columns]


def _designs(plan: list, everything: DesignSet) -> DesignSet:
    """Distinct (outcome, regressors) behind the candidates, on the column layout of the event table."""
    found = list(dict.fromkeys((row["y_col"], tuple(row["exog_cols"])) for row in plan))
    return DesignSet(tuple(Design(i, y, exog) for i, (y, exog) in enumerate(found)), everything.y_cols, everything.x_cols)


def _fits(
    rows: DataFrame, events: DataFrame, designs: DesignSet, tasks: list[tuple], settings: ScanSettings, sparse: DataFrame | bool, moments: dict | None = None,
) -> DataFrame:
    """Fit results for every task (sample keys, events, fit_id, seed, start, known), whatever the sample size."""
    spark = rows.sparkSession
    limit = settings.draws.one_task_events
    small = [t for t in tasks if t[3] <= limit]
    large = [t for t in tasks if t[3] > limit]
    if large and settings.draws.law != "poisson":
        raise ValueError("fixed_size draws need samples of at most one_task_events events")
    keys_schema = "track string, split_role string, design_id int"
    opts = (settings.draws.replicates, settings.optimiser.method, settings.optimiser.adam)
    parts: list[DataFrame] = []

    def samples(chosen: list[tuple]) -> DataFrame:
        keys = spark.createDataFrame(list({t[:3] for t in chosen}), keys_schema)
        # Events of other samples leave before there is a row for each design.
        own = events.join(F.broadcast(keys.select(*KEYS).distinct()), [*KEYS], "left_semi")
        long = design_pairs(rows, own, designs, keep={t[2] for t in chosen}, sparse=sparse)
        return long.join(F.broadcast(keys), [*SAMPLE], "left_semi")  # one row per sample of the plan

    if small:
        n = min(len({t[:3] for t in small}), MAX_FIT_PARTITIONS)
        jobs = spark.createDataFrame([(*t[:3], *t[4:]) for t in small], keys_schema + ", fit_id int, seed bigint, start int, known boolean")
        # Every group here holds at most `limit` events, checked against the gate counts. The
        # number of partitions is given, or small inputs would be merged into one Python task.
        parts.append(
            samples(small)
            .select(*SAMPLE, "event_id", (cluster_hash(F.col("boot")) if settings.draws.law == "poisson" else F.col("boot")).alias("boot"), "chosen", "other")
            .repartition(n, *SAMPLE)
            .groupBy(*SAMPLE)
            .cogroup(jobs.repartition(n, *SAMPLE).groupBy(*SAMPLE))
            .applyInArrow(grouped_fit(*opts, settings.draws.law), FIT_SCHEMA)
        )
    if large:
        # Narrow rows of the large samples, written once and read in every pass; the designs are applied inside the tasks.
        by_sample: dict[tuple, list[tuple]] = {}
        for t in large:
            by_sample.setdefault(t[:3], []).append(t[4:])
        index = designs.indexed()
        plan: dict[tuple, list] = {}
        for track, role, design_id in by_sample:
            plan.setdefault((track, role), []).append((design_id, *index[design_id]))
        more = None
        if isinstance(sparse, DataFrame):
            more = of_designs(sparse, {key[2] for key in by_sample})
        wanted = F.broadcast(spark.createDataFrame(list(plan), "track string, split_role string"))  # as many as the plan has
        sample = Sample(cut_lineage(fit_rows(events, more, KEYS).join(wanted, [*KEYS], "left_semi")), plan)
        parts.append(distributed_fit(sample, by_sample, *opts, moments))
    if not parts:
        return spark.createDataFrame([], FIT_SCHEMA)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _law(settings: ScanSettings) -> str:
    """What fits of one table must have in common to be used for each other."""
    return f"{settings.optimiser.method}|{settings.optimiser.adam}|{settings.draws.law}|{settings.draws.unit}"


FITS_KEY = ("track", "split_role", "y_col", "exog")
NO_DRAWS = "array<struct<rep:int,beta:double>>"


def _prior_fits(prior: DataFrame | None, settings: ScanSettings, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Point fits by (sample, regressors), and replicates by those and seed, of earlier scans with the same law."""
    if prior is None:
        prior = spark.createDataFrame([], FITS_SCHEMA)
    same = prior.where(F.col("law") == _law(settings))
    point = same.groupBy(*FITS_KEY).agg(F.first(F.struct("beta", "llf", "design_rank", "fit_error")).alias("point"))
    drawn = same.where(F.lit(settings.draws.law == "poisson")).groupBy(*FITS_KEY, "seed").agg(F.max_by(F.struct("boot", "boot_attempted"), "boot_attempted").alias("drawn"))
    kept = F.filter("drawn.boot", lambda x: x["rep"] < settings.draws.replicates)
    attempted = F.least(F.col("drawn.boot_attempted"), F.lit(settings.draws.replicates))
    return point, drawn.select(*FITS_KEY, "seed", kept.alias("old_boot"), attempted.alias("old_attempted"))


FITS_SCHEMA = (
    "track string, split_role string, y_col string, exog array<string>, seed bigint, law string, beta double, llf double, design_rank int, fit_error string, "
    f"boot {NO_DRAWS}, boot_attempted int, new_attempted int, point_fitted boolean"
)


def _all_fits(prepared: Prepared, designs: DesignSet, gate_rows: list, settings: ScanSettings, prior: DataFrame | None, sparse: DataFrame | bool) -> DataFrame:
    """Fits by fit_id: what earlier scans have of them, and only the rest fitted now.

    Replicates are addressed by (seed, number), so a bootstrap of 199 after one of 49 runs 150; a point fit holds for
    every seed.
    """
    spark = prepared.rows.sparkSession
    wanted = [(r["track"], r["split_role"], *_named(designs, r["design_id"]), r["seed"], r["fit_id"], r["design_id"], r["n_informative"]) for r in gate_rows if r["status"] == FIT]
    tasks = spark.createDataFrame(wanted, "track string, split_role string, y_col string, exog array<string>, seed bigint, fit_id int, design_id int, n_informative bigint")
    point, drawn = _prior_fits(prior, settings, spark)
    joined = cut_lineage(tasks.join(point, [*FITS_KEY], "left").join(drawn, [*FITS_KEY, "seed"], "left"))
    lost = F.col("point").isNotNull() & F.col("point.beta").isNull()
    # A row a fit of the plan; the replicates themselves stay where they are.
    todo = joined.select(
        *SAMPLE, "n_informative", "fit_id", "seed", F.when(lost, settings.draws.replicates).otherwise(F.coalesce("old_attempted", F.lit(0))).alias("start"), F.col("point").isNotNull().alias("known"))
    jobs = [tuple(r) for r in todo.where(~F.col("known") | (F.col("start") < settings.draws.replicates)).collect()]
    new = _fits(prepared.rows, prepared.events, designs, jobs, settings, sparse, prepared.moments)
    fresh = new.select(
        "fit_id", F.struct("beta", "llf", "design_rank", "fit_error").alias("fresh"), F.arrays_zip(F.col("boot_reps").alias("rep"), F.col("boot_betas").alias("beta")).cast(NO_DRAWS).alias("new_boot"),
        F.col("boot_attempted").alias("new_attempted"), "point_fitted")
    first = F.coalesce("point", "fresh")
    none = F.array().cast(NO_DRAWS)
    done = first["beta"].isNotNull()
    return cut_lineage(joined.join(fresh, "fit_id", "left").select(
        "fit_id", *FITS_KEY, "seed", F.lit(_law(settings)).alias("law"), *[first[c].alias(c) for c in ("beta", "llf", "design_rank", "fit_error")],
        F.when(done, F.concat(F.coalesce("old_boot", none), F.coalesce("new_boot", none))).otherwise(none).alias("boot"),
        F.when(done, F.coalesce("old_attempted", F.lit(0)) + F.coalesce("new_attempted", F.lit(0))).otherwise(0).alias("boot_attempted"),
        F.coalesce("new_attempted", F.lit(0)).alias("new_attempted"), F.coalesce("point_fitted", F.lit(False)).alias("point_fitted"),
    ))


def _named(designs: DesignSet, design_id: int) -> tuple[str, list[str]]:
    d = designs.designs[design_id]
    return d.y_col, list(d.exog)


def run_scan(
    df: DataFrame, features: Sequence[str], settings: ScanSettings, *, penalty: float | None = None, prepared: Prepared | None = None, prior: DataFrame | None = None,
) -> ScanResult:
    """Evaluate every candidate on both splits for every restart.

    `prepared` and `prior` are what an earlier scan of the same rows folded and fitted (`ScanResult.prepared`, `.fits`):
    events are not folded again, and only point fits and replicates that are not there yet are run.
    """
    settings = settings.checked()
    spark: SparkSession = df.sparkSession
    ship_package(spark)
    _require_fixed(df, settings)
    contexts = _valid_contexts(df, settings)
    used = list(dict.fromkeys(f for f in features if f in df.columns))
    controls = [c for _, cs in cand.control_specs(settings.controls, df.columns) for c in cs]
    columns = list(dict.fromkeys([*used, *settings.controls.fixed, *controls]))
    if not contexts:
        raise ValueError("no valid contexts available for scan")
    if not columns:
        raise ValueError("no features available for scan")
    outcomes = [y for _, y in contexts]
    if prepared is None or not prepared.covers(outcomes, columns, settings.draws.unit):
        prepared = prepare(df, outcomes, columns, settings.draws.unit)
    rows, events = prepared.rows, prepared.events

    tracks = spark.createDataFrame([(r[0],) for r in prepared.totals.select("track").distinct().collect()], "track string")
    candidates, skipped = plan_candidates(df, features, settings, tracks.where("track is not null"))
    plan = candidates.where("duplicate_of is null").orderBy("plan_order").collect()  # plan-sized
    if not plan:
        raise ValueError("no candidates left to evaluate")
    designs = _designs(plan, prepared.everything)
    ids = {(d.y_col, d.exog): d.design_id for d in designs.designs}
    kept = spark.createDataFrame(
        [(*(r[c] for c in ("plan_order", "candidate_id", *IDENTITY)), ids[(r["y_col"], tuple(r["exog_cols"]))], len(r["exog_cols"])) for r in plan],
        "plan_order int, candidate_id string, " + ", ".join(f"{c} string" for c in IDENTITY) + ", design_id int, n_exog int",
    )

    # Written once for the counts, the small and the large fits.
    sparse = cut_lineage(sparse_pairs(rows, events, designs, designs.as_column(), KEYS)) if prepared.sparse else False
    counts = design_counts(design_bits(rows, events, designs, sparse=sparse), len(designs.designs))
    evaluated = (
        at_design(cand.evaluation_order(kept).join(counts, ["track", "split_role"], "left"), F.col("design_id"))
        .join(prepared.totals, ["track", "split_role"], "left")
        .na.fill(0, ["n_informative", "n_docs", "n_choice_situations_total", "n_docs_total", "n_twin_sets"])
    )
    # One row per candidate, split and restart: the size of the plan, whatever the data.
    n_eval = 2 * len(plan)
    restarts = F.array(*[F.struct(F.lit(i).alias("restart_id"), F.lit(s).cast("bigint").alias("base")) for i, s in settings.draws.restart_seeds()])
    gated = gate_cascade(evaluated, settings.gates).select("*", F.inline(restarts)).withColumns(
        {
            "fit_id": ((F.col("restart_id") - 1) * n_eval + F.col("candidate_eval_order")).cast("int"),
            "seed": stable_seed(F.col("base"), F.concat_ws("|", "candidate_id", "split_role")),
        }
    )
    gate_rows = gated.collect()
    per_restart = spark.createDataFrame(gate_rows, gated.schema)
    fits = _all_fits(prepared, designs, gate_rows, settings, prior, sparse)

    draws = fits.select("fit_id", F.explode("boot.beta").alias("beta"))
    summary = bootstrap_summary(draws, ["fit_id"])
    fitted = fits.select(
        "fit_id", "beta", "llf", "design_rank", "fit_error", F.size("boot").alias("bootstrap_success"),
        F.col("boot_attempted").alias("bootstrap_attempted"),
    )
    joined = per_restart.join(fitted, "fit_id", "left").join(summary, "fit_id", "left")

    gate = F.col("status") == FIT
    failed = gate & (F.col("fit_error").isNotNull())
    degenerate = gate & (F.col("design_rank") < F.col("n_exog"))
    starved = gate & bootstrap_gate(F.col("bootstrap_success"), F.col("bootstrap_attempted"), settings.gates.converged_share)
    verdict = (
        F.when(~gate, F.struct("status", "reason_code", "reason_detail", "reason_stage"))
        .when(
            degenerate,
            _verdict("not_estimable_degenerate_design_matrix", F.format_string("matrix_rank=%d < n_exog=%d", "design_rank", "n_exog"), "precheck"),
        )
        .when(failed, _verdict("fit_failed", F.col("fit_error"), "fit"))
        .when(
            starved,
            _verdict(
                "not_estimable_low_bootstrap_success",
                F.format_string(f"%d/%d < {settings.gates.converged_share:.3f}", "bootstrap_success", "bootstrap_attempted"),
                "bootstrap",
            ),
        )
        .otherwise(_verdict("ok", F.lit(""), "completed"))
    )
    lam = settings.evidence.penalty if penalty is None else penalty
    ok = F.col("_v.status") == "ok"
    scan = joined.withColumn("_v", verdict).select(
        F.lit(settings.run_id).alias("run_id"),
        "restart_id",
        "candidate_id",
        *IDENTITY,
        "split_role",
        "n_choice_situations_total",
        F.col("n_informative").alias("n_single_choice_informative"),
        F.col("n_docs").alias("n_policy_docs_informative"),
        "n_twin_sets",
        *[F.when(ok, F.col(c)).alias(c) for c in ("beta", "ci95_lower", "ci95_upper", "se_boot", "p_boot")],
        F.when(ok, F.col("llf") - F.lit(float(lam)) * F.col("n_exog")).alias("score"),
        F.lit(settings.draws.unit).alias("bootstrap_cluster_unit"),
        F.coalesce("bootstrap_success", F.lit(0)).alias("bootstrap_success"),
        F.coalesce("bootstrap_attempted", F.lit(0)).alias("bootstrap_attempted"),
        "_v.*",
        F.col("top1_share").alias("top1_policy_doc_event_share"),
        "candidate_eval_order",
        F.lit(len(plan)).alias("candidate_pool_size"),
        F.lit(1).alias("support_only"),
        F.lit(1).alias("not_replacing_confirmatory_claim"),
        F.lit(int(settings.validation_steers)).alias("validation_used_for_search"),
        F.lit(int(settings.pool_locked)).alias("candidate_pool_locked_pre_validation"),
        F.lit(settings.timestamp).alias("timestamp"),
    )
    scan = attach_validation_q(scan, keys=("restart_id",))
    paired = pair_splits(scan, ("restart_id", "candidate_id"), ("run_id", *IDENTITY, "candidate_pool_size"))
    top = assign_tiers(paired, p_threshold=settings.evidence.p_limit, q_threshold=settings.evidence.q_limit)
    scan = scan.join(top.select("restart_id", "candidate_id", "candidate_tier"), ["restart_id", "candidate_id"])
    return ScanResult(scan, top, search_log(scan, skipped, len(plan), settings), fits.drop("fit_id"), prepared)


def _verdict(code: str, detail, stage: str):
    return F.struct(
        F.lit(code).alias("status"), F.lit(code).alias("reason_code"), detail.alias("reason_detail"), F.lit(stage).alias("reason_stage")
    )


def search_log(scan: DataFrame, skipped: DataFrame, pool_size: int, settings: ScanSettings) -> DataFrame:
    """Governance notes, every evaluated row and every skipped item, in one schema."""
    spark = scan.sparkSession
    notes = spark.createDataFrame(
        [
            ("plan", "validation_not_used_for_search", f"candidate_pool_locked_pre_validation=true; candidate_pool_size={pool_size}"),
            ("schedule", "validation_runs_after_discovery_on_locked_pool", f"discovery_candidates_evaluated={pool_size}"),
        ],
        "reason_stage string, reason_code string, reason_detail string",
    ).select("*", F.lit("search_governance_contract").alias("status"), F.lit("plan").alias("split_role"))
    evaluated = scan.select(
        "restart_id", "candidate_id", "track", "context_scope", "y_col", "split_role", "spec_id", "key_factor", "status",
        "reason_stage", "reason_code", "reason_detail", "bootstrap_success", "bootstrap_attempted",
        "candidate_eval_order", "equivalence_hash",
    )
    plan_items = skipped.withColumn("split_role", F.lit("plan"))
    out = evaluated.unionByName(notes, allowMissingColumns=True).unionByName(plan_items, allowMissingColumns=True)
    return out.withColumns(
        {
            "run_id": F.lit(settings.run_id),
            "candidate_pool_size": F.lit(pool_size),
            "validation_used_for_search": F.lit(0),
            "candidate_pool_locked_pre_validation": F.lit(1),
            "timestamp": F.lit(settings.timestamp),
        }
    )
