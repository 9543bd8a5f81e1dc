"""Run listings: modes, states, history, filters, pages, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("queued", "running", "succeeded", "failed", "cancelled")


def _text(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col.cast("string"), F.lit(""))))


def infer_mode(run_id: Column) -> Column:
    """Run mode from the words in a run id, the most specific first."""
    rid = _text(run_id)

    def has(word: str) -> Column:
        return F.contains(rid, F.lit(word))

    return (
        F.when(has("singlex_hypothesis_panel"), "singlex_hypothesis_panel")
        .when(has("nooption_hypothesis_panel"), "nooption_hypothesis_panel")
        .when(has("singlex"), "singlex_baseline")
        .when(has("nooption"), "nooption_baseline")
        .when(has("openexplore_autorefine"), "openexplore_autorefine")
        .when(has("openexplore"), "openexplore")
        .otherwise("nooption_baseline")
    )


def infer_state(status: Column) -> Column:
    s = _text(status)
    return (
        F.when(s.isin(*STATES), s)
        .when(s.isin("partial_failure", "error", "failed_exception"), "failed")
        .when(s == "canceled", "cancelled")
        .otherwise("succeeded")
    )


def first_timestamp(*cols: Column) -> Column:
    filled = [F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) != "", F.trim(c.cast("string"))) for c in cols]
    return F.coalesce(*filled)


def latest_per_run(entries: DataFrame, *, stamp: str = "updated_at", order: str = "source_order") -> DataFrame:
    """Newest entry per run; on equal stamps the later source wins. A map-side combined max_by."""
    rest = [c for c in entries.columns if c != "run_id"]
    newest = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(stamp), F.lit("")).alias("s"), F.col(order).alias("o")))
    return entries.where(F.trim(F.coalesce("run_id", F.lit(""))) != "").groupBy("run_id").agg(newest.alias("_e")).select("run_id", "_e.*")


def live_over_history(live: DataFrame, history: DataFrame) -> DataFrame:
    """Live entries, plus history entries of other runs."""
    return live.unionByName(history.join(live.select("run_id"), "run_id", "left_anti"), allowMissingColumns=True)


def run_page(rows: DataFrame, *, state: str = "", mode: str = "", contains: str = "", offset: int = 0, limit: int = 200) -> DataFrame:
    """One page of runs, newest first."""
    if state.strip():
        rows = rows.where(_text(F.col("state")) == state.strip().lower())
    if mode.strip():
        rows = rows.where(_text(F.col("mode")) == mode.strip().lower())
    if contains.strip():
        rows = rows.where(F.contains(_text(F.col("run_id")), F.lit(contains.strip().lower())))
    return rows.orderBy(F.desc("updated_at"), "run_id").offset(offset).limit(limit)


def run_counters(rows: DataFrame) -> DataFrame:
    s = _text(F.col("state"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(s == name).alias(name) for name in ("succeeded", "running", "queued", "failed", "cancelled")],
        F.count_if(F.col("has_result").cast("int") == 1).alias("with_result"),
    )


def latest_result(rows: DataFrame) -> DataFrame:
    """The newest run with a result, else the newest succeeded, else the newest."""
    s = _text(F.col("state"))
    rank = F.when(F.col("has_result").cast("int") == 1, 2).when(s == "succeeded", 1).otherwise(0)
    return rows.agg(F.max_by("run_id", F.struct(rank.alias("r"), F.col("updated_at"), F.col("run_id").alias("t"))).alias("run_id"))


def actionable(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs that failed, were cancelled or are still open; when there are none, the latest result."""
    open_state = _text(F.col("state")).isin("failed", "cancelled", "running", "queued")
    any_open = rows.agg(F.max(open_state.cast("int"))).scalar()
    latest = latest_result(rows).scalar()
    keep = F.when(any_open == 1, open_state).otherwise(F.col("run_id") == latest)
    found = rows.where(keep).orderBy(F.desc("updated_at"), "run_id")
    return found if limit is None else found.limit(limit)


def paired_ids(run_id: Column, hypothesis_mode: bool = False) -> Column:
    """(nooption, singlex) run ids of the pair a run id belongs to."""
    # Run-id suffixes of the two branches.
    suffixes = [
        ("__nooption_baseline", "__singlex"),
        ("__nooption_hypothesis_panel", "__singlex_hypothesis_panel"),
    ]

    def both(head: Column, pair: tuple[str, str]) -> Column:
        return F.struct(F.concat(head, F.lit(pair[0])).alias("nooption"), F.concat(head, F.lit(pair[1])).alias("singlex"))

    panel = F.lit(hypothesis_mode) | F.contains(F.lower(run_id), F.lit("hypothesis"))
    out = F.when(panel, both(run_id, suffixes[1])).otherwise(both(run_id, suffixes[0]))
    for pair in suffixes:
        for s in pair:
            head = F.substr(run_id, F.lit(1), F.length(run_id) - len(s))
            out = F.when(F.endswith(run_id, F.lit(s)), both(head, pair)).otherwise(out)
    return out


def governance_flags(doc: DataFrame) -> DataFrame:
    """Search-governance flags of run documents, nested block first, top-level fields second.

    Documents have string columns run_id, search_governance (json), validation_used_for_search and
    candidate_pool_locked_pre_validation.
    """

    def pick(name: str) -> Column:
        nested = F.get_json_object("search_governance", f"$.{name}")
        return F.lower(F.when(F.col("search_governance").isNotNull(), nested).otherwise(F.col(name)))

    used, locked = pick("validation_used_for_search"), pick("candidate_pool_locked_pre_validation")
    return doc.select(
        "run_id",
        used.alias("validation_used_for_search"),
        locked.alias("candidate_pool_locked_pre_validation"),
        F.coalesce(used == "false", F.lit(False)).cast("int").alias("validation_used_for_search_false"),
        F.coalesce(locked == "true", F.lit(False)).cast("int").alias("candidate_pool_locked_true"),
    )


def dataset_candidates(entries: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """First existing artifact per run (scan rows, inference rows, top rows), newest runs first.

    `entries` has run_id, updated_at and one path column per artifact; `files` lists paths.
    When none exists the first named artifact is reported as missing.
    """
    kinds = ("scan_runs_csv", "top_models_inference_csv", "top_models_csv")
    named = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).alias("artifact_key"), F.nullif(F.trim(c), F.lit("")).alias("path")) for i, c in enumerate(kinds)])
    options = entries.select("run_id", "updated_at", F.inline(named)).where("path is not null")
    known = options.join(files.select("path", F.lit(1).alias("found")), "path", "left")
    best = known.groupBy("run_id", "updated_at").agg(
        F.min_by(F.struct("artifact_key", "path", "found"), F.struct((-F.coalesce("found", F.lit(0))).alias("f"), "k")).alias("b")
    )
    found = best.select("run_id", "updated_at", "b.artifact_key", "b.path", F.coalesce("b.found", F.lit(0)).alias("exists")).orderBy(
        F.desc("updated_at"), "run_id"
    )
    return found if limit is None else found.limit(limit)
