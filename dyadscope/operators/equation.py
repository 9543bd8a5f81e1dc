"""Equation path: how accuracy and likelihood move as factors enter one after another."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.functions.names import contribution_atoms
from dyadscope.operators import fit as kernel
from dyadscope.operators.bootstrap import distribution_summary
from dyadscope.operators.designs import Design, DesignSet, design_pairs, event_table, has_sparse_events, row_table, sparse_pairs
from dyadscope.operators.distributed_fit import Sample, distributed_metrics, fit_rows
from dyadscope.operators.events import slice_rows
from dyadscope.session import cut_lineage, ship_package

BASELINE = "(base_controls)"
STEP_SEED_STRIDE = 100003
METRIC_SCHEMA = "design_id int, replicate int, status string, accuracy double, llf_per_event double"


def step_metrics(d: np.ndarray, w: np.ndarray, chosen_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(converged, accuracy, log-likelihood per event) for every weight column.

    On equal utilities the first alternative is predicted. Rescaling a regressor changes neither
    number, so replicates need no standardisation of their own.
    """
    beta, llf, ok = kernel.newton(d, w)
    z = d @ beta.T
    hit = np.where(z == 0.0, chosen_first[:, None], z > 0.0)
    total = np.maximum(w.sum(axis=0), 1.0)
    return ok, (w * hit).sum(axis=0) / total, llf / total


def grouped_metrics(n_boot: int, seed: int, steps: dict[int, int], resampling: str = "poisson") -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Function for one step's sample: replicate -1 is the point fit, 0.. are bootstrap draws."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id", kind="stable")
        design_id = int(rows["design_id"].iloc[0])
        chosen = np.vstack(rows["chosen"].to_numpy()).astype(float)
        other = np.vstack(rows["other"].to_numpy()).astype(float)
        _, scale = kernel.standardise(np.vstack([chosen, other]))
        d, first = (chosen - other) / scale, rows["chosen_first"].to_numpy(dtype=bool)
        own_seed = seed + steps[design_id] * STEP_SEED_STRIDE
        out = [(-1, *step_metrics(d, np.ones((len(d), 1)), first))]
        block = max(1, kernel.CELLS_PER_BLOCK // max(len(d), 1))
        weights = kernel.replicate_weights(rows["boot"].to_numpy(), n_boot, own_seed, resampling, block)
        out += [(at * block, *step_metrics(d, w, first)) for at, w in enumerate(weights)]
        parts = [
            pd.DataFrame(
                {
                    "design_id": design_id,
                    "replicate": np.arange(len(ok)) + at,
                    "status": np.where(ok, "ok", "fit_failed"),
                    "accuracy": np.where(ok, acc, np.nan),
                    "llf_per_event": np.where(ok, llf, np.nan),
                }
            )
            for at, ok, acc, llf in out
        ]
        return pd.concat(parts, ignore_index=True)

    return run


def plan_steps(factors: Sequence[str], controls: Sequence[str], available: Sequence[str], *, baseline: bool = True, max_steps: int | None = None) -> list[tuple[int, str, list[str]]]:
    """(step, added factor, regressors): controls alone first, then one more factor per step."""
    wanted = list(dict.fromkeys(f.strip() for f in factors if f.strip()))
    if not wanted:
        raise ValueError("factors must include at least one feature")
    present = [f for f in wanted if f in available]
    if not present:
        raise ValueError("none of the requested factors were found in the data")
    base = [c for c in dict.fromkeys(controls) if c in available]
    chosen = present if max_steps is None else present[: max(1, max_steps)]
    steps = [(0, BASELINE, base)] if baseline and base else []
    for i, f in enumerate(chosen, start=1):
        steps.append((i, f, list(dict.fromkeys([*base, *chosen[:i]]))))
    return steps


def equation_steps(
    df: DataFrame,
    factors: Sequence[str],
    *,
    controls: Sequence[str] = (),
    y_col: str = "y_all",
    track: str = "primary_strict",
    split_role: str = "validation",
    baseline: bool = True,
    max_steps: int | None = None,
    n_bootstrap: int = 49,
    seed: int = 20260219,
    cluster: str = "policy_document_id",
    order: str | None = None,
    grouped_fit_max_events: int = 100_000,
    resampling: str = "poisson",
) -> DataFrame:
    """One row per step with accuracy and likelihood bands, and deltas against the step before."""
    if y_col not in df.columns:
        raise ValueError(f"y_col not found in prepared data: {y_col}")
    spark = df.sparkSession
    ship_package(spark)
    steps = plan_steps(factors, controls, df.columns, baseline=baseline, max_steps=max_steps)
    designs = DesignSet(tuple(Design(i, y_col, tuple(exog)) for i, (_, _, exog) in enumerate(steps)))
    # 'All tracks' is one sample here, and events are keyed without the track.
    data = slice_rows(df, track, split_role).withColumn("_all", F.lit("all"))
    keys = ("_all",)
    rows = row_table(data, designs, keys=keys, cluster=cluster, order=order)
    events = cut_lineage(event_table(rows, designs, keys))
    sparse = has_sparse_events(events)
    long = design_pairs(rows, events, designs, keys=keys, require_variation=False, sparse=sparse)
    per_doc = long.groupBy("design_id", "doc").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_doc.groupBy("design_id").agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_docs")).collect()  # one row per step
    if not sizes:
        raise ValueError("no rows available after applying track and split filters")
    numbers = {i: s for i, (s, _, _) in enumerate(steps)}
    small = [r["design_id"] for r in sizes if r["n_events"] <= grouped_fit_max_events]
    large = [r["design_id"] for r in sizes if r["n_events"] > grouped_fit_max_events]
    if large and resampling != "poisson":
        raise ValueError("fixed_size resampling needs samples of at most grouped_fit_max_events events")
    parts = []
    if small:
        parts.append(
            design_pairs(rows, events, designs, keys=keys, require_variation=False, keep=small, sparse=sparse)
            .select("design_id", "event_id", "boot", "chosen", "other", "chosen_first")
            .repartition(len(small), "design_id").groupBy("design_id").applyInPandas(
                grouped_metrics(n_bootstrap, seed, numbers, resampling), METRIC_SCHEMA
            )
        )
    if large:
        index = designs.indexed()
        more = cut_lineage(sparse_pairs(rows, events, designs, designs.as_column(large), keys)) if sparse else None
        sample = Sample(fit_rows(events, more, keys), {("all", ""): [(i, *index[i]) for i in large]}, vary=False)
        seeds = {("all", "", i): seed + numbers[i] * STEP_SEED_STRIDE for i in large}
        parts.append(distributed_metrics(sample, seeds, n_bootstrap))
    metrics = cut_lineage(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))

    plan = spark.createDataFrame(
        [(i, s, f, " + ".join(x), len(x), int(f == BASELINE)) for i, (s, f, x) in enumerate(steps)],
        "design_id int, step int, added_factor string, exog string, n_exog_cols int, is_baseline int",
    )
    counts = spark.createDataFrame([(r["design_id"], r["n_events"], r["n_docs"]) for r in sizes], "design_id int, n_events bigint, n_policy_docs bigint")
    return step_table(plan.join(counts, "design_id", "left"), metrics, y_col, n_bootstrap)


def step_table(plan: DataFrame, metrics: DataFrame, y_col: str, n_bootstrap: int) -> DataFrame:
    """Bands per step (point values where no replicate converged), then deltas by step order."""
    ok = metrics.where("replicate >= 0 and status = 'ok'")
    bands = {
        m: distribution_summary(ok, ["design_id"], m).select("design_id", *[F.col(c).alias(f"{m}_{c}") for c in ("n", "mean", "ci_low", "ci_high", "std")])
        for m in ("accuracy", "llf_per_event")
    }
    point = metrics.where("replicate = -1").select("design_id", F.col("status").alias("fit_status"), F.col("accuracy").alias("a0"), F.col("llf_per_event").alias("l0"))
    rows = plan.join(point, "design_id", "left")
    for b in bands.values():
        rows = rows.join(b, "design_id", "left")

    def band(m: str, c: str, p: str) -> Column:
        return F.coalesce(f"{m}_{c}", F.when(F.col(p).isNotNull(), F.lit(0.0) if c == "std" else F.col(p))).alias(f"{m}_{c}")

    filled = rows.select(
        "step", "is_baseline", "added_factor", contribution_atoms(F.col("added_factor")).alias("contribution_atoms"),
        F.concat(F.lit(f"{y_col} ~ "), "exog").alias("equation"), "n_exog_cols", F.coalesce("n_events", F.lit(0)).alias("n_events"),
        F.coalesce("n_policy_docs", F.lit(0)).alias("n_policy_docs"), F.coalesce("fit_status", F.lit("insufficient_data")).alias("fit_status"),
        *[band(m, c, p) for m, p in (("accuracy", "a0"), ("llf_per_event", "l0")) for c in ("mean", "ci_low", "ci_high", "std")],
        F.lit(n_bootstrap).alias("bootstrap_attempted"), F.coalesce("accuracy_n", F.lit(0)).alias("bootstrap_success"),
    )
    return step_deltas(filled)


def step_deltas(steps: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Difference to the previous step with a normal band from both spreads."""
    w = Window.partitionBy(*keys).orderBy("step")  # a path has at most a few dozen steps
    out = steps
    for m in ("accuracy", "llf_per_event"):
        mean, sd = F.col(f"{m}_mean"), F.coalesce(F.col(f"{m}_std"), F.lit(0.0))
        delta = mean - F.lag(mean).over(w)
        spread = F.sqrt(sd * sd + F.pow(F.coalesce(F.lag(f"{m}_std").over(w), F.lit(0.0)), 2.0)) * 1.96
        out = out.withColumns({f"delta_{m}_mean": delta, f"delta_{m}_ci_low": delta - spread, f"delta_{m}_ci_high": delta + spread})
    return out


def contribution_groups(steps: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Step contributions shared evenly among the atoms of the added factor, summed per atom."""
    rows = steps.where("is_baseline = 0 and delta_accuracy_mean is not null and size(contribution_atoms) > 0")
    n = F.size("contribution_atoms")
    atoms = rows.select(
        *keys, "added_factor", (F.col("delta_accuracy_mean") / n).alias("a"), (F.col("delta_llf_per_event_mean") / n).alias("l"),
        F.explode("contribution_atoms").alias("feature_atom"),
    )
    grouped = atoms.groupBy(*keys, "feature_atom").agg(
        F.sum("a").alias("contribution_accuracy_sum"),
        F.sum(F.abs("a")).alias("contribution_accuracy_abs_sum"),
        F.coalesce(F.sum("l"), F.lit(0.0)).alias("contribution_llf_per_event_sum"),
        F.count(F.lit(1)).alias("n_steps"),
        F.array_join(F.array_sort(F.collect_set("added_factor")), "|").alias("factors"),
    )
    total = F.sum("contribution_accuracy_abs_sum").over(Window.partitionBy(*keys))
    return grouped.withColumn("contribution_accuracy_share_abs", F.when(total > 0, F.col("contribution_accuracy_abs_sum") / total))


def path_summary(steps: DataFrame) -> DataFrame:
    """Best and last step, total contributions, strongest helper and strongest harm; one row."""
    acc, delta = F.col("accuracy_mean"), F.when(F.col("is_baseline") == 0, F.col("delta_accuracy_mean"))
    best = F.struct(acc.alias("a"), (-F.col("step")).alias("s"))
    return steps.agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.max_by("step", F.when(acc.isNotNull(), best)).alias("best_step"),
        F.max(acc).alias("best_accuracy_mean"),
        F.max("step").alias("final_step"),
        F.max_by(acc, "step").alias("final_accuracy_mean"),
        F.coalesce(F.sum(delta), F.lit(0.0)).alias("contribution_accuracy_total_signed"),
        F.coalesce(F.sum(F.abs(delta)), F.lit(0.0)).alias("contribution_accuracy_total_abs"),
        F.coalesce(F.max_by("added_factor", F.when(delta > 0, delta)), F.lit("")).alias("top_positive_contributor"),
        F.coalesce(F.min_by("added_factor", F.when(delta < 0, delta)), F.lit("")).alias("top_negative_contributor"),
    )


def event_accuracy(long: DataFrame, score: Column) -> DataFrame:
    """Share of events whose score d.beta predicts the chosen alternative; ties go to the first row."""
    hit = F.when(score == 0, F.col("chosen_first")).otherwise(score > 0)
    return long.agg(F.count(F.lit(1)).alias("n_events"), F.avg(hit.cast("double")).alias("accuracy"))
