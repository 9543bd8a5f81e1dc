"""Second passes and run modes built on the scan: escalation, refinement, presets, ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadscope.operators.inference import VALIDATED, restart_inference, restart_stability, track_consensus
from dyadscope.operators.review import ladder_jobs, pending_jobs
from dyadscope.operators.shortlist import escalation_shortlist, shortlist
from dyadscope.plans.scan import ScanResult, run_scan
from dyadscope.session import cut_lineage
from dyadscope.settings import ScanSettings


def run_restarts(df: DataFrame, features: Sequence[str], settings: ScanSettings, *, anchor_track: str = "primary_strict", enforce_consensus: bool = True, confirmatory_y: Sequence[str] = (), penalty: float | None = None) -> tuple[ScanResult, DataFrame, DataFrame]:
    """Scan over all restart seeds, then consensus, inference over restarts, and stability."""
    result = run_scan(df, features, settings, penalty=penalty)
    top = track_consensus(result.top, anchor_track=anchor_track, enforce=enforce_consensus)
    changed = top.select("restart_id", "candidate_id", F.col("candidate_tier").alias("_tier"), "track_consensus_status", "track_consensus_demoted")
    scan = result.scan.join(changed, ["restart_id", "candidate_id"], "left").withColumn("candidate_tier", F.coalesce("_tier", "candidate_tier")).drop("_tier")
    inference = restart_inference(
        top, n_restarts=settings.draws.restarts, p_threshold=settings.evidence.p_limit, q_threshold=settings.evidence.q_limit, confirmatory_y=confirmatory_y
    )
    stability = restart_stability(top, n_restarts=settings.draws.restarts)
    return ScanResult(scan, top, result.log, result.fits, result.prepared), inference, stability


def _rescan(df: DataFrame, picked: DataFrame, settings: ScanSettings, n_bootstrap: int, suffix: str, first: ScanResult | None) -> ScanResult | None:
    features = [r["feature_name"] for r in picked.orderBy("shortlist_rank").collect()]  # at most the shortlist cap
    if not features:
        return None
    # A second pass evaluates its features everywhere: capacity skips are back at their defaults.
    second = settings.but(run_id=f"{settings.run_id}__{suffix}", replicates=n_bootstrap, max_features=0, skip_starved_outcomes=False, drop_starved_base=False)
    return run_scan(df, features, second, prepared=first.prepared if first else None, prior=first.fits if first else None)


def escalate(df: DataFrame, top: DataFrame, settings: ScanSettings, *, n_bootstrap: int = 499, first: ScanResult | None = None, **margins) -> ScanResult | None:
    """Repeat the features nearest to the thresholds with more replicates.

    With `first`, the scan that gave `top`, its events, point fits and replicates are used again; only the replicates
    beyond its number are run.
    """
    picked = escalation_shortlist(top, p_threshold=settings.evidence.p_limit, q_threshold=settings.evidence.q_limit, **margins)
    return _rescan(df, picked, settings, n_bootstrap, "escalation", first)


def refine(df: DataFrame, top: DataFrame, settings: ScanSettings, *, n_bootstrap: int = 199, first: ScanResult | None = None, **limits) -> ScanResult | None:
    """Repeat the shortlist of a wide search with more replicates; `first` as in `escalate`."""
    return _rescan(df, shortlist(top, **limits), settings, n_bootstrap, "refine", first)


def run_ladder(
    df: DataFrame,
    features: Sequence[str],
    settings: ScanSettings,
    *,
    seeds: Sequence[int],
    ladder: Sequence[int],
    attempts_path: str,
) -> DataFrame:
    """One scan per (bootstrap size, seed) that has no finished attempt yet; returns all attempts.

    Every attempt is appended to a table as soon as it ends, with the grid it belongs to, so an
    interrupted ladder goes on where it stopped. A table written by another run or grid is refused. All jobs
    share one fold of the events and one set of point fits; a job takes over the replicates that a smaller
    one with its seed has run.
    """
    spark = df.sparkSession
    grid = f"seeds={list(seeds)};ladder={list(ladder)}"
    stored = _attempts(spark, attempts_path)
    jobs = ladder_jobs(spark, list(seeds), list(ladder))
    if stored is not None:
        other = stored.where((F.col("run_id") != settings.run_id) | (F.col("grid") != grid)).select("run_id", "grid").first()
        if other:
            raise ValueError(f"resume mismatch: the attempts belong to run {other['run_id']} with {other['grid']}")
        jobs = pending_jobs(jobs, stored)
    done: ScanResult | None = None
    for job in jobs.orderBy("position").collect():  # the grid is configuration
        step = settings.but(run_id=f"{settings.run_id}__{job['job_key']}", seed=job["seed"], replicates=job["n_bootstrap"])
        fitted = F.col("status_validation") == "ok"
        result = run_scan(df, features, step, prepared=done.prepared if done else None, prior=done.fits if done else None)
        fits = result.fits if done is None else cut_lineage(done.fits.unionByName(result.fits))
        done = ScanResult(result.scan, result.top, result.log, fits, result.prepared)
        ran = result.fits.agg(F.sum("new_attempted").alias("replicates_run"), F.count_if("point_fitted").alias("point_fits_run")).first()
        best = result.top.agg(
            F.min(F.when(fitted, F.col("q_value_validation"))).alias("best_q_validation"),
            F.min(F.when(fitted, F.col("p_boot_validation"))).alias("best_p_validation"),
            F.max((F.col("candidate_tier") == VALIDATED).cast("int")).alias("gate_pass"),
        )
        labels = {"run_id": settings.run_id, "grid": grid, "job_key": job["job_key"], "status": "ok"}
        numbers = {"position": job["position"], "seed": job["seed"], "n_bootstrap": job["n_bootstrap"], "returncode": 0,
                   "replicates_run": int(ran[0] or 0), "point_fits_run": int(ran[1])}
        best.select("*", *[F.lit(v).alias(k) for k, v in {**labels, **numbers}.items()]).write.mode("append").parquet(attempts_path)
    return _attempts(spark, attempts_path)


def _attempts(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing has been tried yet
        return None
