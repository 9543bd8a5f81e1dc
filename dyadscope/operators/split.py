"""Hold-out split by cluster: hash, exact-size random, or a given assignment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.functions.hashing import unit_score

CLUSTER = "policy_document_id"
DEFAULT_SEED = 20260219
# The exact random split sorts score buckets, not the whole cluster list.
RANK_BUCKETS = 4096


def role_by_score(score: Column, ratio: float) -> Column:
    return F.when(score < ratio, "discovery").otherwise("validation")


def split_name(seed: int, ratio: float) -> str:
    percent = int(round(ratio * 100.0))
    return f"policy_document_holdout_seed{seed}_{percent}_{100 - percent}"


def _check_ratio(ratio: float) -> None:
    if not 0.0 < ratio < 1.0:
        raise ValueError("discovery_ratio must be in (0, 1)")


def _too_few() -> Column:
    return F.raise_error(F.lit("need at least two clusters to create a holdout split")).cast("string")


def hash_holdout(df: DataFrame, *, seed: int = DEFAULT_SEED, ratio: float = 0.80, cluster: str = CLUSTER) -> DataFrame:
    """Role by hash score; neither side is ever left empty.

    The repair needs only four extremes of the whole table, taken in one aggregate and read
    back as a scalar subquery, so no cluster list is built.
    """
    _check_ratio(ratio)
    cid = F.col(cluster).cast("string")
    score = unit_score(seed, cid)
    extremes = df.agg(
        F.struct(
            F.min(score).alias("lo"),
            F.max(score).alias("hi"),
            F.min(cid).alias("first_id"),
            F.max(cid).alias("last_id"),
        ).alias("x")
    ).scalar()
    role = (
        F.when((extremes.getField("lo") >= ratio) & (cid == extremes.getField("first_id")), "discovery")
        .when((extremes.getField("hi") < ratio) & (cid == extremes.getField("last_id")), "validation")
        .otherwise(role_by_score(score, ratio))
    )
    one = extremes.getField("first_id").eqNullSafe(extremes.getField("last_id"))
    return df.withColumns({"split_id": F.lit(split_name(seed, ratio)), "split_role": F.when(one, _too_few()).otherwise(role)})


def random_holdout_roles(df: DataFrame, *, seed: int = DEFAULT_SEED, ratio: float = 0.80, cluster: str = CLUSTER) -> DataFrame:
    """(cluster, split_role) with exactly round-half-even(n * ratio) discovery clusters.

    Clusters are ordered by a seeded hash. Scores are uniform, so fixed score buckets hold about
    equal numbers of clusters: rank = clusters in earlier buckets + rank inside the bucket, and
    only the bucket counts (at most RANK_BUCKETS rows) pass through one window.
    """
    _check_ratio(ratio)
    cid = F.col(cluster).cast("string")
    ids = (
        df.where(F.col(cluster).isNotNull())
        .select(cid.alias(cluster))
        .distinct()
        .withColumn("_score", unit_score(seed, F.col(cluster)))
        .withColumn("_bucket", F.floor(F.col("_score") * RANK_BUCKETS).cast("int"))
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = ids.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_score", cluster)
    quota = F.greatest(F.lit(1), F.least(F.bround(F.col("_total") * ratio), F.col("_total") - 1))
    return (
        ids.join(F.broadcast(offsets), "_bucket")  # at most RANK_BUCKETS rows
        .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
        .select(cluster, F.when(F.col("_total") < 2, _too_few()).when(F.col("_rank") <= quota, "discovery").otherwise("validation").alias("split_role"))
    )


def random_holdout(df: DataFrame, *, seed: int = DEFAULT_SEED, ratio: float = 0.80, cluster: str = CLUSTER) -> DataFrame:
    roles = random_holdout_roles(df, seed=seed, ratio=ratio, cluster=cluster)
    out = df.withColumn(cluster, F.col(cluster).cast("string")).join(roles, cluster, "left")
    return out.withColumns(
        {"split_id": F.lit(split_name(seed, ratio)), "split_role": F.coalesce("split_role", F.lit("validation"))}
    )


def split_assignments(src: DataFrame, *, order: list[Column], cluster: str = CLUSTER) -> DataFrame:
    """First valid role per cluster of an assignment table, with rows that disagree counted.

    Blank ids are ignored, unknown roles are not assignments. Method and seed texts pass through.
    """
    missing = sorted({cluster, "split_role"} - set(src.columns))
    if missing:
        raise ValueError(f"split table missing required columns: {missing}")
    cid = F.trim(F.coalesce(F.col(cluster).cast("string"), F.lit("nan")))
    role = F.trim(F.coalesce(F.col("split_role").cast("string"), F.lit("")))
    rows = src.select(cid.alias(cluster), role.alias("split_role"), F.struct(*order).alias("_order"))
    valid = rows.where((F.col(cluster) != "") & F.col("split_role").isin("discovery", "validation"))
    per_role = valid.groupBy(cluster, "split_role").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_order")
    )
    return per_role.groupBy(cluster).agg(
        F.min_by("split_role", "_order").alias("split_role"),
        (F.sum("_n") - F.min_by("_n", "_order")).alias("n_conflicting_rows"),
    )


def count_invalid_roles(src: DataFrame, cluster: str = CLUSTER) -> DataFrame:
    cid = F.trim(F.coalesce(F.col(cluster).cast("string"), F.lit("nan")))
    role = F.trim(F.coalesce(F.col("split_role").cast("string"), F.lit("")))
    bad = (cid != "") & ~role.isin("discovery", "validation")
    return src.agg(F.count_if(bad).alias("n_invalid_roles"))


def apply_assignments(
    df: DataFrame,
    assignments: DataFrame,
    *,
    seed: int = DEFAULT_SEED,
    ratio: float = 0.80,
    strict: bool = False,
    cluster: str = CLUSTER,
    split_id: str = "policy_document_holdout_external",
) -> DataFrame:
    """Given roles where known, the hash rule elsewhere; strict raises if any row lacks a role."""
    cid = F.col(cluster).cast("string")
    joined = df.withColumn(cluster, cid).join(assignments.select(cluster, "split_role"), cluster, "left")
    if strict:
        unseen = joined.where(F.col("split_role").isNull()).count()
        conflicts = assignments.agg(F.sum("n_conflicting_rows")).first()[0] or 0
        if unseen or conflicts:
            raise ValueError(
                f"strict split lock failed: missing rows={unseen}, conflicting roles={conflicts}"
            )
    rule = role_by_score(unit_score(seed, F.col(cluster)), ratio)
    return joined.withColumns(
        {
            "split_from_rule": F.col("split_role").isNull().cast("int"),
            "split_role": F.coalesce("split_role", rule),
            "split_id": F.lit(split_id),
        }
    )


def split_report(df: DataFrame, cluster: str = CLUSTER) -> DataFrame:
    """Clusters and rows on each side, in one row."""
    role = F.col("split_role")
    per_cluster = df.groupBy(cluster, role).agg(F.count(F.lit(1)).alias("_n"))
    docs = F.count_if(F.col(cluster).isNotNull() & (role == "discovery"))
    return per_cluster.agg(
        F.count_distinct(cluster).alias("n_docs_total"),
        docs.alias("n_docs_discovery"),
        F.count_if(F.col(cluster).isNotNull() & (role == "validation")).alias("n_docs_validation"),
        F.sum(F.when(role == "discovery", F.col("_n")).otherwise(0)).alias("n_rows_discovery"),
        F.sum(F.when(role == "validation", F.col("_n")).otherwise(0)).alias("n_rows_validation"),
    )


def split_integrity(df: DataFrame, cluster: str = CLUSTER) -> DataFrame:
    """One row: clusters per side, clusters on both sides, share in discovery."""
    per_cluster = df.groupBy(cluster).agg(
        F.max((F.col("split_role") == "discovery").cast("int")).alias("d"),
        F.max((F.col("split_role") == "validation").cast("int")).alias("v"),
    )
    return per_cluster.agg(
        (F.sum("d") + F.sum("v")).alias("n_docs_total"),
        F.sum("d").alias("n_docs_discovery"),
        F.sum("v").alias("n_docs_validation"),
        F.count_if(F.col("d") + F.col("v") > 1).alias("n_overlap_docs"),
        (F.sum("d") / (F.sum("d") + F.sum("v"))).alias("discovery_share_by_docs"),
    )


def check_split_integrity(df: DataFrame, *, strict: bool = False, cluster: str = CLUSTER) -> dict:
    row = split_integrity(df, cluster).first().asDict()
    if row["n_overlap_docs"]:
        raise ValueError(f"split integrity failure: {row['n_overlap_docs']} clusters are on both sides")
    if strict and not (row["n_docs_discovery"] and row["n_docs_validation"]):
        raise ValueError("strict split lock failed: discovery and validation must both be non-empty")
    return row
