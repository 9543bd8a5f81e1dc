"""Summary of bootstrap replicates, as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.operators.selection import quantiles
from dyadscope.session import cut_lineage


def two_sided_p(values: Column) -> Column:
    """Finite-sample two-sided p: never exactly zero, at most one."""
    n = F.count(values)
    left = (F.count_if(values <= 0) + 1) / (n + 1)
    right = (F.count_if(values >= 0) + 1) / (n + 1)
    return F.when(n > 0, F.least(F.lit(1.0), F.lit(2.0) * F.least(left, right)))


def bootstrap_summary(df: DataFrame, keys: Sequence[str], value: str = "beta") -> DataFrame:
    """Mean, sd (n-1; 0 for one replicate), linear 2.5/97.5% quantiles and p, per key."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n_boot"),
        F.avg(v).alias("boot_mean"),
        F.percentile(v, F.lit(0.025)).alias("ci95_lower"),
        F.percentile(v, F.lit(0.975)).alias("ci95_upper"),
        F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("se_boot"),
        two_sided_p(v).alias("p_boot"),
    )


def distribution_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, 95% band and sd of a value per key; no key's values are held together."""
    rows = cut_lineage(df.select(*keys, F.col(value).cast("double").alias("v")))
    plain = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.when(F.count("v") > 0, F.coalesce(F.stddev_samp("v"), F.lit(0.0))).alias("std"))
    band = quantiles(rows, keys, {"v": [0.025, 0.975]})
    both = plain.join(band, list(keys), "left")
    return both.select(*keys, "n", "mean", F.get("v_q", F.lit(0)).alias("ci_low"), F.get("v_q", F.lit(1)).alias("ci_high"), "std")
