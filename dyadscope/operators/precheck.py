"""Checks on outcome columns before a search: support, redundancy, time columns, policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.functions.numeric import as_number

TIME_NAME_TOKENS = ("year", "date", "time", "recency", "published_on", "pub_")


def _positive(y: str) -> Column:
    return F.coalesce(as_number(y), F.lit(0.0)) > 0


def _per_outcome(wide: DataFrame, y_cols: Sequence[str], fields: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    entries = [
        F.struct(F.lit(y).alias("y_col"), *[F.col(f"{prefix}_{i}").alias(name) for name, prefix in fields.items()])
        for i, y in enumerate(y_cols)
    ]
    return wide.select(*keep, F.inline(F.array(*entries)))


def outcome_support(df: DataFrame, y_cols: Sequence[str]) -> DataFrame:
    """Positives per outcome over all rows (track null) and per track, in one grouping-sets pass."""
    flags = df.select("track", *[_positive(y).cast("int").alias(f"p_{i}") for i, y in enumerate(y_cols)],
                      *[as_number(y).isNotNull().cast("int").alias(f"k_{i}") for i, y in enumerate(y_cols)])
    wide = flags.groupingSets([(), ("track",)], "track").agg(
        F.grouping("track").alias("is_total"),
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(f"p_{i}").alias(f"p_{i}") for i in range(len(y_cols))],
        *[F.sum(f"k_{i}").alias(f"k_{i}") for i in range(len(y_cols))],
    )
    return _per_outcome(wide, y_cols, {"n_positive": "p", "n_nonmissing": "k"}, ("track", "is_total", "n_rows"))


def outcome_precheck(
    df: DataFrame,
    y_cols: Sequence[str],
    *,
    min_positive: int = 20,
    min_track_positive: int = 10,
    min_share: float = 0.0,
) -> DataFrame:
    """Per outcome: support overall and on the weakest track, and low-support flags."""
    support = outcome_support(df, y_cols)
    total = F.col("is_total") == 1
    per_y = support.groupBy("y_col").agg(
        F.max(F.when(total, F.col("n_rows"))).alias("n_rows"),
        F.max(F.when(total, F.col("n_nonmissing"))).alias("n_nonmissing"),
        F.max(F.when(total, F.col("n_positive"))).alias("n_positive"),
        F.min("n_positive").alias("min_track_positive"),
        F.count_if(~total & F.col("track").isNotNull() & (F.col("n_positive") < min_track_positive)).alias("n_low_support_tracks"),
    )
    share = F.when(F.col("n_rows") > 0, F.col("n_positive") / F.col("n_rows")).otherwise(F.lit(0.0))
    return per_y.select(
        "*",
        share.alias("positive_share"),
        ((F.col("n_positive") < min_positive) | (share < min_share)).cast("int").alias("low_support"),
    )


def low_support_pairs(df: DataFrame, y_cols: Sequence[str], min_track_positive: int) -> DataFrame:
    return (
        outcome_support(df, y_cols)
        .where((F.col("is_total") == 0) & (F.col("n_positive") < min_track_positive))
        .select("y_col", "track", F.col("n_positive").alias("n_positive_track"))
    )


def outcome_redundancy(df: DataFrame, y_cols: Sequence[str]) -> DataFrame:
    """Outcomes that agree on every row, with the one to keep: shortest window, else first by name.

    Agreement is counted directly: one wide aggregate compares each pair of outcome columns, so
    no row key and no hashing is needed. Outcomes are a handful of columns.
    """
    ys = list(y_cols)
    pairs = [(a, b) for i, a in enumerate(ys) for b in ys[i + 1 :]]
    flags = df.select(*[_positive(y).alias(f"f{i}") for i, y in enumerate(ys)])
    place = {y: i for i, y in enumerate(ys)}
    wide = flags.agg(
        *[F.count_if(F.col(f"f{place[a]}") != F.col(f"f{place[b]}")).alias(f"d{j}") for j, (a, b) in enumerate(pairs)],
        *[F.count_if(f"f{i}").alias(f"n{i}") for i in range(len(ys))],
    )
    window = F.regexp_extract("y_col", r"^y_(\d+)y$", 1).try_cast("int")
    # Outcome i joins the group of the first outcome it equals.
    group = []
    for i, y in enumerate(ys):
        earlier = [F.when(F.col(f"d{pairs.index((ys[k], y))}") == 0, F.lit(ys[k])) for k in range(i)]
        group.append(F.coalesce(*earlier, F.lit(y)))
    rows = wide.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(y).alias("y_col"), group[i].alias("group_head"), F.col(f"n{i}").alias("n_positive")) for i, y in enumerate(ys)]
            )
        )
    )
    same = Window.partitionBy("group_head")
    prefer = F.struct(F.coalesce(window, F.lit(1 << 30)).alias("w"), F.col("y_col").alias("y"))
    keep = F.min(prefer).over(same)
    return (
        rows.select(
            "y_col", "n_positive", F.count(F.lit(1)).over(same).alias("group_size"), keep["y"].alias("recommended_keep")
        )
        .where("group_size > 1")
        .select("y_col", "n_positive", "group_size", "recommended_keep", (F.col("y_col") != F.col("recommended_keep")).cast("int").alias("is_redundant"))
    )


def time_columns(df: DataFrame) -> DataFrame:
    """Columns that look like time: by name, or with 80% of their numbers in 1800..2100."""
    cols = list(df.columns)
    cells = df.select(*[as_number(F.col(f"`{c}`").cast("string")).alias(f"x{i}") for i, c in enumerate(cols)])
    wide = cells.agg(
        *[F.count(f"x{i}").alias(f"k_{i}") for i in range(len(cols))],
        *[F.count_if(F.col(f"x{i}").between(1800.0, 2100.0)).alias(f"y_{i}") for i in range(len(cols))],
    )
    rows = _per_outcome(wide, cols, {"n_numeric": "k", "n_year_like": "y"}).withColumnRenamed("y_col", "column_name")
    lowered = F.lower("column_name")
    by_name = F.lit(False)
    for token in TIME_NAME_TOKENS:
        by_name = by_name | F.contains(lowered, F.lit(token))
    year_like = (F.col("n_numeric") > 0) & (F.col("n_year_like") / F.col("n_numeric") >= 0.80)
    return rows.select("column_name", by_name.cast("int").alias("by_name"), F.coalesce(year_like.cast("int"), F.lit(0)).alias("numeric_year_like"))


def apply_precheck_policy(mode: str, *, n_redundant_groups: int, n_low_support: int) -> dict[str, bool]:
    """Flags of the precheck; the fail modes raise on what they name."""
    modes = ("off", "warn", "fail_redundant_confirmatory", "fail_low_support", "fail_any")
    if mode not in modes:
        raise ValueError(f"time-series-precheck-mode must be one of: {', '.join(modes)}")
    redundant, low = n_redundant_groups > 0, n_low_support > 0
    if mode == "off":
        return {"redundant": False, "low_support": False}
    fails = {"fail_redundant_confirmatory": redundant, "fail_low_support": low, "fail_any": redundant or low}
    if fails.get(mode, False):
        found = [t for t, hit in (("redundant confirmatory outcomes", redundant), ("low-support outcomes", low)) if hit]
        raise ValueError("time-series precheck failed: " + "; ".join(found))
    return {"redundant": redundant, "low_support": low}


def confirmatory_outcomes(
    available: DataFrame,
    *,
    requested: Sequence[str] = (),
    redundant: DataFrame | None = None,
    low_support: DataFrame | None = None,
    policy: str = "off",
) -> DataFrame:
    """Outcomes that may confirm: requested ones in scope, minus redundant, minus weakly supported.

    `available` is (position, y_col), one row per outcome. When nothing would be left, the first
    outcome in scope is kept and marked as the fallback.
    """
    if policy not in ("off", "drop_redundant", "drop_redundant_and_low_support"):
        raise ValueError("confirmatory policy must be one of: off, drop_redundant, drop_redundant_and_low_support")
    asked = F.col("y_col").isin([y.strip() for y in requested if y.strip()]) if any(y.strip() for y in requested) else F.lit(False)
    marked = available.withColumn("_asked", asked)
    any_asked = F.max(F.col("_asked").cast("int")).over(Window.partitionBy())
    scoped = marked.withColumn("_in", F.col("_asked") | (any_asked == 0))
    none = F.lit(0)
    if redundant is not None and policy != "off":
        scoped = scoped.join(redundant.select("y_col", F.lit(1).alias("_red")).distinct(), "y_col", "left")
    else:
        scoped = scoped.withColumn("_red", none)
    if low_support is not None and policy == "drop_redundant_and_low_support":
        scoped = scoped.join(low_support.select("y_col", F.lit(1).alias("_low")).distinct(), "y_col", "left")
    else:
        scoped = scoped.withColumn("_low", none)
    keep = F.col("_in") & (F.coalesce("_red", none) == 0) & (F.coalesce("_low", none) == 0)
    everything = Window.partitionBy()
    kept_any = F.max(keep.cast("int")).over(everything)
    first = F.min(F.when(F.col("_in"), F.col("position"))).over(everything)
    fallback = (kept_any == 0) & (F.col("position") == first)
    return scoped.select(
        "position",
        "y_col",
        (keep | fallback).cast("int").alias("is_confirmatory"),
        (F.col("_in") & (F.coalesce("_red", none) == 1)).cast("int").alias("dropped_redundant"),
        (F.col("_in") & (F.coalesce("_red", none) == 0) & (F.coalesce("_low", none) == 1)).cast("int").alias("dropped_low_support"),
        fallback.cast("int").alias("fallback_applied"),
    )
