"""Derived features: unary and binary expressions, one-hot levels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.functions import names
from dyadscope.functions.numeric import as_number
from dyadscope.operators.registry import FEATURES_PER_PASS, variation_metrics

# Operations per expression mode, in generation order.
EXPRESSION_MODES = {
    "signed_log1p": (("signed_log1p",), ()),
    "signed_log1p_square": (("signed_log1p", "square"), ()),
    "ms_benchmark_lite": (("signed_log1p", "square"), ("ratio", "diff", "interaction")),
}


def finite(col: Column) -> Column:
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), None).otherwise(col)


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def guarded_ratio(x: Column, y: Column) -> Column:
    return x / F.when(F.abs(y) > 1e-12, y)


@dataclass(frozen=True)
class Expression:
    name: str
    op: str
    inputs: tuple[str, ...]

    @property
    def formula(self) -> str:
        a, b = self.inputs[0], self.inputs[-1]
        return {
            "signed_log1p": f"sign({a})*log1p(abs({a}))",
            "square": f"{a}^2",
            "ratio": f"{a}/nullif({b},0)",
            "diff": f"{a}-{b}",
            "interaction": f"{a}*{b}",
        }[self.op]

    def column(self) -> Column:
        x, y = as_number(self.inputs[0]), as_number(self.inputs[-1])
        value = {
            "signed_log1p": lambda: signed_log1p(x),
            "square": lambda: x * x,
            "ratio": lambda: guarded_ratio(x, y),
            "diff": lambda: x - y,
            "interaction": lambda: x * y,
        }[self.op]()
        return finite(value)


def plan_expressions(bases: Sequence[str], mode: str, max_pairs: int = 0) -> list[Expression]:
    """Expressions in generation order: unary per base, then pairs in base order."""
    unary, binary = EXPRESSION_MODES.get(mode, ((), ()))
    label = {"signed_log1p": "slog1p", "square": "sq", "ratio": "ratio", "diff": "diff", "interaction": "mul"}
    joint = {"ratio": "over", "diff": "minus", "interaction": "x"}
    out = [Expression(f"expr__{label[op]}__{b}", op, (b,)) for b in bases for op in unary]
    if binary:
        pairs = [(a, b) for i, a in enumerate(bases) for b in bases[i + 1 :]]
        for a, b in pairs[:max_pairs] if max_pairs > 0 else pairs:
            out += [Expression(f"expr__{label[op]}__{a}__{joint[op]}__{b}", op, (a, b)) for op in binary]
    return out


def vector_stats(df: DataFrame, columns: dict[str, Column], row_id: Column) -> DataFrame:
    """Per column: known values, extremes, and an order-free signature of the whole vector.

    Two columns agree on every row exactly when they carry the same (row, value) pairs; the
    signature folds hashes of those pairs by xor and by a bounded sum. One wide aggregate.
    """
    labels = list(columns)
    parts: list[DataFrame] = []
    for start in range(0, len(labels), FEATURES_PER_PASS):
        chunk = labels[start : start + FEATURES_PER_PASS]
        cells = df.select(row_id.alias("rid"), *[columns[c].alias(f"x{i}") for i, c in enumerate(chunk)])
        aggs: list[Column] = []
        for i in range(len(chunk)):
            x = F.col(f"x{i}")
            # -0.0 and 0.0 are one value.
            h = F.xxhash64("rid", F.when(x == 0, F.lit(0.0)).otherwise(x))
            aggs += [
                F.count(x).alias(f"k{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                F.bit_xor(h).alias(f"s{i}"), F.sum(F.pmod(h, F.lit(1 << 31)).cast("decimal(38,0)")).alias(f"t{i}"),
            ]
        wide = cells.agg(*aggs)
        rows = F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature_name"), F.col(f"k{i}").alias("nonmissing_count"), F.col(f"lo{i}").alias("min_value"),
                    F.col(f"hi{i}").alias("max_value"), F.col(f"s{i}").alias("sig_xor"), F.col(f"t{i}").alias("sig_sum"),
                )
                for i, c in enumerate(chunk)
            ]
        )
        parts.append(wide.select(F.inline(rows)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def expression_registry(
    df: DataFrame,
    bases: Sequence[str],
    *,
    mode: str = "ms_benchmark_lite",
    row_id: Column,
    max_new_features: int = 0,
    max_base_features: int = 0,
    max_pairs: int = 0,
    min_nonmissing_count: int = 20,
    min_variation_share: float = 0.10,
    min_nonmissing_share: float = 0.80,
    event: str = "event_id",
) -> DataFrame:
    """Every planned expression with its metrics, and why it is kept or skipped.

    Equal vectors have equal metrics, so 'first in generation order per signature, then gates,
    then cap' picks the features that one-at-a-time acceptance would. All vectors are measured in
    wide aggregates over the table; the selection runs on one row per expression.
    """
    bases = list(dict.fromkeys(bases))
    bases = bases[:max_base_features] if max_base_features > 0 else bases
    base_stats = vector_stats(df, {b: as_number(b) for b in bases}, row_id)
    good = base_stats.where((F.col("nonmissing_count") >= max(min_nonmissing_count, 1)) & (F.col("min_value") < F.col("max_value")))
    kept = {r["feature_name"] for r in good.select("feature_name").collect()}  # one row per base
    eligible = [b for b in bases if b in kept]
    plan = plan_expressions(eligible, mode, max_pairs)
    if not plan:
        raise ValueError(f"no expressions to build for mode {mode!r} from {len(eligible)} eligible bases")
    columns = {e.name: e.column() for e in plan}
    spark = df.sparkSession
    ordered = spark.createDataFrame(
        [(i, e.name, e.op, e.formula, "|".join(e.inputs)) for i, e in enumerate(plan)],
        "position int, feature_name string, expression_op string, expression_formula string, expression_inputs string",
    )
    stats = vector_stats(df, columns, row_id)
    metrics = variation_metrics(df, columns, event)
    rows = ordered.join(stats, "feature_name").join(metrics, "feature_name")

    # From here on: one row per expression.
    taken = good.select("sig_xor", "sig_sum", F.lit(1).alias("is_base"))
    rows = rows.join(taken.distinct(), ["sig_xor", "sig_sum"], "left")
    known = (F.col("nonmissing_count") >= max(min_nonmissing_count, 1)) & (F.col("min_value") < F.col("max_value"))
    same = Window.partitionBy("sig_xor", "sig_sum").orderBy("position")
    reason = (
        F.when(~known, "low_nonmissing_expression")
        .when(F.col("is_base").isNotNull() | (F.row_number().over(same) > 1), "degenerate_signature")
        .when(F.col("share_variation") < min_variation_share, "low_within_event_variation")
        .when(F.col("share_nonmissing") < min_nonmissing_share, "low_nonmissing_share")
        .otherwise("")
    )
    judged = rows.withColumn("skip_reason", reason)
    accepted = F.sum((F.col("skip_reason") == "").cast("int")).over(
        Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    )
    cap = max_new_features if max_new_features > 0 else len(plan)
    judged = judged.withColumn("_place", accepted).withColumn(
        "skip_reason", F.when((F.col("skip_reason") == "") & (F.col("_place") > cap), "over_cap").otherwise(F.col("skip_reason"))
    )
    return judged.select(
        "position", "feature_name", "expression_op", "expression_formula", "expression_inputs", "nonmissing_count",
        "n_two_alt_events", "n_events_with_variation",
        F.round("share_variation", 6).alias("share_events_with_variation"),
        F.round("share_nonmissing", 6).alias("share_events_nonmissing"),
        names.variation_label(F.col("share_variation")).alias("within_event_variation_expected"),
        "skip_reason",
        (F.col("skip_reason") == "").cast("int").alias("allowed_in_scan"),
    )


def add_expressions(df: DataFrame, expressions: Sequence[Expression]) -> DataFrame:
    return df.withColumns({e.name: e.column() for e in expressions})


def frequent_levels(df: DataFrame, source: str, *, min_count: int, max_levels: int = 0) -> DataFrame:
    """Levels with enough rows, most frequent first; ties by text."""
    level = names.clean_level(F.col(source))
    counts = df.where(level.isNotNull()).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("level_count"))
    frequent = counts.where(F.col("level_count") >= max(min_count, 1)).orderBy(F.desc("level_count"), "level")
    return frequent.limit(max_levels) if max_levels > 0 else frequent


def onehot_registry(
    build: DataFrame,
    full: DataFrame,
    source: str,
    *,
    min_level_count: int = 20,
    max_levels: int = 0,
    min_variation_share: float = 0.10,
    min_nonmissing_share: float = 0.80,
    event: str = "event_id",
) -> DataFrame:
    """One row per frequent level of a text column: feature name, counts, metrics, block reasons.

    Levels are chosen on the build scope; the positive count is checked on the full table. The
    number of levels is a setting, so reading their names back is bounded by it.
    """
    top = [(r["level"], r["level_count"]) for r in frequent_levels(build, source, min_count=min_level_count, max_levels=max_levels).collect()]
    shape = (
        "feature_name string, categorical_source_feature string, categorical_level_value string, "
        "categorical_level_count bigint"
    )
    spark = build.sparkSession
    if not top:
        return spark.createDataFrame([], shape)
    clean = names.clean_level(F.col(source))
    cells = {level: F.when(clean.isNotNull(), (clean == F.lit(level)).cast("double")) for level, _ in top}
    wide = full.agg(F.count(clean).alias("known"), *[F.count_if(clean == F.lit(v)).alias(f"p{i}") for i, (v, _) in enumerate(top)])
    counts = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v).alias("level"), F.lit(n).cast("bigint").alias("level_count"), F.col(f"p{i}").alias("positives"), F.col("known").alias("known"))
                    for i, (v, n) in enumerate(top)
                ]
            )
        )
    )
    metrics = variation_metrics(build, cells, event).withColumnRenamed("feature_name", "level")
    rows = counts.where((F.col("positives") >= max(min_level_count, 1)) & (F.col("positives") < F.col("known"))).join(metrics, "level")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("share_variation") < min_variation_share, "low_within_event_variation"),
            F.when(F.col("share_nonmissing") < min_nonmissing_share, "low_nonmissing_share"),
        )
    )
    return rows.select(
        F.concat(F.lit(f"cat__{source}__"), names.level_token(F.col("level"))).alias("feature_name"),
        F.lit(source).alias("categorical_source_feature"),
        F.col("level").alias("categorical_level_value"),
        F.col("level_count").alias("categorical_level_count"),
        "positives",
        "n_two_alt_events",
        "n_events_with_variation",
        F.round("share_variation", 6).alias("share_events_with_variation"),
        F.round("share_nonmissing", 6).alias("share_events_nonmissing"),
        names.variation_label(F.col("share_variation")).alias("within_event_variation_expected"),
        (F.size(reasons) == 0).cast("int").alias("allowed_in_scan"),
        reasons.alias("block_reasons"),
    )


def onehot_column(source: str, level: str) -> Column:
    clean = names.clean_level(F.col(source))
    return F.when(clean.isNotNull(), (clean == F.lit(level)).cast("double"))
