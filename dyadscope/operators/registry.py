"""Feature registry: variation metrics, eligibility, filters, family dedupe."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.functions import names
from dyadscope.functions.numeric import as_number, safe_ratio

# Aggregates per job: wider ones stop fitting into one generated method.
FEATURES_PER_PASS = 60
MIN_NONMISSING = 20


def _chunks(items: Sequence, size: int = FEATURES_PER_PASS) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _rows(aggregated: DataFrame, fields: dict[str, Callable[[int], Column]], labels: Sequence[str]) -> DataFrame:
    """Turn one wide row of per-feature aggregates into one row per feature."""
    entries = [
        F.struct(F.lit(label).alias("feature_name"), *[make(i).alias(name) for name, make in fields.items()])
        for i, label in enumerate(labels)
    ]
    return aggregated.select(F.inline(F.array(*entries)))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def variation_metrics(df: DataFrame, features: dict[str, Column], event: str = "event_id") -> DataFrame:
    """Share of two-row events with the feature known on both rows, and with it differing.

    One fixed-width aggregate per event covers all features of a pass, then one over events. Rows
    are never multiplied by features, and both steps combine before the shuffle.
    """
    parts = []
    for chunk in _chunks(list(features)):
        cells = df.select(event, *[as_number(features[f]).alias(f"x{i}") for i, f in enumerate(chunk)])
        span = range(len(chunk))
        per_event = cells.groupBy(event).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count(f"x{i}").alias(f"k{i}") for i in span],
            *[F.min(f"x{i}").alias(f"lo{i}") for i in span],
            *[F.max(f"x{i}").alias(f"hi{i}") for i in span],
        )
        total = per_event.where("n = 2").agg(
            F.count(F.lit(1)).alias("n_two"),
            *[F.count_if(F.col(f"k{i}") == 2).alias(f"known{i}") for i in span],
            *[F.count_if((F.col(f"k{i}") == 2) & (F.col(f"lo{i}") != F.col(f"hi{i}"))).alias(f"vary{i}") for i in span],
        )
        fields = {
            "n_two_alt_events": lambda i: F.col("n_two"),
            "n_events_nonmissing": lambda i: F.col(f"known{i}"),
            "n_events_with_variation": lambda i: F.col(f"vary{i}"),
        }
        parts.append(_rows(total, fields, chunk))
    out = _union(parts)
    return out.select(
        "*",
        safe_ratio(F.col("n_events_with_variation"), F.col("n_events_nonmissing")).alias("share_variation"),
        safe_ratio(F.col("n_events_nonmissing"), F.col("n_two_alt_events")).alias("share_nonmissing"),
    )


def value_extent(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Per feature: known values, extremes, and whether more than two distinct values exist.

    Two distinct values are told by the extremes; a third is looked for in a second pass that
    compares with them. That replaces exact distinct counts over every column.
    """
    parts = []
    for chunk in _chunks(list(features)):
        span = range(len(chunk))
        cells = df.select(*[as_number(features[f]).alias(f"x{i}") for i, f in enumerate(chunk)])
        ends = cells.agg(
            *[F.min(f"x{i}").alias(f"lo{i}") for i in span], *[F.max(f"x{i}").alias(f"hi{i}") for i in span]
        )
        edge = ends.select(F.struct(*ends.columns)).scalar()
        total = cells.agg(
            *[F.count(f"x{i}").alias(f"k{i}") for i in span],
            *[F.min(f"x{i}").alias(f"lo{i}") for i in span],
            *[F.max(f"x{i}").alias(f"hi{i}") for i in span],
            *[
                F.count_if((F.col(f"x{i}") != edge.getField(f"lo{i}")) & (F.col(f"x{i}") != edge.getField(f"hi{i}"))).alias(f"m{i}")
                for i in span
            ],
        )
        fields = {
            "nonmissing_count": lambda i: F.col(f"k{i}"),
            "min_value": lambda i: F.col(f"lo{i}"),
            "max_value": lambda i: F.col(f"hi{i}"),
            "more_than_two": lambda i: (F.col(f"m{i}") > 0).cast("int"),
        }
        parts.append(_rows(total, fields, chunk))
    return _union(parts)


def known_counts(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    """(feature_name, nonmissing_count), in one pass over the table."""
    parts = []
    for chunk in _chunks(list(features)):
        total = df.agg(*[F.count(as_number(features[f])).alias(f"k{i}") for i, f in enumerate(chunk)])
        parts.append(_rows(total, {"nonmissing_count": lambda i: F.col(f"k{i}")}, chunk))
    return _union(parts)


def column_metrics(df: DataFrame, columns: Sequence[str], event: str = "event_id") -> DataFrame:
    """Variation metrics and value extent together, in two passes over the table.

    The first pass folds rows per event and events to one row of numbers; the second looks for
    a value strictly between the extremes found. What comes back is one row per column.
    """
    rows = []
    for chunk in _chunks(list(columns)):
        span = range(len(chunk))
        cells = df.select(event, *[as_number(F.col(c)).alias(f"x{i}") for i, c in enumerate(chunk)])
        per_event = cells.groupBy(event).agg(
            F.count(F.lit(1)).alias("n"),
            *[f(f"x{i}").alias(f"{name}{i}") for i in span for name, f in (("k", F.count), ("lo", F.min), ("hi", F.max))],
        )
        two = F.col("n") == 2
        first = per_event.agg(
            F.count_if(two).alias("n_two"),
            *[F.count_if(two & (F.col(f"k{i}") == 2)).alias(f"known{i}") for i in span],
            *[F.count_if(two & (F.col(f"k{i}") == 2) & (F.col(f"lo{i}") != F.col(f"hi{i}"))).alias(f"vary{i}") for i in span],
            *[F.sum(f"k{i}").alias(f"count{i}") for i in span],
            *[F.min(f"lo{i}").alias(f"min{i}") for i in span],
            *[F.max(f"hi{i}").alias(f"max{i}") for i in span],
        ).first()
        spread = [i for i in span if first[f"min{i}"] is not None and first[f"min{i}"] < first[f"max{i}"]]
        inside = [F.count_if((F.col(f"x{i}") > first[f"min{i}"]) & (F.col(f"x{i}") < first[f"max{i}"])).alias(f"m{i}") for i in spread]
        between = cells.agg(*inside).first() if inside else {}
        for i, c in enumerate(chunk):
            known, vary, two_alt = first[f"known{i}"], first[f"vary{i}"], first["n_two"]
            rows.append(
                (
                    c, first[f"count{i}"] or 0, first[f"min{i}"], first[f"max{i}"], int(i in spread and between[f"m{i}"] > 0),
                    two_alt, known, vary, vary / known if known else 0.0, known / two_alt if two_alt else 0.0,
                )
            )
    return df.sparkSession.createDataFrame(
        rows,
        "feature_name string, nonmissing_count bigint, min_value double, max_value double, more_than_two int, n_two_alt_events bigint, "
        "n_events_nonmissing bigint, n_events_with_variation bigint, share_variation double, share_nonmissing double",
    )


def build_registry(
    df: DataFrame,
    *,
    min_variation_share: float = 0.10,
    min_nonmissing_share: float = 0.80,
    columns: Sequence[str] | None = None,
    timing: Callable[[Column], Column] = names.timing_label,
    skip: Sequence[str] = names.IDENTIFIER_COLUMNS,
) -> DataFrame:
    """Registry rows for every numeric column that could be a key factor, with block reasons."""
    wanted = [c for c in sorted(columns if columns is not None else df.columns) if c not in skip]
    wanted = [c for c in wanted if not any(t in c.lower() for t in names.OUTCOME_TOKENS)]
    rows = column_metrics(df, wanted).where(
        (F.col("nonmissing_count") >= MIN_NONMISSING) & (F.col("min_value") < F.col("max_value"))
    )
    name = F.col("feature_name")
    label = timing(name)
    reasons = F.array_compact(
        F.array(
            F.when(label != "pre_treatment", "timing_not_pre_treatment"),
            F.when(F.col("share_variation") < min_variation_share, "low_within_event_variation"),
            F.when(F.col("share_nonmissing") < min_nonmissing_share, "low_nonmissing_share"),
        )
    )
    return rows.select(
        name,
        names.data_source(name).alias("data_source"),
        label.alias("timing_label"),
        F.lit("key_factor_candidate").alias("role"),
        name.isin(*names.CONTROL_COLUMNS).cast("int").alias("suggested_as_control"),
        (F.size(reasons) == 0).cast("int").alias("allowed_in_scan"),
        names.variation_label(F.col("share_variation")).alias("within_event_variation_expected"),
        F.round("share_variation", 6).alias("share_events_with_variation"),
        F.round("share_nonmissing", 6).alias("share_events_nonmissing"),
        "n_events_with_variation",
        "n_two_alt_events",
        F.when(F.col("more_than_two") == 1, "zscore_within_track").otherwise("none").alias("transform"),
        F.lit("drop").alias("missing_policy"),
        reasons.alias("block_reasons"),
    )


def cap_features(registry: DataFrame, n: int, order: str = "feature_name") -> DataFrame:
    return registry.orderBy(order).limit(n) if n > 0 else registry


def normalise_names(registry: DataFrame) -> DataFrame:
    """Add the lineage prefix the data source implies; prefer the post-filter allowed flag."""
    name = F.trim(F.col("feature_name"))
    prefixed = (
        F.when(F.startswith(name, F.lit("ext__")) | F.startswith(name, F.lit("pa__")), name)
        .when(F.col("data_source") == "metadata_extension", F.concat(F.lit("ext__"), name))
        .when(F.col("data_source") == "phase_a_model_input", F.concat(F.lit("pa__"), name))
        .otherwise(name)
    )
    flags = [c for c in ("allowed_in_scan_after_variation_filter_any_scope", "allowed_in_scan") if c in registry.columns]
    allowed = F.coalesce(*[F.col(c).cast("string").try_cast("int") for c in flags], F.lit(0))
    return registry.where(name != "").withColumns({"feature_name": prefixed, "allowed_in_scan": allowed})


def filter_by_data(registry: DataFrame, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Block registry features that the data lacks or hardly fill; `features` lists the requested names."""
    present = {c: F.col(c) for c in features if c in df.columns}
    reasons = F.coalesce("block_reasons", F.array().cast("array<string>"))
    if present:
        joined = registry.join(known_counts(df, present), "feature_name", "left")
    else:
        joined = registry.withColumn("nonmissing_count", F.lit(None).cast("bigint"))
    added = F.array_compact(
        F.array(
            F.when(F.col("nonmissing_count").isNull(), "feature_not_in_joined_data"),
            F.when(F.col("nonmissing_count") < MIN_NONMISSING, "feature_non_numeric_or_low_nonmissing"),
        )
    )
    return joined.withColumns(
        {
            "allowed_in_scan": F.when(F.size(added) > 0, 0).otherwise(F.col("allowed_in_scan")),
            "block_reasons": F.array_sort(F.array_distinct(F.concat(reasons, added))),
        }
    ).drop("nonmissing_count")


def filter_counts(filtered: DataFrame) -> DataFrame:
    def blocked(reason: str) -> Column:
        return F.count_if(F.array_contains("block_reasons", reason)).alias(reason)

    return filtered.agg(
        F.count(F.lit(1)).alias("registry_rows_after_filter"),
        F.count_if(F.col("allowed_in_scan") == 1).alias("registry_allowed_after_filter"),
        blocked("feature_not_in_joined_data"),
        blocked("feature_non_numeric_or_low_nonmissing"),
    )


def family_signature(registry: DataFrame, mode: str = "atom") -> Column:
    """Feature name, or the sorted operands / source column / lineage atoms behind it."""
    name = F.trim(F.col("feature_name"))
    if mode == "feature":
        return name
    atoms = F.array().cast("array<string>")
    if "expression_input_features" in registry.columns:
        atoms = F.concat(atoms, F.coalesce("expression_input_features", F.array().cast("array<string>")))
    if "categorical_source_feature" in registry.columns:
        source = F.trim(F.coalesce("categorical_source_feature", F.lit("")))
        atoms = F.concat(atoms, F.when(source != "", F.array(source)).otherwise(F.array().cast("array<string>")))
    atoms = F.when(F.size(atoms) > 0, atoms).otherwise(names.lineage_atoms(name))
    return names.signature(atoms)


def family_dedupe(registry: DataFrame, mode: str = "atom") -> DataFrame:
    """Keep the best allowed feature per family; the others are blocked, not dropped."""
    if mode not in ("none", "feature", "atom"):
        raise ValueError("scan family dedupe mode must be one of: none, feature, atom")
    if mode == "none":
        return registry
    name = F.trim(F.col("feature_name"))
    allowed = F.col("allowed_in_scan") == 1
    marked = registry.withColumn("family_signature", family_signature(registry, mode))
    # The registry has one row per feature, so families are small.
    best_first = Window.partitionBy("family_signature", allowed).orderBy(
        F.startswith(name, F.lit("expr__")).cast("int"),
        F.startswith(name, F.lit("cat__")).cast("int"),
        F.desc(F.coalesce("share_events_with_variation", F.lit(0.0))),
        F.desc(F.coalesce("share_events_nonmissing", F.lit(0.0))),
        F.length(name),
        name,
    )
    loser = allowed & (F.row_number().over(best_first) > 1)
    return marked.withColumn("_loser", loser).select(
        *[c for c in registry.columns if c not in ("allowed_in_scan", "block_reasons")],
        "family_signature",
        F.when(F.col("_loser"), 0).otherwise(F.col("allowed_in_scan")).alias("allowed_in_scan"),
        F.when(
            F.col("_loser"),
            F.array_sort(F.array_distinct(F.concat(F.coalesce("block_reasons", F.array().cast("array<string>")), F.array(F.lit("family_deduped"))))),
        )
        .otherwise(F.col("block_reasons"))
        .alias("block_reasons"),
    )
