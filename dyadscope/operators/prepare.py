"""From a raw dyad table to a choice table: keys, outcomes, dates, merged features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.functions.numeric import as_int_or_zero, as_number, iso_date, years_between

REQUIRED_COLUMNS = (
    "track",
    "pair_id",
    "policy_document_id",
    "openalex_work_id",
    "affiliation_label",
    "reference_dik",
    "reference_dik_evidence_use",
    "reference_count_dik_all_contexts",
    "reference_count_dik_evidence_use",
    "pub_year",
    "pub_date",
    "policy_published_on",
)
GROUP_MODES = ("any_positive", "all_positive", "at_least_k")


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def indicator(col: Column, value: str) -> Column:
    return F.coalesce((col.cast("string") == value).cast("int"), F.lit(0))


def prepare_choices(raw: DataFrame) -> DataFrame:
    """Typed keys, the event key pair|document, 0/1 outcomes, counts and the citation lag in years."""
    require_columns(raw)
    keys = {c: F.col(c).cast("string") for c in ("pair_id", "policy_document_id", "openalex_work_id")}
    return raw.withColumns(
        {
            **keys,
            "event_id": F.concat_ws("|", keys["pair_id"], keys["policy_document_id"]),
            "is_academia_origin": indicator(F.col("affiliation_label"), "academia"),
            "pub_year_alt": as_number("pub_year"),
            "y_all": as_int_or_zero("reference_dik"),
            "y_evidence": as_int_or_zero("reference_dik_evidence_use"),
            "count_all": as_int_or_zero("reference_count_dik_all_contexts"),
            "count_evidence": as_int_or_zero("reference_count_dik_evidence_use"),
            "recency_years_alt": years_between(iso_date("pub_date"), iso_date("policy_published_on")),
        }
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    A min_by aggregate combines on the map side, so a key holding a large share of the rows
    costs one candidate row per task rather than one sorted partition.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def prefixed_merge(
    base: DataFrame,
    table: DataFrame,
    key: str,
    prefix: str,
    *,
    drop: Sequence[str] = (),
    order: Sequence[Column],
    order_columns: Sequence[str] = (),
) -> DataFrame:
    """Left-join the first row per key of a feature table under prefixed names.

    The join side is left to the optimiser: feature tables grow with the data, so nothing is
    forced to broadcast here.
    """
    if key not in table.columns:
        raise ValueError(f"feature table has no key column {key}")
    hidden = {key, *drop, *order_columns}
    kept = [c for c in table.columns if c not in hidden]
    slim = keep_first(
        table.select(F.col(key).cast("string").alias(key), *kept, *order_columns), [key], order
    ).select(key, *[F.col(c).alias(f"{prefix}{c}") for c in kept])
    return base.join(slim, key, "left")


def merge_report(base: DataFrame, table: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """One row: distinct source keys, merged rows, columns added."""
    added = len(merged.columns) - len(base.columns)
    source = table.agg(F.count_distinct(F.col(key).cast("string")).alias("n"))
    rows = merged.agg(F.count(F.lit(1)).alias("n"))
    return merged.sparkSession.range(1).select(
        source.scalar().alias("n_rows_source"),
        rows.scalar().alias("n_rows_merged"),
        F.lit(added).cast("bigint").alias("n_cols_added"),
    )


def window_outcome(y: Column, lag_years: Column, years: int) -> Column:
    """1 when the outcome is positive and its lag lies in [0, years]."""
    hit = (F.coalesce(as_number(y), F.lit(0.0)) > 0) & lag_years.between(0.0, float(years))
    return F.coalesce(hit.cast("int"), F.lit(0))


def add_window_outcomes(
    df: DataFrame, years: Sequence[int], *, y: str = "y_all", lag: str = "recency_years_alt"
) -> tuple[DataFrame, list[str]]:
    windows = list(dict.fromkeys(int(n) for n in years if int(n) > 0))
    if not windows:
        raise ValueError("time windows need at least one positive number of years")
    missing = [c for c in (y, lag) if c not in df.columns]
    if missing:
        raise ValueError("time windows need columns missing from the data: " + ",".join(missing))
    cols = {f"y_{n}y": window_outcome(F.col(y), as_number(lag), n) for n in windows}
    return df.withColumns(cols), list(cols)


def window_report(df: DataFrame, window_cols: Sequence[str], *, y: str = "y_all") -> DataFrame:
    """Per window: positives, share, and whether it equals the unwindowed outcome on every row."""
    base = (F.coalesce(as_number(y), F.lit(0.0)) > 0).cast("int")
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"pos_{c}") for c in window_cols],
        *[F.bool_and(F.col(c) == base).alias(f"same_{c}") for c in window_cols],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("y_col"),
                F.regexp_extract(F.lit(c), r"^y_(\d+)y$", 1).cast("int").alias("window_years"),
                F.col(f"pos_{c}").cast("bigint").alias("n_positive"),
                (F.col(f"pos_{c}") / F.col("n")).alias("positive_share"),
                F.col(f"same_{c}").cast("int").alias("matches_y_all_exactly"),
            )
            for c in window_cols
        ]
    )
    return stats.select(F.inline(rows))


def grouped_outcome(source_cols: Sequence[str], mode: str = "any_positive", k: int | None = None) -> Column:
    """0/1 from several outcome columns: any, all, or at least k of them positive."""
    if mode not in GROUP_MODES:
        raise ValueError(f"unsupported group mode {mode}; use one of {GROUP_MODES}")
    n = len(source_cols)
    need = {"any_positive": 1, "all_positive": n}.get(mode, max(1, min(int(k or 1), n)))
    hits = sum(
        ((F.coalesce(as_number(c), F.lit(0.0)) > 0).cast("int") for c in source_cols[1:]),
        start=(F.coalesce(as_number(source_cols[0]), F.lit(0.0)) > 0).cast("int"),
    )
    return (hits >= need).cast("int")
