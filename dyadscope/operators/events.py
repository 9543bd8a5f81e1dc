"""Choice events: two alternatives, one chosen; capacities counted over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.functions.numeric import as_number

KEYS = ("track", "split_role")
DOC = "policy_document_id"


def _positive(y: str) -> Column:
    return F.coalesce(as_number(y), F.lit(0.0))


def one_chosen(total: Column) -> Column:
    """The outcome sum of the event, truncated to an integer, is one."""
    return total.cast("bigint") == 1


def event_outcomes(df: DataFrame, y_cols: Sequence[str], keys: Sequence[str] = KEYS, event: str = "event_id", doc: str = DOC) -> DataFrame:
    """One row per event: alternatives, cluster, outcome sums. A map-side combined aggregate."""
    return df.groupBy(*keys, event).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.col(doc).cast("string")).alias(doc),
        *[F.sum(_positive(y)).alias(f"sum_{y}") for y in y_cols],
    )


def two_alternative_events(df: DataFrame, keys: Sequence[str] = KEYS, event: str = "event_id") -> DataFrame:
    return df.groupBy(*keys, event).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows = 2")


def informative_capacity(df: DataFrame, y: str, keys: Sequence[str] = KEYS, event: str = "event_id", doc: str = DOC) -> DataFrame:
    """Per group: two-alternative events, informative events, clusters with an informative event."""
    events = event_outcomes(df, [y], keys, event, doc).where("n_rows = 2")
    good = one_chosen(F.col(f"sum_{y}"))
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_two_alt_events"),
        F.count_if(good).alias("n_informative_events"),
        F.count_distinct(F.when(good, F.col(doc))).alias("n_docs_informative"),
    )


def capacity_by_outcome(df: DataFrame, y_cols: Sequence[str], event: str = "event_id", doc: str = DOC) -> DataFrame:
    """Per outcome, over all tracks (track null) and per track, with track-qualified events.

    Events are reduced once for all outcomes; only then do outcomes become rows.
    """
    events = event_outcomes(df, y_cols, ("track",), event, doc).where("n_rows = 2")
    long = events.select(
        "track",
        doc,
        F.inline(
            F.array(
                *[F.struct(F.lit(y).alias("y_col"), one_chosen(F.col(f"sum_{y}")).alias("good")) for y in y_cols]
            )
        ),
    )
    per_doc = long.groupBy("y_col", "track", doc).agg(
        F.count(F.lit(1)).alias("n_two"), F.count_if("good").alias("n_good")
    )
    # Per document first: the distinct count below then sees one row per document and track.
    return per_doc.groupingSets([("y_col",), ("y_col", "track")], "y_col", "track").agg(
        F.sum("n_two").alias("n_two_alt_events"),
        F.sum("n_good").alias("n_informative_events"),
        F.count_distinct(F.when(F.col("n_good") > 0, F.col(doc))).alias("n_docs_informative"),
        F.grouping("track").alias("is_total"),
    )


def informative_events(df: DataFrame, y: str, exog: Sequence[str], keys: Sequence[str] = KEYS, event: str = "event_id", doc: str = DOC) -> DataFrame:
    """Events left with exactly two rows and one chosen after rows with null regressors are dropped."""
    present = df
    for c in exog:
        present = present.where(as_number(c).isNotNull())
    events = event_outcomes(present, [y], keys, event, doc)
    return events.where((F.col("n_rows") == 2) & one_chosen(F.col(f"sum_{y}")))


def keep_event_rows(df: DataFrame, events: DataFrame, keys: Sequence[str] = KEYS, event: str = "event_id") -> DataFrame:
    return df.join(events.select(*keys, event), [*keys, event], "left_semi")


def varying_events(df: DataFrame, feature: str, keys: Sequence[str] = KEYS, event: str = "event_id") -> DataFrame:
    """Two-row events whose feature is known on both rows and differs."""
    x = as_number(feature)
    stats = df.groupBy(*keys, event).agg(
        F.count(F.lit(1)).alias("n"), F.count(x).alias("k"), F.min(x).alias("lo"), F.max(x).alias("hi")
    )
    return stats.where("n = 2 and k = 2 and lo <> hi").select(*keys, event)


def top_cluster_share(informative: DataFrame, keys: Sequence[str] = KEYS, doc: str = DOC) -> DataFrame:
    """Largest share of the informative events that one cluster holds."""
    per_doc = informative.groupBy(*keys, doc).agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy(*keys).agg(
        F.sum("n").alias("n_informative_events"),
        F.count(F.lit(1)).alias("n_docs_informative"),
        (F.max("n") / F.sum("n")).alias("top1_doc_share"),
    )


def validation_capacity(df: DataFrame, event: str = "event_id", doc: str = DOC) -> DataFrame:
    """Documents and events of the validation side, per track and in total (track null)."""
    val = df.where(F.col("split_role") == "validation")
    return (
        val.groupBy("track", doc, event)
        .agg(F.lit(1).alias("_"))
        .groupingSets([(), ("track",)], "track")
        .agg(
            F.count_distinct(doc).alias("n_docs_validation"),
            F.count_distinct(event).alias("n_events_validation"),
            F.grouping("track").alias("is_total"),
        )
    )


def track_capacity_stats(capacity: DataFrame) -> DataFrame:
    """Smallest and largest track capacity, one row."""
    per_track = capacity.where("is_total = 0")
    zero = F.lit(0).cast("bigint")
    return per_track.agg(
        F.count(F.lit(1)).alias("n_tracks"),
        F.coalesce(F.min("n_docs_validation"), zero).alias("min_track_docs_validation"),
        F.coalesce(F.max("n_docs_validation"), zero).alias("max_track_docs_validation"),
        F.coalesce(F.min("n_events_validation"), zero).alias("min_track_events_validation"),
        F.coalesce(F.max("n_events_validation"), zero).alias("max_track_events_validation"),
    )


def slice_rows(df: DataFrame, track: str = "all", split_role: str = "all") -> DataFrame:
    """Rows of one track and split; 'all' or 'any' leaves a side open. Prunes partitions on disk."""
    if split_role not in ("discovery", "validation", "all"):
        raise ValueError("split_role must be one of: discovery, validation, all")
    if track.lower() not in ("all", "any"):
        df = df.where(F.col("track") == track)
    if split_role != "all":
        df = df.where(F.col("split_role") == split_role)
    return df

