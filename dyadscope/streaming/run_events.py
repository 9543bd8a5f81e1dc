"""Run events as streams: current state per run, refreshed summaries, one run per request key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from dyadscope.operators import explore
from dyadscope.session import cut_lineage, ship_package

EVENT_SCHEMA = "ts timestamp, event_type string, run_id string, mode string, state string, attempt int"
# Legal state changes.
TRANSITIONS = {
    "queued": ("running", "cancelled"),
    "running": ("succeeded", "failed", "cancelled"),
    "failed": ("running",),
    "cancelled": ("running",),
    "succeeded": (),
}


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).json(folder)


STATUS_SCHEMA = "run_id string, state string, updated_at timestamp, n_events bigint, n_illegal bigint"
STATE_SCHEMA = "state string, at bigint, n_events bigint, n_illegal bigint"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _legal(before: str | None, after: str) -> bool:
    return before is None or before == after or after in TRANSITIONS.get(before, ())


def moved(stored: tuple[str, int, int, int] | None, events: list[tuple[int, int, str]]) -> tuple[str, int, int, int]:
    """(state, time, events, illegal moves) of a run after its events (time, attempt, state) of a batch.

    Events are judged in order of time. Those older than the stored state are late: they are counted, but neither
    move nor judge the run.
    """
    state, at, n, bad = stored or (None, None, 0, 0)
    n += len(events)
    start = at
    for when, _, after in sorted(events):
        if start is not None and when < start:
            continue
        bad += not _legal(state, after)
        state, at = after, when
    return state, at, n, bad


class RunStatus(StatefulProcessor):
    """Keyed state of one run: its last state and time, and how many events and illegal moves it has had."""

    def __init__(self, keep_ms: int | None = None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", STATE_SCHEMA, ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events: list[tuple[int, int, str]] = []
        for part in rows:
            events += zip(part["at"].tolist(), part["attempt"].fillna(0).astype(int).tolist(), part["state"].tolist(), strict=True)
        stored = tuple(self.status.get()) if self.status.exists() else None
        now = moved(stored, events)
        self.status.update(now)
        yield pd.DataFrame({"run_id": [key[0]], "state": [now[0]], "updated_at": pd.to_datetime([now[1]], unit="us", utc=True), "n_events": [now[2]], "n_illegal": [now[3]]})

    def close(self) -> None:
        pass


def track_runs(events: DataFrame, *, keep_ms: int | None = None) -> DataFrame:
    """Stream of the runs that a batch touches, each with its state after it.

    The state is kept in the state store, a row a run; `keep_ms` drops runs that have not been touched for so
    long. The store must keep named state, so the session's provider is set to RocksDB.
    """
    ship_package(events.sparkSession)
    events.sparkSession.conf.set(*ROCKS)
    narrow = events.where("run_id is not null and ts is not null").select("run_id", F.unix_micros("ts").alias("at"), "attempt", "state")
    return narrow.groupBy("run_id").transformWithStateInPandas(
        RunStatus(keep_ms), STATUS_SCHEMA, outputMode="Update", timeMode="ProcessingTime" if keep_ms else "None")


def maintain_status(events: DataFrame, table: str, checkpoint: str, *, keep_ms: int | None = None) -> StreamingQuery:
    """Keep a status table up to date: each micro-batch writes the runs that it touched, under its number.

    A batch that is run again after a failure replaces its own rows; the state store goes back with it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/v={batch_id}")

    tracked = track_runs(events, keep_ms=keep_ms)
    return tracked.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, table: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", table).parquet(table)
    except AnalysisException:  # nothing written yet
        return None


def read_status(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest row of every run."""
    stored = _versions(spark, table)
    if stored is None:
        return None
    columns = ["state", "updated_at", "n_events", "n_illegal"]
    return stored.groupBy("run_id").agg(F.max_by(F.struct(*columns), "v").alias("x")).select("run_id", *[F.col(f"x.{c}").alias(c) for c in columns])


def compact_status(spark: SparkSession, table: str, target: str) -> None:
    """Write the newest row of every run to a table of its own, under the newest batch number."""
    stored = _versions(spark, table)
    newest = stored.agg(F.max("v")).first()[0]
    read_status(spark, table).write.mode("overwrite").parquet(f"{target}/v={newest}")


#: Parts of the explorer's statistics; a batch reads the parts of its keys only.
VIEW_BUCKETS = 16
VIEWS = {
    "combinations": (explore.COMBO, explore.dashed, explore.combination_table),
    "factors": (("key_factor",), lambda rows: rows.where("key_factor <> ''"), explore.factor_table),
}


def _append_parts(rows: DataFrame, keys: tuple[str, ...], folder: str, batch_id: int) -> DataFrame:
    """Write what a batch adds to the statistics of its keys; the keys it touches, with their buckets."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(VIEW_BUCKETS)).cast("int").alias("bucket")
    for name, part in (("runs", explore.run_parts(rows, keys)), ("values", explore.value_counts(rows, keys))):
        # One task a bucket and file, unless a bucket is large: then it is split.
        part.select("*", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}/batch={batch_id}")
    return rows.select(*keys, bucket).distinct()


def _touched_stats(touched: DataFrame, keys: tuple[str, ...], folder: str) -> DataFrame:
    """Statistics of the touched keys over all batches so far, merged from their parts."""
    spark = touched.sparkSession
    buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most VIEW_BUCKETS

    def stored(name: str) -> DataFrame:
        rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").where(F.col("bucket").isin(buckets))
        return rows.join(touched.select(*keys), list(keys), "left_semi")

    counts = cut_lineage(stored("values").groupBy(*keys, "which", "v").agg(F.sum("n").alias("n")))
    return explore.evidence(explore.merged_parts(stored("runs"), keys), explore.medians_of_counts(counts, keys), keys)


def maintain_explorer(inference: DataFrame, store: str, checkpoint: str, *, q_threshold: float = 0.10) -> StreamingQuery:
    """Keep combination and factor statistics up to date with new inference rows.

    A batch is folded to mergeable parts (a row for each key and run, counts of values), which are written under its
    number. Then only the keys that it touches are merged over their parts and written on to the view; no row of
    an earlier batch is read again. A batch that is run again replaces what it wrote.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        rows = cut_lineage(explore.usable_rows(batch, q_threshold=q_threshold))
        for name, (keys, prepare, table) in VIEWS.items():
            folder = f"{store}/{name}"
            touched = cut_lineage(_append_parts(prepare(rows), keys, folder, batch_id))
            table(_touched_stats(touched, keys, folder)).write.mode("overwrite").parquet(f"{folder}/view/v={batch_id}")

    return (
        inference.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_view(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """The newest statistics of every key of a view."""
    stored = _versions(spark, f"{store}/{name}/view")
    if stored is None:
        return None
    keys = VIEWS[name][0]
    columns = [c for c in stored.columns if c not in (*keys, "v")]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*columns), "v").alias("x"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"x.{c}").alias(c) for c in stored.columns if c != "v"])


def first_submissions(requests: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """The first request per idempotency key, with state dropped once the key is older than the delay."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def submissions(requests: DataFrame) -> DataFrame:
    """Batch form: each request with the run of the first request under its key."""
    first = F.min_by("run_id", F.struct("ts", "run_id"))
    winners = requests.groupBy("idempotency_key").agg(first.alias("effective_run_id"))
    return requests.join(winners, "idempotency_key").withColumn("is_new", (F.col("run_id") == F.col("effective_run_id")).cast("int"))
