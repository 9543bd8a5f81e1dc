"""Queries on runs and files: history, listings, ladders, documents, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dyadscope.operators import review, runs
from dyadscope.plans import workload as w
from dyadscope.plans.oracle import RUNS, sql
from dyadscope.plans.registry_of_queries import query
from dyadscope.plans.result_queries import COMBO_NUMBERS, COMBO_SQL
from dyadscope.session import checkpoint_dir
from dyadscope.sources import readers, sinks
from dyadscope.streaming import run_events


def _entries(spark, sf):
    rows = w.run_table(spark, sf)
    typed = rows.select(
        "run_id", runs.infer_mode(F.col("run_id")).alias("mode"), runs.infer_state(F.col("status")).alias("state"), "updated_at", "source_order", "has_result"
    )
    return runs.latest_per_run(typed)


def _scratch(spark) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    return f"{checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"


@query("run_history", sql(RUNS, "SELECT run_id, mode, state, updated_at, has_result FROM entries"))
def run_history(spark, sf):
    return _entries(spark, sf).select("run_id", "mode", "state", "updated_at", "has_result")


@query("run_page", sql(RUNS, """
SELECT run_id, updated_at FROM entries WHERE state = 'failed' AND mode = 'singlex_baseline' AND run_id LIKE '%1%' ORDER BY updated_at DESC, run_id LIMIT 5 OFFSET 2"""))
def run_page(spark, sf):
    return runs.run_page(_entries(spark, sf), state="failed", mode="singlex_baseline", contains="1", offset=2, limit=5).select("run_id", "updated_at")


@query("run_counters", sql(RUNS, """
SELECT count(*) AS total, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'queued') AS queued,
   count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'cancelled') AS cancelled, count(*) FILTER (has_result = 1) AS with_result FROM entries"""))
def run_counters(spark, sf):
    return runs.run_counters(_entries(spark, sf))


@query("actionable_runs", sql(RUNS, "SELECT run_id, state FROM entries WHERE state IN ('failed', 'cancelled', 'running', 'queued')"))
def actionable_runs(spark, sf):
    return runs.actionable(_entries(spark, sf)).select("run_id", "state")


@query("latest_result", sql(RUNS, "SELECT run_id FROM entries ORDER BY CASE WHEN has_result = 1 THEN 2 WHEN state = 'succeeded' THEN 1 ELSE 0 END DESC, updated_at DESC, run_id DESC LIMIT 1"))
def latest_result(spark, sf):
    return runs.latest_result(_entries(spark, sf))


@query("live_over_history", sql(RUNS, """
, live AS (SELECT * FROM entries WHERE has_result = 0),
hist AS (SELECT DISTINCT run_id FROM run_rows)
SELECT run_id, 'live' AS source FROM live UNION ALL SELECT run_id, 'history' FROM hist WHERE run_id NOT IN (SELECT run_id FROM live)"""))
def live_over_history(spark, sf):
    live = _entries(spark, sf).where("has_result = 0").select("run_id", F.lit("live").alias("source"))
    history = w.run_table(spark, sf).select("run_id").distinct().withColumn("source", F.lit("history"))
    return runs.live_over_history(live, history)


@query("paired_run_ids", sql(RUNS, """
SELECT DISTINCT run_id, CASE WHEN ends_with(run_id, '__singlex') THEN run_id[:-10] || '__nooption_baseline' WHEN ends_with(run_id, '__nooption_baseline') THEN run_id ELSE run_id || '__nooption_baseline' END AS nooption,
   CASE WHEN ends_with(run_id, '__nooption_baseline') THEN run_id[:-20] || '__singlex' WHEN ends_with(run_id, '__singlex') THEN run_id ELSE run_id || '__singlex' END AS singlex FROM run_rows"""))
def paired_run_ids(spark, sf):
    return w.run_table(spark, sf).select("run_id").distinct().select("run_id", runs.paired_ids(F.col("run_id")).alias("p")).select("run_id", "p.*")


@query("governance_flags", """
SELECT CAST(event_id AS VARCHAR) AS run_id,
   CASE WHEN event_type = 'view' THEN CASE WHEN CAST(props->>'k' AS INTEGER) % 2 = 0 THEN 'false' ELSE 'true' END WHEN event_type = 'click' THEN 'false' END AS validation_used_for_search,
   CAST((event_type = 'view' AND CAST(props->>'k' AS INTEGER) % 2 = 0) OR event_type = 'click' AS INTEGER) AS validation_used_for_search_false,
   CAST(event_type = 'click' AS INTEGER) AS candidate_pool_locked_true FROM events""")
def governance_flags(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    nested = F.concat(F.lit('{"validation_used_for_search": '), F.when(k % 2 == 0, "false").otherwise("true"), F.lit("}"))
    docs = w.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("run_id"), F.when(kind == "view", nested).alias("search_governance"),
        F.when(kind == "click", "False").alias("validation_used_for_search"), F.when(kind == "click", "TRUE").alias("candidate_pool_locked_pre_validation"),
    )
    return runs.governance_flags(docs).select("run_id", "validation_used_for_search", "validation_used_for_search_false", "candidate_pool_locked_true")


ATTEMPTS = """
att AS (SELECT CAST(event_id AS INTEGER) AS position, 1 + user_id % 9 AS seed, CASE user_id % 3 WHEN 0 THEN 49 WHEN 1 THEN 99 ELSE 199 END AS nb,
   CASE event_type WHEN 'view' THEN 'ok' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS rc,
   CASE WHEN value < 5 THEN CAST(event_id % 2 AS INTEGER) END AS gate, CASE WHEN value > 10 THEN value / 100.0::DOUBLE END AS nq, value / 50.0::DOUBLE AS sq FROM events)"""


def _attempts(spark, sf):
    u, v = F.col("user_id"), F.col("value")
    kind = F.col("event_type")
    seed, nb = (u % 9 + 1), F.when(u % 3 == 0, 49).when(u % 3 == 1, 99).otherwise(199)
    return w.table(spark, sf, "events").select(
        F.col("event_id").cast("int").alias("position"), seed.alias("seed"), nb.alias("n_bootstrap"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(review.job_key(seed, nb)).alias("job_key"),
        F.when(kind == "view", "ok").when(kind == "error", "failed").otherwise("running").alias("status"), (kind == "error").cast("int").alias("returncode"),
        F.when(v < 5, (F.col("event_id") % 2).cast("int")).alias("gate_pass"), F.when(v > 10, v / 100.0).alias("nooption_best_q_validation"),
        (v / 50.0).alias("singlex_best_q_validation"),
    )


@query("ladder_summary", sql(ATTEMPTS, """
SELECT count(*) AS n_attempts_total, count(*) FILTER (rc = 0) AS n_attempts_returncode_zero, count(gate) AS n_attempts_with_direction_review, count(*) FILTER (gate = 1) AS n_primary_objective_gate_pass,
   round(count(*) FILTER (gate = 1)::DOUBLE / count(gate), 6) AS primary_objective_gate_pass_rate,
   count(DISTINCT CASE WHEN position % 4 <> 0 THEN 's' || seed || '_b' || nb END) AS n_unique_job_keys_completed, min(nq) AS nooption_best_q_validation,
   first(CASE WHEN position % 4 <> 0 THEN 's' || seed || '_b' || nb ELSE '' END ORDER BY nq, position) FILTER (nq IS NOT NULL) AS nooption_best_q_validation_job_key, min(sq) AS singlex_best_q_validation FROM att"""))
def ladder_summary(spark, sf):
    out = review.ladder_summary(_attempts(spark, sf), ("nooption_best_q_validation", "singlex_best_q_validation"))
    return out.drop("singlex_best_q_validation_job_key").withColumn("primary_objective_gate_pass_rate", F.round("primary_objective_gate_pass_rate", 6))


@query("pending_ladder_jobs", sql(ATTEMPTS, """
, done AS (SELECT DISTINCT 's' || seed || '_b' || nb AS k FROM att WHERE status IN ('ok', 'failed')),
jobs AS (SELECT s.s AS seed, b.b AS nb FROM (SELECT unnest([1, 2, 3, 11, 12]) AS s) s, (SELECT unnest([49, 99, 199]) AS b) b)
SELECT 's' || seed || '_b' || nb AS job_key FROM jobs WHERE 's' || seed || '_b' || nb NOT IN (SELECT k FROM done)"""))
def pending_ladder_jobs(spark, sf):
    jobs = review.ladder_jobs(spark, [1, 2, 3, 11, 12], [49, 99, 199])
    return review.pending_jobs(jobs, _attempts(spark, sf)).select("job_key")


@query("dataset_candidates", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, max(event_id) AS m FROM events GROUP BY 1),
a AS (SELECT run_id, lpad(CAST(m AS VARCHAR), 12, '0') AS updated_at, CASE WHEN m % 2 = 0 THEN 'scan_' || run_id END AS s, 'inf_' || run_id AS i FROM e)
SELECT run_id, updated_at, CASE WHEN s IS NOT NULL AND CAST(run_id AS INTEGER) % 3 = 0 THEN 'scan_runs_csv' WHEN CAST(run_id AS INTEGER) % 5 = 0 THEN 'top_models_inference_csv' WHEN s IS NOT NULL THEN 'scan_runs_csv' ELSE 'top_models_inference_csv' END AS artifact_key,
   CAST((s IS NOT NULL AND CAST(run_id AS INTEGER) % 3 = 0) OR CAST(run_id AS INTEGER) % 5 = 0 AS INTEGER) AS "exists" FROM a""")
def dataset_candidates(spark, sf):
    per = w.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.max("event_id").alias("m"))
    entries = per.select(
        "run_id", F.lpad(F.col("m").cast("string"), 12, "0").alias("updated_at"),
        F.when(F.col("m") % 2 == 0, F.concat(F.lit("scan_"), "run_id")).alias("scan_runs_csv"), F.concat(F.lit("inf_"), "run_id").alias("top_models_inference_csv"),
        F.lit(" ").alias("top_models_csv"),
    )
    n = F.col("run_id").cast("int")
    files = per.where(n % 3 == 0).select(F.concat(F.lit("scan_"), "run_id").alias("path")).union(per.where(n % 5 == 0).select(F.concat(F.lit("inf_"), "run_id")))
    return runs.dataset_candidates(entries, files).select("run_id", "updated_at", "artifact_key", "exists")


@query("set_difference", "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS policy_document_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def set_difference(spark, sf):
    customers = w.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("policy_document_id")).distinct()
    seen = w.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("policy_document_id"))
    return customers.join(seen, "policy_document_id", "left_anti")


@query("set_intersection", "SELECT DISTINCT p_brand FROM part WHERE p_size > 40 INTERSECT SELECT p_brand FROM part WHERE p_type = 'PROMO'")
def set_intersection(spark, sf):
    part = w.table(spark, sf, "part")
    return part.where("p_size > 40").select("p_brand").distinct().join(part.where("p_type = 'PROMO'").select("p_brand"), "p_brand", "left_semi")


@query("file_manifest")
def file_manifest(spark, sf):
    return readers.file_manifest(spark, f"{sf}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "n_bytes", "sha256")


@query("csv_round_trip", """
SELECT CAST(o_orderkey AS VARCHAR) AS pair_id, CAST(o_custkey AS VARCHAR) AS policy_document_id, o_orderstatus AS affiliation_label, NULL::VARCHAR AS note FROM orders""")
def csv_round_trip(spark, sf):
    """Fixed-order CSV sink and text-typed CSV scan."""
    rows = w.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("policy_document_id"), F.col("o_orderstatus").alias("affiliation_label"), "o_totalprice"
    )
    path = f"{_scratch(spark)}/rows.csv"
    sinks.write_rows(rows, path, ["pair_id", "policy_document_id", "affiliation_label", "note"], format="csv")
    return readers.read_table(spark, path)


@query("status_stream", """
WITH e AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS run_id, ts, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS state FROM events),
m AS (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY ts, state) AS before FROM e)
SELECT run_id, first(state ORDER BY ts DESC, state DESC) AS state, count(*) AS n_events,
   count(*) FILTER (before IS NOT NULL AND before <> state AND NOT ((before = 'queued' AND state IN ('running', 'cancelled')) OR (before = 'running' AND state IN ('succeeded', 'failed', 'cancelled')) OR (before IN ('failed', 'cancelled') AND state = 'running'))) AS n_illegal
FROM m GROUP BY 1""")
def status_stream(spark, sf):
    """Run events as JSON files, folded by a stream into the current state per run."""
    kind = F.col("event_type")
    state = F.when(kind == "view", "queued").when(kind == "click", "running").when(kind == "purchase", "succeeded").when(kind == "error", "failed").otherwise("cancelled")
    folder = _scratch(spark)
    w.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit("transition").alias("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"),
        F.lit("any").alias("mode"), state.alias("state"), F.lit(1).alias("attempt"),
    ).write.mode("overwrite").json(f"{folder}/log")
    done = run_events.maintain_status(run_events.read_events(spark, f"{folder}/log"), f"{folder}/status", f"{folder}/ckpt")
    done.awaitTermination()
    return run_events.read_status(spark, f"{folder}/status").select("run_id", "state", "n_events", "n_illegal")


def _deal(rows, folder, n_batches):
    """Write rows as files, `n_batches` from every task, for a stream of that many batches; the files of a batch."""
    rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(n_batches))).write.partitionBy("part").parquet(folder)
    return -(-len(rows.sparkSession.read.parquet(folder).inputFiles()) // n_batches)


@query("explorer_stream", sql(COMBO_SQL, "SELECT combo_id, n_rows, n_runs, " + ", ".join(f"round({c}, 9) AS {c}" for c in COMBO_NUMBERS) + " FROM combos"))
def explorer_stream(spark, sf):
    """Inference rows in three batches; the view is kept from what each batch adds."""
    folder = _scratch(spark)
    rows = w.inference_rows(spark, sf)
    per_batch = _deal(rows, f"{folder}/rows", 3)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(f"{folder}/rows").select(*rows.columns)
    run_events.maintain_explorer(stream, f"{folder}/store", f"{folder}/ckpt").awaitTermination()
    view = run_events.read_view(spark, f"{folder}/store", "combinations")
    return view.select("combo_id", "n_rows", "n_runs", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in COMBO_NUMBERS])


@query("idempotent_submissions", """
WITH r AS (SELECT 'k' || CAST(user_id AS VARCHAR) AS idempotency_key, CAST(event_id AS VARCHAR) AS run_id, ts FROM events),
f AS (SELECT idempotency_key, first(run_id ORDER BY ts, run_id) AS effective_run_id FROM r GROUP BY 1)
SELECT run_id, effective_run_id, CAST(run_id = effective_run_id AS INTEGER) AS is_new FROM r JOIN f USING (idempotency_key)""")
def idempotent_submissions(spark, sf):
    requests = w.table(spark, sf, "events").select(
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("idempotency_key"), F.col("event_id").cast("string").alias("run_id"), "ts"
    )
    return run_events.submissions(requests).select("run_id", "effective_run_id", "is_new")


@query("inference_scan", """
WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS c, l_returnflag AS t, CAST(l_quantity AS INTEGER) AS p, CAST(l_linenumber AS INTEGER) AS q, l_shipdate FROM lineitem)
SELECT 'first' AS run_id, 'single' AS mode, c AS candidate_id, t AS track, CAST(p AS VARCHAR) AS p_boot_validation, CAST(q AS VARCHAR) AS q_value_validation, NULL::VARCHAR AS key_factor FROM l
UNION ALL SELECT 'second', 'paired', c, t, CAST(p AS VARCHAR), CAST(q AS VARCHAR), t || ', "' || c FROM l WHERE l_shipdate >= DATE '1995-01-01'""")
def inference_scan(spark, sf):
    """Two runs with one base name: other column order, other names of p and q, a quoted text with commas."""
    lines = w.table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("candidate_id"), F.col("l_returnflag").alias("track"),
        F.col("l_quantity").cast("int").alias("p_boot_validation"), F.col("l_linenumber").cast("int").alias("q_value_validation"), "l_shipdate",
    )
    folder = _scratch(spark)
    lines.drop("l_shipdate").write.csv(f"{folder}/one/top.csv", header=True, escape='"')
    late = lines.where("l_shipdate >= DATE '1995-01-01'")
    late.select(
        F.col("q_value_validation").alias("q_value"), F.concat(F.col("track"), F.lit(', "'), F.col("candidate_id")).alias("key_factor"), "track",
        F.col("p_boot_validation").alias("p_value_validation"), "candidate_id",
    ).write.csv(f"{folder}/two/top.csv", header=True, escape='"')
    found = readers.read_inference(spark, [("first", "single", f"{folder}/one/top.csv"), ("second", "paired", f"{folder}/two/top.csv")])
    return found.select("run_id", "mode", "candidate_id", "track", "p_boot_validation", "q_value_validation", "key_factor")
