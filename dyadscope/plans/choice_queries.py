"""Queries on the choice table: preparation, split, events, registry, gates, candidates, designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadscope.functions import hashing, names
from dyadscope.operators import candidates as cand
from dyadscope.operators import derive, designs, events, gates, precheck, prepare, registry, split
from dyadscope.plans import workload as w
from dyadscope.plans.oracle import CHOICES, WINDOWS, sql
from dyadscope.plans.registry_of_queries import query
from dyadscope.plans.scan import discovery_capacity
from dyadscope.session import cut_lineage
from dyadscope.settings import Controls, Draws, Gates, Need, ScanSettings

Y_WINDOWS = ("y_all", "y_1y", "y_3y", "y_5y")
CHOICE_WINDOWS = CHOICES + "," + WINDOWS
NUMERIC = ("l_discount", "l_extendedprice", "l_quantity", "l_tax", "recency_years_alt", "x_nullable")
LINE_PRETREATMENT = (*NUMERIC, "pa__p_size", "pa__p_retailprice", "ext__s_acctbal")


def _timing(name):
    return names.timing_label(
        name, base=(*names.BASE_PRETREATMENT, *NUMERIC), covariates=("p_size",), extension=("s_acctbal",)
    )


@query("cluster_holdout_split", """
WITH scored AS (
  SELECT CAST(c_custkey AS VARCHAR) AS policy_document_id,
         ('0x' || substr(sha256('20260219|' || CAST(c_custkey AS VARCHAR)), 1, 12))::BIGINT / power(16.0::DOUBLE, 12) AS score
  FROM customer)
SELECT policy_document_id, CASE WHEN score < 0.8 THEN 'discovery' ELSE 'validation' END AS split_role,
       'policy_document_holdout_seed20260219_80_20' AS split_id FROM scored""")
def cluster_holdout_split(spark, sf):
    docs = w.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("policy_document_id"))
    return split.hash_holdout(docs).select("policy_document_id", "split_role", "split_id")


@query("random_holdout_split", """
WITH scored AS (
  SELECT CAST(c_custkey AS VARCHAR) AS policy_document_id,
         ('0x' || substr(sha256('7|' || CAST(c_custkey AS VARCHAR)), 1, 12))::BIGINT / power(16.0::DOUBLE, 12) AS score
  FROM customer),
placed AS (SELECT *, row_number() OVER (ORDER BY score, policy_document_id) AS rn, count(*) OVER () AS n FROM scored)
SELECT policy_document_id,
       CASE WHEN rn <= greatest(1, least(round_even(n * 0.67::DOUBLE, 0), n - 1)) THEN 'discovery' ELSE 'validation' END AS split_role
FROM placed""")
def random_holdout_split(spark, sf):
    docs = w.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("policy_document_id"))
    return split.random_holdout_roles(docs, seed=7, ratio=0.67)


@query("split_report", sql(CHOICES, """
SELECT count(DISTINCT policy_document_id) AS n_docs_total,
       count(DISTINCT policy_document_id) FILTER (split_role = 'discovery') AS n_docs_discovery,
       count(DISTINCT policy_document_id) FILTER (split_role = 'validation') AS n_docs_validation,
       count(*) FILTER (split_role = 'discovery') AS n_rows_discovery,
       count(*) FILTER (split_role = 'validation') AS n_rows_validation FROM choices"""))
def split_report(spark, sf):
    return split.split_report(w.choices(spark, sf))


@query("split_integrity", sql(CHOICES, """
, per AS (SELECT policy_document_id, max(CAST(split_role = 'discovery' AS INTEGER)) d, max(CAST(split_role = 'validation' AS INTEGER)) v
          FROM choices GROUP BY 1)
SELECT CAST(sum(d) + sum(v) AS BIGINT) AS n_docs_total, CAST(sum(d) AS BIGINT) AS n_docs_discovery,
       CAST(sum(v) AS BIGINT) AS n_docs_validation, count(*) FILTER (d + v > 1) AS n_overlap_docs,
       round(sum(d)::DOUBLE / (sum(d) + sum(v))::DOUBLE, 6) AS discovery_share_by_docs FROM per"""))
def split_integrity(spark, sf):
    return split.split_integrity(w.choices(spark, sf)).withColumn("discovery_share_by_docs", F.round("discovery_share_by_docs", 6))


@query("split_assignment_scan", """
WITH src AS (SELECT CAST(user_id AS VARCHAR) AS policy_document_id, event_id,
       CASE event_type WHEN 'view' THEN 'discovery' WHEN 'click' THEN 'validation' WHEN 'purchase' THEN 'discovery' ELSE 'other' END AS role FROM events),
valid AS (SELECT * FROM src WHERE role <> 'other'),
firsts AS (SELECT policy_document_id, arg_min(role, event_id) AS split_role FROM valid GROUP BY 1)
SELECT f.policy_document_id, f.split_role, count(*) FILTER (v.role <> f.split_role) AS n_conflicting_rows
FROM firsts f JOIN valid v USING (policy_document_id) GROUP BY 1, 2""")
def split_assignment_scan(spark, sf):
    kind = F.col("event_type")
    src = w.table(spark, sf, "events").select(
        F.col("user_id").alias("policy_document_id"),
        "event_id",
        F.when(kind.isin("view", "purchase"), "discovery").when(kind == "click", "validation").otherwise("other").alias("split_role"),
    )
    return split.split_assignments(src, order=[F.col("event_id")])


@query("split_role_lookup", sql(CHOICES, """
, known AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS policy_document_id, 'validation' AS given FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT coalesce(given, split_role) AS split_role, CAST(given IS NULL AS INTEGER) AS split_from_rule, count(*) AS n_rows
FROM choices LEFT JOIN known USING (policy_document_id) GROUP BY 1, 2"""))
def split_role_lookup(spark, sf):
    urgent = w.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").cast("string").alias("policy_document_id"), F.lit("validation").alias("split_role"), F.lit(0).alias("n_conflicting_rows")
    ).distinct()
    out = split.apply_assignments(w.choices(spark, sf).drop("split_role"), urgent)
    return out.groupBy("split_role", "split_from_rule").agg(F.count(F.lit(1)).alias("n_rows"))


@query("prepared_choices", """
SELECT CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) AS event_id,
       CAST(o_orderstatus = 'F' AS INTEGER) AS is_academia_origin,
       CAST(trunc(o_totalprice) AS BIGINT) AS count_all_raw,
       round(CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) / 365.25::DOUBLE, 6) AS recency_years_alt
FROM orders""")
def prepared_choices(spark, sf):
    o = w.table(spark, sf, "orders")
    raw = o.select(
        F.lit("t").alias("track"), F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("policy_document_id"),
        F.col("o_orderkey").alias("openalex_work_id"),
        F.when(F.col("o_orderstatus") == "F", "academia").otherwise("industry").alias("affiliation_label"),
        F.lit("1").alias("reference_dik"), F.lit("0").alias("reference_dik_evidence_use"),
        F.col("o_totalprice").cast("string").alias("reference_count_dik_all_contexts"), F.lit(None).cast("string").alias("reference_count_dik_evidence_use"),
        F.lit("1995").alias("pub_year"), F.lit("1995/01/01").alias("pub_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("policy_published_on"),
    )
    out = prepare.prepare_choices(raw)
    return out.select("event_id", "is_academia_origin", F.col("count_all").alias("count_all_raw"), F.round("recency_years_alt", 6).alias("recency_years_alt"))


@query("keep_first_dedupe", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem)
WHERE rn = 1""")
def keep_first_dedupe(spark, sf):
    lines = w.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate", "l_suppkey", "l_extendedprice")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    return prepare.keep_first(lines, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("prefixed_merge", """
WITH slim AS (SELECT * FROM (SELECT CAST(l_partkey AS VARCHAR) AS k, l_quantity, l_tax,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity, l_tax) AS rn FROM lineitem) WHERE rn = 1)
SELECT CAST(p_partkey AS VARCHAR) AS openalex_work_id, p_size, l_quantity AS ext__l_quantity, l_tax AS ext__l_tax
FROM part LEFT JOIN slim ON CAST(p_partkey AS VARCHAR) = k""")
def prefixed_merge(spark, sf):
    base = w.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("openalex_work_id"), "p_size")
    side = w.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("openalex_work_id"), "l_quantity", "l_tax", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"
    )
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_tax")]
    return prepare.prefixed_merge(
        base, side, "openalex_work_id", "ext__", order=order, order_columns=("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    )


@query("merge_report", """
SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_rows_source, (SELECT count(*) FROM part) AS n_rows_merged, CAST(2 AS BIGINT) AS n_cols_added""")
def merge_report(spark, sf):
    merged = prefixed_merge(spark, sf)
    base = w.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("openalex_work_id"), "p_size")
    side = w.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("openalex_work_id"))
    return prepare.merge_report(base, side, merged, "openalex_work_id")


@query("time_window_outcomes", sql(CHOICE_WINDOWS, """
SELECT y_col, window_years, CAST(n_positive AS BIGINT) AS n_positive, round(n_positive::DOUBLE / n, 6) AS positive_share, matches_y_all_exactly FROM (
  SELECT 'y_1y' AS y_col, 1 AS window_years, sum(y_1y) AS n_positive, count(*) AS n, CAST(bool_and(y_1y = y_all) AS INTEGER) AS matches_y_all_exactly FROM windowed
  UNION ALL SELECT 'y_3y', 3, sum(y_3y), count(*), CAST(bool_and(y_3y = y_all) AS INTEGER) FROM windowed
  UNION ALL SELECT 'y_5y', 5, sum(y_5y), count(*), CAST(bool_and(y_5y = y_all) AS INTEGER) FROM windowed)"""))
def time_window_outcomes(spark, sf):
    report = prepare.window_report(w.wide_choices(spark, sf), ["y_1y", "y_3y", "y_5y"])
    return report.withColumn("positive_share", F.round("positive_share", 6))


@query("grouped_outcome", sql(CHOICE_WINDOWS, """
SELECT track, CAST(sum(CAST(y_1y + y_3y + y_5y >= 1 AS INTEGER)) AS BIGINT) AS any_positive,
       CAST(sum(CAST(y_1y + y_3y + y_5y >= 3 AS INTEGER)) AS BIGINT) AS all_positive,
       CAST(sum(CAST(y_1y + y_3y + y_5y >= 2 AS INTEGER)) AS BIGINT) AS at_least_two FROM windowed GROUP BY track"""))
def grouped_outcome(spark, sf):
    ys = ["y_1y", "y_3y", "y_5y"]
    df = w.wide_choices(spark, sf)
    return df.groupBy("track").agg(
        F.sum(prepare.grouped_outcome(ys)).alias("any_positive"),
        F.sum(prepare.grouped_outcome(ys, "all_positive")).alias("all_positive"),
        F.sum(prepare.grouped_outcome(ys, "at_least_k", 2)).alias("at_least_two"),
    )


EVENTS = """
, ev AS (SELECT track, split_role, event_id, min(policy_document_id) AS doc, count(*) AS n, sum(y_all) AS y FROM choices GROUP BY ALL)
"""


@query("two_alternative_events", sql(CHOICES, EVENTS + "SELECT track, split_role, event_id, n AS n_rows FROM ev WHERE n = 2"))
def two_alternative_events(spark, sf):
    return events.two_alternative_events(w.choices(spark, sf))


@query("informative_capacity", sql(CHOICES, EVENTS + """
SELECT track, split_role, count(*) AS n_two_alt_events, count(*) FILTER (y = 1) AS n_informative_events,
       count(DISTINCT doc) FILTER (y = 1) AS n_docs_informative FROM ev WHERE n = 2 GROUP BY ALL"""))
def informative_capacity(spark, sf):
    return events.informative_capacity(w.choices(spark, sf), "y_all")


@query("capacity_by_outcome", sql(CHOICE_WINDOWS, """
, long AS (SELECT track, event_id, policy_document_id, 'y_all' AS y_col, y_all AS y FROM windowed
  UNION ALL SELECT track, event_id, policy_document_id, 'y_1y', y_1y FROM windowed
  UNION ALL SELECT track, event_id, policy_document_id, 'y_3y', y_3y FROM windowed
  UNION ALL SELECT track, event_id, policy_document_id, 'y_5y', y_5y FROM windowed),
ev AS (SELECT y_col, track, event_id, min(policy_document_id) AS doc, count(*) AS n, sum(y) AS y FROM long GROUP BY ALL)
SELECT y_col, track, count(*) AS n_two_alt_events, count(*) FILTER (y = 1) AS n_informative_events,
       count(DISTINCT doc) FILTER (y = 1) AS n_docs_informative, CAST(grouping(track) AS INTEGER) AS is_total
FROM ev WHERE n = 2 GROUP BY GROUPING SETS ((y_col), (y_col, track))"""))
def capacity_by_outcome(spark, sf):
    out = events.capacity_by_outcome(w.wide_choices(spark, sf), Y_WINDOWS)
    return out.withColumn("is_total", F.col("is_total").cast("int"))


@query("informative_events", sql(CHOICES, """
SELECT track, split_role, event_id, min(policy_document_id) AS policy_document_id FROM choices
WHERE x_nullable IS NOT NULL AND l_quantity IS NOT NULL GROUP BY track, split_role, event_id HAVING count(*) = 2 AND sum(y_all) = 1"""))
def informative_events(spark, sf):
    out = events.informative_events(w.choices(spark, sf), "y_all", ["x_nullable", "l_quantity"])
    return out.select("track", "split_role", "event_id", "policy_document_id")


@query("informative_rows", sql(CHOICES, EVENTS + """
SELECT c.track, c.split_role, count(*) AS n_rows, CAST(sum(l_quantity) AS BIGINT) AS sum_quantity
FROM choices c SEMI JOIN (SELECT * FROM ev WHERE n = 2 AND y = 1) e USING (track, split_role, event_id) GROUP BY ALL"""))
def informative_rows(spark, sf):
    df = w.choices(spark, sf)
    good = events.informative_events(df, "y_all", [])
    kept = events.keep_event_rows(df, good)
    return kept.groupBy("track", "split_role").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").cast("bigint").alias("sum_quantity"))


@query("varying_events", sql(CHOICES, """
SELECT track, split_role, event_id FROM choices GROUP BY ALL
HAVING count(*) = 2 AND count(x_nullable) = 2 AND min(x_nullable) <> max(x_nullable)"""))
def varying_events(spark, sf):
    return events.varying_events(w.choices(spark, sf), "x_nullable")


@query("track_split_slice", sql(CHOICES, "SELECT event_id, l_quantity, l_tax FROM choices WHERE track = 'primary_strict' AND split_role = 'validation'"))
def track_split_slice(spark, sf):
    return events.slice_rows(w.choices(spark, sf), "primary_strict", "validation").select("event_id", "l_quantity", "l_tax")


@query("top_cluster_share", sql(CHOICES, EVENTS + """
, d AS (SELECT track, split_role, doc, count(*) AS k FROM ev WHERE n = 2 AND y = 1 GROUP BY ALL)
SELECT track, split_role, CAST(sum(k) AS BIGINT) AS n_informative_events, count(*) AS n_docs_informative,
       round(max(k)::DOUBLE / sum(k)::DOUBLE, 6) AS top1_doc_share FROM d GROUP BY ALL"""))
def top_cluster_share(spark, sf):
    good = events.informative_events(w.choices(spark, sf), "y_all", [])
    return events.top_cluster_share(good).withColumn("top1_doc_share", F.round("top1_doc_share", 6))


VAL_CAPACITY = """
, cap AS (SELECT track, count(DISTINCT policy_document_id) AS n_docs_validation, count(DISTINCT event_id) AS n_events_validation,
         CAST(grouping(track) AS INTEGER) AS is_total FROM choices WHERE split_role = 'validation' GROUP BY GROUPING SETS ((), (track)))
"""


@query("validation_capacity", sql(CHOICES, VAL_CAPACITY + "SELECT * FROM cap"))
def validation_capacity(spark, sf):
    return events.validation_capacity(w.choices(spark, sf)).withColumn("is_total", F.col("is_total").cast("int"))


@query("track_capacity_stats", sql(CHOICES, VAL_CAPACITY + """
SELECT count(*) AS n_tracks, min(n_docs_validation) AS min_track_docs_validation, max(n_docs_validation) AS max_track_docs_validation,
       min(n_events_validation) AS min_track_events_validation, max(n_events_validation) AS max_track_events_validation FROM cap WHERE is_total = 0"""))
def track_capacity_stats(spark, sf):
    return events.track_capacity_stats(events.validation_capacity(w.choices(spark, sf)))


@query("adaptive_gates", sql(CHOICES, VAL_CAPACITY + """
, s AS (SELECT min(n_docs_validation) d, min(n_events_validation) e FROM cap WHERE is_total = 0)
SELECT CASE WHEN e > 0 THEN least(1000, e, greatest(10, CAST(floor(e * 0.5::DOUBLE) AS BIGINT))) ELSE 1000 END AS gate_events,
       CASE WHEN d > 0 THEN least(100, d, greatest(5, CAST(floor(d * 0.5::DOUBLE) AS BIGINT))) ELSE 100 END AS gate_docs FROM s"""))
def adaptive_gates(spark, sf):
    stats = events.track_capacity_stats(events.validation_capacity(w.choices(spark, sf)))
    return gates.profiled_gates(stats, "adaptive_production", events=1000, docs=100)


@query("feasibility_frontier", sql(CHOICES, VAL_CAPACITY + """
, t AS (SELECT * FROM cap WHERE is_total = 0),
s AS (SELECT min(n_docs_validation) dmin, max(n_docs_validation) dmax, min(n_events_validation) emin, max(n_events_validation) emax FROM t),
a AS (SELECT n_docs_validation dall, n_events_validation eall FROM cap WHERE is_total = 1),
dg AS (SELECT DISTINCT g FROM (SELECT unnest([1,3,5,7,10,12,15,20,25,30,40,60, dmin, dmax, dall]::BIGINT[]) AS g FROM s, a) WHERE g > 0),
eg AS (SELECT DISTINCT g FROM (SELECT unnest([1,3,5,7,10,15,20,30,50,100,200,120, emin, emax, eall]::BIGINT[]) AS g FROM s, a) WHERE g > 0),
grid AS (SELECT dg.g AS d, eg.g AS e, coalesce(list_sort(list(track) FILTER (n_docs_validation < dg.g OR n_events_validation < eg.g)), []) AS bad
         FROM dg, eg, t GROUP BY dg.g, eg.g)
SELECT d AS min_docs_gate, e AS min_events_gate, CAST(len(bad) = 0 AS INTEGER) AS strict_track_feasible,
       CAST(dall >= d AND eall >= e AS INTEGER) AS global_feasible, CAST(len(bad) AS INTEGER) AS n_failing_tracks,
       coalesce(array_to_string(bad, ','), '') AS failing_tracks FROM grid, a"""))
def feasibility_frontier(spark, sf):
    capacity = events.validation_capacity(w.choices(spark, sf))
    return gates.feasibility_frontier(capacity, docs_requested=40, events_requested=200, docs_effective=60, events_effective=120)


@query("outcome_gate_map", sql(CHOICE_WINDOWS, """
, val AS (SELECT * FROM windowed WHERE split_role = 'validation'),
long AS (SELECT track, event_id, policy_document_id, 'y_all' AS y_col, y_all AS y FROM val
  UNION ALL SELECT track, event_id, policy_document_id, 'y_1y', y_1y FROM val
  UNION ALL SELECT track, event_id, policy_document_id, 'y_3y', y_3y FROM val
  UNION ALL SELECT track, event_id, policy_document_id, 'y_5y', y_5y FROM val),
ev AS (SELECT y_col, track, event_id, min(policy_document_id) AS doc, sum(y) AS y FROM long GROUP BY ALL HAVING count(*) = 2),
cap AS (SELECT y_col, track, count(*) FILTER (y = 1) AS e, count(DISTINCT doc) FILTER (y = 1) AS d FROM ev GROUP BY GROUPING SETS ((y_col), (y_col, track))),
m AS (SELECT y_col, max(e) FILTER (track IS NULL) AS total_events, max(d) FILTER (track IS NULL) AS total_docs,
             min(e) FILTER (track IS NOT NULL) AS min_track_events, min(d) FILTER (track IS NOT NULL) AS min_track_docs FROM cap GROUP BY y_col)
SELECT *, greatest(1, least(100, greatest(10, CAST(floor(min_track_events * 0.5::DOUBLE) AS BIGINT)), greatest(min_track_events, 1))) AS gate_events,
       greatest(1, least(30, greatest(5, CAST(floor(min_track_docs * 0.5::DOUBLE) AS BIGINT)), greatest(min_track_docs, 1))) AS gate_docs,
       CASE WHEN least(total_events, total_docs, min_track_events, min_track_docs) <= 0 THEN 'unusable'
            WHEN min_track_events < 10 OR min_track_docs < 5 THEN 'low_capacity' ELSE 'usable' END AS feasibility_label,
       CAST(least(total_events, total_docs, min_track_events, min_track_docs) <= 0 AS INTEGER) AS is_unusable,
       CAST(min_track_events < 10 OR min_track_docs < 5 AS INTEGER) AS is_below_floor FROM m"""))
def outcome_gate_map(spark, sf):
    return gates.outcome_gate_map(w.wide_choices(spark, sf), Y_WINDOWS, events=100, docs=30)


@query("outcome_precheck", sql(CHOICE_WINDOWS, """
, long AS (SELECT track, 'y_all' AS y_col, y_all AS y FROM windowed UNION ALL SELECT track, 'y_1y', y_1y FROM windowed
  UNION ALL SELECT track, 'y_3y', y_3y FROM windowed UNION ALL SELECT track, 'y_5y', y_5y FROM windowed),
t AS (SELECT y_col, track, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM long GROUP BY ALL),
a AS (SELECT y_col, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS pos, min(pos) AS weakest, count(*) FILTER (pos < 400) AS low FROM t GROUP BY 1)
SELECT y_col, n AS n_rows, n AS n_nonmissing, pos AS n_positive, least(weakest, pos) AS min_track_positive, low AS n_low_support_tracks,
       round(pos::DOUBLE / n, 6) AS positive_share, CAST(pos < 1000 OR pos::DOUBLE / n < 0.1 AS INTEGER) AS low_support FROM a"""))
def outcome_precheck(spark, sf):
    out = precheck.outcome_precheck(w.wide_choices(spark, sf), Y_WINDOWS, min_positive=1000, min_track_positive=400, min_share=0.1)
    return out.withColumn("positive_share", F.round("positive_share", 6))


@query("outcome_redundancy", sql(CHOICE_WINDOWS, """
, r AS (SELECT y_all, y_1y, y_3y, y_5y, CAST(y_5y > 0 OR y_3y > 0 AS INTEGER) AS y_7y, y_1y AS y_copy FROM windowed),
c AS (SELECT count(*) FILTER (y_5y <> y_7y) AS d57, count(*) FILTER (y_1y <> y_copy) AS d1c, count(*) FILTER (y_all <> y_5y) AS da5,
             CAST(sum(y_5y) AS BIGINT) AS n5, CAST(sum(y_7y) AS BIGINT) AS n7, CAST(sum(y_1y) AS BIGINT) AS n1 FROM r)
SELECT 'y_1y' AS y_col, n1 AS n_positive, CAST(2 AS BIGINT) AS group_size, 'y_1y' AS recommended_keep, 0 AS is_redundant FROM c WHERE d1c = 0
UNION ALL SELECT 'y_copy', n1, 2, 'y_1y', 1 FROM c WHERE d1c = 0
UNION ALL SELECT 'y_5y', n5, 2, 'y_5y', 0 FROM c WHERE d57 = 0 AND da5 > 0
UNION ALL SELECT 'y_7y', n7, 2, 'y_5y', 1 FROM c WHERE d57 = 0 AND da5 > 0"""))
def outcome_redundancy(spark, sf):
    df = w.wide_choices(spark, sf).withColumns({"y_7y": prepare.grouped_outcome(["y_5y", "y_3y"]), "y_copy": F.col("y_1y")})
    return precheck.outcome_redundancy(df, ["y_all", "y_1y", "y_3y", "y_5y", "y_7y", "y_copy"])


@query("confirmatory_outcomes", sql(CHOICE_WINDOWS, """
, low AS (SELECT 'y_all' AS y_col, sum(y_all) AS pos FROM windowed UNION ALL SELECT 'y_1y', sum(y_1y) FROM windowed
  UNION ALL SELECT 'y_3y', sum(y_3y) FROM windowed UNION ALL SELECT 'y_5y', sum(y_5y) FROM windowed)
SELECT CAST(CASE y_col WHEN 'y_all' THEN 0 WHEN 'y_1y' THEN 1 WHEN 'y_3y' THEN 2 ELSE 3 END AS INTEGER) AS position, y_col,
       CAST(y_col IN ('y_1y', 'y_3y') AND NOT pos < (SELECT count(*) * 0.1::DOUBLE FROM windowed) AS INTEGER) AS is_confirmatory,
       0 AS dropped_redundant,
       CAST(y_col IN ('y_1y', 'y_3y') AND pos < (SELECT count(*) * 0.1::DOUBLE FROM windowed) AS INTEGER) AS dropped_low_support,
       0 AS fallback_applied FROM low"""))
def confirmatory_outcomes(spark, sf):
    df = w.wide_choices(spark, sf)
    low = precheck.outcome_precheck(df, Y_WINDOWS, min_positive=0, min_track_positive=0, min_share=0.1).where("low_support = 1")
    available = spark.createDataFrame(list(enumerate(Y_WINDOWS)), "position int, y_col string")
    return precheck.confirmatory_outcomes(available, requested=("y_1y", "y_3y", "y_missing"), low_support=low, policy="drop_redundant_and_low_support")


@query("time_columns", """
SELECT 'o_orderkey' AS column_name, 0 AS by_name, CAST(avg(CAST(o_orderkey BETWEEN 1800 AND 2100 AS INTEGER)) >= 0.8 AS INTEGER) AS numeric_year_like FROM orders
UNION ALL SELECT 'o_orderdate', 1, 0
UNION ALL SELECT 'o_year', 1, CAST(avg(CAST(year(o_orderdate) BETWEEN 1800 AND 2100 AS INTEGER)) >= 0.8 AS INTEGER) FROM orders
UNION ALL SELECT 'o_totalprice', 0, CAST(avg(CAST(o_totalprice BETWEEN 1800 AND 2100 AS INTEGER)) >= 0.8 AS INTEGER) FROM orders""")
def time_columns(spark, sf):
    o = w.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("o_year"), "o_totalprice")
    return precheck.time_columns(o)


def _variation_sql(columns):
    per = ", ".join(f"count({c}) AS k{i}, min({c}) AS a{i}, max({c}) AS b{i}" for i, c in enumerate(columns))
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature_name, count(*) AS n_two_alt_events, count(*) FILTER (k{i} = 2) AS n_events_nonmissing, "
        f"count(*) FILTER (k{i} = 2 AND a{i} <> b{i}) AS n_events_with_variation FROM two"
        for i, c in enumerate(columns)
    )
    return f"""
, two AS (SELECT event_id, {per} FROM choices GROUP BY event_id HAVING count(*) = 2),
v AS ({rows}),
vm AS (SELECT *, CASE WHEN n_events_nonmissing > 0 THEN n_events_with_variation::DOUBLE / n_events_nonmissing ELSE 0 END AS sv,
                 CASE WHEN n_two_alt_events > 0 THEN n_events_nonmissing::DOUBLE / n_two_alt_events ELSE 0 END AS sn FROM v)
"""


@query("variation_metrics", sql(CHOICES, _variation_sql(LINE_PRETREATMENT) + """
SELECT feature_name, n_two_alt_events, n_events_nonmissing, n_events_with_variation, round(sv, 6) AS share_variation, round(sn, 6) AS share_nonmissing,
       CASE WHEN sv >= 0.6 THEN 'high' WHEN sv >= 0.3 THEN 'medium' ELSE 'low' END AS label FROM vm"""))
def variation_metrics(spark, sf):
    out = registry.variation_metrics(w.choices(spark, sf), {c: F.col(c) for c in LINE_PRETREATMENT})
    return out.select(
        "feature_name", "n_two_alt_events", "n_events_nonmissing", "n_events_with_variation",
        F.round("share_variation", 6).alias("share_variation"), F.round("share_nonmissing", 6).alias("share_nonmissing"),
        names.variation_label(F.col("share_variation")).alias("label"),
    )


REGISTRY = _variation_sql(LINE_PRETREATMENT) + """
, reg AS (SELECT feature_name,
   CASE WHEN starts_with(feature_name, 'ext__') THEN 'metadata_extension' WHEN starts_with(feature_name, 'pa__') THEN 'phase_a_model_input' ELSE 'dyad_base' END AS data_source,
   CASE WHEN feature_name = 'pa__p_retailprice' THEN 'unknown' ELSE 'pre_treatment' END AS timing_label,
   CAST(feature_name = 'recency_years_alt' AS INTEGER) AS suggested_as_control,
   list_filter([CASE WHEN feature_name = 'pa__p_retailprice' THEN 'timing_not_pre_treatment' END,
     CASE WHEN sv < 0.1 THEN 'low_within_event_variation' END, CASE WHEN sn < 0.8 THEN 'low_nonmissing_share' END], lambda x: x IS NOT NULL) AS reasons,
   sv, sn FROM vm)
"""


@query("registry_eligibility", sql(CHOICES, REGISTRY + """
SELECT feature_name, data_source, timing_label, suggested_as_control, CAST(len(reasons) = 0 AS INTEGER) AS allowed_in_scan,
       round(sv, 6) AS share_events_with_variation, round(sn, 6) AS share_events_nonmissing, 'zscore_within_track' AS transform,
       array_to_string(reasons, '|') AS block_reasons FROM reg"""))
def registry_eligibility(spark, sf):
    reg = registry.build_registry(w.choices(spark, sf), columns=LINE_PRETREATMENT, timing=_timing)
    return reg.select(
        "feature_name", "data_source", "timing_label", "suggested_as_control", "allowed_in_scan", "share_events_with_variation",
        "share_events_nonmissing", "transform", F.array_join("block_reasons", "|").alias("block_reasons"),
    )


@query("registry_data_filter", """
WITH k AS (SELECT count(p_size) FILTER (p_size > 45) AS a, count(p_retailprice) AS b FROM part)
SELECT 'p_rare' AS feature_name, CAST(a >= 20 AS INTEGER) AS allowed_in_scan, CASE WHEN a < 20 THEN 'feature_non_numeric_or_low_nonmissing' ELSE '' END AS block_reasons FROM k
UNION ALL SELECT 'p_retailprice', 1, '' FROM k
UNION ALL SELECT 'p_gone', 0, 'feature_not_in_joined_data'
UNION ALL SELECT 'p_name', 0, 'feature_non_numeric_or_low_nonmissing|given'""")
def registry_data_filter(spark, sf):
    data = w.table(spark, sf, "part").select(F.when(F.col("p_size") > 45, F.col("p_size")).alias("p_rare"), "p_retailprice", "p_name")
    reg = spark.createDataFrame(
        [("p_rare", 1, []), ("p_retailprice", 1, []), ("p_gone", 1, []), ("p_name", 1, ["given"])],
        "feature_name string, allowed_in_scan int, block_reasons array<string>",
    )
    out = registry.filter_by_data(reg, data, ["p_rare", "p_retailprice", "p_gone", "p_name"])
    return out.select("feature_name", "allowed_in_scan", F.array_join("block_reasons", "|").alias("block_reasons"))


@query("registry_names", """
SELECT DISTINCT CASE WHEN s = 'metadata_extension' THEN 'ext__' || n WHEN s = 'phase_a_model_input' THEN 'pa__' || n ELSE n END AS feature_name, allowed AS allowed_in_scan FROM (
  SELECT lower(p_type) AS n, CASE p_size % 3 WHEN 0 THEN 'metadata_extension' WHEN 1 THEN 'phase_a_model_input' ELSE 'dyad_base' END AS s, CAST(p_size % 2 AS INTEGER) AS allowed FROM part)""")
def registry_names(spark, sf):
    part = w.table(spark, sf, "part").select(
        F.lower("p_type").alias("feature_name"),
        F.when(F.col("p_size") % 3 == 0, "metadata_extension").when(F.col("p_size") % 3 == 1, "phase_a_model_input").otherwise("dyad_base").alias("data_source"),
        (F.col("p_size") % 2).cast("string").alias("allowed_in_scan"),
    ).distinct()
    return registry.normalise_names(part).select("feature_name", "allowed_in_scan").distinct()


@query("family_dedupe", sql(CHOICES, _variation_sql(("l_quantity", "l_tax", "pa__p_size", "ext__s_acctbal")) + """
, reg AS (SELECT feature_name AS base, feature_name, sv, sn FROM vm UNION ALL SELECT feature_name, 'expr__sq__' || feature_name, sv, sn FROM vm),
s AS (SELECT *, base AS sig FROM reg WHERE base LIKE '%\\_\\_%' ESCAPE '\\' UNION ALL SELECT *, feature_name AS sig FROM reg WHERE base NOT LIKE '%\\_\\_%' ESCAPE '\\'),
o AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY CAST(starts_with(feature_name, 'expr__') AS INTEGER), round(sv, 6) DESC, round(sn, 6) DESC, length(feature_name), feature_name) AS rn FROM s)
SELECT feature_name, sig AS family_signature, CAST(rn = 1 AS INTEGER) AS allowed_in_scan, CASE WHEN rn > 1 THEN 'family_deduped' ELSE '' END AS block_reasons FROM o"""))
def family_dedupe(spark, sf):
    cols = ("l_quantity", "l_tax", "pa__p_size", "ext__s_acctbal")
    base = registry.variation_metrics(w.choices(spark, sf), {c: F.col(c) for c in cols})
    names_of = F.explode(F.array(F.col("feature_name"), F.concat(F.lit("expr__sq__"), "feature_name")))
    reg = base.select(
        names_of.alias("feature_name"), F.round("share_variation", 6).alias("share_events_with_variation"),
        F.round("share_nonmissing", 6).alias("share_events_nonmissing"), F.lit(1).alias("allowed_in_scan"),
        F.array().cast("array<string>").alias("block_reasons"),
    )
    out = registry.family_dedupe(reg, "atom")
    return out.select("feature_name", "family_signature", "allowed_in_scan", F.array_join("block_reasons", "|").alias("block_reasons"))


EXPR_BASES = ("l_quantity", "l_tax", "pa__p_size")


@query("expression_features", sql(CHOICES, """
, x AS (SELECT event_id, l_quantity q, l_tax t, pa__p_size s FROM choices),
e AS (SELECT event_id, sign(q)*ln(1+abs(q)) AS e0, q*q AS e1, sign(t)*ln(1+abs(t)) AS e2, t*t AS e3,
   q / CASE WHEN abs(t) > 1e-12 THEN t END AS e4, q - t AS e5, q * t AS e6, q / CASE WHEN abs(s) > 1e-12 THEN s END AS e7, t - s AS e8 FROM x),
two AS (SELECT event_id, """ + ", ".join(f"count(e{i}) AS k{i}, min(e{i}) AS a{i}, max(e{i}) AS b{i}" for i in range(9)) + """ FROM e GROUP BY event_id HAVING count(*) = 2),
rows_ AS (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature_name, (SELECT count(e{i}) FROM e) AS nonmissing_count, count(*) FILTER (k{i} = 2 AND a{i} <> b{i}) AS n_events_with_variation, "
    f"round(count(*) FILTER (k{i} = 2)::DOUBLE / count(*), 6) AS share_events_nonmissing, (SELECT round(sum(e{i}), 4) FROM e) AS value_sum, "
    f"(SELECT round(min(e{i}), 9) FROM e) AS value_min, (SELECT round(max(e{i}), 6) FROM e) AS value_max FROM two"
    for i, n in enumerate(("expr__slog1p__l_quantity", "expr__sq__l_quantity", "expr__slog1p__l_tax", "expr__sq__l_tax",
                           "expr__ratio__l_quantity__over__l_tax", "expr__diff__l_quantity__minus__l_tax", "expr__mul__l_quantity__x__l_tax",
                           "expr__ratio__l_quantity__over__pa__p_size", "expr__diff__l_tax__minus__pa__p_size"))
) + ") SELECT * FROM rows_"))
def expression_features(spark, sf):
    df = w.choices(spark, sf)
    plan = {e.name: e.column() for e in derive.plan_expressions(EXPR_BASES, "ms_benchmark_lite")}
    wanted = [n for n in plan if n.startswith(("expr__slog1p__l_", "expr__sq__l_")) or n in (
        "expr__ratio__l_quantity__over__l_tax", "expr__diff__l_quantity__minus__l_tax", "expr__mul__l_quantity__x__l_tax",
        "expr__ratio__l_quantity__over__pa__p_size", "expr__diff__l_tax__minus__pa__p_size")]
    chosen = {n: plan[n] for n in wanted}
    counts = derive.vector_stats(df, chosen, F.xxhash64("event_id")).select("feature_name", "nonmissing_count")
    metrics = registry.variation_metrics(df, chosen)
    values = derive.add_expressions(df, [e for e in derive.plan_expressions(EXPR_BASES, "ms_benchmark_lite") if e.name in chosen]).agg(
        F.array(*[
            F.struct(F.lit(n).alias("feature_name"), F.round(F.sum(n), 4).alias("value_sum"), F.round(F.min(n), 9).alias("value_min"), F.round(F.max(n), 6).alias("value_max"))
            for n in chosen
        ]).alias("cells")
    ).select(F.inline("cells"))
    return counts.join(metrics, "feature_name").join(values, "feature_name").select(
        "feature_name", "nonmissing_count", "n_events_with_variation", F.round("share_nonmissing", 6).alias("share_events_nonmissing"),
        "value_sum", "value_min", "value_max",
    )


@query("expression_registry")
def expression_registry(spark, sf):
    df = w.choices(spark, sf).withColumn("l_copy", F.col("l_quantity"))
    row_id = F.xxhash64("event_id", "l_extendedprice", "l_discount", "recency_years_alt", "pa__p_retailprice", "ext__s_acctbal")
    return derive.expression_registry(df, [*EXPR_BASES, "l_copy"], row_id=row_id, max_pairs=4, max_new_features=10)


@query("onehot_features", sql(CHOICES, """
, lev AS (SELECT pa__p_type AS level, count(*) AS n FROM choices WHERE split_role = 'discovery' GROUP BY 1 HAVING count(*) >= 20 ORDER BY n DESC, level LIMIT 4),
full_ AS (SELECT pa__p_type AS level, count(*) AS positives FROM choices GROUP BY 1),
two AS (SELECT event_id, min(pa__p_type) AS a, max(pa__p_type) AS b FROM choices WHERE split_role = 'discovery' GROUP BY event_id HAVING count(*) = 2),
m AS (SELECT level, (SELECT count(*) FROM two) AS n_two, (SELECT count(*) FROM two WHERE a <> b AND (a = level OR b = level)) AS nv FROM lev)
SELECT 'cat__pa__p_type__' || lower(level) || '_h' || substr(sha256(level), 1, 8) AS feature_name, level AS categorical_level_value,
       n AS categorical_level_count, positives, n_two AS n_two_alt_events, nv AS n_events_with_variation,
       round(nv::DOUBLE / n_two, 6) AS share_events_with_variation, CAST(nv::DOUBLE / n_two >= 0.1 AS INTEGER) AS allowed_in_scan
FROM lev JOIN full_ USING (level) JOIN m USING (level)"""))
def onehot_features(spark, sf):
    df = w.choices(spark, sf)
    out = derive.onehot_registry(df.where("split_role = 'discovery'"), df, "pa__p_type", max_levels=4)
    return out.select(
        "feature_name", "categorical_level_value", "categorical_level_count", "positives", "n_two_alt_events", "n_events_with_variation",
        "share_events_with_variation", "allowed_in_scan",
    )


@query("clean_levels", """
SELECT level, count(*) AS n FROM (SELECT CASE WHEN lower(trim(t)) IN ('', 'na', 'nan', 'none', 'null') THEN NULL ELSE trim(t) END AS level FROM (
  SELECT CASE event_type WHEN 'view' THEN '  None ' WHEN 'click' THEN ' Click' WHEN 'error' THEN '' ELSE event_type END AS t FROM events)) GROUP BY 1""")
def clean_levels(spark, sf):
    kind = F.col("event_type")
    raw = w.table(spark, sf, "events").select(
        F.when(kind == "view", "  None ").when(kind == "click", " Click").when(kind == "error", "").otherwise(kind).alias("t")
    )
    return raw.groupBy(names.clean_level(F.col("t")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


ATOM_NAMES = """
SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'pa__' || lower(p_type) || '__x__ext__' || lower(replace(p_brand, '#', '_'))
  WHEN 1 THEN 'expr__ratio__pa__' || lower(p_type) || '__over__' || lower(replace(p_brand, '#', '_'))
  WHEN 2 THEN 'cat__pa_' || lower(p_type) || '__' || lower(replace(p_brand, '#', '_')) WHEN 3 THEN 'log_pub_year_alt_' || lower(p_type) ELSE lower(p_type) END AS f FROM part"""


@query("feature_atoms", f"""
WITH n AS ({ATOM_NAMES}),
b AS (SELECT f, str_split(f, '__') AS p, list_distinct(regexp_extract_all(f, '(?:pa|ext)__[a-zA-Z0-9_]+')) AS t FROM n),
s AS (SELECT f, t, p, list_filter([CASE WHEN p[i] IN ('pa', 'ext') THEN p[i] || '__' || p[i + 1] END FOR i IN range(1, len(p))], lambda x: x IS NOT NULL) AS pairs FROM b)
SELECT f AS feature_name,
  CASE WHEN len(pairs) > 0 THEN array_to_string(list_sort(pairs), '|') WHEN f LIKE '%pub_year_alt%' THEN 'pub_year_alt' ELSE f END AS shortlist_atoms,
  CASE WHEN starts_with(f, 'cat__') THEN p[2] WHEN len(t) > 0 THEN array_to_string(list_sort(t), '|') WHEN f LIKE '%pub_year_alt%' THEN 'pub_year_alt' ELSE f END AS lineage_atoms,
  CASE WHEN starts_with(f, 'cat__') THEN regexp_extract(f, '^cat__(.*)__.*$', 1)
       WHEN starts_with(f, 'expr__ratio__') THEN array_to_string(list_sort([str_split(f[14:], '__over__')[1], str_split(f[14:], '__over__')[2]]), '|') ELSE f END AS contribution_atoms
FROM s""")
def feature_atoms(spark, sf):
    kind, brand = F.lower("p_type"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    r = F.col("p_size") % 5
    f = (
        F.when(r == 0, F.concat(F.lit("pa__"), kind, F.lit("__x__ext__"), brand))
        .when(r == 1, F.concat(F.lit("expr__ratio__pa__"), kind, F.lit("__over__"), brand))
        .when(r == 2, F.concat(F.lit("cat__pa_"), kind, F.lit("__"), brand))
        .when(r == 3, F.concat(F.lit("log_pub_year_alt_"), kind))
        .otherwise(kind)
    )
    found = w.table(spark, sf, "part").select(f.alias("feature_name")).distinct()
    name = F.col("feature_name")
    return found.select(
        name,
        names.signature(names.shortlist_atoms(name)).alias("shortlist_atoms"),
        names.signature(names.lineage_atoms(name)).alias("lineage_atoms"),
        names.signature(names.contribution_atoms(name)).alias("contribution_atoms"),
    )


POOL_VIEWS = CHOICES + """,
tracks AS (SELECT DISTINCT track FROM choices),
ctx AS (SELECT * FROM (VALUES (0, 'all_contexts', 'y_all'), (1, 'again', 'y_all')) v(c, scope, y)),
specs AS (SELECT * FROM (VALUES (0, 'clogit_key_only', []::VARCHAR[]), (1, 'clogit_key_plus_base_controls', ['recency_years_alt'])) v(s, spec, controls)),
feats AS (SELECT * FROM (VALUES (0, 'l_quantity'), (1, 'l_tax'), (2, 'recency_years_alt')) v(f, feature)),
pool AS (SELECT track, scope, y, spec, feature, c, s, f,
   CASE WHEN list_contains(controls, feature) THEN [feature] ELSE list_concat([feature], controls) END AS exog FROM tracks, ctx, specs, feats),
named AS (SELECT *, track || '|' || scope || '|' || y || '|' || spec AS family,
   sha256(track || '|' || scope || '|' || y || '|' || array_to_string(list_sort(exog), ',')) AS eq,
   row_number() OVER (ORDER BY track, c, s, f) AS plan_order FROM pool)
"""
POOL_CONTEXTS = (("all_contexts", "y_all"), ("again", "y_all"))
POOL_FEATURES = ("l_quantity", "l_tax", "recency_years_alt")


def _pool(spark, sf):
    df = w.choices(spark, sf)
    controls = Controls(base=("recency_years_alt",))
    specs = cand.control_specs(controls, df.columns)
    return cand.candidate_pool(df.select("track").distinct(), POOL_CONTEXTS, specs, POOL_FEATURES)


@query("candidate_pool", sql(POOL_VIEWS, """
SELECT CAST(plan_order AS INTEGER) AS plan_order, family || '|' || feature AS candidate_id, family AS fdr_family_id,
       array_to_string(exog, '+') AS control_set, eq AS equivalence_hash,
       20260219 + CAST(('0x' || substr(sha256(family || '|' || feature || '|discovery'), 1, 8))::BIGINT % 1000000 AS BIGINT) AS discovery_seed FROM named"""))
def candidate_pool(spark, sf):
    seed = hashing.stable_seed(20260219, F.concat_ws("|", "candidate_id", F.lit("discovery")))
    return _pool(spark, sf).select("plan_order", "candidate_id", "fdr_family_id", "control_set", "equivalence_hash", seed.alias("discovery_seed"))


@query("equivalent_spec_skips", sql(POOL_VIEWS, """
, d AS (SELECT *, family || '|' || feature AS cid, first_value(family || '|' || feature) OVER (PARTITION BY eq ORDER BY plan_order) AS first_cid,
        row_number() OVER (PARTITION BY eq ORDER BY plan_order) AS rn FROM named)
SELECT cid AS candidate_id, first_cid AS duplicate_of FROM d WHERE rn > 1"""))
def equivalent_spec_skips(spark, sf):
    return cand.mark_equivalents(_pool(spark, sf)).where("duplicate_of is not null").select("candidate_id", "duplicate_of")


@query("evaluation_order", sql(POOL_VIEWS, """
, r AS (SELECT family || '|' || feature AS candidate_id, role AS split_role, plan_order FROM named, (VALUES ('discovery'), ('validation')) v(role))
SELECT candidate_id, split_role, CAST(row_number() OVER (ORDER BY split_role, plan_order) AS INTEGER) AS candidate_eval_order FROM r"""))
def evaluation_order(spark, sf):
    return cand.evaluation_order(_pool(spark, sf)).select("candidate_id", "split_role", "candidate_eval_order")


@query("context_validation", """
SELECT CAST(p AS INTEGER) AS position, s AS context_scope, y AS y_col,
   CASE WHEN s = '' OR y = '' THEN 'invalid_context_definition' WHEN row_number() OVER (PARTITION BY s, y ORDER BY p) > 1 THEN 'duplicate_context_definition'
        WHEN y NOT IN ('view', 'click') THEN 'missing_context_y_column' ELSE '' END AS skip_reason
FROM (SELECT event_id AS p, CASE user_id % 4 WHEN 0 THEN '' ELSE 'c' || CAST(user_id % 4 AS VARCHAR) END AS s, event_type AS y FROM events)""")
def context_validation(spark, sf):
    e = w.table(spark, sf, "events").select(
        F.col("event_id").cast("int").alias("position"),
        F.when(F.col("user_id") % 4 == 0, " ").otherwise(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string"))).alias("context_scope"),
        F.col("event_type").alias("y_col"),
    )
    return cand.validate_contexts(e, ["view", "click"])


DISCOVERY_CAP = CHOICE_WINDOWS + """,
long AS (SELECT track, event_id, policy_document_id, 'y_all' AS y_col, y_all AS y FROM windowed WHERE split_role = 'discovery'
  UNION ALL SELECT track, event_id, policy_document_id, 'y_1y', y_1y FROM windowed WHERE split_role = 'discovery'),
ev AS (SELECT y_col, track, event_id, min(policy_document_id) AS doc, sum(y) AS y FROM long GROUP BY ALL HAVING count(*) = 2),
cap AS (SELECT track, y_col, count(*) FILTER (y = 1) AS e, count(DISTINCT doc) FILTER (y = 1) AS d FROM ev GROUP BY ALL)
"""


@query("infeasible_track_outcomes", sql(DISCOVERY_CAP, """
SELECT track, y_col, 'discovery_gate_infeasible_for_track_y' AS reason_code,
   concat_ws('; ', CASE WHEN e < 300 THEN 'events ' || e || ' < gate 300' END, CASE WHEN d < 150 THEN 'policy_docs ' || d || ' < gate 150' END) AS reason_detail
FROM cap WHERE e < 300 OR d < 150"""))
def infeasible_track_outcomes(spark, sf):
    return cand.infeasible_track_outcomes(discovery_capacity(w.wide_choices(spark, sf), ("y_all", "y_1y")), 300, 150)


@query("disabled_control_specs", sql(DISCOVERY_CAP, """
SELECT track, y_col, 'clogit_key_plus_base_controls' AS spec_id, 'disabled_base_controls_low_discovery_capacity' AS reason_code,
   'events ' || e || ' < 300 or policy_docs ' || d || ' < 150' AS reason_detail FROM cap WHERE e < 300 OR d < 150"""))
def disabled_control_specs(spark, sf):
    settings = ScanSettings.of(per_regressor=Need(100, 50))
    need = cand.base_control_needs(settings, 2)
    return cand.disabled_control_specs(discovery_capacity(w.wide_choices(spark, sf), ("y_all", "y_1y")), cand.PLUS_BASE, *need)


@query("complexity_penalty", sql(CHOICES, """
, n AS (SELECT count(DISTINCT event_id) AS ev, count(DISTINCT track) AS t FROM choices WHERE split_role = 'discovery'),
p AS (SELECT t * 8 * 5 * 2 AS pool, ev FROM n)
SELECT pool AS candidate_pool_size, ev AS n_events_discovery,
       round(least(greatest(0.01::DOUBLE * (1 + least(3.0::DOUBLE, ln(1 + pool::DOUBLE / greatest(ev, 1)))), 0.005::DOUBLE), 0.05::DOUBLE), 8) AS complexity_penalty FROM p"""))
def complexity_penalty(spark, sf):
    d = w.choices(spark, sf).where("split_role = 'discovery'").agg(
        F.count_distinct("event_id").alias("n_events_discovery"), F.count_distinct("track").alias("t")
    )
    pool = F.col("t") * cand.pool_size_estimate(8, 1, 5, True)
    lam = cand.complexity_penalty(F.lit(0.01), pool, F.col("n_events_discovery"), 0.005, 0.05)
    return d.select(pool.alias("candidate_pool_size"), "n_events_discovery", F.round(lam, 8).alias("complexity_penalty"))


DESIGN_VIEWS = CHOICES + """,
d0 AS (SELECT 0 AS design_id, track, split_role, event_id, policy_document_id AS doc, y_all AS y, l_quantity AS k, NULL::DOUBLE AS c FROM choices WHERE l_quantity IS NOT NULL),
d1 AS (SELECT 1 AS design_id, track, split_role, event_id, policy_document_id AS doc, y_all AS y, x_nullable AS k, recency_years_alt AS c FROM choices WHERE x_nullable IS NOT NULL AND recency_years_alt IS NOT NULL),
u AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1),
pairs AS (SELECT design_id, track, split_role, event_id, min(doc) AS doc, max(k) FILTER (y = 1) AS kp, max(k) FILTER (y = 0) AS kn,
             max(c) FILTER (y = 1) AS cp, max(c) FILTER (y = 0) AS cn FROM u GROUP BY ALL HAVING count(*) = 2 AND sum(y) = 1),
used AS (SELECT * FROM pairs WHERE kp <> kn)
"""
TWO_DESIGNS = designs.DesignSet((designs.Design(0, "y_all", ("l_quantity",)), designs.Design(1, "y_all", ("x_nullable", "recency_years_alt"))))


def _long(spark, sf):
    rows, ev = _folded(spark, sf)
    return designs.design_pairs(rows, ev, TWO_DESIGNS)


def _folded(spark, sf):
    rows = designs.row_table(w.choices(spark, sf), TWO_DESIGNS)
    events = cut_lineage(designs.event_table(rows, TWO_DESIGNS))
    return cut_lineage(designs.pattern_table(rows, TWO_DESIGNS)), events


@query("event_differences", sql(DESIGN_VIEWS, """
SELECT design_id, track, split_role, event_id, doc, round(kp - kn, 6) AS d_key, round(cp - cn, 6) AS d_control FROM used"""))
def event_differences(spark, sf):
    long = designs.differences(_long(spark, sf))
    return long.select(
        "design_id", "track", "split_role", "event_id", "doc", F.round(F.col("d")[0], 6).alias("d_key"), F.round(F.get("d", F.lit(1)), 6).alias("d_control")
    )


@query("design_statistics", sql(DESIGN_VIEWS, """
, per AS (SELECT design_id, track, split_role, doc, count(*) AS n FROM used GROUP BY ALL)
SELECT design_id, track, split_role, CAST(sum(n) AS BIGINT) AS n_informative, count(*) AS n_docs, round(max(n)::DOUBLE / sum(n)::DOUBLE, 6) AS top1_share FROM per GROUP BY ALL"""))
def design_statistics(spark, sf):
    return designs.gate_stats(*_folded(spark, sf), TWO_DESIGNS).withColumn("top1_share", F.round("top1_share", 6))


@query("gate_cascade", sql(DESIGN_VIEWS, """
, per AS (SELECT design_id, track, split_role, doc, count(*) AS n FROM used GROUP BY ALL),
st AS (SELECT design_id, track, split_role, sum(n) AS n, count(*) AS docs, max(n)::DOUBLE / sum(n)::DOUBLE AS top1 FROM per GROUP BY ALL),
tot AS (SELECT track, split_role, count(DISTINCT policy_document_id) AS all_docs FROM choices GROUP BY ALL),
g AS (SELECT *, split_role = 'validation' AS v, CASE WHEN split_role = 'validation' THEN 100 ELSE 20 END AS ge, CASE WHEN split_role = 'validation' THEN 30 ELSE 10 END AS gd FROM st JOIN tot USING (track, split_role))
SELECT design_id, track, split_role,
  CASE WHEN v AND all_docs < gd THEN 'not_validated_out_of_sample' WHEN n < ge THEN CASE WHEN v THEN 'not_validated_out_of_sample' ELSE 'not_estimable_low_events' END
       WHEN docs < gd THEN CASE WHEN v THEN 'not_validated_out_of_sample' ELSE 'not_estimable_low_policy_doc_clusters' END
       WHEN top1 > 0.016 THEN CASE WHEN v THEN 'not_validated_out_of_sample' ELSE 'not_estimable_high_policy_doc_concentration' END ELSE 'fit' END AS status,
  CASE WHEN v AND all_docs < gd THEN 'validation_gate_infeasible_policy_docs' WHEN n < ge THEN CASE WHEN v THEN 'validation_low_informative_events' ELSE 'not_estimable_low_events' END
       WHEN docs < gd THEN CASE WHEN v THEN 'validation_low_policy_doc_clusters' ELSE 'not_estimable_low_policy_doc_clusters' END
       WHEN top1 > 0.016 THEN CASE WHEN v THEN 'validation_high_policy_doc_concentration' ELSE 'not_estimable_high_policy_doc_concentration' END ELSE 'fit' END AS reason_code,
  CASE WHEN v AND all_docs < gd THEN 'max_docs_possible=' || all_docs || ' < gate=' || gd WHEN n < ge THEN CAST(n AS BIGINT) || ' < ' || ge WHEN docs < gd THEN docs || ' < ' || gd
       WHEN top1 > 0.016 THEN printf('%.4f > %.4f', top1, 0.016::DOUBLE) ELSE '' END AS reason_detail
FROM g"""))
def gate_cascade(spark, sf):
    rows, ev = _folded(spark, sf)
    stats = designs.gate_stats(rows, ev, TWO_DESIGNS)
    full = stats.join(designs.sample_totals(ev), ["track", "split_role"]).withColumn("y_col", F.lit("y_all"))
    out = gates.gate_cascade(full, Gates(largest_document_share=0.016))
    return out.select("design_id", "track", "split_role", "status", "reason_code", "reason_detail")


@query("logit_gradient_at_zero", sql(DESIGN_VIEWS, """
SELECT design_id, track, split_role, count(*) AS n_events, round(sum(0.5::DOUBLE * (kp - kn)), 6) AS gradient,
       round(sum(0.25::DOUBLE * (kp - kn) * (kp - kn)), 6) AS curvature, round(count(*) * ln(0.5::DOUBLE), 6) AS llf FROM used GROUP BY ALL"""))
def logit_gradient_at_zero(spark, sf):
    d = F.col("d")[0]
    return designs.differences(_long(spark, sf)).groupBy("design_id", "track", "split_role").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.round(F.sum(F.lit(0.5) * d), 6).alias("gradient"),
        F.round(F.sum(F.lit(0.25) * d * d), 6).alias("curvature"),
        F.round(F.count(F.lit(1)) * F.log(F.lit(0.5)), 6).alias("llf"),
    )


@query("standardised_regressors", sql(DESIGN_VIEWS, """
, lv AS (SELECT design_id, track, split_role, kp AS k FROM used UNION ALL SELECT design_id, track, split_role, kn FROM used)
SELECT design_id, track, split_role, round(avg(k), 9) AS shift, round(stddev_pop(k), 9) AS scale, CAST(count(DISTINCT k) > 2 AS INTEGER) AS more FROM lv GROUP BY ALL"""))
def standardised_regressors(spark, sf):
    level = F.explode(F.array(F.col("chosen")[0], F.col("other")[0])).alias("k")
    return _long(spark, sf).select("design_id", "track", "split_role", level).groupBy("design_id", "track", "split_role").agg(
        F.round(F.avg("k"), 9).alias("shift"), F.round(F.stddev_pop("k"), 9).alias("scale"), (F.count_distinct("k") > 2).cast("int").alias("more")
    )


@query("event_accuracy", sql(CHOICES, """
, p AS (SELECT event_id, max(l_quantity) FILTER (y_all = 1) AS a, max(l_quantity) FILTER (y_all = 0) AS b, max(l_tax) FILTER (y_all = 1) AS ta, max(l_tax) FILTER (y_all = 0) AS tb
        FROM choices GROUP BY event_id HAVING count(*) = 2 AND sum(y_all) = 1)
SELECT count(*) AS n_events, round(avg(CASE WHEN a = b THEN CAST(ta <= tb AS DOUBLE) ELSE CAST(a > b AS DOUBLE) END), 6) AS accuracy FROM p"""))
def event_accuracy(spark, sf):
    from dyadscope.operators.equation import event_accuracy as accuracy

    one = designs.DesignSet((designs.Design(0, "y_all", ("l_quantity",)),))
    data = w.choices(spark, sf).withColumn("_all", F.lit("all"))
    rows = designs.row_table(data, one, keys=("_all",), order="l_tax")
    long = designs.design_pairs(rows, designs.event_table(rows, one, ("_all",)), one, keys=("_all",), require_variation=False, sparse=False)
    out = accuracy(long, F.col("chosen")[0] - F.col("other")[0])
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("table_fingerprint")
def table_fingerprint(spark, sf):
    return hashing.table_fingerprint(w.choices(spark, sf))


@query("capped_registry", sql(CHOICES, _variation_sql(LINE_PRETREATMENT) + "SELECT feature_name, n_events_with_variation FROM vm ORDER BY feature_name LIMIT 5"))
def capped_registry(spark, sf):
    out = registry.variation_metrics(w.choices(spark, sf), {c: F.col(c) for c in LINE_PRETREATMENT})
    return registry.cap_features(out, 5).select("feature_name", "n_events_with_variation")


@query("distinct_tracks_docs", sql(CHOICES, "SELECT track, count(DISTINCT policy_document_id) AS n_docs FROM choices GROUP BY 1"))
def distinct_tracks_docs(spark, sf):
    docs = w.choices(spark, sf).select("track", "policy_document_id").distinct()
    return docs.groupBy("track").agg(F.count(F.lit(1)).alias("n_docs"))


@query("frequent_levels", """
SELECT p_brand AS level, count(*) AS level_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 20 ORDER BY 2 DESC, 1 LIMIT 7""")
def frequent_levels(spark, sf):
    joined = w.table(spark, sf, "lineitem").select("l_partkey").join(w.table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return derive.frequent_levels(joined, "p_brand", min_count=20, max_levels=7)


@query("restart_seeds", sql(POOL_VIEWS, """
, r AS (SELECT unnest([1, 2, 3]) AS restart_id)
SELECT CAST(restart_id AS INTEGER) AS restart_id, family || '|' || feature AS candidate_id,
   20260219 + (restart_id - 1) * 1009 + CAST(('0x' || substr(sha256(family || '|' || feature || '|validation'), 1, 8))::BIGINT % 1000000 AS BIGINT) AS seed FROM named, r"""))
def restart_seeds(spark, sf):
    pairs = Draws(restarts=3).restart_seeds()
    seeds = F.inline(F.array(*[F.struct(F.lit(i).alias("restart_id"), F.lit(b).cast("bigint").alias("base")) for i, b in pairs]))
    rows = _pool(spark, sf).select("candidate_id", seeds)
    return rows.select("restart_id", "candidate_id", hashing.stable_seed(F.col("base"), F.concat_ws("|", "candidate_id", F.lit("validation"))).alias("seed"))
