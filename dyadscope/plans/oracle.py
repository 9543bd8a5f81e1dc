"""Reference SQL for the registered queries: shared views as WITH clauses."""

from __future__ import annotations

ROLE = (
    "CASE WHEN (('0x' || substr(sha256('20260219|' || CAST({0} AS VARCHAR)), 1, 12))::BIGINT / power(16.0::DOUBLE, 12)) < 0.8 "
    "THEN 'discovery' ELSE 'validation' END"
)

CHOICES = f"""
choices AS (
  SELECT CASE WHEN n_regionkey <= 2 THEN 'primary_strict' ELSE 'sensitivity_broad' END AS track,
         CAST(l_orderkey AS VARCHAR) AS event_id, CAST(l_orderkey AS VARCHAR) AS pair_id,
         CAST(o_custkey AS VARCHAR) AS policy_document_id,
         {ROLE.format('o_custkey')} AS split_role,
         CAST(l_returnflag = 'R' AS INTEGER) AS y_all,
         CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) / CAST(365.25 AS DOUBLE) AS recency_years_alt,
         l_quantity, l_extendedprice, l_discount, l_tax,
         CASE WHEN l_tax > 0.01 THEN l_discount END AS x_nullable,
         CAST(p_size AS DOUBLE) AS pa__p_size, p_retailprice AS pa__p_retailprice, p_type AS pa__p_type,
         s_acctbal AS ext__s_acctbal
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""

WINDOWS = """
windowed AS (
  SELECT *, CAST(y_all = 1 AND recency_years_alt BETWEEN 0 AND 1 AS INTEGER) AS y_1y,
            CAST(y_all = 1 AND recency_years_alt BETWEEN 0 AND 3 AS INTEGER) AS y_3y,
            CAST(y_all = 1 AND recency_years_alt BETWEEN 0 AND 5 AS INTEGER) AS y_5y
  FROM choices
)"""

LINES = f"""
lines AS (
  SELECT CASE WHEN n_regionkey <= 2 THEN 'primary_strict' ELSE 'sensitivity_broad' END AS track,
         {ROLE.format('o_custkey')} AS split_role,
         CASE WHEN l_linestatus = 'O' THEN 'all_contexts' ELSE 'within_window' END AS context_scope,
         CASE WHEN l_linestatus = 'O' THEN 'y_all' ELSE 'y_5y' END AS y_col,
         'spec_' || lower(l_returnflag) AS spec_id,
         CASE p_size % 4 WHEN 0 THEN 'pa__' || lower(p_type)
              WHEN 1 THEN 'ext__' || lower(replace(p_brand, '#', '_'))
              WHEN 2 THEN 'expr__sq__pa__' || lower(p_type)
              ELSE 'expr__ratio__pa__' || lower(p_type) || '__over__ext__' || lower(replace(p_brand, '#', '_')) END AS key_factor,
         l_suppkey, l_partkey, l_linenumber, CAST(l_quantity AS BIGINT) AS qty, l_tax,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
)"""

SCAN = f"""{LINES},
folded AS (
  SELECT track, split_role, CAST(l_suppkey % 5 + 1 AS INTEGER) AS restart_id, context_scope, y_col, spec_id, key_factor,
         CAST(sum(qty) AS BIGINT) AS s
  FROM lines GROUP BY ALL
),
scan AS (
  SELECT * EXCLUDE (s), key_factor AS control_set,
         concat_ws('|', track, context_scope, y_col, spec_id) AS fdr_family_id,
         concat_ws('|', track, context_scope, y_col, spec_id, key_factor) AS candidate_id,
         CASE WHEN s % 7 <> 0 THEN 'ok' ELSE 'not_estimable_low_events' END AS status,
         CASE WHEN s % 7 <> 0 THEN CAST((s % 97) * (s % 97) + 1 AS DOUBLE) / 9500.0::DOUBLE END AS p_boot,
         CASE WHEN s % 7 <> 0 THEN CAST(s % 201 - 100 AS DOUBLE) / 50.0::DOUBLE END AS beta,
         CASE WHEN s % 7 <> 0 THEN CAST(-(s % 1000) AS DOUBLE) / 10.0::DOUBLE END AS score
  FROM folded
)"""

def top_views(scan: str = "scan", tag: str = "") -> str:
    """Views from scan rows to `top`: q values, both splits side by side, tiers; `tag` ends their names."""
    return f"""
counted{tag} AS (SELECT * FROM {scan} WHERE split_role = 'validation' AND status = 'ok'),
ranked{tag} AS (
  SELECT *, p_boot * count(*) OVER (PARTITION BY restart_id, fdr_family_id)
            / count(*) OVER (PARTITION BY restart_id, fdr_family_id ORDER BY p_boot RANGE UNBOUNDED PRECEDING) AS raw
  FROM counted{tag}
),
q{tag} AS (
  SELECT restart_id, candidate_id, least(1.0::DOUBLE, min(raw) OVER (
           PARTITION BY restart_id, fdr_family_id ORDER BY p_boot DESC RANGE UNBOUNDED PRECEDING)) AS q_value
  FROM ranked{tag}
),
paired{tag} AS (
  SELECT restart_id, candidate_id, min(track) AS track, min(context_scope) AS context_scope, min(y_col) AS y_col,
         min(spec_id) AS spec_id, min(key_factor) AS key_factor, min(control_set) AS control_set,
         min(fdr_family_id) AS fdr_family_id,
         max(status) FILTER (split_role = 'discovery') AS status_discovery,
         max(status) FILTER (split_role = 'validation') AS status_validation,
         max(p_boot) FILTER (split_role = 'discovery') AS p_boot_discovery,
         max(p_boot) FILTER (split_role = 'validation') AS p_boot_validation,
         max(beta) FILTER (split_role = 'discovery') AS beta_discovery,
         max(beta) FILTER (split_role = 'validation') AS beta_validation,
         max(score) FILTER (split_role = 'discovery') AS score_discovery,
         max(score) FILTER (split_role = 'validation') AS score_validation
  FROM {scan} GROUP BY restart_id, candidate_id
),
judged{tag} AS (
  SELECT p.*, q.q_value AS q_value_validation,
         CAST(coalesce(status_validation = 'ok' AND p_boot_validation <= 0.05, false) AS INTEGER) AS validation_pass_p,
         CAST(coalesce(status_validation = 'ok' AND q.q_value <= 0.10, false) AS INTEGER) AS validation_pass_q
  FROM paired{tag} p LEFT JOIN q{tag} q USING (restart_id, candidate_id)
),
top{tag} AS (
  SELECT *, CASE WHEN validation_pass_p = 1 AND validation_pass_q = 1 THEN 'validated_candidate'
                 WHEN status_discovery = 'ok' THEN 'support_candidate' ELSE 'exploratory' END AS candidate_tier
  FROM judged{tag}
)"""


TOP = f"{SCAN},{top_views()}"

INFERENCE = f"""{LINES},
inference AS (
  SELECT 'r' || CAST(l_suppkey // 4 AS VARCHAR) || CASE l_suppkey % 4 WHEN 0 THEN '__nooption_baseline' WHEN 1 THEN '__singlex'
           WHEN 2 THEN '__nooption_hypothesis_panel' ELSE '__openexplore' END AS run_id,
         CASE l_suppkey % 4 WHEN 0 THEN 'nooption_baseline' WHEN 1 THEN 'singlex_baseline'
           WHEN 2 THEN 'nooption_hypothesis_panel' ELSE 'openexplore' END AS mode,
         concat_ws('|', track, context_scope, y_col, spec_id, key_factor) AS candidate_id,
         track, context_scope, y_col, spec_id, key_factor,
         CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'not_estimable_low_events' WHEN 3 THEN ' Passed' ELSE 'ok' END AS status_validation,
         CASE qty % 3 WHEN 0 THEN 'validated_candidate' WHEN 1 THEN 'support_candidate' ELSE 'exploratory' END AS candidate_tier,
         CASE WHEN l_linenumber <> 7 THEN CAST((cents % 97) * (cents % 97) + 1 AS DOUBLE) / 9500.0::DOUBLE END AS p,
         CASE WHEN l_linenumber <> 6 THEN CAST(((cents + l_partkey) % 97) * ((cents + l_partkey) % 97) + 1 AS DOUBLE) / 9500.0::DOUBLE END AS q,
         l_tax * 10 AS restart_rate
  FROM lines
),
fitted AS (
  SELECT *, candidate_tier AS tier FROM inference
  WHERE lower(trim(status_validation)) IN ('', 'ok', 'pass', 'passed', 'success')
)"""

RUNS = """
run_rows AS (
  SELECT 'run' || CAST(user_id AS VARCHAR) || CASE user_id % 3 WHEN 0 THEN '__nooption_baseline' WHEN 1 THEN '__singlex' ELSE '_openexplore' END AS run_id,
         CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'error' ELSE 'canceled' END AS status,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, event_id AS source_order, CAST(value > 20 AS INTEGER) AS has_result
  FROM events
),
entries AS (
  SELECT run_id,
         CASE status WHEN 'ok' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'canceled' THEN 'cancelled' ELSE status END AS state,
         CASE WHEN run_id LIKE '%singlex%' THEN 'singlex_baseline' WHEN run_id LIKE '%nooption%' THEN 'nooption_baseline'
              WHEN run_id LIKE '%openexplore%' THEN 'openexplore' ELSE 'nooption_baseline' END AS mode,
         updated_at, has_result
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, source_order DESC) AS rn FROM run_rows)
  WHERE rn = 1
)"""


def sql(views: str, select: str) -> str:
    return f"WITH {views.strip()}\n{select.strip()}"
