"""SQL that gives the rows of a key-only scan: gates, Newton fits, and p values of the bootstrap.

With one regressor the likelihood is concave, so the sign of a replicate's coefficient is the sign of its gradient
at 0; p values count signs and need no iterations. Point fits take Newton steps.
"""

from __future__ import annotations

from dyadscope.operators.fit import POISSON_CDF
from dyadscope.plans.oracle import CHOICES

MOD = "18446744073709551616::UHUGEINT"
SAMPLE = "key_factor, track, split_role"


def mix64_sql(x: str, name: str) -> str:
    """Lateral columns `name`_0.. and `name`: the finaliser that the replicate weights use, on 64-bit numbers."""
    return (
        f"((({x})::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT) % {MOD})::UBIGINT AS {name}_0, "
        f"((xor({name}_0, {name}_0 >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT) % {MOD})::UBIGINT AS {name}_1, "
        f"((xor({name}_1, {name}_1 >> 27)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT) % {MOD})::UBIGINT AS {name}_2, xor({name}_2, {name}_2 >> 31) AS {name}"
    )


def sample_views(features) -> list[str]:
    """Usable events of every sample, its sizes, and standardised differences z."""
    pairs = " UNION ALL ".join(
        f"SELECT '{f}' AS key_factor, track, split_role, event_id, any_value(policy_document_id) AS doc, max({f}) FILTER (y_all = 1) AS xp, max({f}) FILTER (y_all = 0) AS xn "
        f"FROM choices WHERE {f} IS NOT NULL GROUP BY track, split_role, event_id HAVING count(*) = 2 AND sum(y_all) = 1 AND min({f}) <> max({f})"
        for f in features
    )
    return [
        f"pairs AS ({pairs})",
        "per_doc AS (SELECT key_factor, track, split_role, doc, count(*) AS n FROM pairs GROUP BY ALL)",
        "size AS (SELECT key_factor, track, split_role, sum(n) AS n_events, count(*) AS n_docs, max(n) / sum(n) AS top1 FROM per_doc GROUP BY ALL)",
        "levels AS (SELECT key_factor, track, split_role, xp AS x FROM pairs UNION ALL SELECT key_factor, track, split_role, xn FROM pairs)",
        "spread AS (SELECT key_factor, track, split_role, CASE WHEN count(DISTINCT x) > 2 THEN stddev_pop(x) ELSE 1.0::DOUBLE END AS sd FROM levels GROUP BY ALL)",
        f"z AS (SELECT key_factor, track, split_role, doc, (xp - xn) / sd AS d FROM pairs JOIN spread USING ({SAMPLE}))",
    ]


def draw_views(n_boot: int, restarts: int = 1) -> list[str]:
    """Weights of every cluster of a sample in every replicate of every restart: `weighed` (sample, restart_id, r, doc, w)."""
    cdf = ", ".join(f"{c!r}::DOUBLE" for c in POISSON_CDF.tolist())
    named = "track || '|all_contexts|y_all|clogit_key_only|' || key_factor"
    return [
        f"ids AS (SELECT key_factor, track, split_role, restart_id, {named} AS candidate_id, "
        f"20260219 + 1009 * (restart_id - 1) + CAST(('0x' || substr(sha256({named} || '|' || split_role), 1, 8))::BIGINT % 1000000 AS BIGINT) AS seed "
        f"FROM size, (SELECT unnest(range(1, {restarts + 1}))::INT AS restart_id))",
        f"streams AS (SELECT *, {mix64_sql('seed', 's')}, {mix64_sql('xor(s, r::UBIGINT)', 't')} FROM ids, (SELECT unnest(range({n_boot})) AS r))",
        "docs AS (SELECT DISTINCT doc, ('0x' || substr(sha256(doc), 1, 15))::UBIGINT AS h FROM z)",
        f"drawn AS (SELECT key_factor, track, split_role, restart_id, r, doc, {mix64_sql('xor(h, t)', 'b')}, (b >> 11)::DOUBLE / 9007199254740992.0::DOUBLE AS u "
        f"FROM streams JOIN (SELECT key_factor, track, split_role, doc FROM per_doc) USING ({SAMPLE}) JOIN docs USING (doc))",
        f"weighed AS (SELECT key_factor, track, split_role, restart_id, r, doc, len(list_filter([{cdf}], lambda c: c <= u)) AS w FROM drawn)",
    ]


def point_views(steps: int = 25) -> list[str]:
    """`fit` (sample, beta, llf) by Newton steps."""
    views = ["b0 AS (SELECT DISTINCT key_factor, track, split_role, 0.0::DOUBLE AS beta FROM z)"]
    for i in range(steps):
        views.append(
            f"b{i + 1} AS (SELECT key_factor, track, split_role, any_value(beta) + sum(d / (1 + exp(beta * d))) / nullif(sum(d * d / ((1 + exp(beta * d)) * (1 + exp(-beta * d)))), 0) AS beta "
            f"FROM z JOIN b{i} USING ({SAMPLE}) GROUP BY ALL)"
        )
    return [*views, f"fit AS (SELECT key_factor, track, split_role, any_value(beta) AS beta, sum(-ln(1 + exp(-beta * d))) AS llf FROM z JOIN b{steps} USING ({SAMPLE}) GROUP BY {SAMPLE})"]


def p_view(name: str, n_boot: int) -> str:
    """Two-sided p of the first `n_boot` replicates of every sample and restart."""
    return (
        f"{name} AS (SELECT key_factor, track, split_role, restart_id, count(*) AS n, least(1.0::DOUBLE, 2.0::DOUBLE * least((count(*) FILTER (g <= 1e-10) + 1)::DOUBLE / (count(*) + 1), "
        f"(count(*) FILTER (g >= -1e-10) + 1)::DOUBLE / (count(*) + 1))) AS p FROM signs WHERE r < {n_boot} GROUP BY ALL)"
    )


def scan_view(name: str, p: str, events: int, docs: int, where: str = "true") -> str:
    """Scan rows as the tier views read them."""
    failed = ["n_events < {0}", "n_docs < {1}", "top1 > 0.2"]
    kinds = ("not_estimable_low_events", "not_estimable_low_policy_doc_clusters", "not_estimable_high_policy_doc_concentration")
    cases = " ".join(f"WHEN {c.format(events, docs)} THEN '{k}'" for c, k in zip(failed, kinds, strict=True))
    lost = " OR ".join([f"all_docs < {docs}", *[c.format(events, docs) for c in failed]])
    family = "track || '|all_contexts|y_all|clogit_key_only'"
    return (
        f"{name} AS (SELECT *, CASE WHEN status = 'ok' THEN p0 END AS p_boot, CASE WHEN status = 'ok' THEN b0 END AS beta, CASE WHEN status = 'ok' THEN llf - 0.01::DOUBLE END AS score FROM ("
        f"SELECT restart_id, candidate_id, split_role, track, 'all_contexts' AS context_scope, 'y_all' AS y_col, 'clogit_key_only' AS spec_id, key_factor, key_factor AS control_set, {family} AS fdr_family_id, "
        f"n_events, n_docs, p AS p0, n AS n_draws, fit.beta AS b0, llf, CASE WHEN split_role = 'validation' THEN CASE WHEN {lost} THEN 'not_validated_out_of_sample' ELSE 'ok' END ELSE CASE {cases} ELSE 'ok' END END AS status "
        f"FROM ids JOIN size USING ({SAMPLE}) JOIN totals USING (track, split_role) JOIN fit USING ({SAMPLE}) JOIN {p} USING ({SAMPLE}, restart_id)) WHERE {where})"
    )


def scan_sql(features, n_boot: int, restarts: int = 1, steps: int = 25) -> str:
    """Views up to `signs`: the gradient at 0 of every replicate, over its weight."""
    return CHOICES + ", " + ", ".join([
        *sample_views(features), *draw_views(n_boot, restarts), *point_views(steps),
        "totals AS (SELECT track, split_role, count(DISTINCT policy_document_id) AS all_docs FROM choices GROUP BY ALL)",
        "by_doc AS (SELECT key_factor, track, split_role, doc, sum(d) AS d, count(*) AS n FROM z GROUP BY ALL)",
        f"signs AS (SELECT key_factor, track, split_role, restart_id, r, sum(w * d) / sum(w * n) AS g FROM weighed JOIN by_doc USING ({SAMPLE}, doc) WHERE w > 0 GROUP BY ALL)",
    ])
