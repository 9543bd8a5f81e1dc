"""Mining stored inference rows: combinations, factors, runs, affinity, clusters, look-alikes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.functions.numeric import as_number
from dyadscope.operators.inference import SUPPORT, VALIDATED
from dyadscope.operators.selection import quantiles
from dyadscope.session import cut_lineage

COMBO = ("track", "context_scope", "y_col", "spec_id", "key_factor")
MISSING_Q = 9.99  # where a missing q stands in every ordering
# Right-closed probability bins.
PROBABILITY_BINS = (
    ("<=0.01", 0.01), ("0.01-0.05", 0.05), ("0.05-0.10", 0.10), ("0.10-0.20", 0.20), ("0.20-0.50", 0.50), ("0.50-1.00", 1.00), (">1.00", None),
)
JOINT_BINS = 10


def validation_ok(status: Column) -> Column:
    """Fitted rows; a blank status counts as fitted."""
    text = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return (text == "") | text.isin("ok", "pass", "passed", "success")


def mode_in_scope(mode: Column, scope: str) -> Column:
    m, s = F.lower(F.trim(F.coalesce(mode, F.lit("")))), scope.strip().lower()
    if s in ("", "all"):
        return F.lit(True)
    if s in ("singlex", "nooption", "paired"):
        return F.contains(m, F.lit(s))
    return m == s


def usable_rows(rows: DataFrame, *, q_threshold: float = 0.10) -> DataFrame:
    """Fitted rows with numeric p and q, normalised tier, trimmed keys and the strong flag."""
    q = as_number("q_value_validation")
    keys = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in COMBO}
    return rows.where(validation_ok(F.col("status_validation"))).select(
        "run_id",
        "mode",
        *[c.alias(n) for n, c in keys.items()],
        F.lower(F.trim(F.coalesce("candidate_tier", F.lit("")))).alias("tier"),
        as_number("p_boot_validation").alias("p"),
        q.alias("q"),
        as_number("validated_rate_restart").alias("restart_rate"),
        F.coalesce(q <= q_threshold, F.lit(False)).alias("strong"),
    )


def run_parts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mergeable statistics of a key, a row for each run: rows of one (key, run) from several tables add up."""
    return rows.groupBy(*keys, "run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("q").alias("q"),
        F.min("p").alias("p"),
        F.sum("restart_rate").alias("rate"),
        F.count("restart_rate").alias("rated"),
        F.count_if("strong").alias("strong"),
        F.count_if(F.col("tier") == VALIDATED).alias("validated"),
        F.count_if(F.col("tier").isin(VALIDATED, SUPPORT)).alias("supported"),
    )


def merged_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n", "rate", "rated", "strong", "validated", "supported")]
    return parts.groupBy(*keys, "run_id").agg(*sums, F.min("q").alias("q"), F.min("p").alias("p"))


def value_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, which, v, n): how often a key has each value of q and p; counts of several tables add up."""
    both = F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("v")) for c in "qp"])
    return rows.select(*keys, F.inline(both)).where("v is not null").groupBy(*keys, "which", "v").agg(F.count(F.lit(1)).alias("n"))


def medians_of_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = quantiles(counts.select(*keys, "n", *[F.when(F.col("which") == c, F.col("v")).alias(c) for c in "qp"]), keys, {"q": [0.5], "p": [0.5]}, weight="n")
    return found.select(*keys, *[F.get(f"{c}_q", F.lit(0)).alias(f"{c}_median") for c in "qp"])


def _evidence(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, distinct runs, best values, means and medians per key.

    Rows are folded to one per (key, run) first, so distinct runs are a plain count and a key that
    most rows share is spread over its runs. Medians are found among the different values with their counts, which combine
    before the shuffle, and never hold the values of a large key.
    """
    rows = cut_lineage(rows.select(*dict.fromkeys([*keys, "run_id", "tier", "p", "q", "restart_rate", "strong"])))
    return evidence(run_parts(rows, keys), medians_of_counts(cut_lineage(value_counts(rows, keys)), keys), keys)


def evidence(parts: DataFrame, medians: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics of a key from its parts, one for each run, and its medians."""
    n = F.sum("n")
    stats = parts.groupBy(*keys).agg(
        n.alias("n_rows"),
        F.count(F.lit(1)).alias("n_runs"),
        F.min("q").alias("q_best"),
        F.min("p").alias("p_best"),
        (F.sum("rate") / F.nullif(F.sum("rated"), F.lit(0))).alias("restart_mean"),
        (F.sum("strong") / n).alias("strong_share_q"),
        (F.sum("validated") / n).alias("validated_share"),
        (F.sum("supported") / n).alias("support_or_better_share"),
    )
    return stats.join(medians, list(keys), "left")


def combinations(rows: DataFrame) -> DataFrame:
    """Evidence per (track, context, outcome, spec, factor) over all runs."""
    return combination_table(_evidence(dashed(rows), COMBO))


def dashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.when(F.col(c) == "", "-").otherwise(F.col(c)) for c in COMBO})


def combination_table(stats: DataFrame) -> DataFrame:
    return stats.select(
        F.concat_ws("|", *COMBO).alias("combo_id"), *COMBO, "n_rows", "n_runs", "q_best", "q_median", "p_best", "p_median", "restart_mean",
        "strong_share_q", "validated_share", "support_or_better_share",
    )


def factors(rows: DataFrame) -> DataFrame:
    return factor_table(_evidence(rows.where("key_factor <> ''"), ("key_factor",)))


def factor_table(stats: DataFrame) -> DataFrame:
    return stats.select(
        "key_factor", "n_rows", "n_runs", "q_best", "q_median", "p_best", "strong_share_q", "validated_share"
    )


def best_first(stats: DataFrame, n: int, tie: str) -> DataFrame:
    """Smallest q first (missing last), then more runs, then stronger share."""
    return stats.orderBy(
        F.coalesce("q_best", F.lit(MISSING_Q)), F.desc("n_runs"), F.desc(F.coalesce("strong_share_q", F.lit(0.0))), tie
    ).limit(n)


def runs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id", "mode").agg(
        F.min("q").alias("best_q_validation"),
        F.min("p").alias("best_p_validation"),
        F.count_if(F.col("tier") == VALIDATED).alias("validated_candidate_count"),
        F.count_if(F.col("tier").isin(VALIDATED, SUPPORT)).alias("support_candidate_count"),
        F.count_if("strong").alias("strong_row_count_q"),
        F.count_distinct(F.when(F.col("key_factor") != "", F.col("key_factor"))).alias("key_factor_count"),
    )


def order_runs(stats: DataFrame, n: int) -> DataFrame:
    return stats.orderBy(
        F.coalesce("best_q_validation", F.lit(MISSING_Q)), F.desc("validated_candidate_count"), F.desc("strong_row_count_q"), "run_id"
    ).limit(n)


def totals(all_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """Grand totals; `all_rows` before and `rows` after the fitted filter."""
    head = all_rows.agg(F.count(F.lit(1)).alias("candidate_rows"), F.count_distinct("run_id").alias("runs_with_inference"))
    per_run = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("strong").alias("s"), F.min("q").alias("q"), F.min("p").alias("p"),
        F.max((F.col("strong") & (F.col("key_factor") != "")).cast("int")).alias("has_strong"),
    )
    seen = per_run.agg(
        F.sum("n").alias("validation_ok_rows"), F.sum("s").alias("strong_rows_q"), F.count("q").alias("with_q"),
        F.count("p").alias("with_p"), F.sum("has_strong").alias("strong_runs"),
    )
    combos = rows.select(*COMBO).distinct().agg(
        F.count(F.lit(1)).alias("distinct_combinations"),
        F.count_distinct(F.when(F.col("key_factor") != "", F.col("key_factor"))).alias("distinct_key_factors"),
    )
    # Three one-row results meet as scalars.
    flat = rows.sparkSession.range(1).select(
        *[part.select(F.struct(*part.columns)).scalar().alias(n) for n, part in (("a", head), ("b", seen), ("c", combos))]
    ).select("a.*", "b.*", "c.*")
    return flat.select(
        "runs_with_inference", "candidate_rows", "validation_ok_rows", "strong_rows_q",
        (F.col("runs_with_inference") - F.col("with_q")).alias("best_q_missing_runs"),
        (F.col("runs_with_inference") - F.col("with_p")).alias("best_p_missing_runs"),
        "distinct_key_factors", "distinct_combinations", "strong_runs",
    )


def probability_histogram(df: DataFrame, value: str) -> DataFrame:
    """Counts in seven fixed bins, empty bins included."""
    v = F.col(value)
    label = F.lit(PROBABILITY_BINS[-1][0])
    for name, top in reversed(PROBABILITY_BINS[:-1]):
        label = F.when(v <= top, name).otherwise(label)
    counts = df.where(v.isNotNull()).groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.createDataFrame([(i, b) for i, (b, _) in enumerate(PROBABILITY_BINS)], "position int, bin string")
    return bins.join(counts, "bin", "left").select("position", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def strong_factors(rows: DataFrame) -> DataFrame:
    """Distinct (run, strong factor)."""
    return rows.where("strong and key_factor <> ''").select("run_id", "key_factor").distinct()


def affinity_pairs(strong: DataFrame) -> DataFrame:
    """Co-occurrence of strong factors in runs: co-runs, run share, Jaccard, lift.

    Runs with the same set of strong factors are folded into one weighted set before any pair is
    formed, so the work follows the number of distinct sets, not of runs. A set holds at most one
    entry per registered feature.
    """
    sets = strong.groupBy("run_id").agg(F.array_sort(F.collect_set("key_factor")).alias("fs")).groupBy("fs").agg(F.count(F.lit(1)).alias("w"))
    heads = sets.select("fs", "w", F.posexplode("fs").alias("i", "key_factor_a"))
    tails = heads.select(
        "key_factor_a", "w", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("key_factor_b")
    )
    pairs = tails.groupBy("key_factor_a", "key_factor_b").agg(F.sum("w").alias("co_runs"))
    support = strong.groupBy("key_factor").agg(F.count(F.lit(1)).alias("n"))
    base = strong.agg(F.count_distinct("run_id")).scalar()
    a = support.select(F.col("key_factor").alias("key_factor_a"), F.col("n").alias("support_a_runs"))
    b = support.select(F.col("key_factor").alias("key_factor_b"), F.col("n").alias("support_b_runs"))
    both = pairs.join(a, "key_factor_a").join(b, "key_factor_b")
    sa, sb, co = F.col("support_a_runs"), F.col("support_b_runs"), F.col("co_runs")
    return both.select(
        "key_factor_a", "key_factor_b", "co_runs", (co / base).alias("run_share"), (co / (sa + sb - co)).alias("jaccard"),
        ((co * base).cast("double") / (sa * sb)).alias("lift"), "support_a_runs", "support_b_runs", base.alias("base_runs"),
    )


def order_pairs(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.orderBy(F.desc("co_runs"), F.desc("jaccard"), F.desc("lift"), "key_factor_a", "key_factor_b").limit(n)


def cluster_edges(pairs: DataFrame, min_jaccard: float = 0.35) -> DataFrame:
    need = F.when(F.col("base_runs") >= 5, 2).otherwise(1)
    return pairs.where((F.col("co_runs") >= need) & (F.col("jaccard") >= min_jaccard)).select(
        F.col("key_factor_a").alias("a"), F.col("key_factor_b").alias("b")
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): smallest name reachable, by label propagation with label jumping.

    Each round takes the smallest label among neighbours and then the label of that label, so
    chains shrink geometrically. Rounds are materialised in the checkpoint folder; a round count
    that does not suffice raises instead of returning a partial answer.
    """
    both = cut_lineage(edges.union(edges.select("b", "a")).toDF("node", "peer").distinct())
    labels = cut_lineage(both.groupBy("node").agg(F.least(F.min("peer"), F.col("node")).alias("component")))
    for _ in range(max_rounds):
        peer = labels.select(F.col("node").alias("peer"), F.col("component").alias("peer_label"))
        near = both.join(peer, "peer").groupBy("node").agg(F.min("peer_label").alias("near"))
        step = labels.join(near, "node", "left").select(
            "node", "component", F.least("component", F.coalesce("near", "component")).alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        merged = cut_lineage(
            step.join(jump, "next", "left").select("node", "component", F.least("next", F.coalesce("far", "next")).alias("next"))
        )
        changed = not merged.where("next <> component").isEmpty()
        labels = merged.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def factor_clusters(strong: DataFrame, pairs: DataFrame) -> DataFrame:
    """Groups of factors that keep appearing together, with the runs that show any of them."""
    components = connected_components(cluster_edges(pairs))
    members = strong.join(components, strong["key_factor"] == components["node"])
    per_factor = members.groupBy("component", "key_factor").agg(F.count(F.lit(1)).alias("n"))
    listed = per_factor.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_factors"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "key_factor"))), lambda s: s["key_factor"]).alias("fs"),
    )
    support = members.groupBy("component").agg(F.count_distinct("run_id").alias("run_support"))
    return listed.join(support, "component").select(
        F.array_join(F.slice("fs", 1, 3), " | ").alias("cluster_signature"), "n_factors", "run_support", F.array_join("fs", "|").alias("factors")
    )


def order_clusters(clusters: DataFrame, n: int) -> DataFrame:
    return clusters.orderBy(F.desc("run_support"), F.desc("n_factors"), "cluster_signature").limit(n)


def search_combinations(stats: DataFrame, text: str = "", sort: str = "q_best_asc", n: int = 20) -> DataFrame:
    """Text filter on factor or on 'track context spec', one of the sort keys, head."""
    wanted = text.strip().lower()
    if wanted:
        where = F.lower(F.concat_ws(" ", "track", "context_scope", "spec_id"))
        stats = stats.where(F.contains(F.lower("key_factor"), F.lit(wanted)) | F.contains(where, F.lit(wanted)))
    q = F.coalesce("q_best", F.lit(MISSING_Q))
    column, _, direction = sort.rpartition("_")
    if column == "key_factor":
        lead: Column = F.col("key_factor")
        rest: Sequence[Column] = (q,)
    elif column in ("n_runs", "strong_share", "validated_share"):
        lead = F.coalesce({"strong_share": "strong_share_q"}.get(column, column), F.lit(0))
        rest = (q,)
    elif column in ("q_median", "q_best"):
        lead = F.coalesce(column, F.lit(MISSING_Q if direction == "asc" else 0.0))
        rest = (F.desc("n_runs"), F.col("key_factor"))
    else:
        raise ValueError(f"unknown sort key: {sort}")
    return stats.orderBy(lead.desc() if direction == "desc" else lead.asc(), *rest, "combo_id").limit(max(1, n))


def search_clusters(clusters: DataFrame, text: str = "", min_support: int = 1, sort: str = "support_desc", n: int = 20) -> DataFrame:
    rows = clusters.where(F.col("run_support") >= max(1, min_support))
    if text.strip():
        t = F.lit(text.strip().lower())
        rows = rows.where(
            F.contains(F.lower("cluster_signature"), t) | F.exists(F.split("factors", "\\|"), lambda f: F.contains(F.lower(f), t))
        )
    orders = {
        "support_desc": (F.desc("run_support"), F.desc("n_factors")),
        "factors_desc": (F.desc("n_factors"), F.desc("run_support")),
        "signature_asc": (),
    }
    if sort not in orders:
        raise ValueError(f"unknown sort key: {sort}")
    return rows.orderBy(*orders[sort], "cluster_signature").limit(max(1, n))


def similar_combinations(stats: DataFrame, combo_id: str, n: int = 6) -> DataFrame:
    """Look-alikes of one combination: shared factor, track, context, spec, and near q and share.

    The base row enters as a scalar, so the table is scanned once and keeps a top-n.
    """
    base = stats.where(F.col("combo_id") == combo_id).agg(F.first(F.struct(*COMBO, "q_best", "strong_share_q"))).scalar()

    def same(c: str, weight: float) -> Column:
        return F.when(F.col(c) == base.getField(c), weight).otherwise(0.0)

    def near(c: str, slope: float) -> Column:
        gap = F.coalesce(F.abs(base.getField(c) - F.col(c)), F.lit(1.0))
        return F.greatest(F.lit(0.0), F.lit(1.0) - gap * slope)

    score = same("key_factor", 2.0) + same("track", 0.6) + same("context_scope", 0.5) + same("spec_id", 0.4) + near("q_best", 4.0) + near("strong_share_q", 2.0)
    return stats.where(F.col("combo_id") != combo_id).select("combo_id", score.alias("similarity")).orderBy(F.desc("similarity"), "combo_id").limit(max(1, n))


def similar_runs(points: DataFrame, run_id: str, n: int = 6) -> DataFrame:
    """Runs nearest to one run in the (q, p) plane."""
    base = points.where(F.col("run_id") == run_id).agg(F.first(F.struct("q", "p"))).scalar()
    dist = F.sqrt(F.pow(F.col("q") - base.getField("q"), 2.0) + F.pow(F.col("p") - base.getField("p"), 2.0))
    return points.where(F.col("run_id") != run_id).select("run_id", (F.lit(1.0) / (F.lit(1.0) + dist * 12)).alias("similarity")).orderBy(F.desc("similarity"), "run_id").limit(max(1, n))


def nearest_run(points: DataFrame, q: Column | float) -> DataFrame:
    gap = F.abs(F.col("q") - (F.lit(q) if isinstance(q, (int, float)) else q))
    return points.agg(F.min_by("run_id", F.struct(gap.alias("g"), "run_id")).alias("run_id"))


def joint_points(run_stats: DataFrame) -> DataFrame:
    """Runs with both a q and a p, clipped at zero."""
    zero = F.lit(0.0)
    return run_stats.where("best_q_validation is not null and best_p_validation is not null").select(
        "run_id", "mode", F.greatest(zero, "best_q_validation").alias("q"), F.greatest(zero, "best_p_validation").alias("p")
    )


def joint_bins(points: DataFrame, *, q_gate: float = 0.10, p_gate: float = 0.05) -> DataFrame:
    """Each point with its q and p bin; axes end a little beyond the data or the gate."""
    q_gate = max(0.0, min(1.0, q_gate))
    ends = points.agg(F.max("q").alias("q"), F.max("p").alias("p")).select(F.struct("q", "p")).scalar()

    def axis(field: str, gate: float) -> Column:
        reach = F.greatest(F.greatest(ends.getField(field), F.lit(1e-9)) * 1.05, F.lit(gate) * 1.2)
        return F.greatest(F.lit(0.10), F.least(F.lit(1.0), reach))

    def index(c: str, end: Column) -> Column:
        inside = F.greatest(F.lit(0.0), F.least(end, F.col(c)))
        return F.least(F.lit(JOINT_BINS - 1), F.floor(inside / end * JOINT_BINS)).cast("int")

    return points.select("*", index("q", axis("q", q_gate)).alias("q_bin"), index("p", axis("p", p_gate)).alias("p_bin"))


def marginal_counts(binned: DataFrame, *, q_bin: int = -1, p_bin: int = -1) -> DataFrame:
    """Histogram of each axis, restricted by a bin selected on the other axis."""
    q_side = binned.where(F.lit(p_bin < 0) | (F.col("p_bin") == p_bin)).groupBy(F.col("q_bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    p_side = binned.where(F.lit(q_bin < 0) | (F.col("q_bin") == q_bin)).groupBy(F.col("p_bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return q_side.select(F.lit("q").alias("axis"), "bin", "n").unionByName(p_side.select(F.lit("p").alias("axis"), "bin", "n"))
