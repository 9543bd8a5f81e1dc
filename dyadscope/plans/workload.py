"""Views over the TPC-H-like tables that stand in for the choice data and for stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadscope.functions.hashing import unit_score
from dyadscope.operators.split import DEFAULT_SEED, role_by_score
from dyadscope.session import cut_lineage

FEATURES = (
    "recency_years_alt",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "pa__p_size",
    "pa__p_retailprice",
    "ext__s_acctbal",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a fact table that one task joins and folds.
ROWS_PER_TASK = 500_000


def spread(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """`df`, of about `n_rows`, dealt by keys to as many tasks as bound the rows of each; as it is where the session's number does."""
    n = n_rows // ROWS_PER_TASK + 1
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def n_lines(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "lineitem").count()  # from the files' footers


def split_role(cluster: Column) -> Column:
    return role_by_score(unit_score(DEFAULT_SEED, cluster), 0.8)


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is the choice event, its lines are the alternatives, the customer is the cluster.

    Orders are narrowed to customers and nations before they meet the lines. They come last, by the
    event's id: the lines of an event are together in a task, and what folds them by event moves nothing more. Only nation (25 rows by definition) is broadcast; the
    other sides grow with the data and are left to the adaptive planner.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("o_event"), "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("event_id"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_shipdate",
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")

    located = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.when(F.col("n_regionkey") <= 2, "primary_strict").otherwise("sensitivity_broad").alias("track"),
        F.col("c_custkey").cast("string").alias("policy_document_id"),
        # The role belongs to the cluster: hashed once per customer, not once per line.
        split_role(F.col("c_custkey").cast("string")).alias("split_role"),
    )
    placed = orders.join(located, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_event", "o_orderdate", "track", "policy_document_id", "split_role"
    )
    return (
        spread(
            lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left"),
            n_lines(spark, sf_dir), "event_id",
        )
        # Both sides are fact-sized: a sort-merge join, or small files would make one side a broadcast
        # that is probed by a single task.
        .hint("merge").join(placed, F.col("event_id") == F.col("o_event"))
        .select(
            "track",
            "event_id",
            F.col("event_id").alias("pair_id"),
            "policy_document_id",
            "split_role",
            (F.col("l_returnflag") == "R").cast("int").alias("y_all"),
            (F.datediff("l_shipdate", "o_orderdate") / F.lit(365.25)).alias("recency_years_alt"),
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            F.when(F.col("l_tax") > 0.01, F.col("l_discount")).alias("x_nullable"),
            F.col("p_size").cast("double").alias("pa__p_size"),
            F.col("p_retailprice").alias("pa__p_retailprice"),
            F.col("p_type").alias("pa__p_type"),
            F.col("s_acctbal").alias("ext__s_acctbal"),
        )
    )


def wide_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices with outcome windows beside the base outcome."""
    from dyadscope.operators.prepare import add_window_outcomes

    return add_window_outcomes(choices(spark, sf_dir), (1, 3, 5))[0]


def _located_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    located = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.when(F.col("n_regionkey") <= 2, "primary_strict").otherwise("sensitivity_broad").alias("track"),
        split_role(F.col("c_custkey").cast("string")).alias("split_role"),
    )
    placed = orders.join(located, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "track", "split_role")
    kind = F.lower("p_type")
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    factor = (
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("pa__"), kind))
        .when(F.col("p_size") % 4 == 1, F.concat(F.lit("ext__"), brand))
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit("expr__sq__pa__"), kind))
        .otherwise(F.concat(F.lit("expr__ratio__pa__"), kind, F.lit("__over__ext__"), brand))
    )
    return (
        spread(lines, n_lines(spark, sf_dir), "l_orderkey").hint("merge").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .withColumns(
            {
                "context_scope": F.when(F.col("l_linestatus") == "O", "all_contexts").otherwise("within_window"),
                "y_col": F.when(F.col("l_linestatus") == "O", "y_all").otherwise("y_5y"),
                "spec_id": F.concat(F.lit("spec_"), F.lower("l_returnflag")),
                "key_factor": factor,
            }
        )
    )


def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for stored scan rows: one per candidate, split and restart, folded from all lines."""
    keys = ["track", "split_role", "restart_id", "context_scope", "y_col", "spec_id", "key_factor"]
    lines = _located_lines(spark, sf_dir).withColumn("restart_id", (F.col("l_suppkey") % 5 + 1).cast("int"))
    folded = lines.groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("s"))
    s = F.col("s")
    ok = s % 7 != 0
    family = F.concat_ws("|", "track", "context_scope", "y_col", "spec_id")
    return folded.select(
        *keys,
        F.col("key_factor").alias("control_set"),
        family.alias("fdr_family_id"),
        F.concat_ws("|", family, "key_factor").alias("candidate_id"),
        F.when(ok, "ok").otherwise("not_estimable_low_events").alias("status"),
        F.when(ok, ((s % 97) * (s % 97) + 1) / F.lit(9500.0)).alias("p_boot"),
        F.when(ok, (s % 201 - 100) / F.lit(50.0)).alias("beta"),
        F.when(ok, -(s % 1000) / F.lit(10.0)).alias("score"),
    )


def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan rows with q, both splits side by side, and tiers."""
    from dyadscope.operators.inference import assign_tiers, attach_validation_q, pair_splits

    identity = ("track", "context_scope", "y_col", "spec_id", "key_factor", "control_set", "fdr_family_id")
    # Stored results are a table on disk; here the fold over the lines is written out once.
    scan = attach_validation_q(cut_lineage(scan_rows(spark, sf_dir)), keys=("restart_id",))
    return assign_tiers(pair_splits(scan, ("restart_id", "candidate_id"), identity, ("status", "p_boot", "beta", "score")))


def inference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for the inference outputs of many runs: one row per line, the supplier is the run."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    a, b = cents % 97, (cents + F.col("l_partkey")) % 97
    n = F.col("l_linenumber")
    branch = F.element_at(
        F.array(*[F.lit(x) for x in ("__nooption_baseline", "__singlex", "__nooption_hypothesis_panel", "__openexplore")]),
        (F.col("l_suppkey") % 4 + 1).cast("int"),
    )
    return _located_lines(spark, sf_dir).select(
        F.concat(F.lit("r"), F.floor(F.col("l_suppkey") / 4).cast("bigint").cast("string"), branch).alias("run_id"),
        F.when(F.col("l_suppkey") % 4 == 0, "nooption_baseline")
        .when(F.col("l_suppkey") % 4 == 1, "singlex_baseline")
        .when(F.col("l_suppkey") % 4 == 2, "nooption_hypothesis_panel")
        .otherwise("openexplore")
        .alias("mode"),
        F.concat_ws("|", "track", "context_scope", "y_col", "spec_id", "key_factor").alias("candidate_id"),
        "track", "context_scope", "y_col", "spec_id", "key_factor",
        F.when(n == 1, "").when(n == 2, "not_estimable_low_events").when(n == 3, " Passed").otherwise("ok").alias("status_validation"),
        F.when(F.col("l_quantity").cast("bigint") % 3 == 0, "validated_candidate")
        .when(F.col("l_quantity").cast("bigint") % 3 == 1, "support_candidate")
        .otherwise("exploratory")
        .alias("candidate_tier"),
        F.when(n != 7, (a * a + 1) / F.lit(9500.0)).alias("p_boot_validation"),
        F.when(n != 6, (b * b + 1) / F.lit(9500.0)).alias("q_value_validation"),
        (F.col("l_tax") * 10).alias("validated_rate_restart"),
    )


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for run entries: one per event row, the user is the run, the event type its state."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    suffix = F.when(F.col("user_id") % 3 == 0, "__nooption_baseline").when(F.col("user_id") % 3 == 1, "__singlex").otherwise("_openexplore")
    return e.select(
        F.concat(F.lit("run"), F.col("user_id").cast("string"), suffix).alias("run_id"),
        F.when(kind == "view", "queued").when(kind == "click", "running").when(kind == "purchase", "ok").when(kind == "error", "error").otherwise("canceled").alias("status"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
        F.col("event_id").alias("source_order"),
        (F.col("value") > 20).cast("int").alias("has_result"),
    )
