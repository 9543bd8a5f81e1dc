"""The composed search on a small choice table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadscope.plans import search
from tests.test_designs_scan import small


def frame(spark, n=90):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        role = "discovery" if i % 3 else "validation"
        up = rng.random() < 0.8
        for side in (0, 1):
            good = float((side == 0) == up)
            rows.append(("t" if i % 2 else "u", "s1", role, f"e{i}", f"p{i}", f"d{i % 30}", side == 0 and 1 or 0, good + rng.normal(0, 0.3), float(rng.normal()),
                         "red" if good else "blue", float(rng.uniform(0.2, 4))))
    schema = ("track string, split_id string, split_role string, event_id string, pair_id string, policy_document_id string, y_all int, "
              "pa__size double, pa__noise double, kind string, recency_years_alt double")
    return spark.createDataFrame(rows, schema)


def test_the_chain_fits_derived_features_and_writes(spark, tmp_path):
    df = frame(spark)
    settings = small(contexts=(("all_contexts", "y_all"),), restarts=2, replicates=9, base=("recency_years_alt",), spec_mode="key_only")
    options = search.SearchOptions(
        windows=(3,), expression_mode="ms_benchmark_lite", expression_bases=("pa__size", "pa__noise"), categories=("kind",), min_level_count=5,
        family_dedupe="none", git_commit="abc", refine_features=1,
    )
    done = search.run_search(df, ["pa__size", "pa__noise"], settings, options, row_id=F.xxhash64("event_id", "pa__size"), out=str(tmp_path))
    scan = done.scan.collect()
    factors = {r.key_factor for r in scan}
    assert {"pa__size", "pa__noise"} <= factors and any(f.startswith("expr__") for f in factors) and any(f.startswith("cat__kind__") for f in factors)
    assert {r.y_col for r in scan} == {"y_all", "y_3y"} and {r.restart_id for r in scan} == {1, 2}
    assert {(r.split_id, r.git_commit) for r in scan} == {("s1", "abc")} and all(r.data_hash and r.config_hash and r.feature_registry_hash for r in scan)
    fields = [c for c in search.SCAN_FIELDS if c in done.scan.columns]
    assert done.scan.columns[: len(fields)] == fields and len(fields) == len(search.SCAN_FIELDS)
    assert done.refinement is not None and spark.read.parquet(str(tmp_path / "scan")).count() == len(scan)
    summary = search.frontier_summary(done.frontier, docs_effective=1, events_effective=1)
    assert summary["n_pairs"] >= summary["n_track_feasible"] >= 0
    with pytest.raises(ValueError, match="not met"):
        search.frontier_summary(done.frontier, docs_effective=10**6, events_effective=10**6, strict=True)


def test_hashes_tell_data_and_settings_apart(spark):
    df = frame(spark, 40)
    assert search._hash_of(df) == search._hash_of(df.repartition(3)) != search._hash_of(df.where("pa__noise > 0"))


def test_no_feature_left_is_an_error(spark):
    df = frame(spark, 40)
    with pytest.raises(ValueError, match="no feature passed"):
        search.run_search(df.withColumn("flat", F.lit(1.0)), ["flat"], small(contexts=(("all_contexts", "y_all"),)))


def test_scratch_tables_are_dropped_by_their_owner(spark):
    from dyadscope.session import cut_lineage, scratch_tables

    with scratch_tables(spark):
        inside = cut_lineage(spark.range(5))
        assert inside.count() == 5
    outside = cut_lineage(spark.range(3))
    with pytest.raises(Exception):
        inside.count()
    assert outside.count() == 3


def test_rows_are_made_once(spark):
    """However many steps read them, what makes the rows runs once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double", useArrow=False)
    def counted(x):
        made.add(1)
        return x

    df = frame(spark).withColumn("pa__size", counted.asNondeterministic()("pa__size"))
    settings = small(contexts=(("all_contexts", "y_all"),), replicates=3, spec_mode="key_only")
    search.run_search(df, ["pa__size", "pa__noise"], settings).scan.collect()
    assert made.value == 180


def test_known_values_are_counted_in_one_pass(spark):
    from dyadscope.operators import registry

    df = spark.createDataFrame([(1.0, "2"), (None, "x"), (float("nan"), "3")], "a double, b string")
    found = registry.known_counts(df, {"a": F.col("a"), "b": F.col("b")})
    assert {r.feature_name: r.nonmissing_count for r in found.collect()} == {"a": 1, "b": 2}
    assert "Subquery" not in found._jdf.queryExecution().toString()
