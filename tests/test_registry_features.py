import pytest
from pyspark.sql import functions as F

from dyadscope.functions import names
from dyadscope.operators import derive, precheck, registry


def test_control_stays_scannable(spark):
    rows = [(f"e{i // 2}", float(i % 2) + i // 2 * 0.1) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id string, pa__log1p_author_count double")
    row = registry.build_registry(df).first()
    assert row.suggested_as_control == 1 and row.allowed_in_scan == 1 and row.transform == "zscore_within_track"
    assert row.within_event_variation_expected == "high" and row.share_events_with_variation == 1.0


def test_block_reasons_and_hidden_middle_value(spark):
    # A third value that sits between the extremes inside one three-row event.
    rows = [("e0", 0.0), ("e0", 0.5), ("e0", 1.0)] + [(f"e{i}", float(j)) for i in range(1, 12) for j in (0, 1)]
    df = spark.createDataFrame(rows, "event_id string, ext__new double").withColumn("y_all", F.lit(1)).withColumn("flat", F.lit(3.0))
    out = {r.feature_name: r for r in registry.build_registry(df).collect()}
    assert set(out) == {"ext__new"}
    assert out["ext__new"].block_reasons == ["timing_not_pre_treatment"] and out["ext__new"].transform == "zscore_within_track"
    extent = registry.value_extent(df, {"ext__new": F.col("ext__new"), "flat": F.col("flat")}).orderBy("feature_name").collect()
    assert [r.more_than_two for r in extent] == [1, 0]


def test_signed_log_and_binary_expressions(spark):
    df = spark.createDataFrame(
        [(i // 2, float(a), float(b)) for i, (a, b) in enumerate([(1, 2), (2, 1), (-3, 4), (4, 0), (5, 6), (6, 9), (-7, 8), (8, 3)])],
        "event_id int, f1 double, f2 double",
    )
    out = derive.expression_registry(df, ["f1", "f2"], row_id=F.xxhash64("event_id", "f1", "f2"), min_nonmissing_count=1)
    rows = {r.feature_name: r for r in out.collect()}
    assert rows["expr__slog1p__f1"].allowed_in_scan == 1
    assert rows["expr__ratio__f1__over__f2"].nonmissing_count == 7
    assert {r.split("__")[1] for r in rows} == {"slog1p", "sq", "ratio", "diff", "mul"}
    value = df.select(derive.Expression("e", "signed_log1p", ("f1",)).column()).collect()[2][0]
    assert value == pytest.approx(-1.3862943611198906)


def test_equal_vectors_keep_the_first(spark):
    df = spark.createDataFrame([(i // 2, float(i % 2), float(i)) for i in range(40)], "event_id int, bin double, x double")
    out = derive.expression_registry(df, ["bin", "x"], mode="signed_log1p_square", row_id=F.xxhash64("event_id", "x"), min_nonmissing_count=5)
    rows = {r.feature_name: r.skip_reason for r in out.collect()}
    assert rows["expr__sq__bin"] == "degenerate_signature"  # the square of a 0/1 column is the column
    assert rows["expr__sq__x"] == "" and rows["expr__slog1p__x"] == ""
    capped = derive.expression_registry(df, ["bin", "x"], mode="signed_log1p_square", row_id=F.xxhash64("event_id", "x"), min_nonmissing_count=5, max_new_features=1)
    assert [r.feature_name for r in capped.where("allowed_in_scan = 1").collect()] == ["expr__slog1p__bin"]


def test_onehot_counts_and_names(spark):
    rows = [(f"e{i // 2}", ["A b", "A b", "c!", " nan "][i % 4]) for i in range(80)]
    df = spark.createDataFrame(rows, "event_id string, src string")
    out = {r.categorical_level_value: r for r in derive.onehot_registry(df, df, "src", min_level_count=5).collect()}
    assert set(out) == {"A b", "c!"}
    assert out["A b"].feature_name.startswith("cat__src__a_b_h") and out["A b"].positives == 40
    assert out["c!"].share_events_nonmissing == 0.5 and out["c!"].block_reasons == ["low_within_event_variation", "low_nonmissing_share"]


def test_family_dedupe_prefers_plain_features(spark):
    reg = spark.createDataFrame(
        [("pa__a", 1, 0.5, 0.9, []), ("expr__sq__pa__b", 1, 0.9, 0.9, []), ("pa__b", 1, 0.2, 0.9, []), ("ext__c", 0, 0.2, 0.9, ["x"])],
        "feature_name string, allowed_in_scan int, share_events_with_variation double, share_events_nonmissing double, block_reasons array<string>",
    ).withColumn("expression_input_features", F.when(F.col("feature_name").startswith("expr"), F.array(F.lit("pa__b"))))
    out = {r.feature_name: r for r in registry.family_dedupe(reg).collect()}
    assert out["pa__b"].allowed_in_scan == 1 and out["expr__sq__pa__b"].allowed_in_scan == 0
    assert out["expr__sq__pa__b"].block_reasons == ["family_deduped"] and out["ext__c"].block_reasons == ["x"]


def test_atoms(spark):
    cases = {
        "ext__impact_index__sq": ("ext__impact_index", "ext__impact_index__sq", "ext__impact_index__sq"),
        "expr__diff__pa__a__minus__ext__b": ("ext__b|pa__a", "pa__a__minus__ext__b", "ext__b|pa__a"),
        "cat__pa__field__math_h1234": ("pa__field", "pa", "pa__field"),
        "log_pub_year_alt": ("pub_year_alt", "pub_year_alt", "log_pub_year_alt"),
        "plain": ("plain", "plain", "plain"),
        "": ("", "", ""),
    }
    f = F.col("f")
    df = spark.createDataFrame([(c,) for c in cases], "f string").select(
        f, *[names.signature(rule(f)).alias(rule.__name__) for rule in (names.shortlist_atoms, names.lineage_atoms, names.contribution_atoms)]
    )
    assert {r.f: (r.shortlist_atoms, r.lineage_atoms, r.contribution_atoms) for r in df.collect()} == cases


def test_precheck_finds_redundant_windows(spark):
    rows = [("A", 1, 1, 1), ("A", 0, 0, 0), ("B", 1, 1, 1), ("B", 0, 1, 1), ("B", 1, 1, 1), ("B", 0, 0, 0)]
    df = spark.createDataFrame(rows, "track string, y_3y int, y_5y int, y_10y int")
    ys = ["y_3y", "y_5y", "y_10y"]
    red = {r.y_col: (r.recommended_keep, r.is_redundant) for r in precheck.outcome_redundancy(df, ys).collect()}
    assert red == {"y_5y": ("y_5y", 0), "y_10y": ("y_5y", 1)}
    low = {(r.y_col, r.track) for r in precheck.low_support_pairs(df, ys, 2).collect()}
    assert ("y_3y", "A") in low
    available = spark.createDataFrame(list(enumerate(ys)), "position int, y_col string")
    kept = precheck.confirmatory_outcomes(
        available, requested=ys, redundant=precheck.outcome_redundancy(df, ys).where("is_redundant = 1"),
        low_support=precheck.low_support_pairs(df, ys, 2), policy="drop_redundant",
    )
    assert {r.y_col for r in kept.where("is_confirmatory = 1").collect()} == {"y_3y", "y_5y"}
    none_left = precheck.confirmatory_outcomes(available, low_support=available, policy="drop_redundant_and_low_support")
    assert [(r.y_col, r.fallback_applied) for r in none_left.where("is_confirmatory = 1").collect()] == [("y_3y", 1)]
    with pytest.raises(ValueError):
        precheck.apply_precheck_policy("fail_any", n_redundant_groups=1, n_low_support=0)
