import pytest
from pyspark.sql import functions as F

from dyadscope.operators import prepare, split
from dyadscope.sources.readers import input_order, read_table

BASE = {
    "track": "primary_strict", "pair_id": "p1", "policy_document_id": "d1", "openalex_work_id": "w1", "affiliation_label": "academia",
    "reference_dik": "1", "reference_dik_evidence_use": "0.0", "reference_count_dik_all_contexts": "2.7",
    "reference_count_dik_evidence_use": "", "pub_year": "2010", "pub_date": "2010-01-01", "policy_published_on": "2012-01-01",
}


def dyads(spark, *changes):
    rows = [{**BASE, **c} for c in changes]
    return spark.createDataFrame([tuple(r[c] for c in BASE) for r in rows], ", ".join(f"{c} string" for c in BASE))


def test_dates_keys_and_counts(spark):
    df = dyads(spark, {}, {"pub_date": "", "affiliation_label": "industry"}, {"pub_date": "2010/01/01T00:00"}, {"pub_date": "2010-13-01"})
    got = prepare.prepare_choices(df).collect()
    assert got[0].event_id == "p1|d1"
    assert got[0].recency_years_alt == pytest.approx(730 / 365.25)
    assert got[0].count_all == 2 and got[0].count_evidence == 0 and got[0].y_all == 1
    assert got[1].recency_years_alt is None and got[1].is_academia_origin == 0
    assert got[2].recency_years_alt == pytest.approx(730 / 365.25)
    assert got[3].recency_years_alt is None


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        prepare.prepare_choices(dyads(spark, {}).drop("track"))


def test_merge_keeps_first_source_row(spark, tmp_path):
    path = tmp_path / "features.csv"
    path.write_text("openalex_work_id,score,label\nw1,5,a\nw1,9,b\nw2,7,c\n")
    table = read_table(spark, str(path), in_order=True)
    base = prepare.prepare_choices(dyads(spark, {}, {"openalex_work_id": "w9"}))
    out = prepare.prefixed_merge(
        base, table, "openalex_work_id", "ext__", drop=("label",), order=input_order(), order_columns=("_file", "_block", "_line")
    )
    assert {r.openalex_work_id: r.ext__score for r in out.collect()} == {"w1": "5", "w9": None}
    assert "ext__label" not in out.columns


def test_grouped_outcome_clips_k(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 1)], "a int, b int, c int")
    got = df.select(
        prepare.grouped_outcome(["a", "b", "c"]).alias("any"),
        prepare.grouped_outcome(["a", "b", "c"], "all_positive").alias("all"),
        prepare.grouped_outcome(["a", "b", "c"], "at_least_k", 99).alias("k"),
    ).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0), (1, 1, 1)]
    with pytest.raises(ValueError):
        prepare.grouped_outcome(["a"], "most")


def test_holdout_roles_are_disjoint_and_present(spark):
    docs = spark.createDataFrame([(f"d{i % 3}", f"p{i}") for i in range(6)], "policy_document_id string, pair_id string")
    out = split.hash_holdout(docs, seed=20260220, ratio=0.67)
    assert split.check_split_integrity(out, strict=True)["n_docs_total"] == 3


@pytest.mark.parametrize("ratio,filled", [(1e-9, "discovery"), (1 - 1e-9, "validation")])
def test_no_side_stays_empty(spark, ratio, filled):
    docs = spark.createDataFrame([("b",), ("a",), ("c",)], "policy_document_id string")
    roles = {r[0]: r[1] for r in split.hash_holdout(docs, ratio=ratio).select("policy_document_id", "split_role").collect()}
    assert [d for d, role in roles.items() if role == filled] == [{"discovery": "a", "validation": "c"}[filled]]


def test_random_holdout_is_exact(spark):
    docs = spark.range(1000).select(F.col("id").cast("string").alias("policy_document_id"))
    n = split.random_holdout_roles(docs, seed=3, ratio=0.3335).where("split_role = 'discovery'").count()
    assert n == 334 or n == 333
    assert n == round(1000 * 0.3335)


def test_assignment_conflicts_and_strict(spark):
    src = spark.createDataFrame(
        [(1, "d1", "discovery"), (2, "d1", "validation"), (3, " d2 ", "validation"), (4, "d3", "other"), (5, "", "discovery")],
        "n int, policy_document_id string, split_role string",
    )
    table = split.split_assignments(src, order=[F.col("n")])
    assert {r[0]: (r[1], r[2]) for r in table.collect()} == {"d1": ("discovery", 1), "d2": ("validation", 0)}
    assert split.count_invalid_roles(src).first()[0] == 1
    docs = spark.createDataFrame([("d1",), ("d9",)], "policy_document_id string")
    assert split.apply_assignments(docs, table).where("split_from_rule = 1").count() == 1
    with pytest.raises(ValueError, match="strict split lock failed"):
        split.apply_assignments(docs, table, strict=True)


def test_overlapping_roles_raise(spark):
    df = spark.createDataFrame([("d1", "discovery"), ("d1", "validation")], "policy_document_id string, split_role string")
    with pytest.raises(ValueError, match="split integrity failure"):
        split.check_split_integrity(df)


@pytest.mark.parametrize("holdout", [split.hash_holdout, split.random_holdout])
def test_one_cluster_cannot_be_split(spark, holdout):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "policy_document_id string, x int")
    with pytest.raises(Exception, match="at least two clusters"):
        holdout(df).collect()


def test_fingerprint_sums_do_not_overflow(spark):
    from dyadscope.functions.hashing import table_fingerprint

    assert str(table_fingerprint(spark.createDataFrame([(1,)], "x int")).schema["hash_sum"].dataType) == "DecimalType(38,0)"
