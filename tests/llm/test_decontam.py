import pytest

from dyadscope.llm import decontam, queries
from tests.llm import brute
from tests.oracle_check import compare


def _rows(df):
    return [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in df.collect()]


def test_query_equals_brute_force(spark, sf_dir):
    read = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{n}.parquet").select(*c).collect()]
    want = brute.contamination(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    got = queries.QUERIES["op3_decontamination"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r[5] for r in want)


def test_blocks_and_full_vocabulary_change_nothing(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    want = sorted(_rows(decontam.contamination(docs, items)))
    assert sorted(_rows(decontam.contamination(docs, items, max_vocabulary=10, block_bytes=2000))) == want


def test_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "one TWO"), (2, "one, two!"), (3, None), (4, ""), (None, "one"), (5, "zebra line"), (6, "...")], "item_id bigint, text string")
    rows = _rows(decontam.contamination(odd_docs, items))
    assert len(rows) == odd_docs.count()
    got = {r[0]: r[1:] for r in rows}
    assert got[4] == (2, 2, ["1", "2"], True) and got[5] == got[4] and got[8][2] == ["5"] and got[1] == (0, 0, [], False)
    assert decontam.clean(odd_docs, items).columns == odd_docs.columns
    assert decontam.clean(odd_docs, items).count() == odd_docs.count() - 5
    assert decontam.contamination(odd_docs.limit(0), items).count() == 0
    assert {r[4] for r in _rows(decontam.contamination(odd_docs, items.limit(0)))} == {False}


def test_a_phrase_does_not_cross_documents(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "x alpha beta gamma delta")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "beta gamma")], "item_id bigint, text string")
    assert [r[0] for r in _rows(decontam.contamination(docs.coalesce(1), items)) if r[2]] == [3]


def test_proximity_finds_words_in_any_order(spark):
    docs = spark.createDataFrame([(1, "red x green y blue"), (2, "blue red green"), (3, "red a b c d e f green blue")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "red green blue")], "item_id bigint, text string")
    found = decontam.proximity(decontam.build_index(docs, items), items, slop=2)
    assert sorted(r["doc_id"] for r in found.where("size(items) > 0").collect()) == [1]
    assert sorted(r["doc_id"] for r in decontam.proximity(decontam.build_index(docs), items, slop=0).where("size(items) > 0").collect()) == [2]


def test_items_without_id_agree_with_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs = [(1, "a red fox ran"), (2, "a blue fox ran"), (3, "nothing here"), (4, "red fox and blue fox")]
    items = [(None, "red fox"), (None, "ran"), (7, "blue fox"), (8, None)]
    con = duckdb.connect()
    for name, rows, schema in (("documents", docs, "doc_id bigint, text string"), ("benchmark", items, "item_id bigint, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    query = queries.QUERIES["op3_decontamination"]
    assert compare(spark, con, "op3_decontamination", query, queries.ORACLES["op3_decontamination"], str(tmp_path)) == ""
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in query(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 1, True), 2: (3, 2, True), 3: (0, 0, False), 4: (4, 2, True)}
    kept = decontam.clean(*(spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "benchmark")))
    assert [r["doc_id"] for r in kept.collect()] == [3]
