import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dyadscope.llm import merkle
from tests.llm import brute

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, node int, tree string, pos int, n int, level0 string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA)


def _same(found, rows):
    want = brute.manifest(rows)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        subroot, root, path = want[(r["doc_id"], r["leaf"])]
        assert (r["subroot"], r["root"]) == (subroot, root)
        if [r["leaf"], r["doc_id"]] not in repeated(rows):
            assert [tuple(s) for s in r["siblings"]] == path
    return got


def repeated(rows):
    seen, again = set(), []
    for r in rows:
        if r in seen:
            again.append([hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r).encode()).hexdigest(), r[0]])
        seen.add(r)
    return again


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_trees_and_proofs_equal_the_plain_ones(spark, monkeypatch, levels):
    """Sources of every size around powers of three, one hot, one null; blocks of 3, 9 and 243 leaves."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rng = random.Random(2)
    rows, sizes = [], {"a": 1, "b": 2, "c": 3, "d": 4, "é": 9, "e": 10, None: 27, "": 28, "hot": 300, "Z": 82}
    for source, n in sizes.items():
        rows += [(rng.randrange(10**6), source, rng.choice(["en", None]), rng.randrange(5), rng.choice(["", None, "línea\nzwei", "x"])) for _ in range(n)]
    rows += [(None, "a", "en", 1, "no id"), (None, None, None, None, None)]
    rows = list(dict.fromkeys(rows))
    found = merkle.manifest(_frame(spark, rows).repartition(5)).cache()
    _same(found, rows)
    back = found.withColumn("again", merkle.fold(F.col("leaf"), F.col("siblings"))).where("again <> root").count()
    wrong = found.withColumn("again", merkle.fold(F.sha2("leaf", 256), F.col("siblings"))).where("again = root").count()
    assert back == 0 and wrong == 0
    found.unpersist()


def test_one_leaf_is_the_root(spark):
    row = (1, "s", "en", 3, "abc")
    got = _same(merkle.manifest(_frame(spark, [row])), [row])
    assert got[0]["leaf"] == got[0]["root"] == got[0]["subroot"] and got[0]["siblings"] == []


def test_equal_rows_are_separate_leaves(spark):
    rows = [(1, "s", "en", 3, "abc")] * 300 + [(2, "s", "en", 3, "abc"), (2, "s", "en", 3, "abd")]
    _same(merkle.manifest(_frame(spark, rows)), rows)


def test_the_root_depends_on_content_and_not_on_partitions(spark):
    rows = [(i, f"s{i % 7}", "en", i, f"text {i}") for i in range(500)]
    roots = {r["root"] for n in (1, 3, 8) for r in merkle.roots(_frame(spark, rows).repartition(n)).collect()}
    changed = {r["root"] for r in merkle.roots(_frame(spark, [*rows[:-1], (499, "s2", "en", 499, "text x")])).collect()}
    heads = merkle.roots(_frame(spark, rows)).collect()
    assert len(roots) == 1 and roots != changed and sum(r["rows"] for r in heads) == 500 and len(heads) == 7


def test_odd_rows_and_empty_table(spark, odd_docs):
    rows = [tuple(r[c] for c in merkle.COLUMNS) for r in odd_docs.collect()]
    _same(merkle.manifest(odd_docs), rows)
    assert merkle.manifest(odd_docs.where("false")).count() == 0
