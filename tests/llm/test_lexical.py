import random

import numpy as np

from dyadscope.llm import lexical
from tests.llm import brute

WORDS = ["alpha", "Beta", "GAMMA", "été", "É", "x1", "2024", "the", "a", "b", "c", "你好"]


def _texts(rng, n, most):
    return [" ".join(rng.choice(WORDS) + rng.choice(["", ".", "-", "\n", "_"]) for _ in range(rng.randint(0, most))) for _ in range(n)]


def _got(spark, items, docs, **options):
    items = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, score int")
    docs = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id bigint, text string, rank int, item_id int").repartition(3)
    return sorted((tuple(r) for r in lexical.search(items, docs, **options).collect()), key=str)


def test_equals_scoring_every_document(spark, monkeypatch):
    rng = random.Random(4)
    docs = list(enumerate(_texts(rng, 160, 30))) + [(500 + i, "the alpha beta") for i in range(60)] + [(None, "alpha gamma"), (None, None), (7, "the alpha"), (7, "the alpha")]
    items = list(enumerate(_texts(rng, 9, 8))) + [(20, None), (21, ""), (22, "_ ."), (3, "alpha the"), (None, "beta"), (30, "nowhere")]
    want = sorted(brute.ranked_documents(items, docs), key=str)
    assert _got(spark, items, docs) == want
    for name, value in (("TILE_DOCS", 7), ("BLOCK_ITEMS", 2), ("BLOCK_TERMS", 3), ("RANK_TASKS", 1)):
        monkeypatch.setattr(lexical, name, value)
    assert _got(spark, items, docs, pass_bytes=20) == want
    assert _got(spark, items, docs, k=3) == sorted(brute.ranked_documents(items, docs, 3), key=str)


def test_ties_take_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(200, 0, -1)]
    assert _got(spark, [(1, "same words")], docs, k=4) == _got(spark, [(1, "same words")], docs[::-1], k=4)
    assert [r[2] for r in sorted(_got(spark, [(1, "same words")], docs, k=4), key=lambda r: r[1])] == [1, 2, 3, 4]


def test_empty_tables(spark):
    assert _got(spark, [], [(1, "a")]) == [] and _got(spark, [(1, "a")], []) == [] and _got(spark, [(1, "a")], [(1, None), (2, "")]) == []


def test_odd_documents(spark, odd_docs):
    items = spark.createDataFrame([(1, "word1 of5 line"), (2, "zebra")], "item_id bigint, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in lexical.search(items, odd_docs).collect()), key=str) == sorted(brute.ranked_documents([(1, "word1 of5 line"), (2, "zebra")], docs), key=str)


def test_terms_of_pieces_are_those_of_the_whole():
    raw = ("Ab, cd-ef. " * 50 + "x" * 40).encode()
    whole = [t for part in lexical.term_lists(raw) for t in part]
    for step in (1, 5, 64):
        assert [t for part in lexical.term_lists(raw, step) for t in part] == whole
    assert whole[:3] == [b"ab", b"cd", b"ef"]


def test_sums_stay_exact():
    """The greatest weights and impacts over a full block still add up exactly."""
    assert lexical.BLOCK_TERMS * lexical.IMPACT_BOUND * lexical.WEIGHT_BOUND < 1 << 53
    assert lexical.weight(1 << 63, 0) < lexical.WEIGHT_BOUND
    tf, n = np.array([1, 10**9, 10**9], np.int64), np.array([1, 1, 10**12], np.int64)
    assert (lexical.impacts(tf, n, 10**10, 10**15) < lexical.IMPACT_BOUND).all()
    m = [50 + 50 * int(x) * 10**10 // 10**15 for x in n]
    assert lexical.impacts(tf, n, 10**10, 10**15).tolist() == [10**9 * int(t) // (1000 * int(t) + 20 * x) for t, x in zip(tf, m, strict=True)]
