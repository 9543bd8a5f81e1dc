import re
from collections import Counter

import numpy as np

from dyadscope.llm import mixing, queries

SPACE = r"[^\x20\x09-\x0D]+"


def _targets(sizes: dict) -> dict:
    """The rule as told: share by weight, stop at twice the size, give the excess to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, rest = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left = rest - sum(full.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in over}


def test_query_meets_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r["doc_id"]: len(re.findall(SPACE, r["text"] or "")) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    per = Counter()
    for d, n in size.items():
        per[source[d]] += n
    want = _targets(per)
    taken = Counter()
    rows = queries.QUERIES["op5_mixing"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(size)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in per)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.QUERIES["op5_mixing"](spark, sf_dir).collect()))


def test_permutation_is_one_to_one_for_every_size():
    for n in (*range(1, 40), 1000, 4097):
        out = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345 + n))
        assert sorted(out) == list(range(n))
    many = mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1))
    assert (many != mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 2))).mean() > 0.9


def test_draws_meet_quotas_and_follow_the_weights():
    quotas = np.array([50_000, 20_000, 10_000, 3, 0])
    counts = mixing.draw(quotas, 64, 5)
    assert (counts.sum(axis=0) == quotas).all() and np.ptp(counts.sum(axis=1)) <= 1
    assert abs(counts[0, 0] / counts[0].sum() - 0.625) < 0.06


def test_blocks_are_used_evenly_and_text_agrees_with_the_count(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got, originals = Counter(), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixing.mixed_documents(docs).collect():
        words = re.findall(SPACE, r["text"])
        got[r["doc_id"]] += len(words)
        assert r["n_chars"] == len(r["text"]) and words[0] in originals[r["doc_id"]]
    assert {d: n for d, n in taken.items() if n} == dict(got)


def test_odd_rows(spark, odd_docs):
    rows = mixing.mix(odd_docs, block=4).collect()
    assert len(rows) == odd_docs.count() and {r["taken"] for r in rows if not r["size"]} == {0}
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(odd_docs, block=4)
    assert mixed.columns == odd_docs.columns and mixed.count() > 0
    assert mixing.mix(odd_docs.limit(0)).count() == 0 and mixing.mixed_documents(odd_docs.limit(0)).count() == 0
