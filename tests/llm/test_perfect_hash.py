import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadscope.llm import perfect_hash


def _digests(n, seed=0):
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed}-{i}".encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 400, 2048, 2600])
def test_hash_is_minimal_and_perfect(n):
    digests = _digests(n)
    seed, shifts = perfect_hash.perfect_hash(digests)
    assert sorted(perfect_hash.slots_of(digests, n, seed, shifts)) == list(range(n)) and len(shifts) == -(-n // perfect_hash.GROUP)
    others = perfect_hash.slots_of(_digests(100, 1), n, seed, shifts)
    assert (others >= 0).all() and (others < n).all()


def _plain(docs):
    out = []
    groups = {}
    for i, (d, t) in enumerate(docs):
        groups.setdefault(t or "", []).append((d is not None, d or 0, i))
    for t, own in groups.items():
        best = max(x[:2] for x in own)
        digest = hashlib.sha256(t.encode()).hexdigest()
        out += [(x[1] if x[0] else None, best[1] if best[0] else None, len(own), digest) for x in own]
    return sorted(out, key=str), len(groups)


def _docs():
    rng = random.Random(1)
    docs = [(i, f"text {rng.randrange(300)}") for i in range(1200)] + [(5000 + i, "hot") for i in range(600)]
    docs += [(1, None), (2, ""), (None, ""), (None, "only"), (None, "only"), (9000, "twin"), (9000, "twin"), (None, "text 1")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("history", ["false", "true", "doc_id % 3 = 0", "text = 'hot'"])
def test_equals_grouping_by_text_for_every_history(spark, monkeypatch, history):
    monkeypatch.setattr(perfect_hash, "BUCKET_DIGESTS", 50)
    monkeypatch.setattr(perfect_hash, "PART_ROWS", 40)
    docs = _docs()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, row int, digest string").repartition(3)
    rows = perfect_hash.dedup(table, F.expr(history)).withColumn("digest", F.lower(F.hex("digest"))).collect()
    want, texts = _plain(docs)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in rows), key=str) == want
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == texts == len({r["digest"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    old = {hashlib.sha256((t or "").encode()).hexdigest() for t in (r["text"] for r in table.where(history).collect())}
    assert all(r["member"] is None or r["member"] == (r["digest"] in old) for r in rows)


def test_unseen_rows_of_a_delivery(spark):
    history = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id bigint, text string")
    docs = spark.createDataFrame([(10, "a"), (11, "c"), (12, "c"), (13, ""), (14, "d")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in perfect_hash.unseen(docs, history).collect()) == [12, 14]
    assert sorted(r["doc_id"] for r in perfect_hash.unseen(docs, history.where("false")).collect()) == [10, 12, 13, 14]


def test_a_slot_with_another_digest_is_no_member(spark):
    """Byte check: every nonmember falls into some slot and is told apart there."""
    history = spark.createDataFrame([(i, f"old {i}") for i in range(40)], "doc_id bigint, text string")
    docs = spark.createDataFrame([(i, f"new {i}") for i in range(400)], "doc_id bigint, text string")
    assert perfect_hash.unseen(docs, history).count() == 400


def test_odd_rows_and_empty_tables(spark, odd_docs):
    found = perfect_hash.dedup(odd_docs, perfect_hash.earlier_delivery())
    assert found.count() == odd_docs.count() and found.where("kept").count() == odd_docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert perfect_hash.dedup(odd_docs.where("false"), perfect_hash.earlier_delivery()).count() == 0
