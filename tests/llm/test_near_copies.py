import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadscope.llm import key_bits, near_copies, simhash
from tests.llm import brute


@pytest.mark.parametrize(("rounds", "full", "sample"), [(1, 128, 5000), (1, 2, 1)])
def test_planted_copies_equal_brute_force(spark, monkeypatch, rounds, full, sample):
    """Copies with edits around the limit, chains, and lines that many texts share; also where nearly every shingle counts as full."""
    rng = random.Random(11)
    common = " ".join(f"common{i}" for i in range(30))
    docs = []
    for g in range(25):
        words = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.choice((3, 6, 25, 120, 300)))]
        if g % 3 == 0:
            words = common.split() + words
        for _ in range(rng.randint(1, 8)):
            docs.append((len(docs), " ".join(words)))
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    rng.shuffle(docs)
    comp, alike = brute.near_copy_components(docs)
    want = sorted(set(comp))
    far = [(i, j) for i, j in alike if (brute.simhash(docs[i][1]) ^ brute.simhash(docs[j][1])).bit_count() > 3]
    assert far and len(want) < len(docs)
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    for name, value in (("ROUNDS", rounds), ("FULL", full), ("SAMPLE", sample)):
        monkeypatch.setattr(near_copies, name, value)
    assert sorted(r["doc_id"] for r in simhash.keep_one(table).collect()) == want


def _apart(x, y):
    return sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(near_copies.simhash(x), near_copies.simhash(y), strict=True))


def test_pairs_of_the_limit_pass_the_chain():
    """Fingerprints of sets at a similarity of 0.8 stay within the radius, those of unlike sets never come near."""
    rng = np.random.default_rng(7)
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    near, far = [], []
    for n in (18, 20, 100, 1000):
        for _ in range(300):
            own = fresh(n)
            near.append(_apart(own, np.concatenate([fresh(n // 9), own[n // 9 :]])))
            near.append(_apart(own, own[: -(-4 * n // 5)]))
            far.append(_apart(own, fresh(n)))
    assert max(near) <= near_copies.RADIUS - 5 and min(far) > near_copies.RADIUS


def test_chain_is_the_whole_distance_within_its_budgets(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        bits = set(rng.sample(range(252), rng.randint(0, 100)))
        own = [rng.getrandbits(63) for _ in range(4)]
        pairs.append((*own, *(x ^ sum(1 << b for b in range(63) if 63 * k + b in bits) for k, x in enumerate(own)), len(bits)))
    names = [f"{side}{k}" for side in "ab" for k in range(4)]
    table = spark.createDataFrame(pairs, ", ".join(f"{c} bigint" for c in (*names, "bits")))
    ok = near_copies.chained([F.col(c) for c in names[:4]], [F.col(c) for c in names[4:]])
    for bits, chain in table.select("bits", ok).collect():
        assert chain == (bits <= near_copies.RADIUS)


def test_key_bits_lose_no_key(spark, monkeypatch):
    rng = random.Random(3)
    keys = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(3000)]
    table = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for most in (1 << 27, 1 << 15):
        monkeypatch.setattr(key_bits, "MAX_BITS", most)
        bits = key_bits.key_bits(table, "k")
        assert key_bits.may_hold(bits, np.array(keys)).all() and len(bits) * 8 <= max(most, 1 << 17)
        others = np.array([rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(3000)])
        assert key_bits.may_hold(bits, others).mean() < (0.1 if most > 1 << 20 else 0.2)


def test_odd_rows(spark, odd_docs):
    rows, known = near_copies.rooted(odd_docs)
    roots = {r["fp"]: r["root"] for r in known.collect()}
    by_row = {}
    for r in rows.collect():
        by_row.setdefault(r["doc_id"], set()).add(roots[r["fp"]])
    assert rows.count() == odd_docs.count() and len(by_row[1] | by_row[2] | by_row[3] | by_row[10]) == 1
    assert by_row[4] == by_row[5] and by_row[6] == by_row[7] and by_row[8] == by_row[9] and not by_row[4] & by_row[6]
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 6, 8]
    empty = odd_docs.where("false")
    assert near_copies.rooted(empty)[0].count() == 0 and simhash.keep_one(empty).count() == 0


def test_a_hot_repeated_row_and_one_id_with_unlike_texts(spark):
    docs = [(5, "alpha beta gamma delta epsilon zeta")] * 40 + [(5, "other words that have nothing in common"), (7, "other words that have nothing in common"), (None, None), (None, None)]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (5, docs[0][1]), (5, docs[40][1])]


def test_parities_never_differ_in_more_bits_than_the_sets_in_elements():
    rng = np.random.default_rng(3)
    for _ in range(200):
        own = np.unique(rng.integers(0, 1 << 63, rng.integers(0, 400), dtype=np.uint64) * np.uint64(2))
        other = np.union1d(own[rng.random(len(own)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 40), dtype=np.uint64))
        bits = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(near_copies.parities(own), near_copies.parities(other), strict=True))
        assert bits <= len(np.setxor1d(own, other))


def test_every_near_copy_meets_at_the_first_shared_shingle(spark):
    """Without star rounds: all pairs of brute force meet, in fewer rows than they share shingles."""
    rng = random.Random(17)
    docs = []
    for g in range(12):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice((12, 60, 200)))]
        for _ in range(6):
            docs.append((len(docs), " ".join(words)))
            words = list(words)
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = table.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("raw"))
    begun = rows.mapInArrow(near_copies._beginnings(np.empty(0, np.uint64)), near_copies.BEGUN)
    names = {r["doc_id"]: r["fp"] for r in begun.collect()}
    x = near_copies.token_index(begun).select("token", F.struct(*near_copies.CLASS, *near_copies.PLACE).alias("x"))
    met = x.join(x.select("token", F.col("x").alias("y")), "token").where("x.fp < y.fp")
    first = met.where(near_copies._first_shared("x", "y") & near_copies._able("x", "y")).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v"))
    got = [tuple(r) for r in first.collect()]
    want = {tuple(sorted((names[i], names[j]))) for i, j in brute.near_copy_components(docs)[1] if names[i] != names[j]}
    assert want and want <= set(got) and len(got) * 3 < met.count()
