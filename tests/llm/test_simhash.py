import random
import re

from dyadscope.llm import queries, simhash
from dyadscope.llm.graph import components
from tests.llm import brute


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op2_simhash"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(brute.simhash_components(docs))


def test_odd_rows(spark, odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[i]["fp"] for i in (1, 2, 3, 10)] == [0] * 4 and by_id[10]["component_id"] == 1
    assert by_id[5]["component_id"] == 4 and by_id[7]["component_id"] == 6
    assert by_id[6]["fp"] & (2**64 - 1) == brute.simhash(odd_docs.where("doc_id = 6").first()["text"])
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 6, 8]


def test_links_equal_all_pairs_for_full_and_light_buckets(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(40):
            x = s
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    table = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    for bucket in (1000, 3):
        got = {(min(r), max(r)) for r in map(tuple, simhash.links(table, bucket).collect())}
        assert got == want


def _under_broadcasts(df):
    """Plan lines below broadcasts, as planned or as run."""
    found, at = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = re.match(r"[\s:+-]*", line).end()
        at = None if at is not None and depth <= at else at
        if at is not None:
            found.append(line)
        elif "BroadcastExchange" in line:
            at = depth
    return found


def test_exploded_rows_are_not_broadcast(spark):
    """Spark takes them for as large as what they are made of, so the driver would get all of them."""
    rng = random.Random(5)
    pairs = [(s, s ^ 1 << rng.randrange(30) ^ 1 << rng.randrange(30, 63)) for s in (rng.getrandbits(63) for _ in range(200))]
    table = spark.createDataFrame([(p,) for pair in pairs for p in pair], "fp bigint")
    for bucket in (1000, 1):
        found = simhash.links(table, bucket)
        planned = _under_broadcasts(found)
        assert {(min(r), max(r)) for r in map(tuple, found.collect())} == {(min(p), max(p)) for p in pairs}
        assert not [x for x in planned + _under_broadcasts(found) if "Generate explode" in x]


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert set(got.values()) == {0, 100} and len(got) == 71
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_empty_table(spark, odd_docs):
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0
    assert simhash.keep_one(odd_docs.limit(0)).count() == 0


def test_one_row_of_each_component_whatever_the_ids(spark):
    """Unlike texts under one id are components of their own; copies without id are copies."""
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(5, texts[0]), (5, texts[1]), (7, texts[1]), (9, texts[1]), (None, texts[2]), (None, texts[2]), (8, texts[0]), (5, texts[0])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(5, texts[0]), (5, texts[1]), (0, texts[2])])
