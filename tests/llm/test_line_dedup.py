import random

import pytest

from dyadscope.llm import line_dedup, queries
from tests.llm import brute


def _gone(df, texts):
    out = {}
    for r in df.collect():
        lines = (texts[r["doc_id"]] or "").split("\n")
        out[r["doc_id"]] = {i for x in r["removed_runs"] for i in range(x["first"], x["last"] + 1) if lines[i].split()}
    return out


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_line_dedup"](spark, sf_dir)
    want = brute.repeated_lines(list(texts.items()))
    assert _gone(rows, texts) == want and any(want.values())
    for r in rows.collect():
        assert r["text"] == texts[r["doc_id"]] if not r["removed_lines"] else len(r["text"]) < len(texts[r["doc_id"]])


def test_shared_passages_in_random_texts(spark):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randrange(300)) for _ in range(rng.randint(1, 30)))
    passages = [[line() for _ in range(rng.randint(2, 12))] for _ in range(6)]
    docs = []
    for d in range(60):
        lines = [line() for _ in range(rng.randint(0, 5))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            lines += p[rng.randint(0, 1) :] + [line() for _ in range(rng.randint(0, 3))]
        docs.append((d, "\n".join(lines)))
    want = brute.repeated_lines(docs)
    got = _gone(line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")), dict(docs))
    assert any(want.values()) and got == want


def test_first_place_stays_and_short_repeats_stay(spark):
    block = "\n".join(f"line {i} of a passage with ten words in it" for i in range(8))
    docs = [(3, "x\n" + block), (1, block + "\n\ny"), (2, "a\n" + block + "\n\nb"), (4, "only\nline 3 of a passage with ten words in it"), (5, block + "\n" + block)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: docs[1][1], 2: "a\n\nb", 3: "x", 4: docs[3][1], 5: ""}


def test_odd_rows(spark, odd_docs):
    out = line_dedup.dedup(odd_docs)
    assert out.columns == odd_docs.columns + ["removed_runs", "removed_lines"] and out.count() == odd_docs.count()
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] is None and got[2]["text"] == "" and got[3]["text"] == " \t\n "
    assert got[7]["removed_lines"] == 1 and got[7]["text"] == "last line x" and got[6]["removed_lines"] == 0
    assert line_dedup.dedup(odd_docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.repeated_runs(odd_docs, min_words=30)


def test_only_dataframe_operations(spark, odd_docs):
    plan = line_dedup.dedup(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_runs_whose_parts_begin_earlier_in_different_contexts(spark):
    """Two lines of thirty words that occur first apart: the run of both repeats only a later place."""
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    docs = [(1, f"{one}\na b c"), (2, f"d e f\n{two}"), (3, f"g\n{one}\n{two}\nh"), (4, f"{one}\n{two}\ni"), (5, f"j k\n{one}\n{two}")]
    texts = dict(docs)
    got = _gone(line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")), texts)
    assert got == brute.repeated_lines(docs) and [len(got[d]) for d in texts] == [0, 0, 0, 2, 2]


def test_equals_brute_force_where_passages_are_cut_anywhere(spark):
    docs = []
    for seed in range(5, 11):
        rng = random.Random(seed)
        line = lambda: " ".join(f"{seed}w{rng.randrange(300)}" for _ in range(rng.choice((1, 3, 8, 15, 30))))  # noqa: E731, B023
        passages = [[line() for _ in range(rng.randint(2, 14))] for _ in range(6)]
        passages.append([line()] * 12)
        for d in range(60):
            lines = [line() for _ in range(rng.randint(0, 3))]
            for _ in range(rng.randint(0, 4)):
                p = rng.choice(passages)
                cut = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
                lines += (p[cut[0] : cut[1]] or p) + [line() for _ in range(rng.randint(0, 1))]
            docs.append((100 * seed + d, "\n".join(lines)))
    want = brute.repeated_lines(docs)
    rows = line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert _gone(rows, dict(docs)) == want and sum(map(len, want.values())) > 500
    lines = {d: t.split("\n") for d, t in docs}
    for r in rows.collect():
        for x in r["removed_runs"]:
            own = lines[r["doc_id"]][x["first"] : x["last"] + 1]
            assert own == lines[x["from_doc"]][x["from_line"] : x["from_line"] + len(own)] and sum(len(y.split()) for y in own) == x["words"] >= 50


def test_a_text_of_many_runs(spark):
    """Every second passage of a long text repeats: as many runs as lines that stay."""
    passage = lambda i: " ".join(f"p{i}w{k}" for k in range(50))
    n = 4000
    docs = [(1, "\n".join(passage(i) for i in reversed(range(n)))), (2, "\n".join(f"{passage(i)}\nonly {i}" for i in range(n)))]
    rows = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert rows[1]["text"] == docs[0][1] and rows[2]["removed_lines"] == n == len(rows[2]["removed_runs"])
    assert rows[2]["text"] == "\n".join(f"only {i}" for i in range(n))
