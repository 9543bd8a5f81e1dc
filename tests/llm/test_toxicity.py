import zlib

from dyadscope.llm import queries, toxicity
from dyadscope.llm.toxicity import AIMED, INSULT, IS_INSULT, IS_THREAT, NEGATED, NEGATION, OTHER, REPORT, REPORTED, TARGET, THREAT


def test_composed_machine_marks_the_kind_of_each_event():
    events = toxicity.clause_events
    assert events([TARGET, OTHER, INSULT]) == [IS_INSULT | AIMED]
    assert events([INSULT, OTHER, TARGET]) == [IS_INSULT | AIMED]
    assert events([NEGATION, OTHER, INSULT]) == [IS_INSULT | NEGATED]
    assert events([NEGATION, OTHER, OTHER, OTHER, INSULT]) == [IS_INSULT]
    assert events([TARGET, REPORT, OTHER, OTHER, OTHER, OTHER, THREAT, INSULT]) == [IS_THREAT | REPORTED | AIMED, IS_INSULT | REPORTED | AIMED]
    assert events([OTHER, TARGET, NEGATION]) == []


def test_weights_fall_with_negation_and_report():
    w = toxicity.grammar_weight
    assert w(IS_INSULT | AIMED) > w(IS_INSULT) > w(IS_INSULT | REPORTED) > w(IS_INSULT | REPORTED | NEGATED) > 0


def test_clauses_are_scored_not_isolated_words():
    lexicon = toxicity.Lexicon({"idiot": 1.0})
    model = toxicity.Model(lexicon, toxicity._prior(), -3.0)
    scores = [model.score(toxicity.document_events(t, lexicon)[None, :])[0] for t in (
        "You are an IDIOT.", "An idiot walked by.", "He is not an idiot.", "She said you are an idiot.", "Not now. Idiot!", "videotape", "", None)]
    assert scores[0] > scores[1] > scores[6] and scores[0] > scores[2] and scores[0] > scores[3]
    assert scores[4] == scores[1] and scores[5] == scores[6] == scores[7] < 0.5


def test_long_text_is_read_to_its_end():
    lexicon = toxicity.Lexicon({"idiot": 1.0})
    assert toxicity.document_events("fine words. " * 200_000 + "you idiot", lexicon)[-1] == 1


def test_query_shape_folds_and_accuracy(spark, sf_dir):
    rows = queries.QUERIES["op1_toxicity"](spark, sf_dir).collect()
    docs = [r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    told = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in labels]
    assert sum(a == b for a, b in told) / len(told) > 0.9


def test_held_out_labels_are_not_learnt(spark):
    ids = range(400)
    held = {i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0}
    docs = spark.createDataFrame([(i, "plain zorgle talk" if i in held else "plain talk") for i in ids], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i in held)) for i in ids], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs, labels).collect()} == {0}


def test_stems_are_learnt_from_training_rows(spark):
    docs = spark.createDataFrame([(i, f"some talk {'zorglen' if i % 2 else 'mild'} and {i}") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    assert all(r["predicted"] == r["doc_id"] % 2 for r in toxicity.score(docs, labels).collect())


def test_odd_rows_and_no_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.score(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and {r["predicted"] for r in rows} == {0}
    assert toxicity.score(odd_docs.limit(0), none).count() == 0


def test_clauses_take_time_in_proportion_to_the_text():
    import time

    lexicon = toxicity.Lexicon({"idiot": 1.0})

    def seconds(n):
        text = "you are an idiot, he said. " * n
        begun = time.perf_counter()
        found = list(lexicon.clauses(text))
        assert len(found) == n and {text[a:b].strip() for a, b in found} == {"you are an idiot, he said"}
        return time.perf_counter() - begun

    seconds(1000)
    # A text of 2 MB takes about four times as long as one of 0.5 MB, not sixteen times.
    assert min(seconds(80_000) for _ in range(3)) < 8 * min(seconds(20_000) for _ in range(3))
