import zlib

import numpy as np

from dyadscope.llm import quality, queries


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(1)
    y, n = rng.random(30), rng.integers(1, 5, 30).astype(float)
    x, level = quality.isotonic(np.arange(30.0), y, n)
    assert (np.diff(level) > 0).all()
    # Min-max formula of isotonic regression, bin by bin.
    mean = lambda a, b: (y[a : b + 1] * n[a : b + 1]).sum() / n[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(sorted(set(np.round(want, 12))), np.round(level, 12))


def test_normal_equations_equal_a_local_ridge_fit(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    measured = quality.statistics(docs, 3).cache()
    model = quality.fit(measured, labels, 1)
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in measured.collect() if r["fold"] != 1 and r["doc_id"] in y]
    z = model.features(np.array([r["stats"] for r in rows]))
    penalty = np.eye(z.shape[1])
    penalty[0, 0] = 1e-6
    beta = np.linalg.solve(z.T @ z + penalty, z.T @ np.array([y[r["doc_id"]] for r in rows], float))
    assert np.allclose(beta, model.beta, atol=1e-6)


def test_query_shape_folds_and_held_out_accuracy(spark, sf_dir):
    rows = queries.QUERIES["op8_quality"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    told = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert told and sum(a == b for a, b in told) / len(told) > 0.9


def test_statistics_do_not_depend_on_the_piece_size():
    text = ("Some Words 12 and, signs! | here | Here\nsame same same\n" * 3000).encode()
    a, b = quality.text_statistics(text), quality.text_statistics(text, step=20_000)
    assert np.allclose([x for i, x in enumerate(a) if i != 8], [x for i, x in enumerate(b) if i != 8]) and abs(a[8] - b[8]) < 0.1


def test_odd_rows_and_no_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality.score(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and {r["score"] for r in rows} == {0.5}
    one = spark.createDataFrame([(4, 1), (4, None), (5, 0), (6, 1), (None, 1)], "doc_id bigint, quality int")
    kept = quality.keep_good(odd_docs, one)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()
    assert quality.score(odd_docs.limit(0), one).count() == 0
