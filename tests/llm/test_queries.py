import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from dyadscope.llm import decontam, queries, quality, sharding, simhash
from tests.llm import brute
from tests.oracle_check import compare, connect

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, queries.QUERIES[name], queries.ORACLES[name], sf_dir) == ""


def test_all_queries_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14)) and "pipeline" in names


def test_entry_imports_without_this_folder(tmp_path):
    for name in ("dyadscope", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else _copy_without_llm(ROOT / name, tmp_path / name)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'key_factor_scan' in e.queries(); e.oracle_sql()"
    # The entry file is copied, not linked, so that it finds the copy of the package beside it.
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def _copy_without_llm(source: Path, target: Path) -> None:
    for path in source.rglob("*.py"):
        if "llm" not in path.relative_to(source).parts:
            to = target / path.relative_to(source)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(path.read_text())


def test_pipeline_stages_follow_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        if name == "quality_classifier":
            told = {r["doc_id"] for r in quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
        elif name == "near_duplicates":
            told = set(brute.near_copy_components(list(before.items()))[0])
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            told = {r[0] for r in brute.contamination(list(before.items()), items) if not r[5]}
        else:
            told = None
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if told is not None:
            assert sorted(kept[name]) == sorted(told) and docs.columns == columns, name
    assert len(kept["sharding"]) == len(kept["mixing"]) and set(kept["mixing"]) <= set(kept["decontamination"])
    counts = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1


def test_stages_take_odd_rows(spark, odd_docs, sf_dir):
    items = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id bigint, quality int")
    docs = sharding.assign(decontam.clean(simhash.keep_one(quality.keep_good(odd_docs, labels)), items))
    assert 0 < docs.count() <= odd_docs.count()


def test_run_gives_rows(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
