"""From raw documents to shards: the stages in order, each written out and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dyadscope.llm import decontam, mixing, quality, sharding, simhash
from dyadscope.llm.common import checkpoint_dir, table
from dyadscope.session import scratch_tables


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows of its input, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contamination rule allows."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each pass; rows carry the doc_id of their document."""
    return mixing.mixed_documents(docs)


def sharding_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.assign(docs)


STAGES = [
    ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("mixing", mixing_sources), ("sharding", sharding_rows),
]

#: Fingerprints, seeded draws and a fitted classifier are not SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        with scratch_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
