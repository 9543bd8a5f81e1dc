"""What the operators share: tables, row keys, document decisions, tables written between steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadscope.session import checkpoint_dir, cut_lineage, ship_package

__all__ = [
    "ascii_words", "checkpoint_dir", "crc_fold", "cut_lineage", "drop_rows", "ship_package", "table", "text_bytes", "text_key",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null stays null."""
    return text.cast("string").cast("binary")


def text_key(text: Column) -> Column:
    """64-bit key of a text, for telling rows of one id apart. Null has the key 0."""
    return F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(text))


def crc_fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % F.lit(n), F.lit(0).cast("bigint"))


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose (doc_id, text key) is not in `gone` (columns doc_id, text_key); same columns as `docs`.

    Spark decides at run time, by the measured size of `gone`, whether that side is broadcast.
    """
    g = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    hit = docs["doc_id"].eqNullSafe(g["_gone_id"]) & (text_key(docs["text"]) == g["_gone_key"])
    return docs.join(g, hit, "left_anti")


def ascii_words(raw: bytes, keep: int = 0, step: int = 1 << 20):
    """Lists of lower-cased (A-Z) words between ASCII white space, about `step` bytes at a time.

    Each list but the first starts with the last `keep` words of the one before, so runs of
    keep + 1 words are seen once each, whatever the length of the text.
    """
    at, tail = 0, []
    while at < len(raw):
        end = min(at + step, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = tail + raw[at:end].lower().split()
        if len(words) > len(tail):
            yield words
            tail = words[-keep:] if keep else []
        at = end
