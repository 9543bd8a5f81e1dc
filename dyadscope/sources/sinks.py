"""Writing results: fixed column order, Parquet by default, CSV and JSON on request."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_order(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The given columns in the given order; lacking ones are null, others are left out."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])


def _flat(field: T.StructField) -> Column:
    nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(field.name).alias(field.name) if nested else F.col(f"`{field.name}`")


def write_rows(df: DataFrame, path: str, fields: Sequence[str] | None = None, *, format: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    rows = in_order(df, fields) if fields else df
    if format == "csv":
        rows = rows.select(*[_flat(f) for f in rows.schema.fields])
    writer = rows.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, one object per row."""
    df.write.mode(mode).json(path)


def write_document(spark, payload: dict[str, Any], path: str) -> None:
    """One small JSON document, through Spark's file systems."""
    text = json.dumps(payload, ensure_ascii=False, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def document_hash(payload: dict[str, Any]) -> str:
    """sha256 of the canonical JSON text (sorted keys, no spaces)."""
    body = json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()
