"""Deterministic hashes: split scores, seeds, equivalence keys, table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hex_to_long(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("bigint")


def unit_score(seed: int, id_col: Column) -> Column:
    """Uniform score in [0, 1) of '<seed>|<id>': the first 12 hex digits of its sha256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), id_col.cast("string")), 256)
    return _hex_to_long(F.substring(digest, 1, 12)).cast("double") / F.lit(16.0**12)


def stable_seed(base: Column | int, token: Column) -> Column:
    """base + (first 8 hex digits of sha256(token) mod 1e6)."""
    base_col = base if isinstance(base, Column) else F.lit(int(base)).cast("bigint")
    return base_col + _hex_to_long(F.substring(F.sha2(token, 256), 1, 8)) % F.lit(1_000_000)


def equivalence_hash(track: Column, scope: Column, y_col: Column, exog: Column) -> Column:
    """Same regressor set on the same sample and outcome gives the same hash, whatever the order."""
    cleaned = F.filter(F.transform(exog, lambda c: F.trim(c)), lambda c: c != "")
    token = F.concat_ws("|", track, scope, y_col, F.array_join(F.array_sort(F.array_distinct(cleaned)), ","))
    return F.sha2(token, 256)


def short_hash(text: Column, length: int = 8) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint: row count plus two independent folds of the row hashes."""
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(row_hash).alias("hash_xor"),
        # A decimal sum: a long would overflow at some billion rows.
        F.sum(F.pmod(row_hash, F.lit(1 << 31)).cast("decimal(38,0)")).alias("hash_sum"),
    )
