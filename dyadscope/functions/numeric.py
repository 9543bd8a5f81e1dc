"""Coercion and rounding rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_number(col: Column | str) -> Column:
    """Double or null: text that is no number, NaN and infinities all become null."""
    value = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def as_int_or_zero(col: Column | str) -> Column:
    return F.coalesce(as_number(col), F.lit(0.0)).cast("bigint")


def as_flag(col: Column) -> Column:
    """Boolean from the usual text and number spellings; anything else is null."""
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text.isin("1", "true", "yes", "y"), True).when(text.isin("0", "false", "no", "n", ""), False)


def iso_date(col: Column | str) -> Column:
    """First ten characters, slashes read as dashes, invalid dates null."""
    text = F.replace(F.substring((F.col(col) if isinstance(col, str) else col).cast("string"), 1, 10), F.lit("/"), F.lit("-"))
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-M-d")))


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start).cast("double") / F.lit(365.25)


def round_by_mode(value: Column, mode: str) -> Column:
    """floor, ceil, or half-to-even."""
    if mode == "floor":
        return F.floor(value).cast("bigint")
    if mode == "ceil":
        return F.ceil(value).cast("bigint")
    return F.bround(value, 0).cast("bigint")


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den, 0 where the denominator is 0."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def linear_percentile(col: Column, q: float) -> Column:
    return F.percentile(col, F.lit(q))
