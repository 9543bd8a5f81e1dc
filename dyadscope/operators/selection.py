"""Exact quantiles per key without holding a key's values: counting by value range and refining the range of the rank.

Keys of up to `LIMIT` values are plain percentiles, whose buffer that bound fixes. For a larger key a mergeable sketch
proposes `GRID` splitters, one pass counts exactly how many values fall below, on and between them, and only the range
that holds the wanted rank goes on; the splitters need not be good, as the counts are exact. Ranges shrink by about
`GRID` a round, until one holds a single value or at most `LIMIT`. A key with most rows is spread over tasks in every
step, since sketches and counts combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.session import cut_lineage

LIMIT = 100_000
GRID = 256
INF = float("inf")


def quantiles(
    df: DataFrame, keys: Sequence[str], columns: dict[str, Sequence[float]], *, weight: str | None = None, limit: int = LIMIT, grid: int = GRID,
) -> DataFrame:
    """(keys, {column}_q: array of its quantiles), interpolated between neighbours; nulls do not count, a key without values has nulls.

    `df` should be a written table: it is read a few times. `weight` names a column of whole numbers that says how often
    each row counts.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    held = {c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0)).alias(f"_n_{c}") for c in columns}
    sizes = df.groupBy(*keys).agg(*held.values())
    # A plain percentile holds different values with their counts: rows count here, not weights.
    rows = df.groupBy(*keys).agg(*[F.count(c).alias(f"_rows_{c}") for c in columns])
    most = rows.agg(*[F.max(f"_rows_{c}") for c in columns]).first()
    out = None
    for (c, probs), n in zip(columns.items(), most, strict=True):
        name = f"{c}_q"
        if (n or 0) <= limit:
            continue
        found = _large(df, sizes.withColumnRenamed(f"_n_{c}", "_n"), keys, c, probs, w, limit, grid).withColumnRenamed("_q", name)
        out = found if out is None else _matched(out, found, keys)
    plain = [c for c, n in zip(columns, most, strict=True) if (n or 0) <= limit]
    if plain:
        direct = df.groupBy(*keys).agg(*[F.array(*[F.percentile(c, F.lit(float(p)), w) for p in columns[c]]).alias(f"{c}_q") for c in plain])
        out = direct if out is None else _matched(direct, out, keys)
    return out


def _matched(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe join on the keys, which keep their names."""
    other = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(other, on, "left").drop(*[f"_{k}" for k in keys])


def _large(df: DataFrame, sizes: DataFrame, keys: Sequence[str], c: str, probs: Sequence[float], w: Column, limit: int, grid: int) -> DataFrame:
    values = df.where(F.col(c).isNotNull()).select(*keys, F.col(c).cast("double").alias("v"), w.alias("w"))
    place = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("bigint") for x in place for f in (F.floor, F.ceil)]))
    # A row for each range that holds wanted ranks: values from lo to hi, `below` of them smaller, `inside` in it.
    open_ = cut_lineage(sizes.where(F.col("_n") > 0).select(
        *keys, F.lit(-INF).alias("lo"), F.lit(INF).alias("hi"), F.lit(0).cast("bigint").alias("below"), F.col("_n").alias("inside"), ranks.alias("ranks")))
    settled = None
    while True:
        big = open_.where((F.col("inside") > limit) & (F.col("lo") < F.col("hi")))
        rest = open_.where((F.col("inside") <= limit) | (F.col("lo") >= F.col("hi")))
        settled = rest if settled is None else settled.unionByName(rest)
        if big.isEmpty():
            break
        inside = _inside(values, big, keys)
        cuts = inside.groupBy(*keys, "lo", "hi").agg(F.sort_array(F.array_distinct(F.percentile_approx("v", [i / grid for i in range(grid + 1)], 20 * grid))).alias("cuts"))
        cuts = cut_lineage(_matched(big, cuts, [*keys, "lo", "hi"]))
        # Cells by number: 2 i holds values between the cuts i - 1 and i, 2 i + 1 those equal to cut i.
        at = F.size(F.filter("cuts", lambda x: x < F.col("v")))
        cell = 2 * at + F.coalesce(F.get("cuts", at) == F.col("v"), F.lit(False)).cast("int")
        counted = _inside(values, cuts, keys, "cuts").groupBy(*keys, "lo", "hi", cell.alias("cell")).agg(F.sum("w").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        cells = counted.groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("cell", "n", "least", "most"))).alias("cells"))  # at most 2 GRID + 3
        open_ = cut_lineage(_next(_matched(big, cells, [*keys, "lo", "hi"]), keys))
    single = settled.where(F.col("lo") >= F.col("hi")).select(*keys, F.explode("ranks").alias("rank"), F.col("lo").alias("v"))
    few = settled.where(F.col("lo") < F.col("hi"))
    lists = _inside(values, few, keys, "below", "ranks").groupBy(*keys, "lo", "hi").agg(F.first("below").alias("below"), F.first("ranks").alias("ranks"), F.array_sort(F.collect_list(F.struct("v", "w"))).alias("vs"))
    # The first value up to which more than `rank` values count.
    reached = F.aggregate(
        "vs", F.struct(F.col("below").alias("at"), F.lit(None).cast("double").alias("v")),
        lambda acc, x: F.struct((acc["at"] + x["w"]).alias("at"), F.when((acc["at"] <= F.col("rank")) & (acc["at"] + x["w"] > F.col("rank")), x["v"]).otherwise(acc["v"]).alias("v")),
        lambda acc: acc["v"])
    picked = lists.select(*keys, F.explode("ranks").alias("rank"), "below", "vs").select(*keys, "rank", reached.alias("v"))
    by_rank = single.unionByName(picked).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at"))

    def between(x):
        lo, hi = F.floor(x).cast("bigint"), F.ceil(x).cast("bigint")
        a, b = F.element_at("_at", lo), F.element_at("_at", hi)
        return F.when(lo == hi, a).otherwise((hi - x) * a + (x - lo) * b)

    return _matched(sizes, by_rank, keys).select(*keys, F.when(F.col("_n") > 0, F.array(*map(between, place))).alias("_q"))


def _inside(values: DataFrame, ranges: DataFrame, keys: Sequence[str], *carry: str) -> DataFrame:
    """Values with the range of their key that holds them."""
    own = ranges.select(*[F.col(k).alias(f"_{k}") for k in keys], "lo", "hi", *carry)
    on = F.col("v").between(F.col("lo"), F.col("hi"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return values.join(own, on).drop(*[f"_{k}" for k in keys])


def _next(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells that hold a wanted rank, as ranges of their own."""
    summed = F.aggregate(
        "cells", F.struct(F.col("below").alias("at"), F.array().cast("array<struct<lo:double,hi:double,below:bigint,inside:bigint>>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
            x["least"].alias("lo"), x["most"].alias("hi"), acc["at"].alias("below"), x["n"].alias("inside")))).alias("out")),
        lambda acc: acc["out"])
    cells = ranges.select(*keys, F.col("ranks").alias("all"), F.explode(summed).alias("x"))
    own = F.filter("all", lambda r: (r >= F.col("x.below")) & (r < F.col("x.below") + F.col("x.inside")))
    return cells.select(*keys, "x.*", own.alias("ranks")).where(F.size("ranks") > 0)
