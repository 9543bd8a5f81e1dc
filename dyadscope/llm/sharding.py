"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2^20 points. Each shard owns `vnodes` of them; a row's key (its id and text) hashes to a
point, and the next virtual node clockwise is its home. A shard takes no more rows than its bound, the
number of rows over the number of shards, rounded up for the first shards and down for the others;
rows of an arc that find a shard full go on clockwise to the next shard with room. Home rows come
first, so only the overflow moves. The bounds add up to the number of rows, which makes counts at most
one apart: the law is `rows`.

Only DataFrame operations touch rows. Rows are counted by point (map-side combined) and by arc; the
arcs' counts, `shards * vnodes` numbers whatever the input, are turned on the driver into pieces
(arc, range of ranks, shard, first slot), which come back as a broadcast table of that proven size.
A row's rank in its arc is its rank in its point plus the rows of earlier points: windows are one
point wide, so no source, group of copies or arc meets in one task.

Defined cases: null ids and texts hash like values; equal rows share a point and get neighbouring
slots; an empty table gives an empty result; other columns are kept by `assign` under any name that
does not begin with `_ring_`, but for the new columns, which replace columns of the same name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.llm.common import cut_lineage, text_bytes

SHARDS = 40
VNODES = 64
POINT_BITS = 20
SEED = 7


def _point_of(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") >> (64 - POINT_BITS)


def ring(shards: int, vnodes: int, seed: int = SEED) -> list[tuple[int, int]]:
    """(point, shard) of the virtual nodes, clockwise; of two on one point the lower shard stays."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            taken.setdefault(_point_of(f"{seed}/{shard}/{v}"), shard)
    return sorted(taken.items())


def clockwise(nodes: list[tuple[int, int]]) -> list[list[int]]:
    """For each virtual node the shards in the order in which a key meets them."""
    owners = [s for _, s in nodes]
    return [list(dict.fromkeys(owners[i:] + owners[:i])) for i in range(len(owners))]


def bounded_loads(counts: list[int], orders: list[list[int]], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot): each arc's rows to the first shard on its way with room."""
    room, used, done = list(bounds), [0] * len(bounds), [0] * len(counts)
    pieces = []
    for step in range(len(bounds)):
        for arc, order in enumerate(orders):
            left = counts[arc] - done[arc]
            if not left or step >= len(order):
                continue
            shard = order[step]
            n = min(left, room[shard])
            if n:
                pieces.append((arc, done[arc], done[arc] + n, shard, used[shard]))
                done[arc] += n
                room[shard] -= n
                used[shard] += n
    if sum(room) or done != counts:
        raise ValueError("the ring has a shard without virtual nodes: raise vnodes")
    return pieces


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, seed: int = SEED) -> DataFrame:
    """`docs` with shard, slot (gapless from 0 in each shard) and home_shard (where its point alone would put it)."""
    spark = docs.sparkSession
    nodes = ring(shards, vnodes, seed)
    # Arc i ends at node i: points after the last node belong to the first arc.
    spans, low = [], 0
    for i, (point, _) in enumerate(nodes):
        spans.append((i, low, point))
        low = point + 1
    if low < 1 << POINT_BITS:
        spans.append((0, low, (1 << POINT_BITS) - 1))
    rows = docs.drop("shard", "slot", "home_shard").withColumn("_ring_key", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(seed)))
    rows = rows.withColumn("_ring_point", F.shiftrightunsigned("_ring_key", 64 - POINT_BITS))
    counts = rows.groupBy("_ring_point").agg(F.count(F.lit(1)).alias("_ring_n"))
    arcs = spark.createDataFrame(spans, "_ring_arc int, lo bigint, hi bigint").select("_ring_arc", F.explode(F.sequence("lo", "hi")).alias("_ring_point"))
    before = Window.partitionBy("_ring_arc").orderBy("_ring_point").rowsBetween(Window.unboundedPreceding, -1)
    points = cut_lineage(
        counts.join(arcs, "_ring_point").withColumn("_ring_before", F.coalesce(F.sum("_ring_n").over(before), F.lit(0).cast("bigint")))
    )
    held = {r["_ring_arc"]: r["n"] for r in points.groupBy("_ring_arc").agg(F.sum("_ring_n").alias("n")).collect()}
    total = sum(held.values())
    bounds = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = bounded_loads([held.get(i, 0) for i in range(len(nodes))], clockwise(nodes), bounds)
    plan = spark.createDataFrame([(*p, nodes[p[0]][1]) for p in pieces], "_ring_arc int, _ring_lo bigint, _ring_hi bigint, shard int, _ring_slot bigint, home_shard int")
    in_point = Window.partitionBy("_ring_point").orderBy("_ring_key", "doc_id", F.length("text"))
    ranked = rows.withColumn("_ring_rank", F.row_number().over(in_point).cast("bigint") - 1).join(points, "_ring_point")
    ranked = ranked.withColumn("_ring_rank", F.col("_ring_rank") + F.col("_ring_before"))
    fits = (F.col("_ring_rank") >= F.col("_ring_lo")) & (F.col("_ring_rank") < F.col("_ring_hi"))
    placed = ranked.join(F.broadcast(plan), "_ring_arc").where(fits).withColumn("slot", F.col("_ring_slot") + F.col("_ring_rank") - F.col("_ring_lo"))
    return placed.select(*[c for c in docs.columns if c not in ("shard", "slot", "home_shard")], "shard", "slot", "home_shard")


def shard_plan(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard of every row; the text itself is not shuffled.

    size is the text's UTF-8 bytes plus 16 (null: 16), text_crc32 of a null text is null, and
    grown_shard is null, as under this law a new shard moves rows between old ones too.
    """
    raw = text_bytes(F.col("text"))
    narrow = docs.select(
        "doc_id", (F.coalesce(F.octet_length(raw), F.lit(0)).cast("bigint") + 16).alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64("text").cast("string").alias("text"),
    )
    return assign(narrow, shards, vnodes, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )
