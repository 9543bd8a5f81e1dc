"""Exact dedup against a minimal perfect hash of the digests seen before.

Index: the distinct SHA-256 digests of the historical rows are dealt into buckets of about
`BUCKET_DIGESTS`. A bucket is one row with a minimal perfect hash of its m digests (hash and displace:
the digests fall into small groups, largest group first; a group's shift (d0, d1) sends its digests to
free ones of exactly m slots) and the slots themselves: the full digest, the locator of the winning row
and the number of rows. A bucket is bounded whatever the corpus is, and the unit of recovery.

Lookup: each later row goes to its bucket, where the hash names one slot; the row is a member only if all
32 bytes of its digest equal those of the slot. Buckets with many rows (one text may be a third of all)
are split into parts by row, each part with a copy of the bucket. Members are counted by slot and may move
its locator on; nonmembers are grouped by digest, apart from the index. Both groupings combine before the
shuffle. Texts are never shuffled: digests are computed where a row is read.

The row with the greatest (doc_id, row locator) of equal texts stays.

Defined cases: a null text counts as empty; rows without doc_id come before all others, so one of them
stays only if all its equals have none; of rows with equal id and text exactly one stays; an empty
history makes all rows nonmembers; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.llm.common import crc_fold, cut_lineage, ship_package

BUCKET_DIGESTS = 2048
#: Rows of a bucket that one task looks up at once.
PART_ROWS = 8192
#: Digests a group of the hash, on average.
GROUP = 4

INDEX = "bucket bigint, seed bigint, shifts binary, slots array<struct<digest:binary,doc_id:bigint,row:bigint,size:bigint>>"
PROBED = "row bigint, doc_id bigint, digest binary, bucket bigint, slot int"


def digest_rows(docs: DataFrame, historical: Column) -> DataFrame:
    """(row, doc_id, digest, old) of every row; `row` is a locator that is fixed once this is written."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"), F.coalesce(historical, F.lit(False)).alias("old"),
    )


def _winner() -> list[Column]:
    return [F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("size")]


def _words(digests: np.ndarray, seed: int) -> np.ndarray:
    """Three well mixed 63-bit numbers of each digest, one from each of three eighths of it."""
    x = digests.view("<u8").reshape(-1, 4)[:, :3] ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def slots_of(digests: np.ndarray, m: int, seed: int, shifts: np.ndarray) -> np.ndarray:
    """The slot, below m, that the hash gives each digest, member or not."""
    group, base, step = _words(digests, seed).T
    shift = shifts[group % len(shifts)]
    return (base % m + shift // m * (step % m) + shift % m) % m


def perfect_hash(digests: np.ndarray) -> tuple[int, np.ndarray]:
    """(seed, shifts) for which `slots_of` is one to one from different digests onto 0 .. m - 1."""
    m = len(digests)
    for seed in range(1 << 20):
        group, base, step = _words(digests, seed).T
        group, base, step = group % -(-m // GROUP), base % m, step % m
        shifts = np.zeros(-(-m // GROUP), np.int64)
        free = np.ones(m, bool)
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        members = np.split(order, starts[1:])
        for own in sorted(members, key=len, reverse=True):
            if len(own) == 1:  # any free slot will do
                shift = (int(np.argmax(free)) - int(base[own[0]])) % m
                at = (base[own] + shift) % m
            else:
                for d0 in range(64):
                    at = (base[own] + d0 * step[own]) % m
                    if len(np.unique(at)) < len(own):
                        continue
                    fits = np.logical_and.reduce([np.roll(free, -int(a)) for a in at])
                    if fits.any():
                        d1 = int(np.argmax(fits))
                        shift, at = d0 * m + d1, (at + d1) % m
                        break
                else:
                    break
            shifts[group[own[0]]] = shift
            free[at] = False
        if not free.any():
            return seed, shifts
    raise ValueError("digests repeat")


def _build(table: pa.Table) -> pa.Table:
    digests = _matrix(table["digest"])
    seed, shifts = perfect_hash(digests)
    place = np.empty(len(digests), np.int64)
    place[slots_of(digests, len(digests), seed, shifts)] = np.arange(len(digests))
    slots = table.select(["digest", "doc_id", "row", "size"]).take(pa.array(place)).to_pylist()
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("size", pa.int64())]))
    return pa.table({
        "bucket": pa.array([table["bucket"][0].as_py()], pa.int64()), "seed": pa.array([seed], pa.int64()),
        "shifts": pa.array([shifts.tobytes()], pa.binary()), "slots": pa.array([slots], kind),
    })


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def build_index(rows: DataFrame) -> tuple[DataFrame, int]:
    """The written index of the digests of `rows` (row, doc_id, digest), and its number of buckets."""
    ship_package(rows.sparkSession)
    distinct = cut_lineage(rows.groupBy("digest").agg(*_winner()))
    buckets = max(1, -(-distinct.count() // BUCKET_DIGESTS))
    dealt = distinct.select(_bucket(buckets).alias("bucket"), "digest", "keep.doc_id", "keep.row", "size")
    return cut_lineage(dealt.groupBy("bucket").applyInArrow(_build, INDEX)), buckets


def _probe(rows: pa.Table, index: pa.Table) -> pa.Table:
    slot = pa.nulls(len(rows), pa.int32())
    if len(rows) and len(index):
        digests, slots = _matrix(rows["digest"]), index["slots"].combine_chunks().values
        held = _matrix(slots.field("digest"))
        at = slots_of(digests, len(held), index["seed"][0].as_py(), np.frombuffer(index["shifts"][0].as_py(), np.int64))
        slot = pa.array(at.astype(np.int32), mask=(held[at] != digests).any(axis=1))
    return pa.table({**{c: rows[c] for c in ("row", "doc_id", "digest", "bucket")}, "slot": slot})


def lookup(rows: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(row, doc_id, digest, bucket, slot) of every row; slot is null for nonmembers."""
    ship_package(rows.sparkSession)
    dealt = rows.select("row", "doc_id", "digest", _bucket(buckets).alias("bucket"))
    full = dealt.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts")).where("parts > 1")
    full = cut_lineage(full)
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))
    dealt = dealt.join(full, "bucket", "left").select("row", "doc_id", "digest", "bucket", part.alias("part"))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1).cast("bigint")) - 1))
    copies = index.join(full, "bucket", "left").select("bucket", "seed", "shifts", "slots", parts.alias("part"))
    return dealt.groupBy("bucket", "part").cogroup(copies.groupBy("bucket", "part")).applyInArrow(_probe, PROBED)


def earlier_delivery() -> Column:
    """Stands in for a delivery date: rows with an even crc32 of the id are history."""
    return F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 2) == 0)


def dedup(docs: DataFrame, historical: Column) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, member) of every row.

    `historical` is true for the rows the index is built of; the answer is the same for every choice of
    them. `member` is true for later rows whose text is in the index, null for historical rows.
    """
    rows = cut_lineage(digest_rows(docs, historical))
    index, buckets = build_index(rows.where("old"))
    probed = cut_lineage(lookup(rows.where("not old"), index, buckets))
    again = probed.where("slot is not null").groupBy("bucket", "slot").agg(*_winner())
    slots = index.select("bucket", F.posexplode("slots").alias("slot", "s")).select("bucket", "slot", "s.*")
    seen = slots.join(again.withColumnRenamed("size", "more"), ["bucket", "slot"], "left").select(
        "digest", F.greatest(F.struct("doc_id", "row"), F.coalesce("keep", F.struct("doc_id", "row"))).alias("keep"),
        (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.lit(True).alias("known"),
    )
    fresh = probed.where("slot is null").groupBy("digest").agg(*_winner()).withColumn("known", F.lit(False))
    winners = cut_lineage(seen.unionByName(fresh))
    return rows.join(winners, "digest").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"),
        "digest", F.when(~F.col("old"), F.col("known")).alias("member"),
    )


def unseen(docs: DataFrame, history: DataFrame) -> DataFrame:
    """(doc_id, digest) of the later rows to take in: one of each text that the history does not hold."""
    rows = cut_lineage(digest_rows(docs, F.lit(False)))
    index, buckets = build_index(digest_rows(history, F.lit(True)))
    fresh = lookup(rows, index, buckets).where("slot is null").groupBy("digest").agg(*_winner())
    return fresh.select("keep.doc_id", "digest")
