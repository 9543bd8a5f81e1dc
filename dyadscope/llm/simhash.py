"""Near-duplicates by SimHash fingerprints, with pigeonring filtering of candidates.

Fingerprint: 64 bits over the XXH64 (seed 42) values of a text's 3-word shingles, repeats included.
A bit is set if more than half of the values have it. A text without words has fingerprint 0.

Candidates: the fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most
three bits, some chain of consecutive segments starts so that its first l segments differ in at most
floor(3 l / 4) bits for every l: 0, 1, 2, 3. The first two links of the chain are the join key (a
segment that agrees, and the next one, agreeing or with one bit set in the other), the third prunes
the pairs before the full Hamming check. Buckets that are too full for pairs add the third segment to
the key, which leaves sixteen free bits: they are told apart by it, none is dropped.

Linear work per text in Python (vectorised bit counts), everything else in DataFrame operations.

Defined cases: null and empty texts have fingerprint 0 and link like others; a null doc_id gets a
component by its fingerprint; equal rows are folded by fingerprint and come back one by one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.llm import near_copies
from dyadscope.llm.common import ascii_words, cut_lineage, ship_package, text_bytes, text_key
from dyadscope.llm.graph import components
from dyadscope.llm.key_bits import key_bits, may_hold
from dyadscope.session import scratch_tables, shared_path

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Members of a bucket up to which its pairs are formed from the two-segment key.
PAIR_BUCKET = 256


def fingerprint(raw: bytes | None) -> int:
    """64-bit fingerprint of a text as a signed number; memory does not grow with the text."""
    ones, total = np.zeros(64, np.int64), 0
    few: list[bytes] = []
    for words in ascii_words(raw or b"", SHINGLE - 1):
        few = words
        if len(words) < SHINGLE:
            continue
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
        values = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(words) - SHINGLE + 1)
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(values)
    if not total:
        value = xxhash.xxh64_intdigest(b" ".join(few), SEED) if few else 0
    else:
        value = sum(1 << int(b) for b in np.flatnonzero(2 * ones > total))
    return value - (1 << 64) if value >> 63 else value


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([fingerprint(x.as_py()) for x in batch.column(2)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp) of every row."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), text_bytes(F.col("text")).alias("raw")
    )
    return rows.mapInArrow(_batches, "doc_id bigint, text_key bigint, fp bigint")


def _ring(prints: DataFrame) -> DataFrame:
    """Four rows a fingerprint: turned so that the chain starts in the lowest segment."""
    turned = [
        F.struct(F.lit(i).alias("start"), (F.shiftleft("fp", 64 - 16 * i).bitwiseOR(F.shiftrightunsigned("fp", 16 * i)) if i else F.col("fp")).alias("ring"))
        for i in range(4)
    ]
    return prints.select("fp", F.explode(F.array(*turned)).alias("x")).select("fp", "x.start", "x.ring")


def _masks(low: int, most: int) -> Column:
    """Array of all ways to mark up to `most` (one or two) of the sixteen bits that begin at bit `low`."""
    one = [0, *(1 << b for b in range(low, low + 16))]
    return F.array(*[F.lit(m).cast("bigint") for m in (one if most == 1 else sorted({a | b for a in one for b in one}))])


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _within(pairs: DataFrame) -> DataFrame:
    """The third link of the chain first, then the whole distance."""
    three = F.lit((1 << 48) - 1)
    third = F.bit_count(F.col("ring").bitwiseXOR(F.col("other")).bitwiseAND(three)) <= 2
    return pairs.where(third & (_distance(F.col("ring"), F.col("other")) <= MAX_DISTANCE))


def links(prints: DataFrame, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """(u, v) of distinct fingerprints that differ in one to three bits; a pair may come up to four times."""
    ring = _ring(prints)
    low2 = F.col("ring").bitwiseAND(F.lit((1 << 32) - 1))
    keyed = ring.withColumn("key", low2)
    # Of two values that differ in one bit, the one without it reaches the other by setting it.
    probe = ring.withColumn("bit", F.explode(_masks(16, 1))).where("ring & bit = 0").select("start", "ring", "fp", low2.bitwiseOR(F.col("bit")).alias("key"))
    full = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > pair_bucket).select("start", "key")
    full = cut_lineage(full)
    home = keyed.select("start", "key", F.col("ring").alias("other"), F.col("fp").alias("other_fp"))
    differ = F.col("fp") != F.col("other_fp")
    # Spark takes what an explode makes for as large as what it is made of. Such rows are merged: a broadcast would hold them all on the driver.
    if full.isEmpty():
        light, heavy = _within(probe.hint("merge").join(home, ["start", "key"]).where(differ)), None
    else:
        light = _within(probe.hint("merge").join(home.join(full, ["start", "key"], "left_anti"), ["start", "key"]).where(differ))
        # The third segment joins the key: the probing side writes out its values with up to two bits flipped.
        third = F.shiftrightunsigned("ring", 32).bitwiseAND(F.lit(0xFFFF))
        near = probe.join(full, ["start", "key"], "left_semi").withColumn("mask", F.explode(_masks(0, 2))).withColumn("third", third.bitwiseXOR(F.col("mask")))
        there = home.join(full, ["start", "key"], "left_semi").withColumn("third", F.shiftrightunsigned("other", 32).bitwiseAND(F.lit(0xFFFF)))
        heavy = _within(near.hint("merge").join(there, ["start", "key", "third"]).where(differ))
    found = light if heavy is None else light.select("fp", "other_fp").union(heavy.select("fp", "other_fp"))
    return found.select(F.col("fp").alias("u"), F.col("other_fp").alias("v"))


def _rooted(docs: DataFrame, pair_bucket: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) of every row, and (fp, root, component_id) of every different fingerprint."""
    rows = cut_lineage(fingerprints(docs))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(classes.select("fp"), pair_bucket))
    least = linked.join(classes, linked["node"] == classes["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = linked.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    known = classes.join(of_print, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return rows, cut_lineage(known)


def near_duplicates(docs: DataFrame, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """(doc_id, text_key, fp, component_id) of every row; component_id is the smallest doc_id reachable."""
    rows, known = _rooted(docs, pair_bucket)
    return rows.join(known, "fp", "left").select("doc_id", "text_key", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies (`near_copies`: five words, similarity 0.8): the row of smallest (doc_id, text key), rows without doc_id last; same columns as `docs`.

    Components are told apart by their root, so unlike texts under one doc_id stay. Repeated rows are folded to
    one. Only texts whose key may be that of a row to drop or to fold are shuffled; the others stay where they are read.
    """
    spark = docs.sparkSession
    special_path, unclear_path = shared_path(spark), shared_path(spark)
    with scratch_tables(spark):  # only the rows to drop, and those that have to be looked at, are needed later
        rows, known = near_copies.rooted(docs)
        row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
        each = rows.join(known, "fp").groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
        kept = each.groupBy("root").agg(F.min(row).alias("row"))
        all_rows = each.join(kept, "root").select("doc_id", "text_key", "n", (row == F.col("row")).alias("stays"))
        all_rows.where("not stays or n > 1").select(
            F.col("doc_id").alias("_near_id"), F.col("text_key").alias("_near_key"), F.col("stays").alias("_near_stays")).write.parquet(special_path)
    special = spark.read.schema("_near_id bigint, _near_key bigint, _near_stays boolean").parquet(special_path)
    bits = key_bits(special, "_near_key")

    @F.pandas_udf("boolean")
    def may_go(key: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bits, key.to_numpy()))

    key = text_key(docs["text"])
    hit = docs["doc_id"].cast("bigint").eqNullSafe(F.col("_near_id")) & (key == F.col("_near_key"))
    looked = docs.where(may_go(key)).join(special, hit, "left").where("coalesce(_near_stays, true)").drop("_near_id", "_near_key")
    looked.write.parquet(unclear_path)
    unclear = spark.read.schema(looked.schema).parquet(unclear_path)
    folded = unclear.where("_near_stays is not null").dropDuplicates(["doc_id", "text"])
    return docs.where(~may_go(key)).union(unclear.where("_near_stays is null").drop("_near_stays")).union(folded.drop("_near_stays"))
