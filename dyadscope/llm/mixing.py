"""Mixing sources to target weights, in fixed-length blocks of words.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share `share` times all
words by weight; no target passes `most` times its source's words, and what is over goes to the others
by weight (water filling).

Packing: each source's documents, in the order of a hash, form one stream of words, which is cut into
blocks of `block` words (the last may be shorter). Drawing: the output has `shards` shards of equal
numbers of slots; the sources' counts in each are multinomial draws by what each source has left of
its quota, where draws beyond what is left are drawn again, so that the sums meet the quotas. Slots of
a source are numbered through all shards; slot j takes block P(j) of pass j div blocks, where P is a
pseudorandom permutation (Feistel network with cycle walking) of its own for every source and pass: no
block is used more than `most` times. Joining: documents meet the slots by block index.

Prefix sums have two levels (hash bucket, then rows in a bucket), so a source with a third of all rows
is spread like any other. One row per source reaches the driver; the draws go back as sources x shards.

Defined cases: null and wordless texts have size 0 and are taken 0 times; a null source is a source;
rows with equal id and text are copies: each has its own place in the stream; an empty table gives an
empty result; other columns are not read by `mix` and are kept by `mixed_documents`, which writes one
row for each pass that takes words of a document (its text is the whole text if all are taken, else
the taken runs of words joined by line ends).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.llm.common import cut_lineage, ship_package, text_key

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 128
SHARDS = 64
SEED = 11
BUCKETS = 4096
#: Slots that one row expands to, and that one task makes.
CHUNK, TASK_SLOTS = 4096, 1 << 18

WORD = "[^\\x20\\x09-\\x0D]+"


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Image of each index under the pseudorandom permutation of range(size) that the key selects."""
    size = size.astype(np.uint64)
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.uint64) + np.uint64(1)) >> np.uint64(1), 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            mixed = (right ^ (k + np.uint64((r * 0x9E3779B97F4A7C15) & (2**64 - 1)))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, source, size) of every row."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, number, source_size, weight, target) of every source. All windows are over one row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*map(F.lit, weights))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("number", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(cycle, F.col("number") % len(weights) + 1).cast("double")).withColumn("top", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("top") / F.col("weight"), "number")
    earlier, later = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("top").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    rows = rows.withColumn("level", level)
    # Sources that are full come first in this order; the level of the first that is not holds for all the rest.
    open_level = F.min(F.when(F.col("top") > F.col("weight") * F.col("level"), F.struct(F.col("top") / F.col("weight"), F.col("number"), F.col("level").alias("level")))).over(whole)
    target = F.least("top", F.col("weight") * F.coalesce(open_level["level"], F.lit(float("inf"))))
    return rows.withColumn("target", target).select("source", F.col("number").cast("bigint").alias("number"), "source_size", "weight", "target")


def draw(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources counts: multinomial by what is left of the quotas, never more than that."""
    rng = np.random.default_rng(seed)
    left, out = quotas.astype(np.int64).copy(), np.zeros((shards, len(quotas)), np.int64)
    total = int(left.sum())
    for k in range(shards):
        need = total * (k + 1) // shards - total * k // shards
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += got
            left -= got
            need -= int(got.sum())
    return out


def streams(sizes: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows with words, with source number, start in the source's stream of words."""
    rows = sizes.where("size > 0").join(sources.select(F.col("source").alias("_s"), "number"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text_key", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("number", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("base"))
    inside = Window.partitionBy("number", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("bigint"))).join(sums, ["number", "bucket"])
    return placed.select("doc_id", "text_key", "source", "size", "number", (F.col("base") + F.col("start")).alias("start"))


def slots(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(number, shard, slot, pass, block) of every slot of the mix."""
    spark = sources.sparkSession
    ship_package(spark)
    known = sorted((r["number"], r["source_size"], r["target"]) for r in sources.collect() if r["source_size"])
    blocks = [-(-n // block) for _, n, _ in known]
    quotas = np.array([round(t * b / n) for (_, n, t), b in zip(known, blocks, strict=True)], np.int64)
    counts = draw(quotas, shards, seed) if len(quotas) else np.zeros((shards, 0), np.int64)
    first = np.vstack([np.zeros(len(quotas), np.int64), np.cumsum(counts, axis=0)[:-1]]) if len(quotas) else counts
    rows = [(known[s][0], k, int(first[k, s]), int(counts[k, s]), blocks[s]) for k in range(shards) for s in range(len(quotas)) if counts[k, s]]
    drawn = spark.createDataFrame(rows, "number bigint, shard int, first bigint, n bigint, blocks bigint")
    step = F.lit(CHUNK).cast("bigint")
    # The rows are few but long: a fixed number of tasks, as sizes in bytes would put them all in one.
    tasks = max(1, -(-int(quotas.sum()) // TASK_SLOTS))
    pieces = drawn.withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {CHUNK}L)"))).repartition(tasks, "number", "shard", "at")
    each = pieces.withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("n"), F.col("at") + step) - 1)))
    each = each.select("number", "shard", "slot", "blocks", F.expr("slot div blocks").alias("pass"))

    @F.pandas_udf("bigint")
    def place(slot: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permute(slot.to_numpy(), blocks.to_numpy(), key.to_numpy()))

    return each.select("number", "shard", "slot", "pass", place(F.col("slot") % F.col("blocks"), "blocks", F.xxhash64("number", "pass", F.lit(seed))).alias("block"))


def _meet(placed: DataFrame, drawn: DataFrame, block: int) -> DataFrame:
    """Documents' parts of blocks (words from and to, in the stream) with the number of passes that take the block."""
    first, last = F.expr(f"start div {block}L"), F.expr(f"(start + size - 1) div {block}L")
    parts = placed.withColumn("block", F.explode(F.sequence(first, last)))
    parts = parts.withColumn("lo", F.greatest("start", F.col("block") * block)).withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block))
    # A block is taken once in each pass, passes are filled one after the other: the count says which.
    times = drawn.groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"), F.collect_list("pass").alias("passes"))
    return parts.join(times, ["number", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0).cast("bigint")))


def _plan(docs: DataFrame, weights, share, most, block, shards, seed) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = cut_lineage(sized(docs))
    sources = cut_lineage(targets(sizes, weights, share, most))
    # Written out: the planner must see how large the slots are, it would take them for the few rows they are made from.
    drawn = cut_lineage(slots(sources, block, shards, seed))
    return sizes, sources, _meet(streams(sizes, sources, seed), drawn, block)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK,
        shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, size, source_size, target, taken) of every row; taken counts words, repeats included."""
    sizes, sources, parts = _plan(docs, weights, share, most, block, shards, seed)
    row = ["number", "start", "doc_id", "text_key", "source", "size"]
    taken = parts.groupBy(*row).agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken")).select("doc_id", "text_key", "source", "size", "taken")
    rows = taken.union(sizes.where("size = 0").select("doc_id", "text_key", "source", "size", F.lit(0).cast("bigint")))
    facts = sources.select(F.col("source").alias("_s"), "source_size", "target")
    return rows.join(facts, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "text_key", "size", "source_size", "target", "taken")


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, parts: list[dict]) -> str:
    """The parts (words from, to; in order) of a text: neighbours keep the spacing between them, others are joined by line ends."""
    spans = [m.span() for m in _WORDS.finditer(text)]
    runs: list[list[int]] = []
    for p in parts:
        if runs and runs[-1][1] == p["lo"]:
            runs[-1][1] = p["hi"]
        else:
            runs.append([p["lo"], p["hi"]])
    if runs == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[lo][0] : spans[hi - 1][1]] for lo, hi in runs)


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        runs = batch.column(batch.schema.get_field_index("_mix_runs"))
        texts = pa.array([cut(t.as_py(), r.as_py()) for t, r in zip(batch.column(at), runs, strict=True)], batch.schema.field(at).type)
        yield batch.set_column(at, batch.schema.field(at), texts)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK,
                    shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix as documents, same columns: for each pass, what it takes of a document; n_chars follows the text."""
    _, _, parts = _plan(docs, weights, share, most, block, shards, seed)
    taken = parts.where("times > 0").select("doc_id", "text_key", "number", "start", "lo", "hi", F.explode("passes").alias("pass"))
    runs = taken.groupBy("doc_id", "text_key", "number", "start", "pass").agg(
        F.array_sort(F.collect_list(F.struct((F.col("lo") - F.col("start")).alias("lo"), (F.col("hi") - F.col("start")).alias("hi")))).alias("runs")
    )
    runs = runs.select(F.col("doc_id").alias("_mix_id"), F.col("text_key").alias("_mix_key"), F.col("runs").alias("_mix_runs"))
    # Copies (equal id and text) all have runs of their own; their text is needed once.
    key = text_key(F.col("text"))
    copies = cut_lineage(docs.groupBy(F.col("doc_id").cast("bigint").alias("_id"), key.alias("_key")).count().where("count > 1").select("_id", "_key"))
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("_id")) & (key == F.col("_key"))
    once = docs if copies.isEmpty() else docs.join(copies, same, "left_anti").union(docs.join(copies, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    whole = once.join(runs, once["doc_id"].cast("bigint").eqNullSafe(F.col("_mix_id")) & (text_key(once["text"]) == F.col("_mix_key"))).drop("_mix_id", "_mix_key")
    out = whole.mapInArrow(_cut_batches, whole.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
