"""Ranked lexical search by dense blocked multiplication: item weights times document impacts, exactly.

Score of a document for an item: over the item's different terms, the term's weight floor(1000 ln((2N + 2) /
(2 df + 1))) times its impact (10^9 tf) div (1000 tf + 20 m) in the document, m = 50 + (50 n N) div L; N documents
with terms, L their terms, n the document's, df documents with the term.

Items go to the documents in passes of at most `PASS_BYTES` of text. One reading of the texts in a pass
writes tiles: for `TILE_DOCS` documents their ids, lengths and the counts of the items' terms. From the
tiles come N, L and df, sums that combine in the tasks. Then, tile by tile: the items are cut into blocks
of `BLOCK_ITEMS`, whose terms make a compact vocabulary of at most `BLOCK_TERMS` columns (a larger one is
cut further); the tile's impacts are spread out to a dense float64 matrix over those columns and multiplied
with the block's weights by BLAS. Impacts are below 10^6 and weights below 45,000, so a sum over a block's
columns is an integer below 2^53 and exact in any order of addition; sums of blocks are added as 64-bit integers.
Every task keeps the k best documents of each item, ties to the smaller id included; those of groups of tasks and
then of all tasks are ranked. No pair of document and item is a row unless it is among the best of a task.

Defined cases: null and wordless texts and items have no terms and no score; scores of 0 give no row; rows
with equal ids are documents each; rows without id come after all others of their score; equal items are
answered one by one; empty tables give no rows; other columns are not read; a very long text is cut into
pieces between words while its terms are counted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.llm.common import cut_lineage, ship_package, text_bytes

K = 50
PASS_BYTES = 4 << 20
TILE_DOCS = 1024
BLOCK_ITEMS = 64
BLOCK_TERMS = 4096
#: Impacts are below this; a product of it, of any weight and of BLOCK_TERMS is below 2^53.
IMPACT_BOUND = 10**6
WEIGHT_BOUND = 45_000
#: Tasks whose best documents are ranked together before all are.
RANK_TASKS = 64

#: Digits, letters and bytes beyond ASCII stand for themselves, A-Z for a-z, all else for a space.
_TERM_BYTES = bytes((c | 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

TILES = "ids binary, no_id binary, lengths binary, ends binary, terms binary, counts binary"
FOUND = "item int, item_id bigint, doc_id bigint, score bigint"


def term_lists(raw: bytes | None, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """Terms of a text in order, in lists of about `step` bytes."""
    raw = (raw or b"").translate(_TERM_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + step)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of each count; `lengths` is the document's number of terms."""
    if 50 * int(lengths.max(initial=0)) * n_docs >= 1 << 63:
        m = 50 + (50 * lengths.astype(object) * n_docs // n_terms).astype(np.int64)
    else:
        m = 50 + 50 * lengths * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _tiles(vocabulary: dict[bytes, int]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, TILE_DOCS):
                batch = big.slice(at, TILE_DOCS)
                lengths, ends, terms, counts = [], [], [], []
                for raw in batch.column(1):
                    held, n = Counter(), 0
                    for found in term_lists(raw.as_py()):
                        n += len(found)
                        held.update(found)
                    own = [(vocabulary[t], c) for t, c in held.items() if t in vocabulary]
                    lengths.append(n)
                    terms += [t for t, _ in own]
                    counts += [c for _, c in own]
                    ends.append(len(terms))
                ids = batch.column(0)
                parts = (
                    ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False),
                    np.array(lengths, np.int64), np.array(ends, np.int64), np.array(terms, np.int32), np.array(counts, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], TILES.replace(" binary", "").split(", "))

    return build


class Tile:
    """Documents of one row: ids, lengths and the counts of the vocabulary's terms."""

    def __init__(self, row: dict) -> None:
        self.ids, self.lengths, ends, self.counts = (np.frombuffer(row[c], np.int64) for c in ("ids", "lengths", "ends", "counts"))
        self.no_id, self.terms = np.frombuffer(row["no_id"], bool), np.frombuffer(row["terms"], np.int32)
        self.docs = np.repeat(np.arange(len(self.ids)), np.diff(ends, prepend=0))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Tile(batch.slice(i, 1).to_pylist()[0])


def _counted(n_vocabulary: int):
    """(term, n): documents that hold a term; -1 and -2 count documents with terms, and their terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(n_vocabulary, np.int64), 0, 0
        for tile in _read(batches):
            df += np.bincount(tile.terms, minlength=n_vocabulary)
            docs += int((tile.lengths > 0).sum())
            length += int(tile.lengths.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*held, -1, -2], pa.int64()), pa.array([*df[held], docs, length], pa.int64())], ["term", "n"])

    return count


class Block:
    """Weights of some items over the compact vocabulary of their terms."""

    def __init__(self, first: int, items: list[dict[int, int]]) -> None:
        self.first = first
        self.terms = np.array(sorted({t for item in items for t in item}), np.int64)
        self.weights = np.zeros((len(self.terms), len(items)))
        for j, item in enumerate(items):
            at = np.searchsorted(self.terms, np.array(sorted(item), np.int64))
            self.weights[at, j] = [item[t] for t in sorted(item)]

    def scores(self, tile: Tile, impact: np.ndarray) -> np.ndarray:
        """Exact scores, documents by items."""
        out = np.zeros((len(tile.ids), self.weights.shape[1]), np.int64)
        for at in range(0, len(self.terms), BLOCK_TERMS):
            own, weights = self.terms[at : at + BLOCK_TERMS], self.weights[at : at + BLOCK_TERMS]
            if int(weights.sum(axis=0).max(initial=0)) * IMPACT_BOUND >= 1 << 53:
                raise OverflowError("weights beyond their bound")
            place = np.minimum(np.searchsorted(own, tile.terms), len(own) - 1)
            here = own[place] == tile.terms
            if here.any():
                dense = np.zeros((len(tile.ids), len(own)))
                dense[tile.docs[here], place[here]] = impact[here]
                out += (dense @ weights).astype(np.int64)
        return out


class Best:
    """The k best documents of one item: greatest score, then id, rows without id last."""

    def __init__(self, k: int) -> None:
        self.k, self.floor = k, 1
        self.scores, self.ids, self.no_id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """Scores of at least `floor`; equal to the k-th so far is enough, as the id may be smaller."""
        scores, ids, no_id = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.no_id, no_id])
        order = np.lexsort((ids, no_id, -scores))[: self.k]
        self.scores, self.ids, self.no_id = scores[order], ids[order], no_id[order]
        if len(order) == self.k:
            self.floor = int(self.scores[-1])


def _ranked(item_ids: list[int | None], items: list[dict[int, int]], n_docs: int, n_terms: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Block(i, items[i : i + BLOCK_ITEMS]) for i in range(0, len(items), BLOCK_ITEMS)]
        best = [Best(k) for _ in items]
        for tile in _read(batches):
            impact = impacts(tile.counts, tile.lengths[tile.docs], n_docs, n_terms)
            for block in blocks:
                scores = block.scores(tile, impact)
                floors = np.array([b.floor for b in best[block.first : block.first + BLOCK_ITEMS]])
                able = scores >= floors
                for j in np.flatnonzero(able.any(axis=0)):
                    rows = np.flatnonzero(able[:, j])
                    best[block.first + j].add(scores[rows, j], tile.ids[rows], tile.no_id[rows])
        for i, b in enumerate(best):
            if len(b.ids):
                n = len(b.ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int32()), pa.array([item_ids[i]] * n, pa.int64()), pa.array(b.ids, mask=b.no_id), pa.array(b.scores)], ["item", "item_id", "doc_id", "score"])

    return search


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def _pass(texts: DataFrame, rows: list, k: int) -> DataFrame:
    """Best documents of some items, ranked."""
    lists = [sorted({t for part in term_lists(r["raw"]) for t in part}) for r in rows]
    vocabulary = {t: i for i, t in enumerate(sorted({t for own in lists for t in own}))}
    tiles = cut_lineage(texts.mapInArrow(_tiles(vocabulary), TILES))
    sums = dict(map(tuple, tiles.mapInArrow(_counted(len(vocabulary)), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()))
    n_docs, n_terms = sums.get(-1, 0), sums.get(-2, 0)
    items = [{vocabulary[t]: weight(n_docs, sums.get(vocabulary[t], 0)) for t in own} for own in lists]
    found = tiles.mapInArrow(_ranked([r["item_id"] for r in rows], items, n_docs, max(1, n_terms), k), FOUND)
    grouped = cut_lineage(_first(found.withColumn("tasks", (F.spark_partition_id() / RANK_TASKS).cast("int")), ["item", "tasks"], k).drop("rank"))
    return _first(grouped, ["item"], k).select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, k: int = K, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of greatest score above 0 of each item."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(F.col("text")).alias("raw"))
    held = cut_lineage(items.where("text is not null").select(
        F.col("item_id").cast("bigint").alias("item_id"), text_bytes(F.col("text")).alias("raw"), F.monotonically_increasing_id().alias("row")))
    passes = max(1, -(-int(held.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) // pass_bytes))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for p in range(passes):
        rows = held.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).collect()
        if rows:
            out = out.union(_pass(texts, rows, k))
    return out
