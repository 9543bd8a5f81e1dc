"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors become integers: floor(1024 x) of each component. An index block (the rows of one Arrow batch)
holds its vectors and, for every dimension, the order of their values. For a query the lists are read
from their best ends in steps; every vector met is scored in full at once. The values at the depth
reached bound the score of all vectors not met yet; reading stops when the k-th result so far, over all
blocks that the task has searched, is greater than that bound. A bound that is only equal does not
stop it, as a smaller id may still win a tie.

Queries go to the index in passes of at most `pass_queries`, a proven size for what is sent to every
task. A task returns at most k rows a query; the best k of those are taken by query. No pair of vectors
is ever a row, and nothing is approximate.

Defined cases: vectors that are null or hold a null or non-finite component take no part, as query or
candidate; shorter vectors count as filled up with zeros; rows with the id of the query are not its
candidates; equal rows are all candidates; rows with a null id take no part; sums beyond 64 bits
are computed in Python integers, ordered as doubles and saturate in the output; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.llm.common import cut_lineage, ship_package

K = 10
SCALE = 1024
PASS_QUERIES = 32_768
#: First number of list entries read at once in each dimension; doubled at each step.
STEP = 64


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part; v has long components."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(sound).select("vec_id", F.transform("v", lambda x: _floor(x)).alias("v"))


def _floor(x: Column) -> Column:
    return F.floor(F.lit(float(SCALE)) * x).cast("bigint")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows padded with zeros to the longest."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            m = _matrix(batch.column(1))
            order = np.argsort(m, axis=0, kind="stable").T.astype(np.int32)
            ids = np.asarray(batch.column(0), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([m.shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, m, np.ascontiguousarray(order)))],
                ["dims", "ids", "vectors", "orders"],
            )


def build_index(vectors: DataFrame) -> DataFrame:
    """Written blocks of integer vectors with the sorted order of every dimension."""
    ship_package(vectors.sparkSession)
    return cut_lineage(vectors.select("vec_id", "v").mapInArrow(_block, "dims int, ids binary, vectors binary, orders binary"))


def _exact(dtype_bound: int) -> type:
    return np.float64 if dtype_bound < 1 << 53 else np.int64 if dtype_bound < 1 << 63 else object


class Best:
    """The k best (score, then smaller id) so far of one query."""

    def __init__(self, k: int) -> None:
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.ids) == self.k:
            able = scores >= self.scores[-1]
            ids, scores = ids[able], scores[able]
        if not len(ids):
            return
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        if scores.dtype == object:
            order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k]
        else:
            order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]

    def beats(self, bound: int) -> bool:
        return len(self.ids) == self.k and self.scores[-1] > bound


def search_block(query_id: int, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, orders: np.ndarray, best: Best) -> int:
    """Threshold algorithm over one block; the number of vectors scored."""
    d = min(len(query), vectors.shape[1])
    n, q = len(ids), query[:d]
    dims = np.flatnonzero(q)
    top = int(np.abs(q).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(1, d)
    kind = _exact(top)
    if not len(dims):
        own = ids != query_id
        best.add(ids[own], np.zeros(int(own.sum()), np.int64))
        return n
    weights = q[dims].astype(kind)
    rows, columns = orders[dims], vectors[:, dims]
    rows = np.where((q[dims] > 0)[:, None], rows[:, ::-1], rows)  # best end first
    met = ids == query_id
    at, step, scored = 0, STEP, 0
    while at < n:
        end = min(n, at + step)
        new = np.zeros(n, bool)
        new[rows[:, at:end].ravel()] = True
        new &= ~met
        met |= new
        found = np.flatnonzero(new)
        if len(found):
            scored += len(found)
            scores = columns[found].astype(kind) @ weights
            best.add(ids[found], scores if kind is object else scores.astype(np.int64))
        depth = columns[rows[:, end - 1], np.arange(len(dims))].astype(kind)
        if best.beats(int((depth * weights).sum())):
            break
        at, step = end, step * 2
    return scored


def _search(query_ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(k) for _ in query_ids]
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.frombuffer(row.ids, np.int64)
                vectors = np.frombuffer(row.vectors, np.int64).reshape(len(ids), row.dims)
                orders = np.frombuffer(row.orders, np.int32).reshape(row.dims, len(ids))
                for i, qid in enumerate(query_ids):
                    search_block(int(qid), queries[i], ids, vectors, orders, best[i])
        limit = (1 << 63) - 1
        for qid, b in zip(query_ids, best, strict=True):
            if len(b.ids):
                score = [max(-limit - 1, min(limit, int(s))) for s in b.scores]
                yield pd.DataFrame({"query_id": int(qid), "vec_id": b.ids, "score": score, "beyond": [float(s) for s in b.scores]})

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, pass_queries: int = PASS_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of each query, ties to the smaller vec_id.

    Both tables are (vec_id, v) as `integer_vectors` makes them.
    """
    spark = vectors.sparkSession
    index = build_index(vectors)
    queries = cut_lineage(queries)
    passes = max(1, -(-queries.count() // pass_queries))
    # `beyond` orders scores that saturate at 64 bits.
    schema = "query_id bigint, vec_id bigint, score bigint, beyond double"
    found = spark.createDataFrame([], schema)
    for p in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).collect()
        if rows:
            width = max(len(r["v"]) for r in rows)
            matrix = np.zeros((len(rows), width), np.int64)
            for i, r in enumerate(rows):
                matrix[i, : len(r["v"])] = r["v"]
            found = found.union(cut_lineage(index.mapInPandas(_search(np.array([r["vec_id"] for r in rows], np.int64), matrix, k), schema)))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
