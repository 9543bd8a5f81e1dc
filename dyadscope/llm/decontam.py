"""Benchmark decontamination over a distributed positional inverted index.

Index: the corpus is cut into segments (the rows of one Arrow batch). A segment is one row that holds
its documents and, for each term in order, the sorted positions of that term; documents follow one
another with an unused position between them. Segments are written to the shared folder and stay
where their documents were read: nothing is shuffled, a segment is the unit of recovery. If the
benchmark's vocabulary is within `max_vocabulary` terms only those terms have postings, else all have.

Search: the phrases of the benchmark (windows of `window` consecutive words, or a whole item of fewer)
go to the segments in blocks of bounded size. In a segment the terms of a phrase are ordered by the
length of their lists, rarest first; the rarest list less its term's offset gives the starts, and each
further list, adjusted by its own offset, is intersected with what is left. `proximity` finds places
where all terms of an item stand within a span of words, in any order.

Terms are XXH64 values of lower-cased words, so a false match needs equal 64-bit values.

Defined cases: a null or wordless text has no words, no hits and is not contaminated; items without
words match nothing; equal items are all reported; items without id hit like others, together count
as one in `n_items` and are not named in `items` of `contamination` (`matches` has one null for them);
rows with equal ids are judged one by one; empty tables give no rows, an empty benchmark gives no hits;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadscope.llm.common import cut_lineage, drop_rows, ship_package, text_bytes, text_key

WINDOW = 13
#: A document is contaminated if hit words times this are at least its words.
HIT_SHARE = 20
MAX_VOCABULARY = 2_000_000
#: Bytes of benchmark text that one search pass takes to the segments.
BLOCK_BYTES = 8 << 20

_WORD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

#: Stands for a null doc_id in the index.
NO_ID = -(1 << 63)

INDEX = "docs binary, lengths binary, keys binary, terms binary, ends binary, places binary"


def words(raw: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and bytes beyond ASCII."""
    return raw.translate(_WORD).split() if raw else []


def _term(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _segment_rows(vocabulary: dict[bytes, int] | None):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame([_segment(batch, vocabulary)])

    return build


def _segment(batch: pd.DataFrame, vocabulary: dict[bytes, int] | None) -> dict:
    lengths = np.zeros(len(batch), np.int64)
    terms, places, start = [], [], 0
    for i, raw in enumerate(batch["raw"]):
        found = words(raw)
        lengths[i] = len(found)
        if vocabulary is None:
            codes = np.fromiter(map(_term, found), np.uint64, len(found))
            at = np.arange(len(found))
        else:
            codes = np.fromiter(map(vocabulary.get, found, (0 for _ in found)), np.uint64, len(found))
            at = np.flatnonzero(codes)
            codes = codes[at]
        terms.append(codes)
        places.append(at + start)
        start += len(found) + 1
    code, place = np.concatenate(terms), np.concatenate(places).astype(np.int64)
    order = np.argsort(code, kind="stable")
    unique, counts = np.unique(code, return_counts=True)
    docs = batch["doc_id"].to_numpy(np.int64)
    return {
        "docs": docs.tobytes(), "lengths": lengths.tobytes(), "keys": batch["text_key"].to_numpy(np.int64).tobytes(),
        "terms": unique.tobytes(), "ends": np.cumsum(counts).astype(np.int64).tobytes(), "places": place[order].astype(np.int64 if start >> 31 else np.int32).tobytes(),
    }


class Segment:
    """Postings of one index row."""

    def __init__(self, row) -> None:
        self.docs, self.lengths, self.keys = (np.frombuffer(row[k], np.int64) for k in ("docs", "lengths", "keys"))
        self.firsts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        self.terms, self.ends = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["ends"], np.int64)
        n = int(self.ends[-1]) if len(self.ends) else 0
        self.places = np.frombuffer(row["places"], np.int64 if n and len(row["places"]) == 8 * n else np.int32).astype(np.int64)
        #: Term rank and position in one number: sorted, so that a list is looked up by binary search.
        ranks = np.repeat(np.arange(len(self.terms)), np.diff(self.ends, prepend=0))
        self.span = int(self.firsts[-1] + self.lengths[-1] + 2) if len(self.docs) else 1
        self.sorted = ranks * self.span + self.places

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """Rank of each term here; -1 where it does not occur."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        want = rank * self.span + place
        at = np.minimum(np.searchsorted(self.sorted, want), len(self.sorted) - 1)
        return (self.sorted[at] == want) & (place >= 0) & (place < self.span)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, place, "right") - 1


def phrase_starts(seg: Segment, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, start) of each occurrence of phrases of one length (rows of term ids)."""
    rank = seg.ranks(phrases)
    live = np.flatnonzero((rank >= 0).all(axis=1))
    if not len(live):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank = rank[live]
    counts = np.diff(seg.ends, prepend=0)[rank]
    order = np.argsort(counts, axis=1, kind="stable")  # rarest first
    row = np.arange(len(live))
    lead = order[:, 0]
    first, n = rank[row, lead], counts[row, lead]
    which = np.repeat(row, n)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    start = seg.places[np.repeat(seg.ends[first] - n, n) + inside] - lead[which]
    for k in range(1, phrases.shape[1]):
        off = order[which, k]
        ok = seg.has(rank[which, off], start + off)
        which, start = which[ok], start[ok]
    return live[which], start


def near_spans(seg: Segment, terms: np.ndarray, span: int) -> np.ndarray:
    """Starts of spans of `span` words of one document that hold every one of the terms."""
    rank = seg.ranks(np.unique(terms))
    if not len(rank) or (rank < 0).any():
        return np.empty(0, np.int64)
    counts = np.diff(seg.ends, prepend=0)[rank]
    lists = [seg.places[seg.ends[r] - c : seg.ends[r]] for r, c in sorted(zip(rank, counts, strict=True), key=lambda x: x[1])]
    starts = np.unique((lists[0][:, None] - np.arange(span)).ravel())
    starts = starts[starts >= 0]
    for places in lists:
        at = np.minimum(np.searchsorted(places, starts), len(places) - 1)
        starts = starts[(places[at] >= starts) & (places[at] < starts + span)]
    doc = seg.doc_of(starts)
    return starts[starts + span <= seg.firsts[doc] + seg.lengths[doc]]


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the same words; input sorted by start."""
    top = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > top[:-1]])
    return start[new], top[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


def _hits(item_ids: list[str | None], tokens: list[np.ndarray], window: int, slop: int | None):
    """Task that searches one block of items in each segment."""
    groups: dict[int, dict[tuple, list[int]]] = {}
    if slop is None:
        for i, t in enumerate(tokens):
            width = min(window, len(t))
            for w in {tuple(t[k : k + width]) for k in range(len(t) - width + 1)} if width else ():
                groups.setdefault(width, {}).setdefault(w, []).append(i)
    tables = {n: (np.array(list(g), np.uint64).reshape(-1, n), list(g.values())) for n, g in groups.items()}

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                seg = Segment(row)
                docs, starts, ends, items = [], [], [], []
                if slop is None:
                    for n, (phrases, owners) in tables.items():
                        which, at = phrase_starts(seg, phrases)
                        docs.append(seg.doc_of(at)); starts.append(at); ends.append(at + n); items.append([owners[w] for w in which])  # noqa: E702
                else:
                    for i, t in enumerate(tokens):
                        if len(t):
                            at = near_spans(seg, t, len(t) + slop)
                            docs.append(seg.doc_of(at)); starts.append(at); ends.append(at + len(t) + slop); items.append([[i]] * len(at))  # noqa: E702
                doc = np.concatenate(docs) if docs else np.empty(0, np.int64)
                if not len(doc):
                    continue
                start, end = np.concatenate(starts), np.concatenate(ends)
                owner = [x for part in items for x in part]
                order = np.lexsort((start, doc))
                out = []
                for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
                    d = int(doc[part[0]])
                    lo, hi = _union(start[part], end[part])
                    ids = sorted({item_ids[i] for p in part for i in owner[p]}, key=lambda x: (x is None, x or ""))
                    out.append((row["segment"], d, [{"start": int(a), "end": int(b)} for a, b in zip(lo - seg.firsts[d], hi - seg.firsts[d], strict=True)], ids))
                yield pd.DataFrame(out, columns=["segment", "number", "spans", "items"])

    return search


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.to_dict("records"):
            ids, lengths, keys = (np.frombuffer(row[k], np.int64) for k in ("docs", "lengths", "keys"))
            yield pd.DataFrame({"segment": row["segment"], "number": np.arange(len(ids)), "doc_id": ids, "text_key": keys, "n_words": lengths})


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_bytes(F.col("text")).alias("raw")).where("raw is not null")


def _vocabulary(benchmark: DataFrame, limit: int) -> dict[bytes, int] | None:
    """Terms of the benchmark, or none if there are more than the limit."""
    def distinct(batches):
        for batch in batches:
            yield pd.DataFrame({"word": sorted({w for raw in batch["raw"] for w in words(raw)})}, dtype=object)

    found = _items(benchmark).select("raw").mapInPandas(distinct, "word binary").distinct().limit(limit + 1).collect()
    return {bytes(r["word"]): _term(bytes(r["word"])) for r in found} if len(found) <= limit else None


def build_index(docs: DataFrame, benchmark: DataFrame | None = None, max_vocabulary: int = MAX_VOCABULARY) -> DataFrame:
    """The written index of `docs`; with a benchmark, postings only for its terms if they are few enough."""
    ship_package(docs.sparkSession)
    vocabulary = None if benchmark is None else _vocabulary(benchmark, max_vocabulary)
    doc_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    rows = docs.select(doc_id.alias("doc_id"), text_key(F.col("text")).alias("text_key"), text_bytes(F.col("text")).alias("raw"))
    return cut_lineage(rows.mapInPandas(_segment_rows(vocabulary), INDEX).withColumn("segment", F.expr("uuid()")))


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Items in blocks by the hash of their id; each block is read on its own."""
    items = _items(benchmark)
    size = items.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(n)) == k).collect()
        yield [r["item_id"] for r in rows], [np.array([_term(w) for w in words(bytes(r["raw"]))], np.uint64) for r in rows]


def _search(index: DataFrame, benchmark: DataFrame, window: int, slop: int | None, block_bytes: int) -> DataFrame:
    schema = "segment string, number bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    parts = [cut_lineage(index.mapInPandas(_hits(ids, tokens, window, slop), schema)) for ids, tokens in _blocks(benchmark, block_bytes)]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    return hits.groupBy("segment", "number").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, text_key, n_words, spans of hit words, items with an occurring window."""
    return _of_documents(index, _search(index, benchmark, window, None, block_bytes))


def proximity(index: DataFrame, items: DataFrame, slop: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As `matches`, for spans of an item's length plus `slop` words that hold all its words in any order."""
    return _of_documents(index, _search(index, items, 0, slop, block_bytes))


def _of_documents(index: DataFrame, hits: DataFrame) -> DataFrame:
    docs = index.select("segment", "docs", "lengths", "keys").mapInPandas(
        _documents, "segment string, number bigint, doc_id bigint, text_key bigint, n_words bigint"
    )
    none = F.array().cast("array<string>")
    return docs.join(hits, ["segment", "number"], "left").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text_key", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), F.coalesce("items", none).alias("items")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hit_share: int = HIT_SHARE,
                  max_vocabulary: int = MAX_VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit, n_items, items, contaminated (n_hit > 0 and hit_share * n_hit >= n_words)."""
    found = matches(build_index(docs, benchmark, max_vocabulary), benchmark, window, block_bytes)
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0).cast("bigint"))).alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    return found.withColumn("n_hit", covered).select(
        "doc_id", "text_key", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.filter("items", F.isnotnull).alias("items"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * hit_share >= F.col("n_words"))).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that are not contaminated; same columns."""
    judged = contamination(docs, benchmark, **options)
    return drop_rows(docs, cut_lineage(judged.where("contaminated").select("doc_id", "text_key")))
