"""Near copies by Jaccard similarity of five-word shingles, pruned by SimHash chains: the pipeline's stage.

Two texts are near copies if their shingle sets are equal or have a Jaccard similarity of 0.8 or more.
A text of fewer words is one shingle; texts without words have the empty set. Equal sets are one class.

Candidates: with the shingles of all classes in one order, two sets of that similarity share one among
the first n - ceil(0.8 n) + 1 of each. Only shingles of several classes are looked at. In `ROUNDS` rounds
every class meets one class of each of its shingles, so a group of near copies costs a comparison a
member and not its pairs; then the classes that are still in different components meet in pairs. If shingles
of more than `FULL` classes would make more than `PAIRS` pairs for each row of the index, they are put last in
the order and the beginnings are cut again (at most `PASSES` times; what is left then, texts made of such
shingles only, meets in pairs). The first order puts last what is frequent in a sample. The order changes
the work, never the answer.

A pair meets at the first shingle that both have in the order: what follows there must be enough for the
similarity. At a later one it does not meet again if one of the two indexed shingles before it is shared as well.

Pruning: a candidate pair goes on if the sizes allow the similarity, if the sets can differ in few enough elements (by
256 parities, bits that the difference of two sets must explain) and if the 256-bit SimHash values of the
sets form a pigeonring chain within `RADIUS` bits: from one of four 64-bit segments on, the first l differ
in at most RADIUS l / 4 bits for every l. At a similarity of 0.8 fingerprints differ in about 39 bits with
a deviation of 6, unlike texts in 128, so a chain within 70 bits is missed by fewer than one pair in a million.
Sets of at most `SMALL` shingles, whose fingerprints vary more, are not pruned.

Every pair that is left is checked by its whole sets, once. Those are made again from the texts of the classes in
such pairs, where the texts are read: no text is shuffled to find them, only the sets of candidates are.

Defined cases: null, empty and wordless texts are one class; rows without id take part like others; equal
rows have one class; an empty table gives no rows; columns other than doc_id and text are not read.
Shingles, sets and texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadscope.llm.common import ascii_words, cut_lineage, ship_package, text_bytes, text_key
from dyadscope.llm.graph import components
from dyadscope.llm.key_bits import key_bits, may_hold
from dyadscope.session import scratch_tables, shared_path

SHINGLE = 5
SEED = 42
ROUNDS = 2
RADIUS, SMALL, SEGMENTS = 70, 16, 4
#: Classes of a shingle from which it can be put last, times the beginnings are cut, and pairs a row of the index for which they are not cut again.
FULL, PASSES, PAIRS = 128, 3, 16
#: Classes in the sample, count from which a shingle is frequent there, and most shingles that are put last.
SAMPLE, FREQUENT, MOST = 10_000, 3, 1_000_000
#: Bytes of sets that a worker gives back at once.
OUT_BYTES = 4 << 20


def shingles(raw: bytes | None) -> np.ndarray:
    """Sorted different hashes of the five-word shingles of a text."""
    parts, few = [], []
    for words in ascii_words(raw or b"", SHINGLE - 1):
        few = words
        if len(words) >= SHINGLE:
            runs = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
            parts.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64, len(words) - SHINGLE + 1)))
    if not parts and few:
        parts.append(np.array([xxhash.xxh64_intdigest(b" ".join(few), SEED)], np.uint64))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _name(own: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(own.tobytes(), SEED))


def simhash(own: np.ndarray, step: int = 1 << 14) -> list[int]:
    """Segments of the fingerprint of a set: a bit is set if it is in more than half of the hashes; the later segments hash again."""
    ones = np.zeros((SEGMENTS, 64), np.int64)
    for at in range(0, len(own), step):
        part = own[at : at + step].astype("<u8")
        for k in range(SEGMENTS):
            mixed = part if not k else (part ^ (part >> np.uint64(29 + k))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
            mixed = mixed ^ (mixed >> np.uint64(32)) if k else mixed
            ones[k] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [_signed(sum(1 << int(b) for b in np.flatnonzero(2 * x > len(own)))) for x in ones]


def parities(own: np.ndarray) -> list[int]:
    """Which of the 256 top bytes occur an odd number of times in a set: two sets differ in at least as many elements as these bits."""
    odd = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=64 * SEGMENTS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def chained(a: list[Column], b: list[Column], radius: int = RADIUS) -> Column:
    """Whether some chain of segments of the ring stays within its budgets, the whole distance being the last."""
    d = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    n = len(d)
    starts = [reduce(and_, [sum(d[(i + j) % n] for j in range(links)) <= radius * links // n for links in range(1, n + 1)]) for i in range(n)]
    return reduce(or_, starts)


SIMS = [f"s{i}" for i in range(SEGMENTS)]
ODD = [f"b{i}" for i in range(SEGMENTS)]
PLACE = ["at", "p1", "p2"]
LINKS = "u bigint, v bigint"
BEGUN = f"doc_id bigint, text_key bigint, fp bigint, n bigint, {', '.join(f'{c} bigint' for c in SIMS + ODD)}, first binary"


def _beginnings(last: np.ndarray):
    """What near copies must share one of, shingles in `last` put last."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, sims, odd, first = [], [], [], [], []
            for x in batch.column(2):
                own = shingles(x.as_py())
                late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own if len(last) else np.zeros(len(own), bool)
                names.append(_name(own))
                sizes.append(len(own))
                sims.append(simhash(own))
                odd.append(parities(own))
                first.append(np.concatenate([own[~late], own[late]])[: len(own) - (4 * len(own) + 4) // 5 + 1].tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()),
                *(pa.array([x[k] for x in of], pa.int64()) for of in (sims, odd) for k in range(SEGMENTS)), pa.array(first, pa.binary()),
            ], ["doc_id", "text_key", "fp", "n", *SIMS, *ODD, "first"])

    return rows


def _tokens(columns: list[str], bits: np.ndarray | None):
    """A row for each shingle of (*columns, first), fp being the first column; each class once a task.

    With `bits`, of the shingles that may be there: with its place `at` in the set's order, and in `p1` and `p2` those before it (null where none).
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                own, tokens, more = [], [], [[], [], []]
                for i, fp in enumerate(batch.column(0).to_pylist()):
                    if fp not in seen:
                        seen.add(fp)
                        own.append(i)
                        token = np.frombuffer(batch.column(len(columns))[i].as_py(), np.int64)
                        if bits is not None:
                            at = np.flatnonzero(may_hold(bits, token))
                            token = token[at]
                            for column, x in zip(more, (at, *(np.concatenate([token[:0], np.zeros(min(k, len(token)), np.int64), token[: max(0, len(token) - k)]]) for k in (1, 2))), strict=True):
                                column.append(x)
                        tokens.append(token)
                n = np.array([len(t) for t in tokens], np.int64)
                if n.sum():
                    other = [np.repeat(batch.column(c).to_numpy()[own], n) for c in range(len(columns))]
                    arrays = [pa.array(x) for x in (np.concatenate(tokens), *other)]
                    if bits is not None:
                        nth = np.concatenate([np.arange(k) for k in n])
                        at, *before = (np.concatenate(x) for x in more)
                        arrays += [pa.array(at), *(pa.array(x, mask=nth < k) for k, x in enumerate(before, 1))]
                    yield pa.RecordBatch.from_arrays(arrays, ["token", *columns, *(PLACE if bits is not None else [])])

    return rows


def _exploded(begun: DataFrame, columns: list[str], bits: np.ndarray | None) -> DataFrame:
    made = ["token", *columns, *(PLACE if bits is not None else [])]
    return begun.select(*columns, "first").mapInArrow(_tokens(columns, bits), ", ".join(f"{c} bigint" for c in made))


def _wanted(bits: np.ndarray):
    """(fp, shingles) of the texts (key, raw) that may be wanted, each once a task."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets, held = [], 0
            keys = batch.column(0).to_numpy()
            for i in np.flatnonzero(may_hold(bits, keys)):
                if (key := int(keys[i])) in seen:
                    continue
                seen.add(key)
                sets.append(shingles(batch.column(1)[int(i)].as_py()))
                held += sets[-1].nbytes
                if held >= OUT_BYTES:
                    yield _set_rows(sets)
                    sets, held = [], 0
            if sets:
                yield _set_rows(sets)

    return rows


def _set_rows(sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_name(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["fp", "shingles"])


def _frequent(rows: DataFrame) -> np.ndarray:
    """Shingles found often in a sample of the texts."""
    n = rows.agg(F.approx_count_distinct("text_key")).first()[0]
    some = rows.where(F.pmod(F.xxhash64("text_key"), F.lit(max(1, n // SAMPLE))) == 0)

    def all_tokens(batches):
        for batch in batches:
            sets = [shingles(x.as_py()) for x in batch.column(1)]
            sizes = [len(x) for x in sets]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), sizes))], ["token", "text_key"])

    counts = some.select("text_key", "raw").mapInArrow(all_tokens, "token bigint, text_key bigint").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return _listed(counts.where(F.col("n") >= FREQUENT))


def _listed(counts: DataFrame) -> np.ndarray:
    """The most frequent tokens of (token, n), `MOST` of them, sorted."""
    top = counts.orderBy(F.desc("n"), "token").limit(MOST).select("token").toPandas()
    return np.sort(top["token"].to_numpy(np.int64).view(np.uint64))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(5 * both >= 4 * (len(x) + len(y) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


class _Corpus:
    """Texts (text_key, raw) and the classes' names with one text each: where whole sets come from."""

    def __init__(self, texts: DataFrame, classes: DataFrame) -> None:
        self.texts, self.classes, self.tried = texts, classes, None

    def checked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v), u < v, whose whole sets are alike, of those not checked before."""
        spark = pairs.sparkSession
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        pairs = cut_lineage(pairs if self.tried is None else pairs.join(self.tried, ["u", "v"], "left_anti"))
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        path = shared_path(spark)
        with scratch_tables(spark):  # the sets go when the pairs are told apart
            need = cut_lineage(pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct().join(self.classes, "fp"))
            made = self.texts.mapInArrow(_wanted(key_bits(need, "text_key")), "fp bigint, shingles binary")
            sets = cut_lineage(made.join(need.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))
            wide = pairs.join(sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v").join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u")
            wide.select("u", "v", "a", "b").mapInArrow(_alike, "u bigint, v bigint").write.parquet(path)
        return spark.read.schema(LINKS).parquet(path)


CLASS = ["fp", "n", *SIMS, *ODD]


def token_index(begun: DataFrame) -> DataFrame:
    """(token, fp, n, s0 ..., b0 ..., at, p1, p2) of the beginnings' shingles that several classes have."""
    counted = _exploded(begun, ["fp"], None).groupBy("token").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    several = cut_lineage(counted.where("a <> b").select("token"))
    rows = _exploded(begun, CLASS, key_bits(several, "token"))
    return cut_lineage(rows.join(several, "token", "left_semi").distinct())


def _placed(index: DataFrame, found: DataFrame | None) -> DataFrame:
    """The index with each class's component, without shingles whose classes are all in one component."""
    rooted = index.withColumn("root", F.col("fp")) if found is None else index.join(
        components(found), F.col("fp") == F.col("node"), "left").select("token", *CLASS, *PLACE, F.coalesce("root", "fp").alias("root"))
    several = rooted.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("held")).where("a <> b").select("token", "held")
    return cut_lineage(rooted.join(several, "token"))


def _able(x: str, y: str) -> Column:
    """Whether two classes, structs of `CLASS`, can be near copies by their sizes, parities and fingerprints."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    near = chained([F.col(f"{x}.{s}") for s in SIMS], [F.col(f"{y}.{s}") for s in SIMS])
    differ = sum(F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in ODD)
    return (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (differ * 9 <= n + m) & (near | (F.least(n, m) <= SMALL))


def _first_shared(x: str, y: str) -> Column:
    """Whether the shingle can be the first one that two classes share: no earlier one is seen, and what follows it is enough for the similarity."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    enough = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at")) * 9 >= (n + m) * 4
    earlier = reduce(or_, [F.col(f"{x}.{a}").eqNullSafe(F.col(f"{y}.{b}")) & F.col(f"{x}.{a}").isNotNull() for a in PLACE[1:] for b in PLACE[1:]])
    return enough & ~earlier


def star_links(index: DataFrame, corpus: _Corpus, found: DataFrame | None) -> DataFrame | None:
    """`found` and the links of each class to one class of each of its shingles, in `ROUNDS` rounds."""
    for k in range(ROUNDS):
        placed = _placed(index, found).select("token", F.struct(*CLASS, "root").alias("x"))
        head = placed.groupBy("token").agg(F.min_by("x", F.xxhash64("x.fp", F.lit(k))).alias("h"))
        star = placed.join(head, "token").where("x.root <> h.root").where(_able("x", "h"))
        new = corpus.checked(star.select(F.col("h.fp").alias("u"), F.col("x.fp").alias("v")))
        found = new if found is None else cut_lineage(found.union(new))
    return found


def pair_links(placed: DataFrame, corpus: _Corpus) -> DataFrame:
    """Links between classes of different components that share a shingle; a pair meets at the first one, and at later ones only where that is not seen."""
    x = placed.select("token", F.struct(*CLASS, *PLACE, "root").alias("x"))
    across = x.join(x.select("token", F.col("x").alias("y")), "token").where("x.fp < y.fp and x.root <> y.root").where(_first_shared("x", "y") & _able("x", "y"))
    return corpus.checked(across.select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")))


def rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) of every row, fp naming its shingle set, and (fp, root) of every different set."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), text_bytes(F.col("text")).alias("raw"))
    spark = docs.sparkSession
    last, found, corpus, named = _frequent(rows), None, None, shared_path(spark)
    for left in reversed(range(PASSES)):
        kept, tried, classes = (shared_path(spark) for _ in range(3))
        with scratch_tables(spark):  # beginnings and index of this order go when its links are found
            begun = cut_lineage(rows.mapInArrow(_beginnings(last), BEGUN))
            if corpus is None:
                begun.select("doc_id", "text_key", "fp").write.parquet(named)
                begun.groupBy("fp").agg(F.min("text_key").alias("text_key")).write.parquet(classes)
                corpus = _Corpus(rows.select("text_key", "raw"), spark.read.parquet(classes))
            index = token_index(begun)
            found = star_links(index, corpus, found)
            placed = _placed(index, found)
            full = placed.where(F.col("held") > FULL).select("token", F.col("held").alias("n")).distinct()
            pairs = full.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
            more = np.setdiff1d(_listed(full), last) if left and pairs > 2 * PAIRS * index.count() else last[:0]
            found.union(pair_links(placed.where(F.col("held") <= FULL) if len(more) else placed, corpus)).write.parquet(kept)
            corpus.tried.write.parquet(tried)
        found, corpus.tried = spark.read.schema(LINKS).parquet(kept), spark.read.schema(LINKS).parquet(tried)
        if not len(more):
            break
        last = np.union1d(last, more)
    linked = components(found)
    known = corpus.classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return spark.read.parquet(named), cut_lineage(known)
