"""Line dedup by winnowing: later repeats of runs of lines go, the first occurrence stays.

The lines of a text that have words form its sequence; a line's hash is XXH64 of the line without
outer white space. A gram is the shortest run of lines from a line on that has `gram_words` words. A
window is the lines that begin within `gram_words` words; its smallest gram hash (of equal ones the
last) is a fingerprint. Two runs of lines that are equal and have `2 * gram_words` words or more have
a fingerprint in common, as they share a whole window with all its grams.

Fingerprints with another place are matches to extend: from each, the shortest runs of lines with `min_words` words
that hold it are reached to both sides, and runs of one hash meet the first place among them (smallest doc_id, then
text key, then line). Every line of an equal run of `min_words` words or more is in such a run, and each is compared with its
own first place, so nothing depends on where other runs begin. Matches that touch on one diagonal of a document and a
first document are put together to the maximal run, which is deleted. What is deleted always has an equal line
at an earlier place, so the first occurrence of every line stays. A group of copies gives one match a run
and never its pairs. Work grows with the lines of a text, whatever the number of its runs.

Only DataFrame operations. What is shuffled is line hashes and fingerprints, and the runs' hashes of
documents with repeats; texts meet their runs once.

Defined cases: null and empty texts have no lines and stay as they are; lines without words never
match, and go only if they stand inside a deleted run; rows with equal id and text count as one
document and get the same result; a null id comes first; a repeat inside one document goes like any
other; an empty table gives an empty result; other columns are kept under their names by `dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.llm.common import cut_lineage, text_key

MIN_WORDS = 50
GRAM_WORDS = 25
WORD = "[^\\x20\\x09-\\x0D]+"
NO_ID = -(1 << 63)

RUNS = "array<struct<first:int,last:int,words:bigint,from_doc:bigint,from_line:int>>"


def line_table(docs: DataFrame) -> DataFrame:
    """(doc, key, lines) of every different row: lines are (h, n, at) of lines with words, `at` from 0."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        F.xxhash64(F.regexp_replace(x, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"), i.alias("at"),
    ))
    rows = docs.where("text is not null").select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), text_key(F.col("text")).alias("key"), F.filter(lines, lambda x: x["n"] > 0).alias("lines")
    )
    return rows.where(F.size("lines") > 0).dropDuplicates(["doc", "key"])


def _positions(lines: DataFrame) -> DataFrame:
    """(doc, key, seq, h, n, at, start) of every line with words; start counts the words before it."""
    rows = lines.select("doc", "key", F.posexplode("lines").alias("seq", "x")).select("doc", "key", (F.col("seq") + 1).alias("seq"), "x.h", "x.n", "x.at")
    own = Window.partitionBy("doc", "key")
    begun = own.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n").over(begun), F.lit(0).cast("bigint")))


def fingerprints(lines: DataFrame, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(gram, doc, key, seq) of the windows' minima; seq counts lines with words from 1."""
    own = Window.partitionBy("doc", "key")
    rows = _positions(lines)
    reach = own.orderBy("start").rangeBetween(0, gram_words - 1)
    rows = rows.withColumn("gram", F.when(F.sum("n").over(reach) >= gram_words, F.xxhash64(F.collect_list("h").over(reach))))
    least = F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", (-F.col("seq")).alias("back")))).over(reach)
    return rows.select("doc", "key", least.alias("least")).where("least is not null").select("least.gram", "doc", "key", (-F.col("least.back")).alias("seq")).distinct()


def repeated_places(prints: DataFrame) -> DataFrame:
    """(doc, key, seq) of the fingerprints whose gram has another place."""
    again = cut_lineage(prints.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    return prints.join(again, "gram").select("doc", "key", "seq").distinct()


def extended(lines: DataFrame, places: DataFrame, min_words: int) -> DataFrame:
    """(run, doc, key, seq, at, last, start, end): the shortest runs around repeated fingerprints, reached to both sides; at and last are lines of the text."""
    own = Window.partitionBy("doc", "key")
    held = lines.join(places.select("doc", "key").distinct(), ["doc", "key"], "left_semi")
    rows = _positions(held).withColumn("end", F.col("start") + F.col("n")).join(places.withColumn("met", F.lit(True)), ["doc", "key", "seq"], "left")
    sides = own.orderBy("start").rangeBetween(0, min_words - 1), own.orderBy("end").rangeBetween(1 - min_words, 0)
    runs = [F.when((F.sum("n").over(side) >= min_words) & F.max("met").over(side), F.struct(
        F.xxhash64(F.collect_list("h").over(side)).alias("run"), F.min("seq").over(side).alias("seq"), F.min("at").over(side).alias("at"),
        F.max("at").over(side).alias("last"), F.min("start").over(side).alias("start"), F.max("end").over(side).alias("end"),
    )) for side in sides]
    return rows.select("doc", "key", *[r.alias(f"r{i}") for i, r in enumerate(runs)]).select("doc", "key", F.explode(F.array_distinct(F.array("r0", "r1"))).alias("x")).where(
        "x is not null"
    ).select("x.run", "doc", "key", "x.seq", "x.at", "x.last", "x.start", "x.end")


def _maximal(matches: DataFrame) -> DataFrame:
    """(doc, key, first, last, words, from_doc, from_line): matches on one diagonal put together where they touch."""
    diagonal = ["doc", "key", "from_doc", "from_key", "shift"]
    order = Window.partitionBy(*diagonal).orderBy("start", "end")
    apart = F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = matches.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    rows = rows.withColumn("part", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*diagonal, "part").agg(
        F.min("at").alias("first"), F.max("last").alias("last"), (F.max("end") - F.min("start")).alias("words"), F.min("from_line").alias("from_line")
    ).select("doc", "key", "first", "last", "words", "from_doc", "from_line")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(doc, key, runs, cuts) of each document with lines to delete: its runs, and by turns how many lines stay and go."""
    if min_words < 2 * gram_words:
        raise ValueError("runs of min_words are found for sure only if they have two grams")
    lines = cut_lineage(line_table(docs))
    places = cut_lineage(repeated_places(cut_lineage(fingerprints(lines, gram_words))))
    runs = cut_lineage(extended(lines, places, min_words))
    place = F.struct("doc", "key", "seq", "at")
    first = cut_lineage(runs.groupBy("run").agg(F.min(place).alias("from"), F.max(place).alias("to")).where("from <> to").select("run", "from"))
    matches = runs.join(first, "run").where(place != F.col("from")).select(
        "doc", "key", "start", "end", "at", "last", F.col("from.doc").alias("from_doc"), F.col("from.key").alias("from_key"),
        F.col("from.at").alias("from_line"), (F.col("seq") - F.col("from.seq")).alias("shift"),
    )
    before = Window.partitionBy("doc", "key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    rows = _maximal(matches).withColumn("gone", F.coalesce(F.max("last").over(before), F.lit(-1)))
    cut = F.struct("first", F.greatest(F.col("first") - F.col("gone") - 1, F.lit(0)).alias("stay"), (F.col("last") - F.greatest("gone", F.col("first") - 1)).alias("go"))
    return rows.groupBy("doc", "key").agg(
        F.array_sort(F.collect_set(F.struct("first", "last", "words", "from_doc", "from_line"))).alias("runs"),
        F.array_sort(F.collect_list(F.when(F.col("last") > F.col("gone"), cut))).alias("cuts"),
    )


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """`docs` with the runs taken out of `text`, and the columns removed_runs and removed_lines."""
    runs = cut_lineage(repeated_runs(docs, min_words, gram_words)).select(
        F.col("doc").alias("_dedup_doc"), F.col("key").alias("_dedup_key"), F.col("runs").alias("_dedup_runs"), F.col("cuts").alias("_dedup_cuts")
    )
    own = (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)) == F.col("_dedup_doc")) & (text_key(docs["text"]) == F.col("_dedup_key"))
    # The runs are hashed, the wide rows are not sorted; said here, so that the plan is the same at every size.
    rows = docs.drop("removed_runs", "removed_lines").join(runs.hint("shuffle_hash"), own, "left").drop("_dedup_doc", "_dedup_key")
    gone = F.flatten(F.transform("_dedup_cuts", lambda c: F.concat(F.array_repeat(F.lit(False), c["stay"]), F.array_repeat(F.lit(True), c["go"]))))
    # Lines past the last cut have no mark and stay; lines that go become null, which array_join leaves out.
    stays = F.zip_with(F.split("text", "\n"), gone, lambda x, g: F.when(~F.coalesce(g, F.lit(False)), x))
    rows = rows.withColumn("_dedup_text", F.when(F.col("_dedup_runs").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")))
    removed = F.coalesce(F.aggregate("_dedup_cuts", F.lit(0), lambda n, c: n + c["go"]), F.lit(0))
    return rows.withColumn("removed_lines", removed).withColumn("text", F.col("_dedup_text")).withColumn(
        "removed_runs", F.coalesce("_dedup_runs", F.array().cast(RUNS))
    ).select(*[c for c in docs.columns if c not in ("removed_runs", "removed_lines")], "removed_runs", "removed_lines")
