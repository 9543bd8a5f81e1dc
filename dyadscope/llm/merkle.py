"""Merkle manifest of a table: a tree a source, a tree over the sources' roots, and proofs of rows.

A leaf is the SHA-256 of a row's columns, each written as `-` if null, else its UTF-8 length, a colon and
the value. Leaves of a source ascend by id; every `ARITY` consecutive nodes become the hash of their
concatenated hex digests (the last run may be shorter), until one node is left.

Concatenated-level strings: an aligned block of `BLOCK` leaves is one row that keeps each of its levels as
one hex string, 64 characters a node. Parents are the hashes of fixed-width substrings of 192 characters,
the siblings of a node are the substrings that flank it in its run. The topmost nodes of the blocks are
the leaves of the next round, so a source of n rows takes log n / log `BLOCK` rounds, each on a table
`BLOCK` times smaller; the roots of the sources go through the same rounds as one more tree. Proofs are put
together downwards: a block learns the segments above its top node once, for all its leaves.

Positions come from a range sort by (source, id, leaf) and the counts of each source in each sorted part,
so a source that holds most rows is spread over tasks; only the counts, a row for each part and source, meet in
a window. All on Spark's own functions; texts are hashed where they are read and never shuffled.

Defined cases: a null source is a tree of its own, the first one; rows without id come first; rows with
equal source and id are ordered by leaf, equal rows are separate leaves; an empty table has no root and
gives no rows; columns other than `COLUMNS` are not read; a table without rows of a source has no tree for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.llm.common import cut_lineage

ARITY = 3
LEVELS = 5
BLOCK = ARITY**LEVELS
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

SEGMENTS = "array<struct<left:string,right:string>>"


def leaf_digest(values: dict[str, Column] | None = None) -> Column:
    """Leaf of a row; `values` stand in for columns of the row."""
    def part(name: str) -> Column:
        value = (values or {}).get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, COLUMNS)), 256)


def tree_key(source: Column) -> Column:
    """Sorts like the source bytewise, null first, and is never null."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def fold(start: Column, siblings: Column) -> Column:
    """Root that follows from a node and its siblings, level by level."""
    return F.aggregate(siblings, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings_text(siblings: Column) -> Column:
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")


def _positions(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, from 0 within the tree in the given order, and n, the tree's number of nodes."""
    # Equal rows differ in `_any` only, so that no part of the range sort is bound to hold them all.
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_any")]
    ranged = nodes.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut_lineage(ranged.drop("_any").withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).select(
        "tree", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return rows.join(runs, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _parents(level: Column) -> Column:
    """The next level of a block as one string."""
    width = ARITY * HEX
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / width).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), "")


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """(tree, block, n, depth, members, level0 .. level{LEVELS}) of nodes (tree, pos, n, node, *carry), written out."""
    deep = sum((F.when(F.col("n") > ARITY**i, 1).otherwise(0) for i in range(LEVELS)), F.lit(0))
    rows = nodes.groupBy("tree", (F.col("pos") / BLOCK).cast("bigint").alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "node", *carry))).alias("members"))
    rows = rows.withColumn("depth", deep).withColumn("level0", F.array_join("members.node", ""))
    for i in range(LEVELS):
        rows = rows.withColumn(f"level{i + 1}", F.when(F.col("depth") > i, _parents(F.col(f"level{i}"))))
    top = F.coalesce(*[F.col(f"level{i}") for i in range(LEVELS, -1, -1)])
    return cut_lineage(rows.withColumn("top", top))


def _own_siblings(i: Column) -> Column:
    """Segments of the i-th member of a block at the levels inside the block."""
    def at(j: int) -> Column:
        own = F.floor(i / ARITY**j).cast("int")
        run = own - own % ARITY
        level = F.col(f"level{j}")
        left = F.substring(level, run * HEX + 1, (own - run) * HEX)
        right = F.substring(level, (own + 1) * HEX + 1, (run + (ARITY - 1) - own) * HEX)
        return F.when(F.col("depth") > j, F.struct(left.alias("left"), right.alias("right")))

    return F.filter(F.array(*map(at, range(LEVELS))), lambda s: s.isNotNull())


def _spread(blocks: DataFrame, above: DataFrame, carry: list[str]) -> DataFrame:
    """(tree, pos, node, *carry, siblings, tops...) of each member; `above` has (tree, block, up, ...) for every block."""
    rest = [c for c in above.columns if c not in ("tree", "block", "up")]
    member = F.transform("members", lambda m, i: F.struct(
        *[m[c].alias(c) for c in ("pos", "node", *carry)], F.concat(_own_siblings(i), F.col("up")).alias("siblings")))
    joined = blocks.join(above, ["tree", "block"])
    return joined.select("tree", *rest, F.explode(member).alias("m")).select("tree", "m.*", *rest)


def _climb(nodes: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks of the nodes, and for each block (tree, block, up, subroot): segments above its top node, root of its tree."""
    rounds = [_blocks(nodes, carry)]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        more = rounds[-1].where(F.col("n") > BLOCK)
        rounds.append(_blocks(more.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("node")), []))
    none = F.array().cast(SEGMENTS)
    above = None
    for blocks in reversed(rounds):
        tops = blocks.where(F.col("n") <= BLOCK).select("tree", "block", none.alias("up"), F.col("top").alias("subroot"))
        above = tops if above is None else tops.unionByName(above)
        if blocks is not rounds[0]:
            above = cut_lineage(_spread(blocks, above, []).select("tree", F.col("pos").alias("block"), F.col("siblings").alias("up"), "subroot"))
    return rounds[0], above


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, source, leaf, pos, siblings, subroot, root, *carry) of every row.

    `siblings` are the segments left and right of the row's node, from its leaf to the root of all
    sources. `carry` adds values that are computed where rows are read.
    """
    carry = carry or {}
    leaves = docs.select(
        tree_key(F.col("source")).alias("tree"), F.col("doc_id"), leaf_digest().alias("node"), *[c.alias(k) for k, c in carry.items()])
    kept = ["doc_id", *carry]
    # Written first: a range sort reads its input twice, and texts are to be hashed once.
    blocks, above = _climb(_positions(cut_lineage(leaves), ["doc_id", "node"]), kept)
    above = cut_lineage(above)
    subroots = above.where("block = 0").select("tree", F.col("subroot").alias("node"))
    sources = _positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), ["source"])
    top, over = _climb(sources, ["source"])
    roots = _spread(top, over.withColumnRenamed("subroot", "root"), ["source"]).select(F.col("source").alias("tree"), F.col("siblings").alias("over"), "root")
    above = above.join(roots, "tree").select("tree", "block", F.concat("up", "over").alias("up"), "subroot", "root")
    rows = _spread(blocks, cut_lineage(above), kept)
    source = F.when(F.col("tree") != "0", F.expr("substring(tree, 2)"))
    return rows.select("doc_id", source.alias("source"), F.col("node").alias("leaf"), "pos", "siblings", "subroot", "root", *carry)


def roots(docs: DataFrame) -> DataFrame:
    """(source, rows, subroot, root): the manifest's head, a row a source."""
    found = manifest(docs).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.first("subroot").alias("subroot"), F.first("root").alias("root"))
    return found
