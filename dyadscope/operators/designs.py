"""Regression designs on choice events: from rows to chosen/other regressor vectors.

A design is (outcome, key factor, ordered regressors). Rows with a null regressor do not count
for a design, so one event may be usable for some designs only, and an event of three or more
rows becomes usable when nulls leave exactly two.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadscope.functions.numeric import as_number
from dyadscope.operators.events import DOC, KEYS, one_chosen
from dyadscope.session import cut_lineage

DESIGN_SCHEMA = "array<struct<design_id int, y int, exog array<int>>>"
BIT_SCHEMA = "array<struct<design_id int, y int, exog array<int>, bit bigint>>"
PAIR_COLUMNS = ("doc", "boot", "lo", "hi")
USABLE_EVENT = "n = 2 or (n > 2 and n_full <= 2)"


@dataclass(frozen=True)
class Design:
    design_id: int
    y_col: str
    exog: tuple[str, ...]  # the key factor comes first

    @property
    def key_factor(self) -> str:
        return self.exog[0]


@dataclass(frozen=True)
class DesignSet:
    """Designs, and the outcome and regressor columns their indices point into."""

    designs: tuple[Design, ...]
    outcomes: Sequence[str] | None = None
    regressors: Sequence[str] | None = None

    @property
    def y_cols(self) -> list[str]:
        return list(self.outcomes or dict.fromkeys(d.y_col for d in self.designs))

    @property
    def x_cols(self) -> list[str]:
        return list(self.regressors or dict.fromkeys(c for d in self.designs for c in d.exog))

    def indexed(self) -> dict[int, tuple[int, list[int]]]:
        """design_id -> (outcome index, regressor indices)."""
        ys, xs = self.y_cols, self.x_cols
        return {d.design_id: (ys.index(d.y_col), [xs.index(c) for c in d.exog]) for d in self.designs}

    def as_column(self, keep: Collection[int] | None = None) -> Column:
        """Constant array column of the designs; its size is set by the plan, not the data."""
        rows = [
            {"design_id": i, "y": y, "exog": exog}
            for i, (y, exog) in self.indexed().items()
            if keep is None or i in keep
        ]
        return F.from_json(F.lit(json.dumps(rows)), DESIGN_SCHEMA)


def _value_names(designs: DesignSet) -> list[str]:
    """Flat value columns of a row: outcomes, regressors, and the input position."""
    ys = [f"y{i}" for i in range(len(designs.y_cols))]
    xs = [f"x{i}" for i in range(len(designs.x_cols))]
    return [*ys, *xs, "place"]


def row_table(
    df: DataFrame,
    designs: DesignSet,
    *,
    keys: Sequence[str] = KEYS,
    event: str = "event_id",
    doc: str = DOC,
    cluster: str = DOC,
    order: str | None = None,
) -> DataFrame:
    """One narrow row per input row: event, its clusters, outcomes and regressors as doubles.

    Document, pair and bootstrap cluster are attributes of the event (the event key contains
    them), so they are grouping columns below, not aggregates.
    """
    ys = {f"y{i}": F.coalesce(as_number(c), F.lit(0.0)) for i, c in enumerate(designs.y_cols)}
    xs = {f"x{i}": as_number(c) for i, c in enumerate(designs.x_cols)}
    place = F.col(order).cast("double") if order else F.lit(0.0)
    packed = df.select(
        *keys,
        F.col(event).alias("event_id"),
        F.col(doc).cast("string").alias("doc"),
        F.col(cluster).cast("string").alias("boot"),
        (F.col("pair_id") if "pair_id" in df.columns else F.col(event)).cast("string").alias("pair"),
        *[c.alias(n) for n, c in {**ys, **xs, "place": place}.items()],
    )
    full = F.lit(True)
    for name in xs:
        full = full & F.col(name).isNotNull()
    tag = F.xxhash64(*_value_names(designs))
    return packed.withColumns({"n": F.lit(1), "n_full": full.cast("int"), "tag_lo": tag, "tag_hi": tag})


def _two_rows(df: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Row count, and the rows with the smallest and largest content hash, per group.

    When the group has exactly two rows these are the two rows. The buffer has a fixed width
    whatever the group size, so this is a hash aggregate combined before the shuffle: a huge
    event costs nothing extra and no list is ever collected.
    """

    def side(c: str, which: str) -> str:
        return f"{c}_{which}" if f"{c}_{which}" in df.columns else c

    return df.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum("n_full").alias("n_full"),
        F.min("tag_lo").alias("tag_lo"),
        F.max("tag_hi").alias("tag_hi"),
        *[F.min_by(side(c, "lo"), "tag_lo").alias(f"{c}_lo") for c in names],
        *[F.max_by(side(c, "hi"), "tag_hi").alias(f"{c}_hi") for c in names],
    )


def _pack(names: Sequence[str], which: str) -> Column:
    ys = F.array(*[F.col(f"{c}_{which}") for c in names if c.startswith("y")])
    xs = F.array(*[F.col(f"{c}_{which}") for c in names if c.startswith("x")])
    return F.struct(ys.alias("ys"), xs.alias("xs"), F.col(f"place_{which}").alias("place"))


ATTRIBUTES = ("doc", "boot", "pair")


def event_table(rows: DataFrame, designs: DesignSet, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every event once: its row counts and clusters, and its two rows where a design may use them.

    An event with three or more complete rows is unusable for every design, so its rows are not
    carried along. All later steps read this table; the input is scanned and shuffled once.
    """
    names = _value_names(designs)
    usable = F.expr(USABLE_EVENT)
    return _two_rows(rows, [*keys, "event_id", *ATTRIBUTES], names).select(
        *keys,
        "event_id",
        *ATTRIBUTES,
        "n",
        "n_full",
        *[F.when(usable, _pack(names, which)).alias(which) for which in ("lo", "hi")],
    )


def pattern_table(rows: DataFrame, designs: DesignSet, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows folded per null pattern, of the events of more than two rows that nulls could reduce to two.

    Written out, it stands for the rows in `sparse_pairs`: the input need not be joined again for every use.
    """
    names = _value_names(designs)
    known = F.array(*[F.col(c).isNotNull() for c in names if c.startswith("x")])
    folded = _two_rows(rows.withColumn("known", known), [*keys, "event_id", *ATTRIBUTES, "known"], names)
    event = Window.partitionBy(*keys, "event_id")
    sized = folded.withColumns({"_n": F.sum("n").over(event), "_full": F.sum("n_full").over(event)})
    return sized.where("_n > 2 and _full <= 2").drop("_n", "_full")


def sparse_pairs(rows: DataFrame, events: DataFrame, designs: DesignSet, plan: Column, keys: Sequence[str]) -> DataFrame:
    """Two usable rows per (event, design) for events with more than two rows.

    Rows are first folded per null pattern, if they are not already (`pattern_table`), then per design over the patterns
    it tolerates. Both folds keep two rows per group.
    """
    names = _value_names(designs)
    group = [*keys, "event_id", *ATTRIBUTES]
    folded = rows
    if "known" not in rows.columns:
        wanted = events.where("n > 2 and n_full <= 2").select(*keys, "event_id")
        folded = pattern_table(rows.join(wanted, [*keys, "event_id"], "left_semi"), designs, keys)
    per_design = folded.withColumn("design", F.explode(plan)).where(
        F.forall("design.exog", lambda i: F.col("known")[i])
    )
    out = _two_rows(per_design, [*group, "design"], names).where("n = 2")
    return out.select(*group, "design", *[_pack(names, which).alias(which) for which in ("lo", "hi")])


def has_sparse_events(events: DataFrame) -> bool:
    """Is there an event of more than two rows that nulls could reduce to two?"""
    return not events.where("n > 2 and n_full <= 2").isEmpty()


def of_designs(pairs: DataFrame, keep: Collection[int] | None) -> DataFrame:
    return pairs if keep is None else pairs.where(F.col("design.design_id").isin(*keep))


def design_pairs(
    rows: DataFrame,
    events: DataFrame,
    designs: DesignSet,
    *,
    keys: Sequence[str] = KEYS,
    require_variation: bool = True,
    keep: Collection[int] | None = None,
    sparse: bool | DataFrame | None = None,
) -> DataFrame:
    """Long table, one row per (event, design) usable for the design: chosen and other vectors.

    `sparse` tells whether events with more than two rows can matter; when not given it is looked
    up, since the branch re-reads the rows and most tables do not need it. It can be their `sparse_pairs` for all designs,
    written out.
    """
    plan = designs.as_column(keep)
    if sparse is None:
        sparse = has_sparse_events(events)
    columns = [*keys, "event_id", *PAIR_COLUMNS, "design"]
    both = events.where("n = 2").withColumn("design", F.explode(plan)).select(columns)
    if isinstance(sparse, DataFrame):
        both = both.unionByName(of_designs(sparse, keep).select(columns))
    elif sparse:
        both = both.unionByName(sparse_pairs(rows, events, designs, plan, keys).select(columns))

    y_lo, y_hi = (F.col(f"{s}.ys")[F.col("design.y")] for s in ("lo", "hi"))
    key = F.col("design.exog")[0]
    x_lo, x_hi = (F.col(f"{s}.xs")[key] for s in ("lo", "hi"))
    usable = both.where(one_chosen(y_lo + y_hi) & x_lo.isNotNull() & x_hi.isNotNull())
    if require_variation:
        usable = usable.where(x_lo != x_hi)

    def vector(first: str, second: str) -> Column:
        return F.transform(
            "design.exog",
            lambda i: F.when(y_hi > y_lo, F.col(f"{first}.xs")[i]).otherwise(F.col(f"{second}.xs")[i]),
        )

    chosen_first = F.when(y_hi > y_lo, F.col("hi.place") <= F.col("lo.place")).otherwise(
        F.col("lo.place") <= F.col("hi.place")
    )
    out = usable.select(
        *keys,
        F.col("design.design_id").alias("design_id"),
        "event_id",
        "doc",
        "boot",
        vector("hi", "lo").alias("chosen"),
        vector("lo", "hi").alias("other"),
        chosen_first.alias("chosen_first"),
    )
    known = F.forall("chosen", lambda x: x.isNotNull()) & F.forall("other", lambda x: x.isNotNull())
    return out.where(known)


#: Designs of one bitmap word.
WORD = 64


def _usable(design: Column, require_variation: bool) -> Column:
    """Whether the two rows of an event can be used for a design (a struct as in `DESIGN_SCHEMA`)."""
    lo, hi = F.col("lo.xs"), F.col("hi.xs")
    ok = one_chosen(F.col("lo.ys")[design["y"]] + F.col("hi.ys")[design["y"]]) & F.forall(design["exog"], lambda c: lo[c].isNotNull() & hi[c].isNotNull())
    key = design["exog"][0]
    return ok & (lo[key] != hi[key]) if require_variation else ok


def _mask(i: int) -> int:
    """Bit of the i-th design in its word, as a signed number."""
    return 1 << i % WORD if i % WORD < WORD - 1 else -(1 << WORD - 1)


def design_bits(
    rows: DataFrame, events: DataFrame, designs: DesignSet, *, keys: Sequence[str] = KEYS, require_variation: bool = True, sparse: bool | DataFrame | None = None,
) -> DataFrame:
    """(keys, doc, w0, w1, ...): of every event a bitmap of the designs, by position, that it is usable for.

    A word is one fold over a constant array of its designs. As an expression for each design they would make one generated
    method, too large for the JVM to compile already with fifteen designs.
    """
    rows_of = [{"design_id": i, "y": y, "exog": exog, "bit": _mask(at)} for at, (i, (y, exog)) in enumerate(designs.indexed().items())]
    words = range(-(-len(rows_of) // WORD))
    none = F.lit(0).cast("bigint")

    def bits(word: int, only: Column | None = None) -> Column:
        own = F.from_json(F.lit(json.dumps(rows_of[word * WORD : (word + 1) * WORD])), BIT_SCHEMA)

        def add(held: Column, design: Column) -> Column:
            able = _usable(design, require_variation)
            return held.bitwiseOR(F.when(able if only is None else able & (only == design["design_id"]), design["bit"]).otherwise(none))

        return F.aggregate(own, none, add).alias(f"w{word}")

    out = events.where("n = 2").select(*keys, "doc", *map(bits, words))
    if has_sparse_events(events) if sparse is None else sparse:
        more = sparse if isinstance(sparse, DataFrame) else sparse_pairs(rows, events, designs, designs.as_column(), keys)
        found = more.select(*keys, "event_id", "doc", *[bits(w, F.col("design.design_id")) for w in words])
        out = out.unionByName(found.groupBy(*keys, "event_id", "doc").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in words]).drop("event_id"))
    return out


def design_counts(bits: DataFrame, n_designs: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n, docs, top): arrays by position of a design's events, documents, and events of its largest document.

    Bits are counted by (keys, document) and then by keys, both combined on the map side, a word of designs at a time;
    there is never a row for an event and a design.
    """
    out = None
    bits = bits if n_designs <= WORD else cut_lineage(bits)
    for word in range(-(-n_designs // WORD)):
        own = range(min(WORD, n_designs - word * WORD))
        counted = bits.where(F.col(f"w{word}") != 0).groupBy(*keys, "doc").agg(
            *[F.sum(F.shiftrightunsigned(f"w{word}", i).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"b{i}") for i in own])
        part = counted.groupBy(*keys).agg(
            F.array(*[F.sum(f"b{i}") for i in own]).alias("n"), F.array(*[F.count_if(F.col(f"b{i}") > 0) for i in own]).alias("docs"),
            F.array(*[F.max(f"b{i}") for i in own]).alias("top"))
        if out is None:
            out = part
        else:
            none = F.transform(F.sequence(F.lit(1), F.lit(word * WORD)), lambda _: F.lit(0).cast("bigint"))
            rest = F.array(*[F.lit(0).cast("bigint") for _ in own])
            names = ("n", "docs", "top")
            later = part.select(*keys, *[F.col(c).alias(f"{c}_more") for c in names])
            out = out.join(later, [*keys], "full").select(*keys, *[F.concat(F.coalesce(c, none), F.coalesce(f"{c}_more", rest)).alias(c) for c in names])
    return out


def at_design(counts: DataFrame, position: Column) -> DataFrame:
    """`counts` (n, docs, top) joined to rows that name a design: its n_informative, n_docs and top1_share; null where it has no event."""
    n, docs, top = (F.get(c, position) for c in ("n", "docs", "top"))
    some = n > 0
    return counts.withColumns({
        "n_informative": F.when(some, n), "n_docs": F.when(some, docs), "top1_share": F.when(some, top / n)}).drop("n", "docs", "top")


def gate_stats(rows: DataFrame, events: DataFrame, designs: DesignSet, *, keys: Sequence[str] = KEYS, sparse: bool | None = None) -> DataFrame:
    """Per (keys, design) with any event: n_informative, n_docs, top1_share. Rows appear only here, one for each design of a sample."""
    counts = design_counts(design_bits(rows, events, designs, keys=keys, sparse=sparse), len(designs.designs), keys)
    ids = F.array(*[F.struct(F.lit(d.design_id).alias("design_id"), F.lit(i).alias("_at")) for i, d in enumerate(designs.designs)])
    each = counts.select("*", F.inline(ids))
    return at_design(each, F.col("_at")).drop("_at").where("n_informative > 0")


def sample_totals(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two-alternative events, documents and pairs of every (track, split)."""
    return events.groupBy(*keys).agg(
        F.count_if(F.col("n") == 2).alias("n_choice_situations_total"),
        F.count_distinct("doc").alias("n_docs_total"),
        F.count_distinct("pair").alias("n_twin_sets"),
    )


def differences(long: DataFrame) -> DataFrame:
    """Chosen minus other, per regressor."""
    return long.withColumn("d", F.zip_with("chosen", "other", lambda a, b: a - b))


def design_stats(long: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per (group, design): events, documents, largest document share. Two map-side combined steps."""
    per_doc = long.groupBy(*keys, "design_id", "doc").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy(*keys, "design_id").agg(
        F.sum("n").alias("n_informative"),
        F.count(F.lit(1)).alias("n_docs"),
        (F.max("n") / F.sum("n")).alias("top1_share"),
    )
