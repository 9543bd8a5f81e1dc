"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words of a clause become symbols: insult, threat, target, negation, reported speech, other. Small
transducers read them: `insult` and `threat` give events, `target` remembers whom a clause addresses,
`negation` is open for a few words, `report` stays open once a clause reports what someone said. They
are composed into one machine whose states are the reachable combinations and whose output is the
kind of each event (insult or threat; aimed or not; negated or not; reported or not). A document is
scored by its matched clauses: a weight per kind, fitted to labels around the grammar's own weights.

Insults are stems (a word, or the first letters of a word). Seed stems are given; more are learnt from
labelled training rows, where a stem must be in so many more toxic documents than their share that
chance would do it for less than one of all stems tried. Stem counts combine in Spark and only those
that pass reach the driver, at most `max_stems`. Stems and weights are learnt from at most
`max_fit_rows` labelled training rows, the first by a hash of the id; every document is scored over its
whole text.

Defined cases: null and empty texts have no clause and get the score of no match; a null id is in fold
0 without label; several labels of an id count as toxic if their mean is at least one half; without
labels the grammar's own weights hold; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadscope.llm.common import crc_fold, cut_lineage, ship_package, text_key

MAX_STEMS = 2000
#: Labelled training rows that the stems and weights are learnt from.
MAX_FIT_ROWS = 30_000
STEM_LETTERS = (4, 5, 6)
LEAST_LETTERS = 4
NEGATION_REACH = 3
#: A learnt stem occurs in so many training documents at least, and in no more clean ones than this leaves.
LEAST_DOCS, LEAST_SHARE = 5, 0.95

# Fixed seed vocabulary of the grammar (lower case).
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "imbecile", "dumb", "vermin", "clown")
THREATS = ("kill", "hurt", "destroy", "beat", "shoot", "stab", "burn", "attack", "strangle", "töten", "umbringen", "tuer", "frapper", "matar", "golpear")
TARGETS = ("you", "your", "you're", "he", "she", "they", "him", "her", "them", "du", "dich", "dir", "ihr", "sie", "tu", "toi", "te", "vous", "eux", "tú", "ti", "usted", "ustedes", "ellos")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "wasn't", "don't", "won't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "wrote", "called", "claimed", "quoted", "reported", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")

CLAUSE = re.compile(r"[.!?;:\n\r]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


@dataclass(frozen=True)
class Transducer:
    """states x symbols: next state, and what the step adds to the output (flags)."""

    start: int
    moves: dict[tuple[int, int], int]
    adds: dict[tuple[int, int], int] = field(default_factory=dict)
    flags: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state; the output holds the state's flags as they were before the symbol."""
        return self.moves.get((state, symbol), self.moves.get((state, -1), state)), self.adds.get((state, symbol), 0) | self.flags.get(state, 0)


IS_INSULT, IS_THREAT, AIMED, NEGATED, REPORTED = 1, 2, 4, 8, 16
EVENTS = Transducer(0, {}, adds={(0, INSULT): IS_INSULT, (0, THREAT): IS_THREAT})
ADDRESSEE = Transducer(0, {(0, TARGET): 1}, flags={1: AIMED})
SPEECH = Transducer(0, {(0, REPORT): 1}, flags={1: REPORTED})


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """Open for `reach` words after a negation; another one starts it again."""
    moves = {(s, NEGATION): reach for s in range(reach + 1)} | {(s, -1): s - 1 for s in range(1, reach + 1)}
    return Transducer(0, moves, flags={s: NEGATED for s in range(1, reach + 1)})


def compose(machines: list[Transducer]) -> Transducer:
    """One machine that runs all of them: its states are the combinations reachable from the start."""
    first = tuple(m.start for m in machines)
    number, todo, moves, adds = {first: 0}, [first], {}, {}
    while todo:
        at = todo.pop()
        for symbol in range(6):
            steps = [m.step(s, symbol) for m, s in zip(machines, at, strict=True)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            moves[number[at], symbol] = number[after]
            out = 0
            for _, flags in steps:
                out |= flags
            adds[number[at], symbol] = out if symbol in (INSULT, THREAT) else 0
    return Transducer(0, moves, adds)


GRAMMAR = compose([EVENTS, ADDRESSEE, negation(), SPEECH])


def clause_events(symbols: list[int], grammar: Transducer = GRAMMAR) -> list[int]:
    """Output flags of each insult or threat of a clause. A target after the event aims it as well."""
    state, out = grammar.start, []
    for symbol in symbols:
        state, flags = grammar.step(state, symbol)
        if flags:
            out.append(flags)
    return [f | AIMED for f in out] if TARGET in symbols else out


#: Kinds of events: (insult or threat) x aimed x negated x reported.
KINDS = tuple(k | a | n | r for k in (IS_INSULT, IS_THREAT) for a in (0, AIMED) for n in (0, NEGATED) for r in (0, REPORTED))


def grammar_weight(kind: int) -> float:
    """The grammar's own weight of a kind, before any label is seen."""
    weight = 3.0 if kind & IS_INSULT else 1.5
    weight += 1.0 if kind & AIMED else 0.0
    return weight * (0.4 if kind & NEGATED else 1.0) * (0.5 if kind & REPORTED else 1.0)


@dataclass
class Lexicon:
    """Insult stems with weights, and the words of the other symbols."""

    stems: dict[str, float]

    def __post_init__(self) -> None:
        self.words = {w: THREAT for w in THREATS} | {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in REPORTS}
        self.lengths = sorted({len(s) for s in self.stems})
        self.finder = ahocorasick.Automaton()
        for w in (*self.stems, *THREATS):
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        if word in self.words:
            return self.words[word], 1.0
        best = max((self.stems.get(word[:n], 0.0) for n in self.lengths if n <= len(word)), default=0.0)
        return (INSULT, best) if best else (OTHER, 0.0)

    def clauses(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the clauses in which a stem or threat begins a word."""
        last = -1
        for end, n in self.finder.iter(text):
            begin = end - n + 1
            if begin <= last or (begin and (text[begin - 1].isalpha())):
                continue
            left = max(max(text.rfind(c, max(last, 0), begin) for c in ".!?;:\n\r") + 1, max(last, 0))
            stop = CLAUSE.search(text, begin)
            last = stop.start() if stop else len(text)
            yield left, last


WIDTH = len(KINDS) + 2


def document_events(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """log(1 + weighted events) per kind, then log(1 + events) and the number of matched clauses."""
    out = np.zeros(WIDTH)
    if not text:
        return out
    text = text.lower()
    index = {k: i for i, k in enumerate(KINDS)}
    for left, right in lexicon.clauses(text):
        symbols, weights = [], []
        for token in TOKEN.findall(text, left, right):
            symbol, weight = lexicon.symbol(token)
            symbols.append(symbol)
            if symbol in (INSULT, THREAT):
                weights.append(weight)
        events = clause_events(symbols)
        for flags, weight in zip(events, weights, strict=True):
            out[index[flags]] += weight
        out[-2] += len(events)
        out[-1] += bool(events)
    return np.concatenate([np.log1p(out[:-1]), out[-1:]])


def _stems_of(text: str) -> set[str]:
    words = {w for w in TOKEN.findall(text.lower()) if len(w) >= LEAST_LETTERS}
    return words | {w[:n] for w in words for n in STEM_LETTERS if len(w) > n}


def learn_stems(train: DataFrame, max_stems: int = MAX_STEMS) -> dict[str, float]:
    """Stems of (text, toxic) rows that mark toxic documents, with weights in (0, 1]."""
    def count(batches):
        for b in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(b["text"], b["toxic"], strict=True):
                (toxic if y else clean).update(_stems_of(text or ""))
            keys = list(toxic.keys() | clean.keys())
            yield pd.DataFrame({"stem": keys, "a": [toxic[k] for k in keys], "b": [clean[k] for k in keys]})

    sizes = train.agg(F.sum(F.col("toxic").cast("bigint")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    if not sizes["n"] or not sizes["a"] or sizes["a"] == sizes["n"]:
        return {}
    base = sizes["a"] / sizes["n"]
    found = train.mapInPandas(count, "stem string, a bigint, b bigint").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = F.col("a") / (F.col("a") + F.col("b"))
    # Chernoff bound, in nats: how unlikely so many toxic documents are among those with the stem.
    clean = F.when(F.col("b") > 0, F.col("b") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    found = cut_lineage(found.where(F.col("a") + F.col("b") >= LEAST_DOCS).withColumn("nats", F.col("a") * F.log(share / base) + clean))
    tried = max(1, found.count())
    marks = found.where((share >= LEAST_SHARE) & (F.col("nats") > math.log(tried) + 0.5))
    rows = marks.orderBy(F.desc("nats"), "stem").limit(max_stems).collect()
    top = max((r["nats"] for r in rows), default=1.0)
    return {r["stem"]: 0.75 + 0.25 * r["nats"] / top for r in rows}


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x[:, : len(self.weights)] @ self.weights + self.bias, -30, 30)))


def _prior() -> np.ndarray:
    return np.array([grammar_weight(k) for k in KINDS] + [0.0])


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton steps, pulled towards the grammar's own weights."""
    prior = np.append(_prior(), -3.0)
    beta, z = prior.copy(), np.hstack([x, np.ones((len(x), 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (p - y) + pull * (beta - prior)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + pull * np.eye(len(beta))
        move = np.linalg.solve(hessian, gradient)
        beta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, folds: int, held_out_fold: int, label: str = "toxic",
        max_stems: int = MAX_STEMS, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("toxic"))
    # At most max_fit_rows ids and labels: a proven size, so no text is shuffled to meet its label.
    sample = y.where(crc_fold(F.col("_id"), folds) != held_out_fold).orderBy(F.xxhash64("_id"), "_id").limit(max_fit_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("text").cast("string").alias("text"))
    known = texts.join(F.broadcast(cut_lineage(sample)), F.col("_doc") == F.col("_id")).select("text", "toxic")
    known = cut_lineage(known)
    # Copies of one text are one witness: else all its rare words would pass for marks.
    lexicon = Lexicon({s: 1.0 for s in INSULTS} | learn_stems(cut_lineage(known.dropDuplicates(["text"])), max_stems))

    def measure(batches):
        for b in batches:
            yield pd.DataFrame({"x": [document_events(t, lexicon)[:-1] for t in b["text"]], "y": b["toxic"]})

    rows = known.mapInPandas(measure, "x array<double>, y int").groupBy("x", "y").count().collect()
    if not rows:
        return Model(lexicon, _prior(), -3.0)
    x = np.repeat(np.array([r["x"] for r in rows], float), [r["count"] for r in rows], axis=0)
    weights, bias = fit_weights(x, np.repeat([r["y"] for r in rows], [r["count"] for r in rows]).astype(float))
    return Model(lexicon, weights, bias)


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, **options) -> DataFrame:
    """(doc_id, text_key, held_out, score, predicted, n_clauses) of every document; n_clauses had a match."""
    ship_package(docs.sparkSession)
    model = fit(docs, labels, folds, held_out_fold, **options)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([document_events(t.as_py(), model.lexicon) for t in batch.column(2)]) if len(batch) else np.empty((0, WIDTH))
            s = model.score(x)
            held = pa.array(np.asarray(batch.column(3)) == held_out_fold)
            out = [batch.column(0), batch.column(1), held, pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(x[:, -1].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_key", "held_out", "score", "predicted", "n_clauses"])

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"),
        F.col("text").cast("string").alias("text"), crc_fold(F.col("doc_id"), folds).alias("fold"),
    )
    return rows.mapInArrow(apply, "doc_id bigint, text_key bigint, held_out boolean, score double, predicted int, n_clauses bigint")
