"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of a whole text (lengths, letter, digit, symbol and capital shares, repeated words and
lines, word variety) are standardised with the moments of the training rows. Random Fourier features
cos(w x + b) with normal w approximate a Gaussian kernel over them. Each training partition adds up
its part of the normal equations, the parts are summed by row of the matrix, and the small ridge
system is solved once. Isotonic regression over the training rows, counted in score bins, turns ridge
scores into probabilities that never fall as the ridge score rises.

What reaches the driver does not depend on the data: moments, a matrix of `n_features` + 1, and the
score bins. All labelled training rows are used; `statistics` reads every text once.

Defined cases: null and empty texts have all-zero statistics and get a score; a null id is in fold 0
and has no label; several labels of an id count as their mean, null labels do not count; without any
training row every score is 0.5; equal rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadscope.llm.common import crc_fold, cut_lineage, ship_package, text_bytes, text_key

N_FEATURES = 192
SEED = 20260220
RIDGE = 1.0
GAMMA = 0.03
#: Bins of the ridge score, from -0.5 to 1.5, in which training rows are counted for calibration.
BINS = 800

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "capital_share", "digit_share", "symbol_share", "punctuation_share", "other_share",
    "variety", "same_as_last", "top_gap", "lines_per_word", "repeated_lines", "edge_symbols", "shouting",
)
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = (1 if 65 <= _c <= 90 else 2 if 97 <= _c <= 122 else 3 if 48 <= _c <= 57 else 4 if chr(_c) in ".,;:'\"?()-" else 5 if 33 <= _c < 127 else 6 if _c >= 128 else 0)


def text_statistics(raw: bytes | None, step: int = 1 << 20) -> list[float]:
    """Shares and means over a whole text, read in pieces of about `step` bytes."""
    raw = raw or b""
    if not raw.strip():
        return [0.0] * len(STATISTICS)
    classes = np.zeros(7)
    n_words = chars = same = edges = shouts = distinct = pieces = 0
    last = b""
    lines = raw.split(b"\n")
    at = 0
    while at < len(raw):
        end = min(at + step, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        part = raw[at:end]
        classes += np.bincount(_CLASS[np.frombuffer(part, np.uint8)], minlength=7)
        words = part.split()
        at = end
        if not words:
            continue
        n_words += len(words)
        chars += sum(map(len, words))
        same += sum(map(bytes.__eq__, words, [last, *words[:-1]]))
        last = words[-1]
        edges += sum(w[-1] in b"|#$%&*!@=+<>~^_" for w in words)
        shouts += sum(map(bytes.isupper, words))
        for k in range(0, len(words), 200):  # variety in pieces of equal length does not fall with the length of a text
            distinct += len(set(words[k : k + 200])) / len(words[k : k + 200])
            pieces += 1
    total = max(1.0, classes.sum())
    ends = len(re.findall(rb"[.?!]\s", raw))
    return [
        math.log1p(len(raw)), math.log1p(n_words), min(40.0, chars / max(1, n_words)), classes[1] / total, classes[3] / total, classes[5] / total,
        classes[4] / total, classes[6] / total, distinct / max(1, pieces), same / max(1, n_words), math.log1p(n_words / (1 + ends)),
        min(1.0, len(lines) / max(1, n_words)), 1 - len(set(lines)) / len(lines), edges / max(1, n_words), shouts / max(1, n_words),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = pa.array([text_statistics(x.as_py()) for x in batch.column(2)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), stats], ["doc_id", "text_key", "fold", "stats"])


def statistics(docs: DataFrame, folds: int) -> DataFrame:
    """(doc_id, text_key, fold, stats) of every row; fold is crc32 of the id modulo `folds`."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"),
        text_bytes(F.col("text")).alias("raw"), crc_fold(F.col("doc_id"), folds).alias("fold"),
    )
    return rows.mapInArrow(_measure, "doc_id bigint, text_key bigint, fold bigint, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), np.cos(z @ self.weights + self.phase) * math.sqrt(2 / len(self.phase))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        # A thousandth of the ridge score keeps the order inside the steps of the isotonic curve.
        return 0.999 * np.interp(raw, self.knots, self.levels) + 0.001 * np.clip(raw, 0, 1)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.empty((0, width))


def _sum_rows(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of the partitions' matrices: rows (i, values) are added up by i in Spark."""
    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [np.sum(_matrix(pdf["v"], width), axis=0)]})

    found = parts.groupBy("i").applyInPandas(add, "i int, v array<double>").collect()
    out = np.zeros((max((r["i"] for r in found), default=-1) + 1, width))
    for r in found:
        out[r["i"]] = r["v"]
    return out


def _moments(train: DataFrame) -> np.ndarray:
    d = len(STATISTICS)

    def part(batches):
        total = np.zeros((3, d))
        for b in batches:
            x = _matrix(b["stats"], d)
            total += [np.full(d, len(x)), x.sum(axis=0), (x * x).sum(axis=0)]
        yield pd.DataFrame({"i": range(3), "v": list(total)})

    return _sum_rows(train.select("stats").mapInPandas(part, "i int, v array<double>"), d)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by x; the curve as (position, level) of the pooled blocks."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n, strict=True):
        blocks.append([xi * ni, yi * ni, ni])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(measured: DataFrame, labels: DataFrame, held_out_fold: int, label: str = "quality", n_features: int = N_FEATURES,
        ridge: float = RIDGE, gamma: float = GAMMA, seed: int = SEED) -> Model:
    """Fit on the labelled rows outside the held-out fold."""
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg(label).alias("y"))
    train = cut_lineage(measured.where(F.col("fold") != held_out_fold).join(y, "doc_id").select("stats", "y"))
    moments = _moments(train)
    rng = np.random.default_rng(seed)
    d = len(STATISTICS)
    weights, phase = rng.normal(scale=math.sqrt(2 * gamma), size=(d, n_features)), rng.uniform(0, 2 * math.pi, n_features)
    if not len(moments) or not moments[0, 0]:
        return Model(np.zeros(d), np.ones(d), weights, phase)
    n = moments[0, 0]
    mean = moments[1] / n
    model = Model(mean, np.sqrt(np.maximum(moments[2] / n - mean**2, 1e-8)) + 1e-3, weights, phase)
    width = n_features + 2

    def equations(batches):
        total = np.zeros((width, width))
        for b in batches:
            z = np.hstack([model.features(_matrix(b["stats"], d)), b["y"].to_numpy()[:, None]])
            total += z.T @ z
        yield pd.DataFrame({"i": range(width), "v": list(total)})

    sums = _sum_rows(train.mapInPandas(equations, "i int, v array<double>"), width)
    penalty = np.eye(width - 1) * ridge
    penalty[0, 0] = 1e-6
    model.beta = np.linalg.solve(sums[:-1, :-1] + penalty, sums[:-1, -1])

    def binned(batches):
        for b in batches:
            raw = model.raw(_matrix(b["stats"], d))
            yield pd.DataFrame({"bin": np.clip((raw + 0.5) * (BINS / 2), 0, BINS).astype(int), "raw": raw, "y": b["y"]})

    bins = train.mapInPandas(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("y").alias("n"))
    rows = sorted(map(tuple, bins.collect()))
    model.knots, model.levels = isotonic(*(np.array([r[k] for r in rows], float) for k in (1, 2, 3)))
    return model


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, **options) -> DataFrame:
    """(doc_id, text_key, held_out, score, predicted) of every document."""
    measured = cut_lineage(statistics(docs, folds))
    model = fit(measured, labels, held_out_fold, **options)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array(batch.column(3).to_pylist(), float).reshape(-1, len(STATISTICS))
            s = np.clip(model.score(stats), 0.0, 1.0)
            held = pa.array(np.asarray(batch.column(2)) == held_out_fold)
            out = [batch.column(0), batch.column(1), held, pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_key", "held_out", "score", "predicted"])

    return measured.mapInArrow(apply, "doc_id bigint, text_key bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, **options) -> DataFrame:
    """Documents that the classifier does not reject; same columns. Texts are scored where they are read, none is shuffled."""
    model = fit(cut_lineage(statistics(docs, folds)), labels, held_out_fold, **options)

    @F.pandas_udf("boolean")
    def good(raw: pd.Series) -> pd.Series:
        stats = np.array([text_statistics(x) for x in raw], float).reshape(-1, len(STATISTICS))
        return pd.Series(model.score(stats) >= 0.5)

    return docs.where(good(text_bytes(F.col("text"))))
