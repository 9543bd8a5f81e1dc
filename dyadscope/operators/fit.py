"""Conditional logit on two-alternative events, with a cluster bootstrap, for one bounded sample.

With two alternatives and one chosen, the likelihood depends on d = chosen - other only:
sum of log sigmoid(d . beta). The functions here are the small numpy kernels that run inside a
task on one (track, split, design) sample; samples over the size bound go through
operators.distributed_fit, which takes the same replicate weights, rank rule, mode check and
optimiser steps from here and only sums elsewhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from dyadscope.settings import AdamSettings

MAX_NEWTON = 60
GRAD_TOL = 1e-10  # on the mean gradient
ACCEPT_TOL = 1e-5  # a fit whose mean gradient stays above this did not converge
CELLS_PER_BLOCK = 100_000  # events x replicates held at once: arrays that stay in a core's cache

FIT_SCHEMA = (
    "track string, split_role string, design_id int, fit_id int, beta double, llf double, "
    "design_rank int, fit_error string, boot_reps array<int>, boot_betas array<double>, boot_attempted int, point_fitted boolean"
)
_ARROW_TYPES = {
    "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow's form of a flat schema string."""
    return pa.schema([(name, _ARROW_TYPES[kind]) for name, kind in (f.strip().split(" ") for f in ddl.split(", "))])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of a matrix, nulls as NaN; there is no object for a list."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(lists), -1)


class Task(NamedTuple):
    """One bootstrap of a sample: its replicates from `start` on; `known` where the point fit is there already."""

    fit_id: int
    seed: int
    start: int = 0
    known: bool = False


def sigmoids(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log sigmoid, sigmoid) of z from one exponential, which never overflows."""
    small = np.exp(-np.abs(z))
    return np.minimum(z, 0.0) - np.log1p(small), np.where(z >= 0, 1.0, small) / (1.0 + small)


def log_sigmoid(z: np.ndarray) -> np.ndarray:
    return sigmoids(z)[0]


def sigmoid(z: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, small) / (1.0 + small)


def standardise(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shift, scale) per column: none for up to two distinct values, else mean and population sd."""
    shift, scale = np.zeros(levels.shape[1]), np.ones(levels.shape[1])
    for j in range(levels.shape[1]):
        col = levels[:, j]
        if len(np.unique(col)) <= 2:
            continue
        shift[j] = col.mean()
        sd = col.std()
        if sd > 0 and math.isfinite(sd):
            scale[j] = sd
    return shift, scale


def solve_newton(gram: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """Newton step per replicate; a regressor with no information keeps its coefficient."""
    return np.einsum("rij,rj->ri", np.linalg.pinv(gram, hermitian=True), grad)


def newton(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted fits for every column of w: (beta[r, k], log-likelihood[r], converged[r])."""
    k, r = d.shape[1], w.shape[1]
    total = np.maximum(w.sum(axis=0), 1.0)
    beta = np.zeros((r, k))
    llf = w.sum(axis=0) * -math.log(2.0)
    prob = np.full(w.shape, 0.5)  # of the chosen alternative at beta, for the active replicates
    active = np.ones(r, dtype=bool)
    mean_grad = np.full(r, np.inf)
    products = np.einsum("ni,nj->nij", d, d).reshape(len(d), k * k)
    for _ in range(MAX_NEWTON):
        idx = np.flatnonzero(active)
        if not len(idx):
            break
        wa, p = w[:, idx], prob
        pull = wa * (1.0 - p)
        grad = pull.T @ d
        mean_grad[idx] = np.abs(grad).max(axis=1) / total[idx]
        done = mean_grad[idx] <= GRAD_TOL
        active[idx[done]] = False
        if done.any():
            idx, wa, p, pull, grad = idx[~done], wa[:, ~done], p[:, ~done], pull[:, ~done], grad[~done]
        if not len(idx):
            break
        gram = ((pull * p).T @ products).reshape(-1, k, k)
        step = solve_newton(gram, grad)
        size = np.ones(len(idx))
        for _halving in range(30):
            trial = beta[idx] + size[:, None] * step
            ll, prob = sigmoids(d @ trial.T)
            value = np.einsum("nr,nr->r", wa, ll)
            worse = ~(value >= llf[idx] - 1e-12 * np.abs(llf[idx]))
            if not worse.any():
                break
            size[worse] *= 0.5
        still = value <= llf[idx]
        beta[idx], llf[idx] = trial, value
        # No gain in double precision: the optimum is reached as far as it can be resolved.
        stop = still & (mean_grad[idx] <= ACCEPT_TOL)
        active[idx[stop]] = False
        if stop.any():
            prob = prob[:, ~stop]
    finite = np.isfinite(beta).all(axis=1) & np.isfinite(llf)
    return beta, llf, finite & (mean_grad <= ACCEPT_TOL) & (w.sum(axis=0) > 0)


def clamped(opts: AdamSettings) -> AdamSettings:
    """Adam settings inside the limits that the optimiser accepts."""
    # Limits of the rates.
    return AdamSettings(
        max_iter=max(int(opts.max_iter), 1), learning_rate=max(opts.learning_rate, 1e-6), beta1=min(max(opts.beta1, 0.0), 0.9999),
        beta2=min(max(opts.beta2, 0.0), 0.999999), eps=max(opts.eps, 1e-12), l2=max(opts.l2, 0.0), min_iter=max(int(opts.min_iter), 0), tol=max(opts.tol, 0.0),
    )


def adam_step(m: np.ndarray, v: np.ndarray, grad: np.ndarray, t: int, opts: AdamSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(new first moment, new second moment, step to subtract) of clamped settings at iteration t."""
    m = opts.beta1 * m + (1.0 - opts.beta1) * grad
    v = opts.beta2 * v + (1.0 - opts.beta2) * grad * grad
    return m, v, opts.learning_rate * (m / (1.0 - opts.beta1**t)) / (np.sqrt(v / (1.0 - opts.beta2**t)) + opts.eps)


def adam(d: np.ndarray, w: np.ndarray, opts: AdamSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adam ascent with an L2 pull, each replicate stopped on its own step norm."""
    opts = clamped(opts)
    k, r = d.shape[1], w.shape[1]
    beta, m, v = np.zeros((r, k)), np.zeros((r, k)), np.zeros((r, k))
    live = np.ones(r, dtype=bool)
    norm = np.full(r, np.inf)
    for t in range(1, opts.max_iter + 1):
        idx = np.flatnonzero(live)
        if not len(idx):
            break
        p = sigmoid(d @ beta[idx].T)
        grad = opts.l2 * beta[idx] - (w[:, idx] * (1.0 - p)).T @ d
        m[idx], v[idx], step = adam_step(m[idx], v[idx], grad, t, opts)
        beta[idx] -= step
        norm[idx] = np.linalg.norm(step, axis=1)
        if t >= opts.min_iter:
            live[idx[norm[idx] <= opts.tol]] = False
    llf = (w * log_sigmoid(d @ beta.T)).sum(axis=0)
    return beta, llf, np.isfinite(beta).all(axis=1) & np.isfinite(llf) & np.isfinite(norm) & (w.sum(axis=0) > 0)


def gram_rank(gram: np.ndarray) -> int:
    """Rank of a design from the cross products of its standardised levels."""
    values = np.linalg.eigvalsh(gram)
    tol = max(values.max(), 0.0) * max(gram.shape) * 1e-13
    return int((values > tol).sum())


def optimizer(mode: str) -> str | None:
    """newton or adam; null for a mode that is not supported."""
    mode = (mode or "none").strip().lower()
    return {"none": "newton", "statsmodels": "newton", "adam_lite": "adam"}.get(mode)


def unsupported(mode: str) -> str:
    return f"fit_failed:unsupported_optimizer_mode:{(mode or 'none').strip().lower()}"


def solver(mode: str, opts: AdamSettings) -> Callable[[np.ndarray, np.ndarray], tuple] | None:
    known = optimizer(mode)
    return None if known is None else newton if known == "newton" else lambda d, w: adam(d, w, opts)


# Cumulative Poisson(1) probabilities for 0, 1, ...: beyond the last the tail is below the resolution of a double.
_TERMS = np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 22.0)]))
POISSON_CDF = np.cumsum(_TERMS)
# The weight by the first 16 bits of a draw; UNSURE where one of the limits lies among the draws that share them.
_FIRST = np.arange(1 << 16) / (1 << 16)
_LEAST, _MOST = (np.searchsorted(POISSON_CDF, u, side="right") for u in (_FIRST, _FIRST + 1 / (1 << 16) - 1 / (1 << 53)))
UNSURE = 255
WEIGHT_BY_BITS = np.where(_LEAST == _MOST, _LEAST, UNSURE).astype(np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64, copy=False)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def poisson_weights(cluster_hash: np.ndarray, seed: int, replicates: np.ndarray) -> np.ndarray:
    """Weight of each row's cluster in each replicate; the same wherever it is computed."""
    with np.errstate(over="ignore"):
        streams = mix64(mix64(np.array([seed], dtype=np.int64).view(np.uint64)) ^ replicates.astype(np.uint64))
        bits = mix64(cluster_hash.view(np.uint64)[:, None] ^ streams[None, :])
    weights = WEIGHT_BY_BITS[bits >> np.uint64(48)]
    unsure = np.flatnonzero(weights == UNSURE)
    u = (bits.ravel()[unsure] >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))
    weights.ravel()[unsure] = np.searchsorted(POISSON_CDF, u, side="right")
    return weights.astype(np.float64)


def cluster_hash(ids: Column) -> Column:
    """First 60 bits of the sha256 of a cluster id; 0 for a null."""
    return F.coalesce(F.conv(F.substring(F.sha2(ids.cast("string"), 256), 1, 15), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def cluster_hashes(clusters: np.ndarray) -> np.ndarray:
    """The same of an array; each different id is hashed once."""
    ids, codes = np.unique(np.array(["" if c is None else str(c) for c in clusters], dtype=str), return_inverse=True)
    found = np.array([int(hashlib.sha256(str(i).encode()).hexdigest()[:15], 16) for i in ids], dtype=np.int64)[codes]
    found[[c is None for c in clusters]] = 0
    return found


def draw_multiplicities(codes: np.ndarray, n_clusters: int, n_draws: int, rng: np.random.Generator) -> np.ndarray:
    """Event weights for a block of replicates; clusters are drawn with replacement, in order."""
    out = np.empty((len(codes), n_draws))
    for b in range(n_draws):
        drawn = rng.choice(n_clusters, size=n_clusters, replace=True)
        out[:, b] = np.bincount(drawn, minlength=n_clusters)[codes]
    return out


def replicate_weights(clusters: np.ndarray, n_boot: int, seed: int, resampling: str, block: int, start: int = 0, hashed: bool = False) -> Iterator[np.ndarray]:
    """Event weights of the replicates from `start` on, `block` columns at a time.

    poisson: hash draws per cluster, equal at every sample size, each replicate on its own; `clusters` may be `hashed` already.
    fixed_size: as many clusters as there are, drawn in sequence from a seeded generator; for samples that fit one task only.
    """
    if resampling == "poisson":
        hashes = clusters if hashed else cluster_hashes(clusters)
        for at in range(start, n_boot, block):
            yield poisson_weights(hashes, int(seed), np.arange(at, min(at + block, n_boot)))
        return
    if start:
        raise ValueError("draws in sequence have no replicates to go on from")
    ids, codes = np.unique(clusters.astype(str), return_inverse=True)
    rng = np.random.default_rng(int(seed))
    for start in range(0, n_boot, block):
        yield draw_multiplicities(codes, len(ids), min(block, n_boot - start), rng)


def bootstrap_key(d: np.ndarray, clusters: np.ndarray, n_boot: int, seed: int, fit: Callable, resampling: str = "poisson", start: int = 0, hashed: bool = False) -> tuple[list[int], list[float]]:
    """Replicates from `start` on that converged, and their key coefficients."""
    reps: list[int] = []
    betas: list[float] = []
    at = start
    for w in replicate_weights(clusters, n_boot, seed, resampling, max(1, CELLS_PER_BLOCK // max(len(d), 1)), start, hashed):
        beta, _, ok = fit(d, w)
        reps.extend((at + np.flatnonzero(ok)).tolist())
        betas.extend(beta[ok, 0].tolist())
        at += w.shape[1]
    return reps, betas


def fit_sample(
    chosen: np.ndarray,
    other: np.ndarray,
    clusters: np.ndarray,
    tasks: Sequence[tuple],
    n_boot: int,
    mode: str,
    opts: AdamSettings,
    resampling: str = "poisson",
    hashed: bool = False,
) -> list[dict]:
    """Point fit once, unless every task knows it, then the bootstrap of every task (fields of `Task`).

    `clusters` are ids, or their hashes if `hashed`.
    """
    tasks = [Task(*t) for t in tasks]
    k = chosen.shape[1]
    empty = {"beta": None, "llf": None, "boot_reps": [], "boot_betas": [], "boot_attempted": 0, "point_fitted": False}
    levels = np.vstack([chosen, other])
    shift, scale = standardise(levels)
    centred = (levels - shift) / scale
    rank = gram_rank(centred.T @ centred)
    base = {**empty, "design_rank": rank, "fit_error": None}
    if rank < k:
        return [{**base, "fit_id": t.fit_id} for t in tasks]
    fit = solver(mode, opts)
    if fit is None:
        return [{**base, "fit_id": t.fit_id, "fit_error": unsupported(mode)} for t in tasks]
    d = (chosen - other) / scale
    point = {}
    if not all(t.known for t in tasks):
        beta, llf, ok = fit(d, np.ones((len(d), 1)))
        if not ok[0]:
            finite = np.isfinite(beta[0]).all() and np.isfinite(llf[0])
            reason = "non_converged" if finite else "non_finite_estimate"
            return [{**base, "fit_id": t.fit_id, "fit_error": f"fit_failed:{reason}", "point_fitted": True} for t in tasks]
        point = {"beta": float(beta[0, 0]), "llf": float(llf[0]), "point_fitted": True}
    out = []
    for t in tasks:
        reps, betas = bootstrap_key(d, clusters, n_boot, t.seed, fit, resampling, t.start, hashed)
        out.append({**base, **({} if t.known else point), "fit_id": t.fit_id, "boot_reps": reps, "boot_betas": betas, "boot_attempted": max(n_boot - t.start, 0)})
    return out


def grouped_fit(n_boot: int, mode: str, opts: AdamSettings, resampling: str = "poisson") -> Callable:
    """Function for cogroup: the long design rows of one sample with its tasks.

    Rows stay Arrow columns until they are matrices: a sample costs its numbers, not an object for each event. `boot`
    holds cluster hashes, or ids for draws in sequence.
    """
    schema = arrow_schema(FIT_SCHEMA)

    def run(rows: pa.Table, tasks: pa.Table) -> pa.Table:
        if not rows.num_rows or not tasks.num_rows:
            return schema.empty_table()
        order = pc.sort_indices(rows["event_id"]).to_numpy()
        results = fit_sample(
            matrix(rows["chosen"])[order],
            matrix(rows["other"])[order],
            rows["boot"].to_numpy()[order],
            list(zip(*(tasks[c].to_pylist() for c in ("fit_id", "seed", "start", "known")), strict=True)),
            n_boot,
            mode,
            opts,
            resampling,
            pa.types.is_integer(rows.schema.field("boot").type),
        )
        key = {c: rows[c][0].as_py() for c in ("track", "split_role", "design_id")}
        return pa.Table.from_pylist([{**r, **key} for r in results], schema=schema)

    return run
