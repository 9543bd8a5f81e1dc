"""Conditional logit and bootstrap for samples too large for one task.

The event table stays partitioned as it is, and is never multiplied by designs: a task derives the
differences of each design from the two rows of its events, batch by batch. Coefficients and step state are a written table, a row for each slot (sample, bootstrap,
replicate). A pass reads the active slots in the tasks, adds up gradients and curvatures by slot, joins them
to the state and writes the moved slots on; the driver gets their number, and rows of events never move.
Replicate weights are Poisson(1) draws computed from
(seed, replicate, cluster hash) wherever the row happens to be, so clusters need no shuffle and a
cluster holding a third of the rows is spread over as many tasks as its rows are. Weights, rank
rule, mode check and optimiser steps are those of operators.fit: the size of a sample decides where
its sums run, not what they are. Samples with one regressor need one pass, however many steps their fit takes: it folds
them to weighted points (operators.folding), and the fits run on those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dyadscope.operators import fit as kernel
from dyadscope.operators import folding
from dyadscope.session import cut_lineage, read_in_task, shared_path
from dyadscope.settings import AdamSettings

KEY = ("track", "split_role", "design_id")
PARTIAL_SCHEMA = "track string, split_role string, design_id int, slot int, pos int, value double"
SUMS_SCHEMA = "track string, split_role string, design_id int, slot int, sums array<double>"
STATE_SCHEMA = (
    "track string, split_role string, design_id int, k int, slot int, task int, seed bigint, rep int, scale array<double>, beta array<double>, "
    "step array<double>, first array<double>, second array<double>, llf double, mean_grad double, halvings int, steps int, weight double, hits double, active boolean"
)
STATE_COLUMNS = [f.split()[0] for f in STATE_SCHEMA.split(", ")]
ALL_DESIGNS = -1
FOLD_SCHEMA = "track string, split_role string, design_id int, slot int, part int, sums array<double>"
FOLD_FITS = "track string, split_role string, design_id int, slot int, f_beta double, f_llf double, f_weight double, f_ok boolean"
#: Slots of a sample that are fitted together, and bytes of sums that a task holds in one pass.
FOLD_SLOTS = 16
FOLD_BYTES = 64 << 20
#: A sample is folded that has so many times more events than points.
FOLD_GAIN = 8
MAX_FOLD_PARTITIONS = 1024


def fit_rows(events: DataFrame, sparse_pairs: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Narrow numeric rows of the events: packed outcomes, regressors, cluster hash.

    `keys` are the one or two columns that separate samples. Rows of `sparse_pairs` hold for one
    design only.
    """

    def narrow(df: DataFrame, only: Column) -> DataFrame:
        names = [F.col(k) for k in keys] + [F.lit("")] * (2 - len(keys))
        return df.select(
            names[0].alias("track"), names[1].alias("split_role"), only.cast("int").alias("only"), kernel.cluster_hash(F.col("boot")).alias("cluster_hash"),
            *[F.col(f"{side}.{part}").alias(f"{side}_{part}") for side in ("lo", "hi") for part in ("ys", "xs", "place")],
        )

    rows = narrow(events.where("n = 2"), F.lit(ALL_DESIGNS))
    return rows if sparse_pairs is None else rows.unionByName(narrow(sparse_pairs, F.col("design.design_id")))


@dataclass(frozen=True)
class Pairs:
    """One design's usable events in a batch."""

    chosen: np.ndarray
    other: np.ndarray
    cluster_hash: np.ndarray
    chosen_first: np.ndarray

    @property
    def d(self) -> np.ndarray:
        return self.chosen - self.other


def batch_pairs(batch: pa.RecordBatch, plan: dict[tuple, list[tuple[int, int, list[int]]]], vary: bool) -> Iterator[tuple[tuple, Pairs]]:
    """(sample key, usable events) for each sample in a batch; plan: (track, split) -> [(design, y, regressors)]."""
    found = batch.select(["track", "split_role"]).to_pandas().groupby(["track", "split_role"], sort=False).indices
    for (track, role), at in found.items():
        designs = plan.get((track, role), [])
        if not designs:
            continue
        rows = batch if len(at) == batch.num_rows else batch.take(pa.array(at))
        lo_y, hi_y, lo_x, hi_x = (kernel.matrix(rows.column(c)) for c in ("lo_ys", "hi_ys", "lo_xs", "hi_xs"))
        only, h, lo_place, hi_place = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("only", "cluster_hash", "lo_place", "hi_place"))
        order = lo_place.astype(float) - hi_place.astype(float)
        for design_id, y, exog in designs:
            a, b = lo_x[:, exog], hi_x[:, exog]
            use = (only == ALL_DESIGNS) | (only == design_id)
            use &= np.trunc(lo_y[:, y] + hi_y[:, y]) == 1
            use &= np.isfinite(a).all(axis=1) & np.isfinite(b).all(axis=1)
            if vary:
                use &= a[:, 0] != b[:, 0]
            if not use.any():
                continue
            high = (hi_y[:, y] > lo_y[:, y])[use]
            pos, neg = np.where(high[:, None], b[use], a[use]), np.where(high[:, None], a[use], b[use])
            gap = order[use]
            yield (track, role, design_id), Pairs(pos, neg, h[use], np.where(high, gap >= 0, gap <= 0))


def _arrow_batch(schema: pa.Schema, key: tuple, **columns) -> pa.RecordBatch:
    """Rows of one sample key in the order of the schema; scalars repeat."""
    return pa.RecordBatch.from_pandas(pd.DataFrame({**dict(zip(KEY, key, strict=True)), **columns}), schema=schema, preserve_index=False)


@dataclass(frozen=True)
class Sample:
    """Where the rows are and which designs each (track, split) has."""

    rows: DataFrame
    plan: dict[tuple, list[tuple[int, int, list[int]]]]
    vary: bool = True

    def totals(self, kernel_sums: Callable[[tuple, Pairs], np.ndarray | None], how: str = "sum") -> dict[tuple, np.ndarray]:
        """Reduce per-batch arrays (slots x positions) over the whole table, per sample key.

        Partitions add up their batches first; what is shuffled and read back has the size of
        the plan.
        """
        plan, vary = self.plan, self.vary
        # "sum, max": sums in the first slot, maxima in the second.
        combine = {"sum": np.add, "max": np.maximum, "sum, max": lambda a, b: np.vstack([a[0] + b[0], np.maximum(a[1], b[1])])}[how]

        schema = kernel.arrow_schema(PARTIAL_SCHEMA)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for key, pairs in batch_pairs(batch, plan, vary):
                    part = kernel_sums(key, pairs)
                    if part is not None:
                        acc[key] = combine(acc[key], part) if key in acc else part
            for key, arr in acc.items():
                n, width = arr.shape
                yield _arrow_batch(schema, key, slot=np.repeat(np.arange(n), width), pos=np.tile(np.arange(width), n), value=arr.ravel())

        fold = {"sum": F.sum, "max": F.max, "sum, max": lambda c: F.when(F.col("slot") == 0, F.sum(c)).otherwise(F.max(c))}[how]
        total = self.rows.mapInArrow(run, PARTIAL_SCHEMA).groupBy(*KEY, "slot", "pos").agg(fold("value").alias("value")).toPandas()
        out: dict[tuple, np.ndarray] = {}
        for key, part in total.groupby(list(KEY), sort=False):
            arr = np.zeros((int(part["slot"].max()) + 1, int(part["pos"].max()) + 1))
            arr[part["slot"].to_numpy(), part["pos"].to_numpy()] = part["value"].to_numpy()
            out[(key[0], key[1], int(key[2]))] = arr
        return out


@dataclass(frozen=True)
class Coefficients:
    """Active slots of one sample, as a task reads them from the state table."""

    slots: np.ndarray
    seeds: np.ndarray
    reps: np.ndarray
    beta: np.ndarray
    scale: np.ndarray

    def between(self, first: int, end: int) -> Coefficients:
        at = np.flatnonzero((self.slots >= first) & (self.slots < end))
        return Coefficients(self.slots[at], self.seeds[at], self.reps[at], self.beta[at], self.scale)

    def weights(self, cluster_hash: np.ndarray, part: np.ndarray) -> np.ndarray:
        out = np.ones((len(cluster_hash), len(part)))
        drawn = self.reps[part] >= 0
        for seed in np.unique(self.seeds[part][drawn]):
            here = np.flatnonzero(drawn & (self.seeds[part] == seed))
            out[:, here] = kernel.poisson_weights(cluster_hash, int(seed), self.reps[part][here])
        return out


def _coefficients(path: str) -> dict[tuple, Coefficients]:
    columns = [*KEY, "slot", "seed", "rep", "beta", "scale"]
    rows = read_in_task(path, [*columns, "active"], dataset.field("active")).to_pandas()
    return {
        (key[0], key[1], int(key[2])): Coefficients(
            p["slot"].to_numpy(), p["seed"].to_numpy(np.int64), p["rep"].to_numpy(), np.vstack(p["beta"].to_numpy()), np.asarray(p["scale"].iloc[0], float))
        for key, p in rows.groupby(list(KEY), sort=False)
    }


def _replicate_sums(own: Coefficients, pairs: Pairs, curvature: bool) -> np.ndarray:
    """Per active slot: weight, log-likelihood, hits, gradient, and the curvature when asked for."""
    d = pairs.d / own.scale
    products = np.einsum("ni,nj->nij", d, d).reshape(len(d), -1)
    block = max(1, kernel.CELLS_PER_BLOCK // max(len(d), 1))
    parts = []
    for s in range(0, len(own.slots), block):
        part = np.arange(s, min(s + block, len(own.slots)))
        w = own.weights(pairs.cluster_hash, part)
        ll, p = kernel.sigmoids(d @ own.beta[part].T)
        hit = np.where(p == 0.5, pairs.chosen_first[:, None], p > 0.5)
        pull = w * (1 - p)
        cols = [w.sum(axis=0)[:, None], np.einsum("nr,nr->r", w, ll)[:, None], np.einsum("nr,nr->r", w, hit)[:, None], pull.T @ d]
        if curvature:
            cols.append((pull * p).T @ products)
        parts.append(np.hstack(cols))
    return np.vstack(parts)


def slot_sums(sample: Sample, path: str, curvature: bool) -> DataFrame:
    """(key, slot, sums) of the active slots of the state table at `path`, added up over all events."""
    plan, vary = sample.plan, sample.vary
    width = max(3 + len(x) + curvature * len(x) ** 2 for designs in plan.values() for _, _, x in designs)
    schema = kernel.arrow_schema(SUMS_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = _coefficients(path)
        live = {(t, r): [d for d in designs if (t, r, d[0]) in states] for (t, r), designs in plan.items()}
        acc: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, pairs in batch_pairs(batch, live, vary):
                part = _replicate_sums(states[key], pairs, curvature)
                acc[key] = acc[key] + part if key in acc else part
        for key, arr in acc.items():
            yield _arrow_batch(schema, key, slot=states[key].slots, sums=list(arr))

    state = sample.rows.sparkSession.read.parquet(path)
    wanted = F.broadcast(state.where("active").select("track", "split_role").distinct())  # as many as the plan has
    parts = sample.rows.join(wanted, ["track", "split_role"], "left_semi").mapInArrow(run, SUMS_SCHEMA)
    return parts.groupBy(*KEY, "slot").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))


def _rows_matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


def newton_update(s: pd.DataFrame) -> pd.DataFrame:
    """State after one pass of slots that have the same number of regressors."""
    k = int(s["k"].iloc[0])
    beta, step, sums = (_rows_matrix(s[c]) for c in ("beta", "step", "sums"))
    old, halvings, steps, active = (s[c].to_numpy().copy() for c in ("llf", "halvings", "steps", "active"))
    weight, llf, grad = sums[:, 0], sums[:, 1], sums[:, 3 : 3 + k]
    mean_grad, kept_weight, hits = (s[c].to_numpy().copy() for c in ("mean_grad", "weight", "hits"))
    # A step that lowered the likelihood is taken back half-way.
    worse = (llf < old - 1e-12 * np.abs(np.where(np.isfinite(old), old, 0.0))) & (halvings < 30)
    step[worse] *= 0.5
    beta[worse] -= step[worse]
    halvings[worse] += 1
    go = ~worse
    gain = llf - old
    size = np.abs(grad).max(axis=1) / np.maximum(weight, 1.0)
    old[go], mean_grad[go], halvings[go], kept_weight[go], hits[go] = llf[go], size[go], 0, weight[go], sums[go, 2]
    done = go & ((size <= kernel.GRAD_TOL) | ((gain <= 0) & (size <= kernel.ACCEPT_TOL)))
    active[done] = False
    on = np.flatnonzero(go & ~done)
    if len(on):
        step[on] = kernel.solve_newton(sums[on, 3 + k : 3 + k + k * k].reshape(-1, k, k), grad[on])
        beta[on] += step[on]
        steps[on] += 1
        active[on[steps[on] > kernel.MAX_NEWTON]] = False
    return s.assign(beta=list(beta), step=list(step), llf=old, mean_grad=mean_grad, halvings=halvings, steps=steps, weight=kept_weight, hits=hits, active=active)


def adam_update(s: pd.DataFrame, t: int, opts: AdamSettings) -> pd.DataFrame:
    k = int(s["k"].iloc[0])
    beta, m, v, sums = (_rows_matrix(s[c]) for c in ("beta", "first", "second", "sums"))
    grad = opts.l2 * beta - sums[:, 3 : 3 + k]
    m, v, step = kernel.adam_step(m, v, grad, t, opts)
    norm = np.linalg.norm(step, axis=1)
    # A replicate's likelihood is not asked for; that of the point fit is summed once at the end.
    return s.assign(
        beta=list(beta - step), first=list(m), second=list(v), weight=sums[:, 0], llf=0.0, mean_grad=np.where(np.isfinite(norm), 0.0, np.inf),
        active=(norm > opts.tol) if t >= opts.min_iter else True,
    )


def _updated(update: Callable[[pd.DataFrame], pd.DataFrame]):
    """Task that moves each slot on by its sums; a slot without events ends."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lost = batch["sums"].isna()
            if lost.any():
                yield batch[lost].assign(active=False, mean_grad=np.inf)[STATE_COLUMNS]
            for _, part in batch[~lost].groupby("k", sort=False):
                yield update(part)[STATE_COLUMNS]

    return run


def initial_state(sample: Sample, tasks: dict[tuple, list[kernel.Task]], scales: dict[tuple, np.ndarray], n_boot: int) -> DataFrame:
    """A row for each slot: the point fit of each sample that needs it, and the replicates of its tasks."""
    spark = sample.rows.sparkSession
    points = [(*key, -1, 0, -1, -1, scales[key].tolist()) for key, jobs in tasks.items() if not all(t.known for t in jobs)]
    boots = [(*key, i, t.seed, t.start, n_boot - 1, scales[key].tolist()) for key, jobs in tasks.items() for i, t in enumerate(jobs) if t.start < n_boot]
    rows = spark.createDataFrame(points + boots, "track string, split_role string, design_id int, task int, seed bigint, lo int, hi int, scale array<double>")
    zero = F.transform("scale", lambda x: F.lit(0.0))
    return rows.select("*", F.explode(F.sequence("lo", "hi")).alias("rep")).select(
        *KEY, F.size("scale").alias("k"), F.when(F.col("task") < 0, 0).otherwise(1 + F.col("task") * n_boot + F.col("rep")).alias("slot"), "task", "seed", "rep", "scale",
        zero.alias("beta"), zero.alias("step"), zero.alias("first"), zero.alias("second"), F.lit(float("-inf")).alias("llf"), F.lit(float("inf")).alias("mean_grad"),
        F.lit(0).alias("halvings"), F.lit(0).alias("steps"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("hits"), F.lit(True).alias("active"),
    )


def iterate(sample: Sample, state: DataFrame, adam: AdamSettings | None = None) -> DataFrame:
    """Last state of every slot, by passes over the events until all have settled.

    A pass reads the slots that are still active, joins their summed gradients and writes them on as a table
    of its own; what has settled stays in the table of its pass. The driver gets the number of active slots. A Newton
    step that is taken back costs a pass but no step of the slot's budget.
    """
    spark = state.sparkSession
    paths = [shared_path(spark)]
    state.write.parquet(paths[0])
    t, left = 0, 1
    while left and (adam is None or t < adam.max_iter):
        t += 1
        moved = spark.read.schema(STATE_SCHEMA).parquet(paths[-1]).where("active").join(slot_sums(sample, paths[-1], adam is None), [*KEY, "slot"], "left")
        update = newton_update if adam is None else partial(adam_update, t=t, opts=adam)
        seen = Observation()
        paths.append(shared_path(spark))
        moved.mapInPandas(_updated(update), STATE_SCHEMA).observe(seen, F.count_if("active").alias("active")).write.parquet(paths[-1])
        left = seen.get["active"]
    settled = spark.read.schema(STATE_SCHEMA).parquet(*paths).where("not active")
    return settled.unionByName(spark.read.schema(STATE_SCHEMA).parquet(paths[-1]).where("active")) if left else settled


def _settled() -> Column:
    """Slots with a finite, converged fit on a sample that has any weight."""
    finite = F.forall("beta", lambda x: F.abs(x) < float("inf")) & (F.abs("llf") < float("inf"))
    return finite & (F.col("mean_grad") <= kernel.ACCEPT_TOL) & (F.col("weight") > 0)


@dataclass
class Moments:
    """Both alternatives of every usable event: count, shift and scale of the levels, rank of the design."""

    n_events: int
    shift: np.ndarray
    scale: np.ndarray
    rank: int
    reach: np.ndarray  # largest difference of the alternatives, standardised


def sample_moments(sample: Sample, seen: dict[tuple, Moments] | None = None) -> dict[tuple, Moments]:
    """Standardisation and rank of every sample, in two plan-sized reductions.

    `seen` keeps them by (track, split, outcome, regressors): samples found there are not read again.
    """
    seen = {} if seen is None else seen
    ids = {(t, r, d): (t, r, y, tuple(x)) for (t, r), designs in sample.plan.items() for d, y, x in designs}
    new = {key: [d for d in designs if ids[(*key, d[0])] not in seen] for key, designs in sample.plan.items()}
    new = {key: designs for key, designs in new.items() if designs}
    if new:
        seen |= {ids[key]: m for key, m in _moments(Sample(sample.rows, new, sample.vary)).items()}
    return {key: seen[name] for key, name in ids.items() if name in seen}


def _moments(sample: Sample) -> dict[tuple, Moments]:
    def levels(pairs: Pairs) -> np.ndarray:
        return np.vstack([pairs.chosen, pairs.other])

    def first(_: tuple, pairs: Pairs) -> np.ndarray:
        x = levels(pairs)
        sums = np.hstack([[len(pairs.chosen)], x.sum(axis=0)])
        ends = np.hstack([(-x).max(axis=0), x.max(axis=0), np.abs(pairs.d).max(axis=0)])
        out = np.zeros((2, max(len(sums), len(ends))))
        out[0, : len(sums)], out[1, : len(ends)] = sums, ends
        return out

    both = sample.totals(first, "sum, max")
    width = {key: len(x) for (t, r), designs in sample.plan.items() for d, _, x in designs for key in [(t, r, d)]}
    sums = {key: v[:1, : 1 + width[key]] for key, v in both.items()}
    low, high, gap = ({key: sign * np.split(v[1, : 3 * width[key]], 3)[i] for key, v in both.items()} for i, sign in enumerate((-1, 1, 1)))
    mean = {k: v[0, 1:] / (2 * v[0, 0]) for k, v in sums.items()}

    def centred(key: tuple, pairs: Pairs) -> np.ndarray:
        x = levels(pairs)
        inside = ((x != low[key]) & (x != high[key])).sum(axis=0)
        c = x - mean[key]
        return np.vstack([c.T @ c, inside])

    out = {}
    for key, arr in sample.totals(centred).items():
        n = 2 * sums[key][0, 0]
        cross, more = arr[:-1], arr[-1] > 0
        sd = np.sqrt(np.diag(cross) / n)
        shift = np.where(more, mean[key], 0.0)
        scale = np.where(more & (sd > 0), sd, 1.0)
        offset = mean[key] - shift  # left in by columns that are not centred
        gram = (cross + n * np.outer(offset, offset)) / np.outer(scale, scale)
        out[key] = Moments(int(sums[key][0, 0]), shift, scale, kernel.gram_rank(gram), gap[key] / scale)
    return out


def _folded_turns(moments: dict[tuple, Moments], tasks: dict[tuple, list[kernel.Task]], n_boot: int) -> list[dict[tuple, tuple[int, int]]]:
    """Slots (first, end) by sample for each pass that folds; samples that do not gain from it are left out."""
    turns: list[dict[tuple, tuple[int, int]]] = []
    room = 0
    for key, jobs in tasks.items():
        m = moments[key]
        if len(m.scale) != 1 or not m.reach[0] <= folding.REACH:
            continue
        n_points = folding.cells(m.reach[0]) * folding.NODES
        if m.n_events < FOLD_GAIN * n_points:
            continue
        n_slots, step = 1 + len(jobs) * n_boot, max(1, FOLD_BYTES // (8 * n_points))
        for first in range(0, n_slots, step):
            end = min(first + step, n_slots)
            if 8 * n_points * (end - first) > room:
                turns.append({})
                room = FOLD_BYTES
            turns[-1][key] = (first, end)
            room -= 8 * n_points * (end - first)
    return turns


def folded_points(sample: Sample, path: str, turn: dict[tuple, tuple[int, int]], n_cells: dict[tuple, int]) -> DataFrame:
    """(key, slot, part, sums): the weights of each slot's points in each task, to be added up."""
    plan, vary = sample.plan, sample.vary
    schema = kernel.arrow_schema(FOLD_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = {key: own.between(*turn[key]) for key, own in _coefficients(path).items() if key in turn}
        live = {(t, r): [d for d in designs if (t, r, d[0]) in states] for (t, r), designs in plan.items()}
        acc: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, pairs in batch_pairs(batch, live, vary):
                own = states[key]
                if key not in acc:
                    acc[key] = np.zeros((len(own.slots), n_cells[key] * folding.NODES))
                folding.fold(acc[key], pairs.d[:, 0] / own.scale[0], lambda rows, part, own=own, h=pairs.cluster_hash: own.weights(h[rows], part))
        for key, arr in acc.items():
            slots = states[key].slots
            yield _arrow_batch(schema, key, slot=slots, part=slots // FOLD_SLOTS, sums=list(arr))

    wanted = sample.rows.sparkSession.createDataFrame(list({key[:2] for key in turn}), "track string, split_role string")
    return sample.rows.join(F.broadcast(wanted), ["track", "split_role"], "left_semi").mapInArrow(run, FOLD_SCHEMA)  # as many as the plan has


def _point_fits(mode: str, opts: AdamSettings) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Task for the points of a few slots of a few samples, a row for each slot and task that folded: their fits.

    Rows are added up as they come, so what is held is a turn's sums at most, however many tasks folded.
    """
    fit = kernel.solver(mode, opts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, dict[int, np.ndarray]] = {}
        for batch in batches:
            for track, role, design_id, slot, part, own in zip(*(batch[c] for c in (*KEY, "slot", "part", "sums")), strict=True):
                slots = acc.setdefault((track, role, design_id, part), {})
                if slot in slots:
                    slots[slot] += own
                else:
                    slots[slot] = np.array(own)
        for key in list(acc):
            own = acc.pop(key)
            slots = sorted(own)
            w = np.stack([own[s] for s in slots], axis=1)
            beta, llf, ok = fit(folding.points(len(w) // folding.NODES)[:, None], w)
            yield pd.DataFrame({**dict(zip(KEY, key, strict=False)), "slot": slots, "f_beta": beta[:, 0], "f_llf": llf, "f_weight": w.sum(axis=0), "f_ok": ok})

    return run


def folded_fits(sample: Sample, state: DataFrame, moments: dict[tuple, Moments], tasks: dict[tuple, list[kernel.Task]], n_boot: int, mode: str, opts: AdamSettings) -> tuple[DataFrame | None, DataFrame]:
    """(last state of the slots that folding settles, first state of all others)."""
    turns = _folded_turns(moments, tasks, n_boot)
    if not turns:
        return None, state
    spark = state.sparkSession
    path = shared_path(spark)
    state.write.parquet(path)
    n_cells = {key: folding.cells(moments[key].reach[0]) for turn in turns for key in turn}
    fits = None
    for turn in turns:
        groups = sum(-(-end // FOLD_SLOTS) - first // FOLD_SLOTS for first, end in turn.values())
        found = (
            folded_points(sample, path, turn, n_cells).repartition(min(groups, MAX_FOLD_PARTITIONS), *KEY, "part")
            .mapInPandas(_point_fits(mode, opts), FOLD_FITS)
        )
        fits = found if fits is None else fits.unionByName(found)
    joined = cut_lineage(spark.read.schema(STATE_SCHEMA).parquet(path).join(fits, [*KEY, "slot"], "left"))
    inside = F.coalesce(F.abs("f_beta") <= folding.BETA, F.lit(False))
    settled = joined.where(inside).withColumns({
        "beta": F.array("f_beta"), "llf": F.col("f_llf"), "weight": F.col("f_weight"), "mean_grad": F.when(F.col("f_ok"), 0.0).otherwise(F.lit(float("inf"))), "active": F.lit(False)})
    return settled.select(*STATE_COLUMNS), joined.where(~inside).select(*STATE_COLUMNS)


def distributed_fit(
    sample: Sample, tasks: dict[tuple, list[tuple]], n_boot: int, mode: str, opts: AdamSettings, seen: dict[tuple, Moments] | None = None,
) -> DataFrame:
    """Same result rows as the grouped fit, for every sample key in `tasks`.

    The sample's rows should be materialised (a checkpoint or a written table): they are read
    once per pass. `seen` keeps what `sample_moments` finds for later fits of the same rows.
    """
    spark = sample.rows.sparkSession
    jobs = {key: [kernel.Task(*t) for t in own] for key, own in tasks.items()}
    moments = sample_moments(sample, seen)
    known = kernel.optimizer(mode)
    error = None if known else kernel.unsupported(mode)
    full = {key: m.rank == len(m.scale) for key, m in moments.items()}
    fitted = {key: own for key, own in jobs.items() if full[key] and known}
    scales = {key: moments[key].scale for key in fitted}
    out = spark.createDataFrame(
        [(*key, i, t.fit_id, t.start, t.known, moments[key].rank, error if full[key] else None) for key, own in jobs.items() for i, t in enumerate(own)],
        "track string, split_role string, design_id int, task int, fit_id int, start int, known boolean, design_rank int, error string",
    )
    state = initial_state(sample, fitted, scales, n_boot)
    settled, rest = folded_fits(sample, state, moments, fitted, n_boot, mode, opts) if known else (None, state)
    last = settled
    if settled is None or not rest.isEmpty():
        last = iterate(sample, rest, kernel.clamped(opts) if known == "adam" else None)
        if known == "adam":
            last = _with_point_likelihood(sample, cut_lineage(last))
        last = cut_lineage(last if settled is None else last.unionByName(settled))
    ok = _settled()
    finite = F.forall("beta", lambda x: F.abs(x) < float("inf")) & (F.abs("llf") < float("inf"))
    point = last.where("rep < 0").select(*KEY, ok.alias("ok"), finite.alias("finite"), F.get("beta", F.lit(0)).alias("beta"), "llf")
    drawn = last.where("rep >= 0").where(ok).groupBy(*KEY, "task").agg(F.array_sort(F.collect_list(F.struct("rep", F.get("beta", F.lit(0)).alias("beta")))).alias("boot"))
    rows = out.join(point, [*KEY], "left").join(drawn, [*KEY, "task"], "left")
    good = F.col("error").isNull() & (F.col("known") | F.coalesce("ok", F.lit(False)))
    failed = F.when(~F.col("known") & F.col("ok").isNotNull() & ~F.col("ok"), F.concat(F.lit("fit_failed:"), F.when(F.col("finite"), "non_converged").otherwise("non_finite_estimate")))
    boot = F.when(good & F.col("boot").isNotNull(), F.col("boot")).otherwise(F.array().cast("array<struct<rep:int,beta:double>>"))
    return cut_lineage(rows.select(
        *KEY, "fit_id", F.when(good, F.col("beta")).alias("beta"), F.when(good, F.col("llf")).alias("llf"), "design_rank", F.coalesce("error", failed).alias("fit_error"),
        boot["rep"].alias("boot_reps"), boot["beta"].alias("boot_betas"),
        F.when(good & F.col("error").isNull() & (F.col("ok").isNotNull() | F.col("known")), F.greatest(F.lit(n_boot) - F.col("start"), F.lit(0))).otherwise(0).alias("boot_attempted"),
        F.col("ok").isNotNull().alias("point_fitted"),
    ))


def _with_point_likelihood(sample: Sample, last: DataFrame) -> DataFrame:
    path = shared_path(last.sparkSession)
    last.where("rep < 0").withColumn("active", F.lit(True)).write.parquet(path)
    found = slot_sums(sample, path, False).select(*KEY, "slot", F.get("sums", F.lit(1)).alias("found"))
    return last.join(found, [*KEY, "slot"], "left").withColumn("llf", F.coalesce("found", "llf")).select(*STATE_COLUMNS)


def distributed_metrics(sample: Sample, seeds: dict[tuple, int], n_boot: int) -> DataFrame:
    """(design, replicate, status, accuracy, log-likelihood per event) for steps over the size bound."""
    moments = sample_moments(sample)
    tasks = {key: [kernel.Task(key[2], seed)] for key, seed in seeds.items()}
    last = iterate(sample, initial_state(sample, tasks, {key: moments[key].scale for key in tasks}, n_boot))
    ok = _settled()
    return cut_lineage(last.select(
        "design_id", F.col("rep").alias("replicate"), F.when(ok, "ok").otherwise("fit_failed").alias("status"),
        F.when(ok, F.col("hits") / F.col("weight")).alias("accuracy"), F.when(ok, F.col("llf") / F.col("weight")).alias("llf_per_event"),
    ))
