"""Many regularised linear models fitted in the same passes.

The grid points and folds of a selection share their rows: one pass over the training
table gives every model its loss, gradient and curvature at its present coefficients
(a matrix with a row for each model), summed inside tasks and then over tasks. The
driver turns these sums, whose size is that of the models and not of the table, into
the next coefficients. So a pass is read once however many models take part, and a
selection needs as many passes as its slowest model, about ten, in place of one scan
for each fit and iteration.

Logistic regression minimises MLlib's objective (mean log loss + reg * (a |b|_1 +
(1 - a) / 2 |b|^2), b in units of the features' standard deviations) by Newton steps, with
coordinate descent for the penalised step. The linear SVM (mean hinge loss + reg / 2
|b|^2) takes Newton steps on a smooth hinge, e log(1 + exp((1 - m) / e)) at margin m, for
falling e. It is never below the hinge and at most e log 2 above it, which gives a lower
bound of the least objective.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.metrics import auc_roc
from pixelmill.session import scratch_path

LOGISTIC, HINGE = "logistic", "hinge"
#: Features, at most: the curvature of a model has this number squared.
MAX_FEATURES = 512
BLOCK_ROWS = 1024
MAX_PASSES = 200
#: Violation of the optimality conditions at which a model is done.
TOLERANCE = 1e-8
#: Widths of the smoothed hinge, one after the other; a model goes on to the next when a
#: step would gain less than this share of the width.
WIDTHS = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003)
ENOUGH = 0.01
#: Gain of a step at which an SVM is done.
LEAST_GAIN = 1e-10
#: A model stops at the least step of the line search.
LEAST_STEP = 1e-9


def pack(rows: DataFrame, features: str = "features", label: str = "label", weight: str | None = None,
         fold: str | None = "fold") -> DataFrame:
    """The training rows as blocks (fold, n, x, y, w) of little-endian doubles, up to
    ``BLOCK_ROWS`` rows of one fold each, written to the shared folder."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    f = F.col(fold).cast("int") if fold else F.lit(-1)
    src = rows.select(f.alias("fold"), vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if src.rdd.getNumPartitions() < cores:  # a table of few files
        src = src.repartition(cores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, y, weights = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y", "w"))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else None
            for value in np.unique(folds):
                own = np.flatnonzero(folds == value)
                for at in range(0, len(own), BLOCK_ROWS):
                    some = own[at:at + BLOCK_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(value)], pa.int32()), pa.array([len(some)], pa.int32()),
                         *[pa.array([np.ascontiguousarray(a[some], np.float64).tobytes()], pa.binary()) for a in (x, y, weights)]],
                        names=["fold", "n", "x", "y", "w"])

    path = scratch_path(rows.sparkSession, "blocks")
    src.mapInArrow(run, "fold int, n int, x binary, y binary, w binary").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _summed(blocks: DataFrame, work: Callable, size: int, parts: int = 1) -> np.ndarray:
    """``work(fold, x, y, w)`` (an array of ``size`` doubles, in ``parts`` equal parts) summed
    over all blocks: in every task, for many tasks in about as many as the root of their
    number, and then each part in one task. The driver gets one row a part, however
    many tasks there are."""
    each = size // parts

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for fold, n, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                x, y, w = (np.frombuffer(p, np.float64) for p in packed)
                total += work(fold, x.reshape(n, -1), y, w)
        for i in range(parts):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i * each:(i + 1) * each].tobytes()], pa.binary())], names=["part", "s"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, s in zip(*(c.to_pylist() for c in batch.columns)):
                if part not in totals:
                    totals[part] = np.zeros(each)
                totals[part] += np.frombuffer(s, np.float64)
        for part, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "s"])

    sums = blocks.select("fold", "n", "x", "y", "w").mapInArrow(add, "part int, s binary")
    tasks = blocks.rdd.getNumPartitions()
    if tasks > 64:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(merge, "part int, s binary")
    if tasks > 1:
        sums = sums.repartition(min(parts, blocks.sparkSession.sparkContext.defaultParallelism), "part").mapInArrow(merge, "part int, s binary")
    out = np.zeros((parts, each))
    for r in sums.collect():
        out[r["part"]] += np.frombuffer(r["s"], np.float64)
    return out.reshape(-1)


@dataclass
class Scale:
    """Rows that a set of models is fitted on (all but one fold), and their scale."""

    left_out: int | None
    mean: np.ndarray
    std: np.ndarray
    weight: float
    rows: float
    #: Directions and phases of random Fourier features of the scaled rows, if any.
    lift: tuple[np.ndarray, np.ndarray] | None = None


def scales(blocks: DataFrame, d: int, left_out: list[int | None], weighted_std: bool) -> list[Scale]:
    """Mean and sample standard deviation of every feature without each fold (None:
    without none), weighted or plain, by sums and then sums of squares about the mean."""
    folds = sorted({r[0] for r in blocks.select("fold").distinct().collect()})
    at = {f: i for i, f in enumerate(folds)}
    k = 4 + d

    def first(fold, x, y, w):
        out = np.zeros((len(folds), k))
        u = w if weighted_std else np.ones(len(y))
        out[at[fold]] = [len(y), w.sum(), u.sum(), (u * u).sum(), *(u @ x)]
        return out.reshape(-1)

    sums = _summed(blocks, first, len(folds) * k).reshape(len(folds), k)
    use = [np.array([f != out for f in folds]) for out in left_out]
    totals = [sums[u].sum(0) for u in use]
    means = [t[4:] / t[2] if t[2] else np.zeros(d) for t in totals]

    def second(fold, x, y, w):
        out = np.zeros((len(left_out), d))
        u = w if weighted_std else np.ones(len(y))
        for s, (own, mean) in enumerate(zip(use, means)):
            if own[at[fold]]:
                out[s] = u @ (x - mean) ** 2
        return out.reshape(-1)

    squares = _summed(blocks, second, len(left_out) * d).reshape(len(left_out), d)
    out = []
    for left, t, mean, square in zip(left_out, totals, means, squares):
        freedom = t[2] - t[3] / t[2] if t[2] else 0.0
        std = np.sqrt(square / freedom) if freedom > 0 else np.zeros(d)
        # the mean of a constant is that constant up to rounding
        out.append(Scale(left, mean, np.where(std > 1e-10 * np.abs(mean), std, 0.0), t[1], t[0]))
    return out


@dataclass
class Fit:
    """One model: its scale, penalty and, in scaled units, its coefficients (the
    intercept last)."""

    scale: Scale
    reg: float
    mix: float = 0.0
    coef: np.ndarray | None = None
    objective: float = math.inf
    violation: float = math.inf
    lower_bound: float = -math.inf
    passes: int = 0
    _trial: np.ndarray | None = field(default=None, repr=False)
    _step: tuple | None = field(default=None, repr=False)
    _width: int = 0

    def penalty(self, coef: np.ndarray) -> float:
        b = coef[:-1]
        return self.reg * (self.mix * np.abs(b).sum() + (1 - self.mix) / 2 * float(b @ b))

    def original(self) -> tuple[np.ndarray, float]:
        """Coefficients and intercept in the features' own units."""
        live = self.scale.std > 0
        b = np.where(live, self.coef[:-1] / np.where(live, self.scale.std, 1), 0.0)
        return b, float(self.coef[-1] - b @ self.scale.mean)


def _scaled(x: np.ndarray, scale: Scale) -> np.ndarray:
    """Scaled (and lifted) rows with a last column of ones; a feature without variance
    is zero."""
    z = np.where(scale.std > 0, (x - scale.mean) / np.where(scale.std > 0, scale.std, 1), 0.0)
    if scale.lift is not None:
        directions, phases = scale.lift
        z = math.sqrt(2 / len(phases)) * np.cos(z @ directions.T + phases)
    return np.hstack([z, np.ones((len(z), 1))])


def _parts(kind: str, margin: np.ndarray, y: np.ndarray, width: float):
    """(loss, slope, curvature) of every row by its margin (the score of label 1)."""
    if kind == LOGISTIC:
        s = np.where(y > 0, margin, -margin)
        p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
        return np.logaddexp(0, -s), p - (y > 0), p * (1 - p)
    sign = np.where(y > 0, 1.0, -1.0)
    gap = (1 - sign * margin) / width
    p = 1 / (1 + np.exp(-np.clip(gap, -700, 700)))
    return width * np.logaddexp(0, gap), -sign * p, p * (1 - p) / width


def _pass(blocks: DataFrame, kind: str, fits: list[Fit], d: int) -> np.ndarray:
    """(loss, gradient, curvature) sums of every model at its trial coefficients. The
    curvature is symmetric, so that only one triangle of it travels."""
    upper = np.triu_indices(d + 1)
    k = 1 + (d + 1) + len(upper[0])
    groups: dict[int, list[int]] = {}
    for i, f in enumerate(fits):
        groups.setdefault(id(f.scale), []).append(i)
    sets = [(fits[own[0]].scale, own, np.stack([fits[i]._trial for i in own]), [WIDTHS[fits[i]._width] for i in own])
            for own in groups.values()]

    def work(fold, x, y, w):
        out = np.zeros((len(fits), k))
        triangle = np.triu_indices(d + 1)
        for scale, own, coef, widths in sets:
            if scale.left_out == fold:
                continue
            z = _scaled(x, scale)
            margins = z @ coef.T
            for j, i in enumerate(own):
                loss, slope, bend = _parts(kind, margins[:, j], y, widths[j])
                out[i, 0] = w @ loss
                out[i, 1:d + 2] = (w * slope) @ z
                live = bend > 0
                out[i, d + 2:] = ((z[live] * (w * bend)[live, None]).T @ z[live])[triangle]
        return out.reshape(-1)

    sums = _summed(blocks, work, len(fits) * k, len(fits)).reshape(len(fits), k)
    whole = np.zeros((len(fits), d + 2 + (d + 1) ** 2))
    whole[:, :d + 2] = sums[:, :d + 2]
    bends = whole[:, d + 2:].reshape(len(fits), d + 1, d + 1)
    bends[:, upper[0], upper[1]] = bends[:, upper[1], upper[0]] = sums[:, d + 2:]
    return whole


def _violation(fit: Fit, coef: np.ndarray, gradient: np.ndarray) -> float:
    """Distance of zero from the subdifferential, over all coordinates."""
    b, l1 = coef[:-1], fit.reg * fit.mix
    smooth = gradient[:-1] + fit.reg * (1 - fit.mix) * b
    off = np.where(b != 0, np.abs(smooth + l1 * np.sign(b)), np.maximum(np.abs(smooth) - l1, 0))
    return float(max(off.max(initial=0.0), abs(gradient[-1])))


def _newton(fit: Fit, coef: np.ndarray, gradient: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """The step to the least value of the penalised quadratic model at ``coef``."""
    d = len(coef) - 1
    ridge = np.full(d + 1, fit.reg * (1 - fit.mix))
    ridge[-1] = 0.0
    h = bend + np.diag(ridge + 1e-12)
    g = gradient + ridge * coef
    l1 = fit.reg * fit.mix
    if l1 == 0:
        return np.linalg.lstsq(h, -g, rcond=None)[0]
    step, moved = np.zeros(d + 1), h @ np.zeros(d + 1)
    for _ in range(1000):
        largest = 0.0
        for j in range(d + 1):
            a = h[j, j]
            slope = g[j] + moved[j] - a * step[j]  # of the quadratic without coordinate j's own step
            if j == d:
                to = -slope / a
            else:
                target = coef[j] - slope / a  # where coordinate j would go without the l1 term
                to = math.copysign(max(abs(target) - l1 / a, 0.0), target) - coef[j]
            if to != step[j]:
                moved += h[:, j] * (to - step[j])
                largest = max(largest, abs(to - step[j]))
                step[j] = to
        if largest < 1e-12:
            break
    return step


def solve(blocks: DataFrame, kind: str, fits: list[Fit], d: int, longest: float = 0.0) -> list[Fit]:
    """Fits all models. ``longest``: a bound of the length of a scaled row (the lower
    bound of the SVM's least objective needs one)."""
    for f in fits:
        f._trial = np.zeros(d + 1)
        f._width = 0 if kind == HINGE else len(WIDTHS) - 1
    active = [f for f in fits if f.scale.weight > 0]
    for f in fits:
        if f.scale.weight <= 0:
            f.coef = np.zeros(d + 1)
    for _ in range(MAX_PASSES):
        if not active:
            break
        sums = _pass(blocks, kind, active, d)
        left = []
        for f, row in zip(active, sums):
            f.passes += 1
            if _advance(f, kind, row / f.scale.weight, d, longest):
                left.append(f)
        active = left
    return fits


def _advance(f: Fit, kind: str, sums: np.ndarray, d: int, longest: float) -> bool:
    """Takes up a pass: accepts or halves the step, and sets the next trial. Returns
    whether the model goes on."""
    loss, gradient, bend = sums[0], sums[1:d + 2], sums[d + 2:].reshape(d + 1, d + 1)
    value = loss + f.penalty(f._trial)
    if f._step is not None:
        step, t, expected = f._step
        if not value <= f.objective + 1e-4 * t * expected + 1e-15 * abs(f.objective):
            if t / 2 < LEAST_STEP:
                return _stage_done(f, kind, d)
            f._step = (step, t / 2, expected)
            f._trial = f.coef + t / 2 * step
            return True
    f.coef, f.objective = f._trial, value
    f.violation = _violation(f, f.coef, gradient)
    if kind == HINGE and f._width == len(WIDTHS) - 1:
        g = gradient[:-1] + f.reg * f.coef[:-1]
        reach = abs(f.coef[-1]) + 2 + longest * math.sqrt(2 / f.reg) if f.reg > 0 else math.inf
        slack = float(g @ g) / (2 * f.reg) + abs(gradient[-1]) * reach if f.reg > 0 else math.inf
        f.lower_bound = max(f.lower_bound, f.objective - slack - WIDTHS[-1] * math.log(2))
    if f.violation < TOLERANCE:
        return _stage_done(f, kind, d)
    step = _newton(f, f.coef, gradient, bend)
    ridge = f.reg * (1 - f.mix)
    b = f.coef[:-1]
    expected = float(gradient @ step + ridge * b @ step[:-1]) + f.reg * f.mix * float(np.abs(b + step[:-1]).sum() - np.abs(b).sum())
    last = kind == LOGISTIC or f._width == len(WIDTHS) - 1
    least = ENOUGH * WIDTHS[f._width] if not last else 1e-16 if kind == LOGISTIC else LEAST_GAIN
    if -expected < least:
        return _stage_done(f, kind, d)
    f._step = (step, 1.0, expected)
    f._trial = f.coef + step
    return True


def _stage_done(f: Fit, kind: str, d: int) -> bool:
    if kind == HINGE and f._width < len(WIDTHS) - 1:
        f._width += 1
        f._step, f._trial, f.objective = None, f.coef, math.inf
        return True
    return False


def held_out_scores(blocks: DataFrame, groups: list[list[Fit]]) -> DataFrame:
    """(fold, point, label, score): every row of a fold scored by the models that leave the
    fold out (a group for each fold, whose scale it shares)."""
    by_fold = {g[0].scale.left_out: (g[0].scale, np.stack([f.coef for f in g])) for g in groups}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("fold", "n", "x", "y"))):
                if fold not in by_fold:
                    continue
                scale, coef = by_fold[fold]
                scores = _scaled(np.frombuffer(x, np.float64).reshape(n, -1), scale) @ coef.T
                label = np.frombuffer(y, np.float64)
                points = len(coef)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * points, fold, np.int32)), pa.array(np.tile(np.arange(points, dtype=np.int32), n)),
                     pa.array(np.repeat(label, points)), pa.array(scores.reshape(-1))], names=["fold", "point", "label", "score"])

    return blocks.mapInArrow(run, "fold int, point int, label double, score double")


def held_out_auc(blocks: DataFrame, groups: list[list[Fit]]) -> dict[tuple[int, int], float]:
    """Exact AUC of model ``i`` of every group on the fold that the group leaves out, as
    {(fold, i): auc}; all models are scored in one pass. One half where a fold lacks
    a class."""
    scored = held_out_scores(blocks, groups)
    found = {(r["fold"], r["point"]): r["auc_roc"] for r in auc_roc(scored, by=["fold", "point"]).collect()}
    return {(g[0].scale.left_out, i): 0.5 if found.get((g[0].scale.left_out, i)) is None else float(found[g[0].scale.left_out, i])
            for g in groups for i in range(len(g))}
