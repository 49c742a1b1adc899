"""The kernel SVM and its probabilities (C11).

MLlib has no solver for kernels. Random Fourier features turn the Gaussian kernel
exp(-gamma |x - y|^2) into an inner product of D cosines, so that a linear SVM on them is
a kernel SVM up to an error that falls with the root of D. Probabilities come from
a logistic curve through scores of rows that were left out of their model's fit.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators import linear_fits as Lf
from pixelmill.operators import models as Mo
from pixelmill.session import scratch_path

#: Cosines that stand in for the kernel.
N_FEATURES = 256
LINEAR, RBF = "linear", "rbf"
# The widths of the original grid.
GAMMAS = ("scale", "auto")


def fourier_map(d: int, n_features: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (n_features x d) and phases; they depend on the arguments alone."""
    rng = np.random.default_rng([seed, d, n_features])
    return rng.normal(0.0, math.sqrt(2 * gamma), (n_features, d)), rng.uniform(0, 2 * math.pi, n_features)


def lifted(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Rows whose inner products are about the kernel's values."""
    return math.sqrt(2 / len(phases)) * np.cos(x @ directions.T + phases)


def error_bound(n_features: int, n_pairs: int, chance: float = 1e-6) -> float:
    """No kernel value of ``n_pairs`` pairs is off by more, but with this chance
    (Hoeffding, for means of terms between -2 and 2)."""
    return math.sqrt(8 * math.log(2 * n_pairs / chance) / n_features)


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """A pipeline stage: vectors to their random Fourier features, in Arrow batches."""

    numFeatures = Param(Params._dummy(), "numFeatures", "number of cosines", typeConverter=TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel exp(-gamma |x - y|^2)", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, numFeatures=N_FEATURES, gamma=1.0, seed=Mo.SEED):
        super().__init__()
        self._setDefault(numFeatures=N_FEATURES, gamma=1.0, seed=Mo.SEED)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n, gamma, seed = self.getOrDefault("numFeatures"), self.getOrDefault("gamma"), self.getOrDefault("seed")

        @F.pandas_udf("array<double>")
        def lift(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                if not len(batch):
                    yield pd.Series([], dtype=object)
                    continue
                x = np.stack(batch.to_numpy())
                if x.shape[1] not in maps:
                    maps[x.shape[1]] = fourier_map(x.shape[1], n, gamma, seed)
                yield pd.Series(list(lifted(x, *maps[x.shape[1]])))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(lift(vector_to_array(F.col(self.getInputCol())))))


def kernel_gamma(rows: DataFrame, gamma: str, features: str = "features") -> float:
    """``auto``: 1 / d; ``scale``: 1 / (d * variance of all values of the scaled rows), in
    which a feature that varies has variance 1 and any other none."""
    row = rows.agg(F.max(F.size(vector_to_array(F.col(features)))).alias("d")).first()
    d = row["d"] or 1
    if gamma == "auto":
        return 1.0 / d
    arrays = rows.select(F.posexplode(vector_to_array(F.col(features))).alias("i", "v"))
    varying = arrays.groupBy("i").agg((F.max("v") > F.min("v")).alias("varies")).where("varies").count()
    return 1.0 / max(varying, 1)


def kernel_pipeline(kernel: str, gamma: float, reg: float, features: str = "features", label: str = "label",
                    weight: str | None = None, n_features: int = N_FEATURES, pre=()) -> Pipeline:
    """``pre`` stages, centred and scaled features, their cosines (``rbf``) and a linear SVM."""
    scale = StandardScaler(inputCol=features, outputCol="scaledFeatures", **Mo.CENTRE_AND_SCALE)
    lift = [RandomFourierFeatures(inputCol="scaledFeatures", outputCol="liftedFeatures", numFeatures=n_features, gamma=gamma)]
    svm = LinearSVC(featuresCol="liftedFeatures" if kernel == RBF else "scaledFeatures", labelCol=label,
                    **(Mo.SVM_SETTINGS | {"maxIter": 100, "regParam": reg}))
    if weight:
        svm.setWeightCol(weight)
    return Pipeline(stages=[*pre, scale, *(lift if kernel == RBF else []), svm])


def fit_kernel_grid(train: DataFrame, n: int, features: str = "features", label: str = "label", weight: str | None = "class_weight",
                    fold_col: str = "fold", folds: int = Mo.NUM_FOLDS, n_features: int = N_FEATURES,
                    costs=tuple(Mo.TWIN_SVM_C), gammas=GAMMAS) -> Mo.FitResult:
    """C11 in full: linear and Gaussian kernels over ``costs`` and ``gammas``, by
    cross-validated AUC (each family of one feature map in shared passes), a refit of the
    best point, and its probability curve: ``extra`` has ``platt`` (slope, offset), fitted
    on the scores that its folds' models give the rows they left out."""
    t0 = time.perf_counter()
    d = len(train.select(vector_to_array(F.col(features)).alias("x")).first()["x"])
    blocks = Lf.pack(train, features, label, weight, fold_col)
    scales = Lf.scales(blocks, d, list(range(folds)), weighted_std=False)
    params, avg, groups_of = [], [], []
    fitted: dict[tuple[str, float], tuple] = {}  # widths that are the same number are one family
    for kernel, name in [(LINEAR, None), *[(RBF, g) for g in gammas]]:
        lift, gamma, dim = None, 1.0, d
        if kernel == RBF:
            gamma, dim = kernel_gamma(train, name, features), n_features
            lift = fourier_map(d, n_features, gamma, Mo.SEED)
        if (kernel, gamma) not in fitted:
            own = [Lf.Scale(s.left_out, s.mean, s.std, s.weight, s.rows, lift) for s in scales]
            groups = [[Lf.Fit(s, Mo.twin_reg_param(c, n)) for c in costs] for s in own]
            Lf.solve(blocks, Lf.HINGE, [f for g in groups for f in g], dim)
            fitted[kernel, gamma] = groups, Lf.held_out_auc(blocks, groups)
        groups, auc = fitted[kernel, gamma]
        for i, c in enumerate(costs):
            params.append({"kernel": kernel, "gamma": name, "C": c, "gamma_value": gamma})
            avg.append(sum(auc.get((f, i), 0.5) for f in range(folds)) / folds)
            groups_of.append([[g[i]] for g in groups])
    best = max(range(len(params)), key=lambda i: avg[i])
    p = params[best]
    model = kernel_pipeline(p["kernel"], p["gamma_value"], Mo.twin_reg_param(p["C"], n), features, label, weight, n_features).fit(train)
    path = scratch_path(train.sparkSession, "left-out-scores")
    Lf.held_out_scores(blocks, groups_of[best]).select("label", "score").write.parquet(path)
    left_out = train.sparkSession.read.parquet(path)  # read by every step of the curve
    curve = platt(left_out)
    return Mo.FitResult("Kernel SVM", model, avg, params, time.perf_counter() - t0, n_fits=folds * len(params) + 1,
                        extra={"best_params": p, "platt": curve, "platt_residual": platt_residual(left_out, curve)})


# --- probabilities ------------------------------------------------------------------------

def _platt_sums(scored: DataFrame, slope: float, offset: float, targets: tuple[float, float], label: str, score: str):
    """Loss, gradient and curvature of the curve 1 / (1 + exp(-(slope s + offset))), in one
    aggregate."""
    s = F.col(score).cast("double")
    t = F.when(F.col(label) == 1, F.lit(targets[0])).otherwise(F.lit(targets[1]))
    z = slope * s + offset
    p = 1.0 / (1.0 + F.exp(-z))
    # log(1 + exp(z)) without overflow
    soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    h = p * (1.0 - p)
    row = scored.agg(F.sum(soft - t * z), F.sum((p - t) * s), F.sum(p - t), F.sum(h * s * s), F.sum(h * s), F.sum(h)).first()
    return [float(v or 0.0) for v in row]


def platt_targets(scored: DataFrame, label: str = "label") -> tuple[float, float]:
    """Targets of the two classes, drawn in from 1 and 0 by their counts."""
    row = scored.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) != 1)).first()
    return (row[0] + 1.0) / (row[0] + 2.0), 1.0 / (row[1] + 2.0)


def platt(scored: DataFrame, label: str = "label", score: str = "score", tolerance: float = 1e-9, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of the logistic curve of best likelihood through ``scored``, by
    Newton's method with step halving; each step is one aggregate of six sums. Rows
    without a label or score take no part; without rows the curve is flat."""
    scored = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    targets = platt_targets(scored, label)
    n = scored.count()
    if not n:
        return 0.0, 0.0
    slope, offset = 0.0, 0.0
    loss, gs, go, hss, hs, ho = _platt_sums(scored, slope, offset, targets, label, score)
    for _ in range(rounds):
        if max(abs(gs), abs(go)) < tolerance * n:
            break
        a, b, c = hss + 1e-12, hs, ho + 1e-12
        det = a * c - b * b
        step = (-(c * gs - b * go) / det, -(a * go - b * gs) / det) if det > 1e-300 else (-gs, -go)
        t = 1.0
        while t > 1e-10:
            new = _platt_sums(scored, slope + t * step[0], offset + t * step[1], targets, label, score)
            if new[0] <= loss + 1e-4 * t * (gs * step[0] + go * step[1]) + 1e-12 * abs(loss):
                break
            t /= 2
        else:
            break
        slope, offset = slope + t * step[0], offset + t * step[1]
        loss, gs, go, hss, hs, ho = new
    return slope, offset


def with_probability(scored: DataFrame, curve: tuple[float, float], score: str = "score") -> DataFrame:
    """``scored`` with ``probability`` of label 1."""
    return scored.withColumn("probability", 1.0 / (1.0 + F.exp(-(curve[0] * F.col(score) + curve[1]))))


def platt_residual(scored: DataFrame, curve: tuple[float, float], label: str = "label", score: str = "score") -> float:
    """Largest part of the mean gradient at a curve: 0 at the best one."""
    n = scored.count()
    _, gs, go, *_ = _platt_sums(scored, curve[0], curve[1], platt_targets(scored, label), label, score)
    return max(abs(gs), abs(go)) / n if n else float("nan")
