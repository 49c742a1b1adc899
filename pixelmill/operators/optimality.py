"""Proof that a fitted linear model is where its objective is least.

Both objectives are convex, so what certifies a model does not depend on the solver
that found it.

Logistic regression (elastic net, as MLlib states it: mean log loss + reg * (a |b|_1
+ (1 - a) / 2 |b|^2) over coefficients b of features scaled by their standard
deviation): one aggregate over the training rows gives the gradient at the fitted
coefficients, and the residual is the largest distance of zero from the
subdifferential over all coordinates and the intercept.

Linear SVM (mean hinge loss + reg / 2 |w|^2): the hinge has no gradient at its kink, so
a subgradient proves little. The gap is the objective of the fitted coefficients, one
aggregate, less a lower bound of the least objective that the smoothed problem gives
(:mod:`pixelmill.operators.linear_fits`).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.operators import linear_fits as Lf


def _margin(model) -> Column:
    """The fitted score of a row, as the model's own raw prediction has it."""
    return vector_to_array(F.col(model.getOrDefault("rawPredictionCol")))[1]


def _sums(rows: DataFrame, vector: str, weights: dict[str, Column]) -> dict[str, np.ndarray]:
    """For each weight column (of any sign) the sum of weight x vector and of weight, in
    one aggregate; summaries take no negative weights, so the signs are summed apart."""
    metric = Summarizer.metrics("sum")
    parts = []
    for name, w in weights.items():
        for sign, part in (("p", F.greatest(w, F.lit(0.0))), ("n", F.greatest(-w, F.lit(0.0)))):
            parts.append(metric.summary(F.col(vector), part).alias(f"{name}_{sign}"))
        parts.append(F.sum(w).alias(f"{name}_t"))
    row = rows.agg(*parts).first()
    return {name: (row[f"{name}_p"]["sum"].toArray() - row[f"{name}_n"]["sum"].toArray(), float(row[f"{name}_t"] or 0.0))
            for name in weights}


def _stages(model: PipelineModel):
    last = model.stages[-1]
    if not isinstance(last, (LogisticRegressionModel, LinearSVCModel)):
        raise TypeError(f"no linear model at the end of the pipeline: {type(last).__name__}")
    return last, last.getOrDefault("featuresCol")


def logistic_residual(model: PipelineModel, train: DataFrame, label: str = "label", weight: str | None = None) -> float:
    """Largest violation of the optimality conditions of the fitted logistic
    regression over ``train``: 0 at the optimum, whatever the solver. Coordinates
    without variance hold no coefficient and are left out. An empty table has no
    residual (nan)."""
    fitted, features = _stages(model)
    scored = model.transform(train)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    p = 1.0 / (1.0 + F.exp(-_margin(fitted)))
    total = scored.agg(F.sum(w)).first()[0]
    if not total:
        return float("nan")
    std = scored.agg(Summarizer.metrics("std").summary(F.col(features), w).alias("s")).first()["s"]["std"].toArray()
    gradient, shift = _sums(scored, features, {"g": w * (p - y)})["g"]
    live = std > 0
    g = gradient[live] / std[live] / total
    b = fitted.coefficients.toArray()[live] * std[live]
    reg, mix = fitted.getOrDefault("regParam"), fitted.getOrDefault("elasticNetParam")
    smooth, l1 = g + reg * (1 - mix) * b, reg * mix
    distance = np.where(b != 0, np.abs(smooth + l1 * np.sign(b)), np.maximum(np.abs(smooth) - l1, 0))
    return float(max([*distance, abs(shift) / total if fitted.getOrDefault("fitIntercept") else 0.0]))


def hinge_gap(model: PipelineModel, train: DataFrame, label: str = "label", weight: str | None = None) -> float:
    """What the objective of the fitted linear SVM (unstandardised, as the grids fit it)
    exceeds its least value by, at most; about 0.003 of it is the bound's own slack. An
    empty table has no gap (nan)."""
    fitted, features = _stages(model)
    if fitted.getOrDefault("standardization"):
        raise ValueError("the gap is that of the unstandardised objective")
    scored = model.transform(train)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sign = 2.0 * F.col(label).cast("double") - 1.0
    length = F.sqrt(F.aggregate(vector_to_array(F.col(features)), F.lit(0.0), lambda a, x: a + x * x))
    row = scored.agg(F.sum(w).alias("w"), F.sum(w * F.greatest(F.lit(0.0), 1.0 - sign * _margin(fitted))).alias("loss"),
                     F.max(length).alias("longest"), F.count(F.lit(1)).alias("n")).first()
    if not row["w"]:
        return float("nan")
    reg, b = fitted.getOrDefault("regParam"), fitted.coefficients.toArray()
    d = len(b)
    # the rows as the model sees them: no further scaling
    best = Lf.Fit(Lf.Scale(None, np.zeros(d), np.ones(d), float(row["w"]), float(row["n"])), reg)
    Lf.solve(Lf.pack(scored, features, label, weight, fold=None), Lf.HINGE, [best], d, float(row["longest"]))
    return float(row["loss"] / row["w"] + reg / 2 * float(b @ b) - best.lower_bound)


def residual(model: PipelineModel, train: DataFrame, label: str = "label", weight: str | None = None) -> float:
    """The residual of whichever linear model stands at the end of the pipeline."""
    fitted, _ = _stages(model)
    return (logistic_residual if isinstance(fitted, LogisticRegressionModel) else hinge_gap)(model, train, label, weight)
