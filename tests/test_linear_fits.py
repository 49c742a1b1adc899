"""Shared passes, proofs of optimum, forests as tables, kernels and probabilities."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.operators import forest as Fo
from pixelmill.operators import kernel as Ke
from pixelmill.operators import linear_fits as Lf
from pixelmill.operators import models as Mo
from pixelmill.operators import optimality as Op
from pixelmill.plans import q_models
from pixelmill.session import scratch_path

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("features", VectorUDT()), T.StructField("label", T.IntegerType()),
                       T.StructField("class_weight", T.DoubleType()), T.StructField("fold", T.IntegerType())])


def _table(spark, x, y, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, Vectors.dense(v.tolist()), int(t), float(rng.uniform(0.5, 2)), i % 3) for i, (v, t) in enumerate(zip(x, y))], SCHEMA)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) * [1, 10, 0.1, 3, 0] + [0, 100, 0, -5, 7]  # the last feature is constant
    y = x[:, 0] + x[:, 1] / 10 - 10 + rng.normal(size=300) > 0
    return _table(spark, x, y)


@pytest.mark.parametrize("weight", [None, "class_weight"])
def test_averages_equal_mllib(spark, noisy, weight):
    pipe, lr = Mo.classifier_pipeline("lr", weight=weight)
    grid = Mo._grid(lr, {"regParam": [0.01, 0.3], "elasticNetParam": [0.0, 0.5, 1.0]})
    a = Mo.cross_validate_passes("lr", "lr", pipe, grid, noisy, weight=weight)
    b = Mo.cross_validate("lr", pipe, grid, noisy)
    assert np.allclose(a.avg_metrics, b.avg_metrics, atol=1e-4) and a.extra["best_params"] == b.extra["best_params"]
    assert a.n_fits == b.n_fits == 19 and a.extra["passes"] < 20
    assert np.allclose(a.model.stages[-1].coefficients.toArray(), b.model.stages[-1].coefficients.toArray())


def test_coefficients_equal_mllib(spark, noisy):
    blocks = Lf.pack(noisy, weight="class_weight", fold=None)
    scale, = Lf.scales(blocks, 5, [None], weighted_std=True)
    fits = Lf.solve(blocks, Lf.LOGISTIC, [Lf.Fit(scale, r, m) for r, m in ((0.02, 0.0), (0.02, 0.5), (0.1, 1.0), (0.0, 0.0))], 5)
    assert all(f.violation < Lf.TOLERANCE for f in fits)
    for f in fits:
        own = LogisticRegression(regParam=f.reg, elasticNetParam=f.mix, weightCol="class_weight", tol=1e-12, maxIter=500).fit(noisy)
        b, intercept = f.original()
        theirs = own.coefficients.toArray()
        assert np.allclose(b[:4], theirs[:4], rtol=1e-3, atol=1e-4)
        assert abs(intercept - own.intercept - 7 * theirs[4]) < 1e-2  # the constant feature is 7
    assert scale.std[4] == 0 and fits[0].original()[0][4] == 0


def test_many_partitions_are_summed_in_two_steps(spark, noisy):
    blocks = Lf.pack(noisy, fold=None)
    one = Lf._summed(blocks, lambda fold, x, y, w: np.array([len(y), x.sum()]), 2)
    wide = spark.createDataFrame(blocks.rdd.repartition(80), blocks.schema)
    assert np.allclose(Lf._summed(wide, lambda fold, x, y, w: np.array([len(y), x.sum()]), 2), one) and one[0] == 300


def test_svm_is_within_its_bound(spark, noisy):
    """The objective of the shared passes is at most MLlib's, and above its lower bound."""
    blocks = Lf.pack(noisy, fold=None)
    scale, = Lf.scales(blocks, 5, [None], weighted_std=False)
    fit, = Lf.solve(blocks, Lf.HINGE, [Lf.Fit(scale, 0.05)], 5, longest=20.0)
    z = Lf._scaled(np.array([r["features"].toArray() for r in noisy.select("features").collect()]), scale)
    sign = np.array([2.0 * r["label"] - 1 for r in noisy.select("label").collect()])
    objective = lambda c: np.maximum(0, 1 - sign * (z @ c)).mean() + 0.025 * c[:-1] @ c[:-1]
    model = Mo.classifier_pipeline("svm", regParam=0.05, maxIter=300)[0].fit(noisy)
    svm = model.stages[-1]
    assert fit.lower_bound <= objective(fit.coef) <= objective(np.append(svm.coefficients.toArray(), svm.intercept)) + 1e-3
    assert objective(fit.coef) - fit.lower_bound < 0.005


def test_selection_falls_back(spark, noisy, monkeypatch):
    pipe, lr = Mo.classifier_pipeline("lr")
    grid = Mo._grid(lr, {"regParam": [0.1]})
    monkeypatch.setattr(Lf, "MAX_FEATURES", 4)
    assert Mo.cross_validate_passes("lr", "lr", pipe, grid, noisy) is None
    assert Mo.fit_grid("lr", noisy).n_fits == 28


def _moved(spark, model, by):
    """A copy of a fitted pipeline with another first coefficient."""
    last = model.stages[-1]
    coefficients = last.coefficients.toArray().copy()
    coefficients[0] += by
    sc = spark.sparkContext
    copy = last.copy()
    copy._java_obj = getattr(sc._jvm.org.apache.spark.ml.classification, type(last).__name__)(
        last.uid + "x", _py2java(sc, Vectors.dense(coefficients.tolist())), float(last.intercept))
    last._transfer_params_to_java()
    for p in ("featuresCol", "labelCol", "rawPredictionCol", "predictionCol", "regParam", "standardization", "elasticNetParam"):
        if last.hasParam(p):
            copy._set(**{p: last.getOrDefault(p)})
    return PipelineModel([*model.stages[:-1], copy])


@pytest.mark.parametrize("kind", ["lr", "svm"])
def test_a_perturbed_model_is_not_proved(spark, noisy, kind):
    train = noisy
    model = Mo.classifier_pipeline(kind)[0].fit(train)
    assert q_models.fit_proved(kind, model, train, None)
    wrong = _moved(spark, model, 0.4)
    assert not q_models.fit_proved(kind, wrong, train, None)
    other = Mo.classifier_pipeline(kind)[0].fit(train.where("fold < 2"))  # fitted on other rows
    assert Op.residual(other, train) > Op.residual(model, train)
    assert math.isnan(Op.residual(model, train.limit(0)))


def test_residual_of_weighted_fits(spark, noisy):
    for settings in ({"elasticNetParam": 0.0}, {"elasticNetParam": 1.0, "regParam": 0.05}):
        model = Mo.classifier_pipeline("lr", weight="class_weight", **settings)[0].fit(noisy)
        assert Op.logistic_residual(model, noisy, weight="class_weight") < 1e-5 < Op.logistic_residual(model, noisy)


def test_standardised_svm_has_no_gap(spark, noisy):
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[LinearSVC(maxIter=2, standardization=True)]).fit(noisy)
    with pytest.raises(ValueError, match="unstandardised"):
        Op.hinge_gap(model, noisy)
    with pytest.raises(TypeError, match="no linear model"):
        Op.residual(Mo.classifier_pipeline("rf", numTrees=2)[0].fit(noisy), noisy)


# --- forests -----------------------------------------------------------------------------

@pytest.mark.parametrize("depth", [1, 6])
def test_walk_equals_the_model(spark, noisy, depth):
    model = Mo.classifier_pipeline("rf", numTrees=7, maxDepth=depth, weight="class_weight")[0].fit(noisy)
    forest = model.stages[-1]
    nodes = Fo.forest_nodes(spark, forest)
    assert Fo.structure_faults(nodes, depth).collect() == []
    roots = nodes.where("node = 0").collect()
    leaves = {r["tree"]: r["n"] for r in nodes.where("left IS NULL").groupBy("tree").agg(F.sum("n").alias("n")).collect()}
    assert len(roots) == 7 and {r["tree"]: r["n"] for r in roots} == leaves
    scored = model.transform(noisy)
    got = {r["vec_id"]: r for r in Fo.walk(scored, nodes, ["vec_id"], "scaledFeatures", depth).collect()}
    for r in scored.collect():
        assert np.allclose(got[r["vec_id"]]["votes"], r["rawPrediction"].toArray(), atol=1e-9) and got[r["vec_id"]]["prediction"] == r["prediction"]


def test_broken_forests_are_found(spark, noisy, monkeypatch):
    forest = Mo.classifier_pipeline("rf", numTrees=3, maxDepth=4)[0].fit(noisy).stages[-1]
    nodes = Fo.forest_nodes(spark, forest)
    faults = lambda n, depth=4: {r["fault"] for r in Fo.structure_faults(n, depth).collect()}
    assert "not reached once within the depth" in faults(nodes, 2)
    at = (F.col("tree") == 1) & (F.col("node") == 2)
    assert "children do not add up" in faults(nodes.withColumn("n", F.when(at, F.col("n") + 1).otherwise(F.col("n"))))
    assert "child is missing" in faults(nodes.where(~at))
    inner = (F.col("tree") == 0) & (F.col("node") == 0)
    assert "no split" in faults(nodes.withColumn("threshold", F.when(~inner, F.col("threshold"))))
    # a larger forest is joined by a shuffle
    whole = sorted(map(str, Fo.walk(noisy.select("vec_id", "features"), nodes, ["vec_id"], "features", 4).collect()))
    monkeypatch.setattr(Fo, "BROADCAST_NODES", 0)
    assert sorted(map(str, Fo.walk(noisy.select("vec_id", "features"), nodes, ["vec_id"], "features", 4).collect())) == whole


# --- kernels and probabilities ---------------------------------------------------------------

def test_kernel_error_is_under_its_bound():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    for gamma in (0.05, 1 / 6, 1.0):
        exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
        for n in (256, 4096):
            z = Ke.lifted(x, *Ke.fourier_map(6, n, gamma, 42))
            error = np.abs(z @ z.T - exact)
            assert error.max() <= Ke.error_bound(n, 60 * 60) and error.mean() < 2 / math.sqrt(n)


def test_rings_need_the_kernel(spark, tmp_path):
    rng = np.random.default_rng(4)
    angle, y = rng.uniform(0, 2 * math.pi, 360), rng.integers(0, 2, 360)
    x = (1 + 2 * y + rng.normal(0, 0.2, 360))[:, None] * np.stack([np.cos(angle), np.sin(angle)], 1)
    rows = _table(spark, x, y)
    fit = Ke.fit_kernel_grid(rows, 360, n_features=64, costs=(1.0, 10.0))
    by = {(p["kernel"], p["gamma"], p["C"]): a for p, a in zip(fit.params, fit.avg_metrics)}
    assert len(by) == 6 and fit.n_fits == 19
    assert max(a for (k, *_), a in by.items() if k == "linear") < 0.7 < 0.97 < max(a for (k, *_), a in by.items() if k == "rbf")
    assert fit.extra["best_params"]["kernel"] == "rbf" and fit.extra["platt_residual"] < 1e-6 and fit.extra["platt"][0] > 0
    scored = Ke.with_probability(fit.model.transform(rows).withColumn("score", vector_to_array("rawPrediction")[1]), fit.extra["platt"])
    good = scored.where((F.col("probability") > 0.5) == (F.col("label") == 1)).count()
    assert good > 0.95 * 360
    # the lifted pipeline is saved and loaded like any other
    path = scratch_path(spark, "kernel-model")
    fit.model.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(rows)
    assert [r[0] for r in again.select("prediction").collect()] == [r[0] for r in fit.model.transform(rows).select("prediction").collect()]


def test_gammas(spark, noisy):
    assert Ke.kernel_gamma(noisy, "auto") == 1 / 5 and Ke.kernel_gamma(noisy, "scale") == 1 / 4


def test_probability_curve_equals_a_direct_search(spark):
    rng = np.random.default_rng(5)
    s = rng.normal(size=400) * 2
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(1.5 * s - 0.5)))).astype(int)
    scored = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)] + [(None, 1.0), (1, None), (1, float("nan"))], "label int, score double")
    slope, offset = Ke.platt(scored)
    # rows without a label or score count towards no target
    targets = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda a, b: (np.logaddexp(0, a * s + b) - targets * (a * s + b)).sum()
    best = loss(slope, offset)
    assert all(best <= loss(slope + da, offset + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    assert abs(slope - 1.5) < 0.4 and Ke.platt(scored.limit(0)) == (0.0, 0.0)
    # classes that a score separates: the drawn-in targets keep the curve finite
    apart = spark.createDataFrame([(int(i >= 50), float(i) * 100) for i in range(100)], "label int, score double")
    curve = Ke.platt(apart)
    assert all(math.isfinite(v) for v in curve) and Ke.platt_residual(apart, curve) < 1e-6
