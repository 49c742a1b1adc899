"""Classifiers, grids and cross-validated model selection with MLlib.

Every estimator is a ``Pipeline(scaler, classifier)`` so the fitted model
carries its own scaling. Model selection is MLlib's ``CrossValidator``:
* folds come from a hash of the *source* id (``fold_column``), so oversampled
  copies of one row never sit on both sides of a fold, and the folds do not
  depend on partitioning;
* up to ``parallelism`` fits run at a time, each itself a set of distributed
  jobs (tree aggregation of gradients / split statistics). Every fit keeps its own
  cached blocks of the training rows, so the number at a time bounds the storage:
  ``PARALLELISM`` is meant for large tables; small ones can take more.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.hashing import hash_uniform

# --- fixed values: grids and settings of the original model selection ---------------
LR_GRID = {"regParam": [0.01, 0.1, 0.5], "elasticNetParam": [0.0, 0.5, 1.0]}
RF_GRID = {"numTrees": [50], "maxDepth": [5, 7]}
SVM_GRID = {"regParam": [0.3], "maxIter": [30]}
TWIN_LR_C = [0.01, 0.1, 1, 10]
TWIN_RF_GRID = {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15, None], "min_samples_split": [2, 5]}
TWIN_SVM_C = [0.1, 1, 10]
NUM_FOLDS = 3
SEED = 42
# Settings of the three estimators and of the scaler before each.
LR_SETTINGS = {"maxIter": 100, "regParam": 0.01, "elasticNetParam": 0.5}
RF_SETTINGS = {"numTrees": 50, "maxDepth": 7, "seed": SEED}
SVM_SETTINGS = {"maxIter": 50, "regParam": 0.3, "tol": 1e-4, "aggregationDepth": 2, "standardization": False}
SCALE_ONLY, CENTRE_AND_SCALE = {}, {"withMean": True, "withStd": True}
# MLlib's deepest tree is 30 levels; an unbounded depth maps to it.
MAX_TREE_DEPTH = 30
# --------------------------------------------------------------------------------------

#: Fits at a time unless a caller knows that more fit in memory.
PARALLELISM = 2
# kind -> (display name, estimator, its settings, scaler settings, grid)
KINDS = {
    "lr": ("Logistic Regression", LogisticRegression, LR_SETTINGS, SCALE_ONLY, LR_GRID),
    "rf": ("Random Forest", RandomForestClassifier, RF_SETTINGS, SCALE_ONLY, RF_GRID),
    "svm": ("Linear SVM", LinearSVC, SVM_SETTINGS, CENTRE_AND_SCALE, SVM_GRID),
}


@dataclass
class FitResult:
    name: str
    model: PipelineModel
    avg_metrics: list[float]
    params: list[dict]
    training_time: float
    n_fits: int
    extra: dict = field(default_factory=dict)


def fold_column(key: str, folds: int = NUM_FOLDS, seed: int = SEED) -> Column:
    """Fold index in [0, folds) from the source id (copies share a fold)."""
    return F.floor(hash_uniform(f"{seed}:fold", key) * F.lit(folds)).cast("int")


def _grid(stage, spec: dict):
    b = ParamGridBuilder()
    for name, values in spec.items():
        b = b.addGrid(stage.getParam(name), values)
    return b.build()


def classifier_pipeline(kind: str, features: str = "features", label: str = "label", weight: str | None = None,
                        pre: list | tuple = (), **changed):
    """``pre`` stages, the kind's scaler and its classifier. Returns
    (pipeline, classifier); ``changed`` settings replace the fixed ones."""
    _, estimator, settings, scaling, _ = KINDS[kind]
    scale = StandardScaler(inputCol=features, outputCol="scaledFeatures", **scaling)
    stage = estimator(featuresCol="scaledFeatures", labelCol=label, **(settings | changed))
    if weight:
        stage.setWeightCol(weight)
    return Pipeline(stages=[*pre, scale, stage]), stage


def auc_evaluator(label: str = "label") -> BinaryClassificationEvaluator:
    """Exact AUC (no binning), as the test metrics have it."""
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)


def cross_validate_mllib(name: str, pipeline: Pipeline, grid: list, train: DataFrame,
                         label: str = "label", fold_col: str | None = "fold",
                         folds: int = NUM_FOLDS, parallelism: int | None = None) -> FitResult:
    """The same selection with MLlib's own ``CrossValidator`` (grid points of
    one fold run concurrently, folds one after another)."""
    from pyspark.ml.tuning import CrossValidator

    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=auc_evaluator(label),
                        numFolds=folds, seed=SEED, parallelism=parallelism or PARALLELISM)
    if fold_col:
        cv.setFoldCol(fold_col)
    t0 = time.perf_counter()
    cvm = cv.fit(train)
    elapsed = time.perf_counter() - t0
    params = [{p.name: v for p, v in pm.items()} for pm in grid]
    best = max(range(len(grid)), key=lambda i: cvm.avgMetrics[i])
    return FitResult(name, cvm.bestModel, list(cvm.avgMetrics), params, elapsed,
                     n_fits=folds * len(grid) + 1, extra={"best_params": params[best]})


def cross_validate(name: str, pipeline: Pipeline, grid: list, train: DataFrame,
                   label: str = "label", fold_col: str | None = "fold",
                   folds: int = NUM_FOLDS, parallelism: int | None = None,
                   engine: str = "concurrent") -> FitResult:
    """C4 + C5 + C7: k-fold cross-validation over the grid, then a refit of the
    best grid point on all of ``train``; wall time of the whole selection.

    Same result as MLlib's ``CrossValidator`` with a fold column (mean AUC per
    grid point over the held-out folds, arg-max, refit), but the fits of all
    folds share one queue of ``parallelism`` workers, so that a small grid (one SVM
    point, two forest points) does not wait fold by fold. Each fold is a filter
    on ``train``, which callers write once before. ``engine="mllib"`` uses
    MLlib's ``CrossValidator`` instead."""
    from concurrent.futures import ThreadPoolExecutor

    if engine == "mllib":
        return cross_validate_mllib(name, pipeline, grid, train, label, fold_col, folds, parallelism)

    ev = auc_evaluator(label)
    data = train if fold_col else train.withColumn("_fold", F.floor(F.rand(SEED) * folds).cast("int"))
    fcol = fold_col or "_fold"

    def run(task):
        f, i = task
        model = pipeline.fit(data.where(F.col(fcol) != f), grid[i])
        return ev.evaluate(model.transform(data.where(F.col(fcol) == f)))

    tasks = [(f, i) for f in range(folds) for i in range(len(grid))]
    t0 = time.perf_counter()
    with ThreadPoolExecutor(max_workers=parallelism or PARALLELISM) as pool:
        scores = list(pool.map(run, tasks))
    avg = [sum(s for s, (_, at) in zip(scores, tasks) if at == i) / folds for i in range(len(grid))]
    best = max(range(len(grid)), key=lambda i: avg[i])  # first point wins ties
    model = pipeline.fit(data, grid[best])
    elapsed = time.perf_counter() - t0
    params = [{p.name: v for p, v in pm.items()} for pm in grid]
    return FitResult(name, model, avg, params, elapsed, n_fits=len(tasks) + 1,
                     extra={"best_params": params[best]})


def cross_validate_passes(kind: str, name: str, pipeline: Pipeline, grid: list, train: DataFrame,
                          label: str = "label", fold_col: str = "fold", folds: int = NUM_FOLDS,
                          weight: str | None = None) -> FitResult | None:
    """The same selection for linear models, all grid points and folds fitted in shared
    passes (:mod:`pixelmill.operators.linear_fits`); the best point is refitted by its
    MLlib pipeline. The logistic averages are MLlib's to rounding; the SVM's are those
    of fits at their optimum. None where it does not apply: stages before the scaler that
    need fitting, or more than ``MAX_FEATURES`` features."""
    from pixelmill.operators import linear_fits as Lf

    *pre, scale, stage = pipeline.getStages()
    if kind not in ("lr", "svm") or any(hasattr(p, "fit") for p in pre):
        return None
    t0 = time.perf_counter()
    rows = train
    for p in pre:
        rows = p.transform(rows)
    blocks = Lf.pack(rows, scale.getInputCol(), label, weight, fold_col)
    first = blocks.select("n", F.length("x").alias("bytes")).where("n > 0").first()
    if first is None or first["bytes"] // 8 // first["n"] > Lf.MAX_FEATURES:
        return None
    d = first["bytes"] // 8 // first["n"]
    params = [{p.name: v for p, v in pm.items()} for pm in grid]
    value = lambda p, c: float(p.get(c, stage.getOrDefault(c)))
    scales = Lf.scales(blocks, d, list(range(folds)), weighted_std=kind == "lr")
    groups = [[Lf.Fit(s, value(p, "regParam"), value(p, "elasticNetParam") if kind == "lr" else 0.0) for p in params] for s in scales]
    fits = [f for g in groups for f in g]
    Lf.solve(blocks, Lf.LOGISTIC if kind == "lr" else Lf.HINGE, fits, d)
    auc = Lf.held_out_auc(blocks, groups)
    avg = [sum(auc.get((f, i), 0.5) for f in range(folds)) / folds for i in range(len(grid))]
    best = max(range(len(grid)), key=lambda i: avg[i])  # first point wins ties
    model = pipeline.fit(train, grid[best])
    return FitResult(name, model, avg, params, time.perf_counter() - t0, n_fits=len(fits) + 1,
                     extra={"best_params": params[best], "passes": max(f.passes for f in fits)})


def cross_validate_forests(name: str, pipeline: Pipeline, grid: list, train: DataFrame, label: str = "label",
                           fold_col: str = "fold", folds: int = NUM_FOLDS, parallelism: int | None = None) -> FitResult:
    """The same selection for forests whose grid varies the number of trees and the
    depth: points that agree in all else are the first trees, cut at a depth, of the largest
    forest among them (:func:`pixelmill.operators.forest.cut_scores`), grown once a fold. Every
    point of every fold is scored on all of its left-out rows; the best is refitted at
    its own parameters by its pipeline. ``n_fits`` counts the forests scored, ``grown``
    those grown for them. They are grown into tables (:mod:`pixelmill.operators.grown_forest`), so the
    driver holds none of them."""
    from concurrent.futures import ThreadPoolExecutor

    from pixelmill.operators import forest as Fo
    from pixelmill.operators.grown_forest import GrownForestClassifier
    from pixelmill.operators.metrics import auc_roc

    stage = GrownForestClassifier.like(pipeline.getStages()[-1])
    pipeline = Pipeline(stages=[*pipeline.getStages()[:-1], stage])
    grid = [{stage.getParam(p.name): v for p, v in pm.items()} for pm in grid]
    t0 = time.perf_counter()
    params = [{p.name: v for p, v in pm.items()} for pm in grid]
    sizes = [tuple(int(p.get(c, stage.getOrDefault(c))) for c in ("numTrees", "maxDepth")) for p in params]
    families: dict[tuple, list[int]] = {}
    for i, p in enumerate(params):
        # a single tree draws among all features, others among some
        rest = tuple(sorted((k, v) for k, v in p.items() if k not in ("numTrees", "maxDepth")))
        families.setdefault((sizes[i][0] == 1, rest), []).append(i)

    tasks = [(f, own) for f in range(folds) for own in families.values()]
    at_a_time = min(parallelism or PARALLELISM, len(tasks))
    cores = train.sparkSession.sparkContext.defaultParallelism

    def spread(rows, fits):
        """A table of few files over the cores that one of ``fits`` fits at a time has."""
        wanted = -(-cores // fits)
        return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows

    def run(task):
        f, own = task
        trees, depth = max(sizes[i][0] for i in own), max(sizes[i][1] for i in own)
        changed = {stage.numTrees: trees, stage.maxDepth: depth}
        model = pipeline.fit(spread(train.where(F.col(fold_col) != f), at_a_time), grid[own[0]] | changed)
        left_out = PipelineModel(model.stages[:-1]).transform(train.where(F.col(fold_col) == f))
        scored = Fo.cut_scores(model.stages[-1], left_out, [sizes[i] for i in own], label)
        return {own[r["point"]]: r["auc_roc"] for r in auc_roc(scored, by=["point"]).collect()}

    with ThreadPoolExecutor(max_workers=at_a_time) as pool:
        found = list(pool.map(run, tasks))
    sums = [0.0] * len(grid)
    for (_, own), auc in zip(tasks, found):
        for i in own:
            sums[i] += 0.5 if auc.get(i) is None else auc[i]
    avg = [s / folds for s in sums]
    best = max(range(len(grid)), key=lambda i: avg[i])  # first point wins ties
    model = pipeline.fit(spread(train, 1), grid[best])
    return FitResult(name, model, avg, params, time.perf_counter() - t0, n_fits=folds * len(grid) + 1,
                     extra={"best_params": params[best], "grown": len(tasks)})


def cv_table(spark, fit: FitResult) -> DataFrame:
    """The average metric of every grid point, as a table to persist."""
    rows = [(fit.name, i, ", ".join(f"{k}={v}" for k, v in sorted(p.items())), float(m),
             p == fit.extra["best_params"]) for i, (p, m) in enumerate(zip(fit.params, fit.avg_metrics))]
    return spark.createDataFrame(rows, "model string, point int, params string, avg_auc double, best boolean")


def fit_grid(kind: str, train: DataFrame, pre=(), engine: str | None = None, **kw) -> FitResult:
    """One of the three original grids. Logistic regression is fitted in shared passes; the
    SVM's grid fixes a number of iterations, so it is fitted by MLlib as it stands."""
    pipe, stage = classifier_pipeline(kind, pre=pre)
    grid = _grid(stage, KINDS[kind][4])
    if engine == "passes" or engine is None and kind == "lr":
        done = cross_validate_passes(kind, KINDS[kind][0], pipe, grid, train, fold_col=kw.get("fold_col", "fold"))
        if done is not None:
            return done
    return cross_validate(KINDS[kind][0], pipe, grid, train, **kw, engine=engine if engine == "mllib" else "concurrent")


def validation_auc(result: FitResult, val: DataFrame, label: str = "label") -> float:
    """AUC of the selected model on the validation split (one scalar)."""
    return auc_evaluator(label).evaluate(result.model.transform(val))


# --- C9-C11: the single-machine grids, re-aimed at MLlib with balanced weights --------

def twin_reg_param(c: float, n: int) -> float:
    """sklearn's C (loss sum + 1/2|w|^2 / C) as MLlib's regParam (mean loss +
    regParam/2 |w|^2): regParam = 1 / (C * n)."""
    return 1.0 / (c * n)


def twin_grid(kind: str, n: int, weight: str = "class_weight", pre=()):
    """(pipeline, grid) of a re-aimed grid for ``n`` training rows.

    The forest's min_samples_split s has no MLlib twin; minInstancesPerNode =
    s // 2 is the nearest rule (a split needs two children of at least that
    size). A row's node in every tree is kept between levels, so that a level of a deep
    forest does not lead every row down from the roots. Of the kernel-SVM grid only the linear part runs (no distributed RBF
    solver in MLlib)."""
    changed = {"lr": {"elasticNetParam": 0.0, "maxIter": 1000}, "rf": {"cacheNodeIds": True}, "svm": {"maxIter": 100}}[kind]
    pipe, stage = classifier_pipeline(kind, weight=weight, pre=pre, **changed)
    if kind == "rf":
        spec = {"numTrees": TWIN_RF_GRID["numTrees"],
                "maxDepth": [MAX_TREE_DEPTH if d is None else d for d in TWIN_RF_GRID["maxDepth"]],
                "minInstancesPerNode": [max(1, s // 2) for s in TWIN_RF_GRID["min_samples_split"]]}
    else:
        spec = {"regParam": [twin_reg_param(c, n) for c in (TWIN_LR_C if kind == "lr" else TWIN_SVM_C)]}
    return pipe, _grid(stage, spec)


def fit_twin(kind: str, train: DataFrame, n: int, weight: str = "class_weight", pre=(), engine: str | None = None, **kw) -> FitResult:
    """A single-machine grid, re-aimed; the linear ones in shared passes, the
    forests as parts of the largest ones."""
    pipe, grid = twin_grid(kind, n, weight, pre)
    if engine is None and kind == "rf" and kw.get("fold_col", "fold"):
        return cross_validate_forests(KINDS[kind][0], pipe, grid, train, **kw)
    if engine in (None, "passes") and kind != "rf":
        done = cross_validate_passes(kind, KINDS[kind][0], pipe, grid, train, fold_col=kw.get("fold_col", "fold"), weight=weight)
        if done is not None:
            return done
    return cross_validate(KINDS[kind][0], pipe, grid, train, **kw, engine=engine if engine == "mllib" else "concurrent")


# --- S9 / S10: model store --------------------------------------------------------------

def save_model(model: PipelineModel, root: str, name: str, prefix: str = "spark_") -> str:
    path = f"{root.rstrip('/')}/{prefix}{name}"
    model.write().overwrite().save(path)
    return path


def load_models(spark, root: str, names, prefix: str = "spark_") -> tuple[dict, DataFrame]:
    """Load each known model that exists; a broken one is reported, not fatal.
    Returns (name -> model, catalogue DataFrame(name, path, stages, status))."""
    models, rows = {}, []
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for name in names:
        path = f"{root.rstrip('/')}/{prefix}{name}"
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            continue
        try:
            m = PipelineModel.load(path)
            models[name] = m
            rows.append((name, path, ",".join(type(s).__name__ for s in m.stages), "loaded"))
        except Exception as e:  # noqa: BLE001 - a bad model must not stop the others
            rows.append((name, path, "", f"error: {type(e).__name__}"))
    cat = spark.createDataFrame(rows, "name string, path string, stages string, status string")
    return models, cat
