import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from pixelmill.operators import metrics as E


def _numpy_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def _pred(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(rng.normal(size=n) + y * 0.8, 1) + 0.0  # rounded: many ties; no -0.0
    p = (s > 0.4).astype(float)
    rows = [(int(i), int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, s, p))]
    return spark.createDataFrame(rows, "id long, label int, score double, prediction double"), y, s, p


def test_auc_matches_brute_force_and_mllib(spark):
    df, y, s, _ = _pred(spark)
    got = E.auc_roc(df).collect()[0]["auc_roc"]
    assert abs(got - _numpy_auc(y, s)) < 1e-12
    schema = T.StructType([T.StructField("rawPrediction", VectorUDT()), T.StructField("label", T.DoubleType())])
    raw = spark.createDataFrame([(Vectors.dense([-float(b), float(b)]), float(a)) for a, b in zip(y, s)], schema)
    ml = BinaryClassificationEvaluator(numBins=0).evaluate(raw)
    assert abs(got - ml) < 1e-9


def test_auc_of_skewed_tied_and_many_groups(spark):
    """Groups of very different sizes and score ranges over several ranges."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(30):
        n = 2000 if g == 0 else int(rng.integers(2, 40))
        y = rng.integers(0, 2, n)
        s = [np.round(rng.normal(size=n), 1), np.exp(rng.normal(size=n) * 20), np.ones(n)][g % 3] + 0.0
        rows += [(g, int(a), float(b)) for a, b in zip(y, s)]
        want[g] = _numpy_auc(y, s) if 0 < y.sum() < n else None
    df = spark.createDataFrame(rows, "g int, label int, score double").repartition(6)
    for r in E.auc_roc(df, by=["g"]).collect():
        assert (r["auc_roc"] is None) == (want[r["g"]] is None)
        assert want[r["g"]] is None or abs(r["auc_roc"] - want[r["g"]]) < 1e-12


def test_nothing_runs_while_metrics_are_defined(spark):
    df, *_ = _pred(spark, seed=5)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("define-metrics", "none expected")
    E.evaluate(df), E.class_report(df), E.weighted_metrics(df), E.auc_roc(df)
    assert list(tracker.getJobIdsForGroup("define-metrics")) == []


def test_predictions_of_other_classes_are_counted(spark):
    rows = [(0, 0.0), (0, 2.0), (1, None), (1, 1.0)]
    cm = {r["label"]: tuple(r)[1:] for r in E.confusion_matrix(
        spark.createDataFrame(rows, "label int, prediction double")).collect()}
    assert cm == {0: (1, 0, 1), 1: (0, 1, 1)}


def test_weighted_metrics_match_mllib(spark):
    df, y, _, p = _pred(spark, seed=1)
    got = E.weighted_metrics(df).collect()[0]
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    d = df.selectExpr("cast(label as double) label", "prediction")
    for name, metric in [("accuracy", "accuracy"), ("precision", "weightedPrecision"),
                         ("recall", "weightedRecall"), ("f1_score", "f1")]:
        assert abs(got[name] - ev.evaluate(d, {ev.metricName: metric})) < 1e-12


def test_confusion_matrix(spark):
    df, y, _, p = _pred(spark, seed=2)
    cm = {r["label"]: (r["pred_0"], r["pred_1"]) for r in E.confusion_matrix(df).collect()}
    for c in (0, 1):
        assert cm[c] == (int(((y == c) & (p == 0)).sum()), int(((y == c) & (p == 1)).sum()))


def test_one_class_prediction_edge_case(spark):
    rows = [(i, i % 2, 0.5, 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, label int, score double, prediction double")
    m = E.evaluate(df).collect()[0]
    assert m["accuracy"] == 0.5 and m["precision"] == 0.25 and m["auc_roc"] == 0.5


def test_class_report_rows(spark):
    df, *_ = _pred(spark, seed=3)
    rows = {r["row"]: r for r in E.class_report(df).collect()}
    assert set(rows) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rows["accuracy"]["support"] == 400
