import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T
from pyspark.sql import functions as F

from pixelmill.operators import models as Mo
from pixelmill.operators.scoring import score
from pixelmill.plans import train as Tr
from pixelmill.session import scratch_path
from pixelmill.streaming import scoring as St


def _separable(spark, n=240):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        y = i % 2
        x = rng.normal(size=4) + (3.0 if y else -3.0)
        rows.append((i, Vectors.dense(x.tolist()), y))
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("features", VectorUDT()),
                           T.StructField("label", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


def test_lr_cv_separable_auc_one(spark):
    prepared = Tr.prepare(_separable(spark), balance=False)
    fit, metrics = Tr.run_spark_grid(prepared, "svm")
    m = metrics.collect()[0]
    assert m["auc_roc"] == 1.0 and m["accuracy"] == 1.0
    assert fit.n_fits == 4


def test_save_load_same_predictions_and_stream_equals_batch(spark, tmp_path):
    df = _separable(spark)
    pipe, _ = Mo.classifier_pipeline("lr")
    model = pipe.fit(df)
    root = scratch_path(spark, "m")
    Mo.save_model(model, root, "logistic_regression")
    models, cat = Mo.load_models(spark, root, ["logistic_regression", "missing"])
    assert cat.count() == 1
    a = {r["vec_id"]: r["prediction"] for r in model.transform(df).collect()}
    b = {r["vec_id"]: r["prediction"] for r in models["logistic_regression"].transform(df).collect()}
    assert a == b
    src_path = str(tmp_path / "src")
    df.select("vec_id", F.col("label"), "features").write.parquet(src_path)
    stream = St.parquet_stream(spark, src_path, spark.read.parquet(src_path).schema)
    out = St.stream_score(spark, model, stream, ["vec_id"], "lr")
    batch = {r["vec_id"]: r["prediction"] for r in score(model, df, ["vec_id"], "lr").collect()}
    assert {r["vec_id"]: r["prediction"] for r in out.collect()} == batch


def test_stream_restart_is_exactly_once(spark, tmp_path):
    """R3 restarted on the same checkpoint: files seen before are not
    re-scored, new files are, every row lands in the sink once."""
    df = _separable(spark)
    pipe, _ = Mo.classifier_pipeline("lr")
    model = pipe.fit(df)
    src_path, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    df.where("vec_id < 100").write.parquet(src_path + "/batch1")
    schema = spark.read.parquet(src_path + "/batch1").schema

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src_path)
        return St.stream_score(spark, model, stream, ["vec_id"], "lr", out_path=out, checkpoint=ckpt)

    assert run().count() == 100
    df.where("vec_id >= 100").write.parquet(src_path + "/batch2")
    res = run()
    assert res.count() == df.count()
    assert res.select("vec_id").distinct().count() == df.count()


def test_concurrent_cv_equals_mllib_cv(spark):
    df = _separable(spark).withColumn("fold", Mo.fold_column("vec_id"))
    pipe, lr = Mo.classifier_pipeline("lr")
    grid = Mo._grid(lr, {"regParam": [0.01, 0.5]})
    a = Mo.cross_validate("lr", pipe, grid, df)
    b = Mo.cross_validate("lr", pipe, grid, df, engine="mllib")
    assert np.allclose(a.avg_metrics, b.avg_metrics, atol=1e-12)
    assert a.extra["best_params"] == b.extra["best_params"]


def test_cv_table_lists_every_point(spark):
    prepared = Tr.prepare(_separable(spark), balance=False)
    fit, _ = Tr.run_spark_grid(prepared, "rf")
    rows = Mo.cv_table(spark, fit).collect()
    assert len(rows) == 2 and sum(r["best"] for r in rows) == 1
    assert [r["avg_auc"] for r in rows] == fit.avg_metrics and fit.n_fits == 7
    confusion, report = Tr.test_tables(fit, prepared.where("split = 'test'"))
    assert confusion.agg({"pred_other": "sum"}).first()[0] == 0
    assert report.where("row = 'accuracy'").first()["f1_score"] == 1.0


@pytest.mark.parametrize("kind,points", [("lr", 4), ("svm", 3), ("rf", 24)])
def test_twin_grids(spark, monkeypatch, kind, points):
    assert len(Mo.twin_grid(kind, 100)[1]) == points
    # the forest grid is cut to one small point: its size is checked above
    monkeypatch.setattr(Mo, "TWIN_RF_GRID", {"numTrees": [3], "maxDepth": [3], "min_samples_split": [4]})
    fit, metrics = Tr.run_twin_grid(Tr.prepare(_separable(spark), balance=False), kind, parallelism=4)
    assert metrics.first()["accuracy"] == 1.0
    assert fit.n_fits == 3 * (1 if kind == "rf" else points) + 1 and fit.name == Mo.KINDS[kind][0]


def test_requests_are_routed_to_their_model(spark):
    from pixelmill.operators.scoring import score_requests

    df = _separable(spark, 60)
    models = {k: Mo.classifier_pipeline(k)[0].fit(df) for k in ("lr", "svm")}
    wanted = F.element_at(F.array(F.lit("lr"), F.lit("svm"), F.lit("other"), F.lit(None)), (F.col("vec_id") % 4 + 1).cast("int"))
    got = {r["vec_id"]: r for r in score_requests(models, df.withColumn("m", wanted), "m", ["vec_id"]).collect()}
    assert set(got) == {i for i in range(60) if i % 4 < 2}
    for name, model in models.items():
        for r in score(model, df, ["vec_id"], name).collect():
            if r["vec_id"] in got and got[r["vec_id"]]["model"] == name:
                assert got[r["vec_id"]]["score"] == r["score"]
