"""Requests that name their model: batch and stream, each answered exactly once."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.operators import models as Mo
from pixelmill.operators import scoring as Sc
from pixelmill.operators.features import assembler
from pixelmill.session import scratch_path
from pixelmill.streaming import routing as Ro

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("wanted", T.StringType()),
                       T.StructField("features", VectorUDT()), T.StructField("label", T.IntegerType())])
NAMES = ("logistic_regression", "random_forest", "svm")


def _rows(n, first=0):
    rng = np.random.default_rng(first)
    wanted = [*NAMES, "other", None]
    return [(first + i, wanted[i % 5], Vectors.dense((rng.normal(size=4) + (2 if i % 2 else -2)).tolist()), i % 2) for i in range(n)]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(_rows(120), SCHEMA)


@pytest.fixture(scope="module")
def models(spark, train):
    return {name: Mo.classifier_pipeline(kind)[0].fit(train) for kind, name in zip(Mo.KINDS, NAMES)}


def _batch(models, df):
    return {(name, r["vec_id"]): (r["prediction"], r["score"]) for name in models
            for r in Sc.score(models[name], df, ["vec_id"], name).collect()}


def test_one_pass_gives_the_scores_of_every_model(spark, train, models):
    got = Sc.score_all(models, train, ["vec_id"])
    assert {(r["model"], r["vec_id"]): (r["prediction"], r["score"]) for r in got.collect()} == _batch(models, train)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan


def test_every_request_has_one_answer(spark, train, models):
    bad = [(1000, NAMES[0], None, 0), (1001, NAMES[1], Vectors.dense([1.0, float("nan"), 0.0, 0.0]), 0), (1002, NAMES[2], Vectors.dense([1.0]), 0),
           (1003, NAMES[0], Vectors.dense([1.0, float("inf"), 0.0, 0.0]), 0), (1004, None, None, 0), (1005, "other", None, 0), (None, NAMES[0], Vectors.dense([1.0, 0.0, 0.0, 0.0]), 0),
           (5, NAMES[0], Vectors.sparse(4, [1], [2.0]), 0)]
    requests = train.unionByName(spark.createDataFrame(bad, SCHEMA))
    got = Sc.answer_requests(models, requests, "wanted", ["vec_id", "label"]).collect()
    assert len(got) == 128
    expected = _batch(models, train)
    for r in got:
        if r["sink"] == Sc.SCORED:
            assert r["reason"] is None and r["available_models"] is None and r["flag"] == r["class_predicted"] == r["prediction"]
            if r["vec_id"] is not None and r["vec_id"] != 5:
                assert (r["prediction"], r["score"]) == expected[r["model"], r["vec_id"]]
        else:
            assert r["prediction"] is None and r["score"] is None and r["flag"] is None and r["diagnosis"] is None
            assert r["available_models"] == ",".join(sorted(NAMES))
    reasons = {r["vec_id"]: r["reason"] for r in got}
    assert reasons[1000] == reasons[1001] == reasons[1002] == reasons[1003] == Sc.INVALID_INPUT_TEXT
    assert reasons[1004] == "Modèle non spécifié" and reasons[1005] == "Modèle other non disponible" and reasons[None] is None


def test_assembled_columns_and_no_models(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 2), i % 2) for i in range(40)], "vec_id long, a double, b double, label int")
    model = Mo.classifier_pipeline("lr", pre=[assembler(["a", "b"], "features", "skip")])[0].fit(rows)
    asked = spark.createDataFrame([(1, 1.0, None, "lr"), (2, 1.0, 1.0, "lr"), (3, float("nan"), 0.0, "lr"), (4, 0.0, 0.0, "x")], "vec_id long, a double, b double, m string")
    got = {r["vec_id"]: (r["sink"], r["reason"]) for r in Sc.answer_requests({"lr": model}, asked, "m", ["vec_id"]).collect()}
    assert got == {1: ("rejected", Sc.INVALID_INPUT_TEXT), 2: ("scored", None), 3: ("rejected", Sc.INVALID_INPUT_TEXT), 4: ("rejected", "Modèle x non disponible")}
    none = Sc.answer_requests({}, asked, "m", ["vec_id"]).collect()
    assert len(none) == 4 and {r["sink"] for r in none} == {"rejected"} and {r["available_models"] for r in none} == {""}


class _Stream:
    """A folder that requests arrive in, a store of models and a folder of answers."""

    def __init__(self, spark, tmp):
        self.spark, self.src, self.root = spark, str(tmp / "in"), scratch_path(spark, "store")
        self.out, self.ckpt = str(tmp / "out"), str(tmp / "ckpt")
        self.store = Ro.ModelStore(spark, self.root, NAMES)

    def arrive(self, name, rows):
        self.spark.createDataFrame(rows, SCHEMA).write.parquet(f"{self.src}/{name}")

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(self.src)
        Ro.route_stream(self.spark, self.store, stream, "wanted", ["vec_id"], self.out, self.ckpt)
        return {r["vec_id"]: r for r in self.once()}

    def once(self):
        rows = Ro.answers(self.spark, self.out).collect()
        assert len(rows) == len({r["vec_id"] for r in rows})
        return rows


def test_a_stream_of_requests(spark, models, train, tmp_path):
    s = _Stream(spark, tmp_path)
    s.arrive("first", _rows(120))
    assert {r["sink"] for r in s.run().values()} == {"rejected"}  # no model is there yet
    for name in NAMES[:2]:
        Mo.save_model(models[name], s.root, name)
    s.arrive("second", _rows(50, 1000))
    got = s.run()
    assert len(got) == 170
    later = {i: r for i, r in got.items() if i >= 1000}
    expected = _batch({n: models[n] for n in NAMES[:2]}, spark.createDataFrame(_rows(50, 1000), SCHEMA))
    for i, r in later.items():
        wanted = [*NAMES, "other", None][(i - 1000) % 5]
        assert r["sink"] == ("scored" if wanted in NAMES[:2] else "rejected")
        if r["sink"] == "scored":
            assert (r["prediction"], r["score"]) == expected[wanted, i]
    loads = s.store.loads
    s.arrive("third", _rows(10, 2000))
    assert len(s.run()) == 180 and s.store.loads == loads  # nothing has changed
    Mo.save_model(models["svm"], s.root, "svm")
    s.arrive("fourth", _rows(10, 3000))
    got = s.run()
    assert s.store.loads == loads + 1 and sum(r["sink"] == "scored" for i, r in got.items() if i >= 3000) == 6
    assert Ro.scored(spark, s.out).count() + Ro.rejected(spark, s.out).count() == 190
    assert set(Ro.scored(spark, s.out).columns) & set(Ro.ONLY_REJECTED) == set()


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_restart_inside_a_batch(spark, models, tmp_path, monkeypatch, when):
    """The query ends before or after a batch's answers are written, before the batch is
    committed; a model is added, and the batch runs again."""
    s = _Stream(spark, tmp_path)
    Mo.save_model(models[NAMES[0]], s.root, NAMES[0])
    s.arrive("first", _rows(30))
    write = Ro.write_batch

    def broken(answers, out, batch_id):
        if when == "after":
            write(answers, out, batch_id)
        raise RuntimeError("lost")

    monkeypatch.setattr(Ro, "write_batch", broken)
    with pytest.raises(Exception, match="lost"):
        s.run()
    if when == "after":
        assert sum(r["sink"] == "scored" for r in s.once()) == 6
    monkeypatch.setattr(Ro, "write_batch", write)
    for name in NAMES[1:]:
        Mo.save_model(models[name], s.root, name)
    got = s.run()
    assert len(got) == 30 and sum(r["sink"] == "scored" for r in got.values()) == 18
    s.arrive("second", _rows(10, 100))
    assert len(s.run()) == 40


def test_a_batch_without_rejects_leaves_none_of_an_earlier_try(spark, models, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([r for r in _rows(30) if r[1] in NAMES], SCHEMA)
    Ro.write_batch(Sc.answer_requests({}, rows, "wanted", ["vec_id"]), out, 0)
    assert Ro.rejected(spark, out).count() == 18
    Ro.write_batch(Sc.answer_requests(models, rows, "wanted", ["vec_id"]), out, 0)
    assert Ro.answers(spark, out).where(F.col("sink") == "rejected").count() == 0 and Ro.scored(spark, out).count() == 18
