"""Forests grown into a table: by definition, by levels, against MLlib's, and in a selection."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pixelmill.operators import forest as Fo
from pixelmill.operators import grown_forest as Gf
from pixelmill.operators import models as Mo
from pixelmill.plans import q_models
from tests.test_forest_cuts import _score


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    r = random.Random(3)
    data = []
    for i in range(400):
        x = [r.gauss(0, 1) for _ in range(5)] + [float(r.randrange(3))]
        y = int(x[0] + x[1] * x[2] + r.gauss(0, 0.7) > 0)
        data.append((i, x, y, i % 3, 1.5 if y else 0.75, r.choice([0.5, 1.0, 3.0])))
    path = str(tmp_path_factory.mktemp("rows") / "t")
    spark.createDataFrame(data, "vec_id long, features array<double>, label int, fold int, class_weight double, own_weight double").withColumn(
        "features", array_to_vector(F.col("features"))).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def _fit(rows, **settings):
    return Gf.GrownForestClassifier(**({"seed": 42, "weightCol": "class_weight"} | settings)).fit(rows)


def _nodes(spark, model):
    out: dict[int, dict] = {}
    for r in Fo.forest_nodes(spark, model).collect():
        out.setdefault(r["tree"], {})[r["node"]] = r
    return out


def _by_definition(x, y, w, c, edges, depth, least):
    """A tree as nested tuples, split by split over all rows and features."""
    s, n = [(w * c)[y == k].sum() for k in (0, 1)], [c[y == k].sum() for k in (0, 1)]
    leaf = (int(s[1] > s[0]), s, sum(n), None)
    gini = lambda v: 1 - sum((a / sum(v)) ** 2 for a in v)
    best = (0.0, None)
    if min(n) > 0 and depth > 0:
        for f in range(x.shape[1]):
            for e in edges[f][np.isfinite(edges[f])]:
                go = x[:, f] <= e
                if min(c[go].sum(), c[~go].sum()) < least:
                    continue
                a, b = ([(w * c)[side & (y == k)].sum() for k in (0, 1)] for side in (go, ~go))
                gain = gini(s) - (sum(a) * gini(a) + sum(b) * gini(b)) / sum(s)
                if gain > best[0] + 1e-12:
                    best = (gain, (f, e, go))
    if best[1] is None:
        return leaf
    f, e, go = best[1]
    a, b = (_by_definition(x[side], y[side], w[side], c[side], edges, depth - 1, least) for side in (go, ~go))
    return leaf if a[3] is None and b[3] is None and a[0] == b[0] else (leaf[0], s, sum(n), (f, e, a, b))


def _same(tree, node, own):
    got = own[node]
    assert got["stats"] == pytest.approx(tree[1]) and got["n"] == tree[2] and got["prediction"] == tree[0]
    assert (got["left"] is None) == (tree[3] is None)
    if tree[3]:
        assert (got["feature"], got["threshold"]) == (tree[3][0], pytest.approx(tree[3][1]))
        _same(tree[3][2], got["left"], own)
        _same(tree[3][3], got["right"], own)


@pytest.mark.parametrize("local", [None, 3000])
@pytest.mark.parametrize("least,weight", [(1, "class_weight"), (6, "own_weight")])
def test_trees_are_those_of_the_definition(spark, rows, monkeypatch, least, weight, local):
    """Whole in a task, and with the large nodes split by sums over all tasks."""
    if local:
        monkeypatch.setattr(Gf, "LOCAL_BYTES", local)
        monkeypatch.setattr(Gf, "NODES_AT_A_TIME", 2)
    table = rows.orderBy("vec_id").coalesce(1)
    for bootstrap in (False, True):
        model = _fit(table, numTrees=2, maxDepth=7, minInstancesPerNode=least, featureSubsetStrategy="all", bootstrap=bootstrap, weightCol=weight, maxBins=16)
        own = _nodes(spark, model)
        data = table.collect()
        x, y, w = (np.array(v) for v in zip(*((r["features"].toArray(), r["label"], r[weight]) for r in data)))
        assert sorted(own) == [0, 1]
        for tree in own:
            c = Gf.bag(np.arange(len(x)), tree, 42, 1.0) if bootstrap else np.ones(len(x), int)
            _same(_by_definition(x, y, w, c, model.edges, 7, least), 0, own[tree])
        assert Fo.structure_faults(Fo.forest_nodes(spark, model), 7).isEmpty()


def test_bags_and_features_are_draws(rows):
    ids = np.arange(200_000) + (5 << 33)
    drawn = Gf.bag(ids, 3, 42, 1.0)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02 and abs((drawn == 0).mean() - np.exp(-1)) < 0.005
    other = Gf.bag(ids, 4, 42, 1.0)
    assert abs(np.corrcoef(drawn, other)[0, 1]) < 0.01 and abs(np.corrcoef(drawn[1:], drawn[:-1])[0, 1]) < 0.01
    assert (Gf.bag(ids[::-1], 3, 42, 1.0)[::-1] == drawn).all()
    growth = Gf.Growth(np.zeros((64, 31)), 8, 30, 1, 0.0, 42, 1.0)
    tried = growth.features(0, 1, 4000)
    assert tried.shape == (4000, 8) and all(len(set(t)) == 8 for t in tried[:50]) and abs(np.bincount(tried.ravel()) / 500 - 1).max() < 0.3


def test_grown_forests_are_like_those_of_mllib(spark, rows):
    """Of the same settings: as many nodes, and as good on rows that were left out."""
    sizes, aucs = [], []
    for kind in (RandomForestClassifier, Gf.GrownForestClassifier):
        model = kind(numTrees=60, maxDepth=12, minInstancesPerNode=2, weightCol="class_weight", seed=1).fit(rows.where("fold <> 0"))
        sizes.append(Fo.forest_nodes(spark, model).count() / 60)
        aucs.append(Mo.auc_evaluator().evaluate(model.transform(rows.where("fold = 0"))))
    assert abs(sizes[1] / sizes[0] - 1) < 0.08 and abs(aucs[1] - aucs[0]) < 0.05


@pytest.mark.parametrize("local", [None, 3000])
def test_scores_are_those_of_the_cut_forests(spark, rows, monkeypatch, local):
    if local:
        monkeypatch.setattr(Gf, "LOCAL_BYTES", local)
    monkeypatch.setattr(Gf, "BLOCK_ROWS", 64)
    model = _fit(rows, numTrees=7, maxDepth=9)
    points = [(7, 9), (7, 3), (3, 9), (2, 1), (4, 0), (7, 30)]
    got = Fo.cut_scores(model, rows, points, "label")
    nodes, data = _nodes(spark, model), rows.collect()
    for point, (trees, cut) in enumerate(points):
        want = sorted((r["label"], _score(nodes, r["features"].toArray(), trees, cut)) for r in data)
        found = sorted((r["label"], r["score"]) for r in got.where(F.col("point") == point).collect())
        assert [a[0] for a in found] == [a[0] for a in want] and [a[1] for a in found] == pytest.approx([a[1] for a in want], abs=1e-9)
    own = {r["vec_id"]: r for r in model.transform(rows).collect()}
    assert len(own) == len(data)
    for r in data:
        votes, raw = _score(nodes, r["features"].toArray(), 7, 9), own[r["vec_id"]]["rawPrediction"]
        assert (raw[0], raw[1]) == pytest.approx((7 - votes, votes), abs=1e-9) and own[r["vec_id"]]["prediction"] == float(votes > 7 - votes)
        assert own[r["vec_id"]]["probability"][1] == pytest.approx(votes / 7) and own[r["vec_id"]]["features"] == r["features"]
    walked = {r["vec_id"]: r for r in Fo.walk(rows, Fo.forest_nodes(spark, model), ["vec_id"], "features", 9).collect()}
    assert all(walked[k]["votes"] == pytest.approx(list(r["rawPrediction"]), abs=1e-9) and walked[k]["prediction"] == r["prediction"] for k, r in own.items())


def test_a_selection_keeps_no_forest_on_the_driver(spark, rows, monkeypatch):
    """MLlib's forests stayed there while they grew, 200 trees of depth 30 six times over."""
    grown = []
    fit = RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, data: grown.append(self) or fit(self, data))
    monkeypatch.setattr(Mo, "TWIN_RF_GRID", {"numTrees": [3, 6], "maxDepth": [2, None], "min_samples_split": [2, 8]})
    got = Mo.fit_twin("rf", rows, rows.count())
    last = got.model.stages[-1]
    assert not grown and isinstance(last, Gf.GrownForestModel) and not hasattr(last, "_java_obj")
    assert got.n_fits == 3 * 8 + 1 and got.extra["grown"] == 6
    # a point's measure is that of its own forest: the largest of a family is the grown one itself
    pipe, grid = Mo.twin_grid("rf", rows.count())
    at = next(i for i, p in enumerate(got.params) if p == {"numTrees": 6, "maxDepth": 30, "minInstancesPerNode": 1})
    stage = Gf.GrownForestClassifier.like(pipe.getStages()[-1])
    assert (stage.getOrDefault("weightCol"), stage.getOrDefault("seed"), stage.getOrDefault("featuresCol")) == ("class_weight", Mo.SEED, "scaledFeatures")
    assert all(0.5 < m <= 1 for m in got.avg_metrics) and got.avg_metrics[at] > got.avg_metrics[0] - 0.05
    assert q_models.fit_proved("rf", got.model, rows, rows.where("fold = 0"))


def test_a_forest_of_other_votes_is_not_proved(spark, rows, monkeypatch):
    scaler = Mo.classifier_pipeline("rf")[0].getStages()[0]
    model = Pipeline(stages=[scaler, Gf.GrownForestClassifier(featuresCol="scaledFeatures", numTrees=5, maxDepth=6, seed=2)]).fit(rows)
    assert q_models.fit_proved("rf", model, rows, rows)
    other = Gf.GrownForestModel(spark, Gf.GrownForestClassifier(featuresCol="scaledFeatures", numTrees=5, maxDepth=6, seed=3).fit(
        model.stages[0].transform(rows)).path, model.stages[1].edges, {"featuresCol": "scaledFeatures", "numTrees": 5, "maxDepth": 6})
    nodes = other.nodes()
    monkeypatch.setattr(Gf.GrownForestModel, "nodes", lambda self: nodes)
    assert not q_models.fit_proved("rf", model, rows, rows)


def test_large_forests_are_walked_without_a_broadcast(spark, rows, monkeypatch):
    """Up to a million nodes were broadcast at once, and more shuffled with the rows at every level."""
    model = _fit(rows, numTrees=9, maxDepth=6)
    nodes = Fo.forest_nodes(spark, model).cache()
    assert Fo.BROADCAST_NODES <= 1 << 17
    twice = rows.unionByName(rows)
    for limit in (6, 3):
        whole = {r["vec_id"]: r for r in Fo.walk(twice, nodes, ["vec_id"], "features", limit).collect()}
        with monkeypatch.context() as m:
            m.setattr(Fo, "BROADCAST_NODES", nodes.count() - 1)
            m.setattr(Fo, "BLOCK_ROWS", 64)
            walked = Fo.walk(twice, nodes, ["vec_id"], "features", limit)
            assert walked._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
            parts = {r["vec_id"]: r for r in walked.collect()}
        assert set(parts) == set(whole) and len(parts) == 400
        assert all(parts[k]["votes"] == pytest.approx(r["votes"], abs=1e-12) and parts[k]["prediction"] == r["prediction"] for k, r in whole.items())


def test_few_trees_and_blocks_meet_in_a_task(spark, rows, monkeypatch, tmp_path):
    """Batches of 64 MB brought an executor to its limit."""
    trees = _fit(rows, numTrees=9, maxDepth=6).trees_table()
    blocks = spark.createDataFrame([(i, b"\0" * 8, b"\0" * 6) for i in range(4)], "block long, ids binary, x binary").coalesce(1)
    assert Fo.meeting(trees, blocks, F.size("left")).count() == 36
    monkeypatch.setattr(Fo, "MEETING_BYTES", 1000)
    pairs = Fo.meeting(trees, blocks, F.size("left"))
    assert pairs.count() == 36 and "Repartition 9, true" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_what_cannot_be_grown_is_said(spark, rows):
    with pytest.raises(ValueError, match="no rows"):
        _fit(rows.limit(0))
    with pytest.raises(ValueError, match="Gini"):
        _fit(rows, impurity="entropy")
    with pytest.raises(Exception, match="labels 0 and 1"):
        _fit(rows.withColumn("label", F.col("label") + 1))
    assert PipelineModel([_fit(rows, numTrees=2)]).transform(rows.limit(0)).count() == 0
