"""One grown forest scores the points of a grid: fewer trees, cut at a depth."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pixelmill.operators import forest as Fo
from pixelmill.operators import models as Mo


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    r = random.Random(3)
    data = []
    for i in range(240):
        x = [r.gauss(0, 1) for _ in range(5)]
        data.append((i, x, int(x[0] + x[1] * x[2] + r.gauss(0, 0.7) > 0), i % 3, 1.0))
    path = str(tmp_path_factory.mktemp("rows") / "t")
    spark.createDataFrame(data, "vec_id long, features array<double>, label int, fold int, class_weight double").withColumn(
        "features", array_to_vector(F.col("features"))).write.parquet(path)
    return spark.read.parquet(path)


def _score(nodes, x, trees, cut):
    """The votes for class 1, tree by tree from the definition: cut, then merge leaves."""
    total = 0.0
    for t in range(trees):
        own = nodes[t]

        def pruned(n, depth):
            node = own[n]
            if node["left"] is None or depth == cut:
                return {"p": node["prediction"], "s": node["stats"], "kids": None}
            a, b = pruned(node["left"], depth + 1), pruned(node["right"], depth + 1)
            if a["kids"] is None and b["kids"] is None and a["p"] == b["p"]:
                return {"p": a["p"], "s": node["stats"], "kids": None}
            return {"p": None, "s": None, "kids": (node["feature"], node["threshold"], a, b)}

        at = pruned(0, 0)
        while at["kids"]:
            feature, threshold, a, b = at["kids"]
            at = a if x[feature] <= threshold else b
        total += at["s"][1] / sum(at["s"])
    return total


def test_cut_scores_are_those_of_the_smaller_forests(spark, rows):
    pipe, _ = Mo.classifier_pipeline("rf", numTrees=7, maxDepth=9, cacheNodeIds=True)
    model = pipe.fit(rows)
    scaled = PipelineModel(model.stages[:-1]).transform(rows)
    points = [(7, 9), (7, 3), (3, 9), (2, 1), (4, 0), (7, 6)]
    got: dict[int, list] = {}
    for r in Fo.cut_scores(model.stages[-1], scaled, points, "vec_id").collect():
        got.setdefault(r["point"], []).append((r["label"], r["score"]))
    assert all(len(v) == rows.count() for v in got.values()) and sorted(got) == list(range(len(points)))
    own = {r["vec_id"]: r["rawPrediction"][1] for r in model.transform(rows).collect()}
    assert all(s == pytest.approx(own[k], abs=1e-12) for k, s in got[0])
    nodes: dict[int, dict] = {}
    for r in Fo.forest_nodes(spark, model.stages[-1]).collect():
        nodes.setdefault(r["tree"], {})[r["node"]] = r
    x = {r["vec_id"]: r["scaledFeatures"].toArray() for r in scaled.collect()}
    for point, (trees, cut) in enumerate(points):
        for k, s in got[point]:
            assert s == pytest.approx(_score(nodes, x[k], trees, cut), abs=1e-12)


def test_a_selection_grows_one_forest_for_all_sizes_of_a_fold(rows, monkeypatch):
    monkeypatch.setattr(Mo, "TWIN_RF_GRID", {"numTrees": [3, 6], "maxDepth": [2, 4], "min_samples_split": [2, 8]})
    grown = []
    fit = Mo.Pipeline.fit
    monkeypatch.setattr(Mo.Pipeline, "fit", lambda self, *a: grown.append(1) or fit(self, *a))
    got = Mo.fit_twin("rf", rows, rows.count())
    # two forests a fold (one for each least leaf) and the refit, for eight points
    assert len(grown) == 3 * 2 + 1 and got.n_fits == 3 * 8 + 1 and got.extra["grown"] == 6
    last = got.model.stages[-1]
    assert (last.getNumTrees, last.getOrDefault("maxDepth")) == (got.extra["best_params"]["numTrees"], got.extra["best_params"]["maxDepth"])
    # the largest point of a family is the grown forest itself, by MLlib's own measure
    pipe, grid = Mo.twin_grid("rf", rows.count())
    at = next(i for i, p in enumerate(got.params) if p == {"numTrees": 6, "maxDepth": 4, "minInstancesPerNode": 1})
    assert 0.5 < got.avg_metrics[at] <= 1 and len(set(got.avg_metrics)) > 1


def test_a_forest_of_depth_30_is_checked_level_by_level_in_one_pass(spark, rows):
    """Joining the levels anew for each level took some 465 joins here."""
    pipe, _ = Mo.classifier_pipeline("rf", numTrees=3, maxDepth=30)
    forest = pipe.fit(rows).stages[-1]
    nodes = Fo.forest_nodes(spark, forest)
    reached = Fo.depths(nodes, 30)
    assert reached._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert reached.count() == forest.totalNumNodes
    assert Fo.structure_faults(nodes, 30).collect() == []
