"""A fitted random forest as a table, walked by joins.

The nodes of a saved forest become rows, so its structure can be checked with ordinary
aggregates, and rows are led from the roots to the leaves by one join with the nodes
for each level; of a large forest whole trees are joined to blocks of rows. The votes are
summed as MLlib sums them.

A forest also holds smaller ones: its first trees are a forest of fewer trees, and a tree
cut at a depth is the tree that the same draws grow to that depth, as the limit of
depth decides only where growth ends. So one grown forest scores rows for many points of a grid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.session import scratch_path

#: Nodes that are broadcast, at most (about 10 MB); of larger forests each tree is packed into one
#: row, and trees meet blocks of rows in tasks.
BROADCAST_NODES = 1 << 17
BLOCK_ROWS = 1024
#: Bytes of trees and blocks that meet in a task, about.
MEETING_BYTES = 16 << 20
PACKED = ("feature", "threshold", "left", "right", "shares")


def forest_nodes(spark, model, path: str | None = None) -> DataFrame:
    """(tree, node, feature, threshold, left, right, stats, n, prediction): a row for
    every node of a fitted forest, from its saved form under ``path``. ``stats`` are the
    weighted rows of each class that reached the node in training, ``n`` their number;
    leaves have null features and children."""
    if hasattr(model, "trees_table"):  # a grown forest is a table already
        return model.nodes()
    path = path or scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    node, split = "nodeData.", F.col("nodeData.split")
    inner = F.col("nodeData.leftChild") >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col(node + "id").alias("node"), F.when(inner, split["featureIndex"]).alias("feature"),
        F.when(inner, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, F.col(node + "leftChild")).alias("left"), F.when(inner, F.col(node + "rightChild")).alias("right"),
        F.col(node + "impurityStats").alias("stats"), F.col(node + "rawCount").alias("n"), F.col(node + "prediction").alias("prediction"))


def levels(left: np.ndarray, right: np.ndarray, limit: int):
    """The levels of a tree from its root: for each (position of the nodes, how often the
    root reaches each). Children are positions, negative where there are none."""
    at, times = np.zeros(min(1, len(left)), np.int64), np.ones(min(1, len(left)))
    for _ in range(limit + 1):
        if not len(at):
            return
        yield at, times
        kids, twice = np.concatenate([left[at], right[at]]), np.concatenate([times, times])
        at, inverse = np.unique(kids[kids >= 0], return_inverse=True)
        times = np.bincount(inverse, twice[kids >= 0], len(at))


def _tree(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The nodes of one tree by their number, and the positions of their children."""
    pdf = pdf.sort_values("node", ignore_index=True)
    numbers, sides = pdf["node"].to_numpy(np.int64), []
    for side in ("left", "right"):
        child = pdf[side].fillna(-1).to_numpy(np.int64)
        at = np.minimum(np.searchsorted(numbers, child), len(numbers) - 1)
        sides.append(np.where(numbers[at] == child, at, -1) if len(numbers) else at)
    return pdf, *sides


def depths(nodes: DataFrame, limit: int) -> DataFrame:
    """(tree, node, depth, times) of every node that the roots reach within ``limit``
    steps, and how often they do. Each tree is one group; MLlib itself holds it whole."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, left, right = _tree(pdf)
        if not len(pdf) or pdf["node"][0] != 0:
            return pd.DataFrame({"tree": [], "node": [], "depth": [], "times": []})
        parts = [pd.DataFrame({"node": pdf["node"].to_numpy()[at], "depth": depth, "times": times})
                 for depth, (at, times) in enumerate(levels(left, right, limit))]
        return pd.concat(parts).assign(tree=pdf["tree"][0])[["tree", "node", "depth", "times"]]

    return (nodes.select("tree", "node", "left", "right").groupBy("tree")
            .applyInPandas(run, "tree int, node int, depth int, times double"))


def structure_faults(nodes: DataFrame, limit: int) -> DataFrame:
    """(tree, fault) for whatever a forest of depth ``limit`` cannot have: a node whose
    children do not add up to it (count or class), an inner node without a threshold, a
    node that is not reached from its root once, within the depth. Empty for a sound
    forest. Each tree is one group, as for :func:`depths`."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, left, right = _tree(pdf)
        inner = pdf["left"].notna().to_numpy()
        missing = inner & ((left < 0) | (right < 0))
        n, stats = pdf["n"].to_numpy(np.float64), np.stack(pdf["stats"].to_numpy())
        own, a, b = (i[inner] for i in (np.arange(len(pdf)), left, right))
        wrong = missing.copy()
        wrong[own] |= (n[own] != n[a] + n[b]) | (np.abs(stats[own] - stats[a] - stats[b]) > 1e-6 * (1 + np.abs(stats[own]))).any(1)
        unsplit = inner & (pdf["threshold"].isna() | (pdf["feature"] < 0) | pdf["right"].isna()).to_numpy()
        times = np.zeros(len(pdf))
        for at, reached in levels(left, right, limit) if pdf["node"][0] == 0 else ():
            times[at] += reached
        found = {"children do not add up": wrong, "child is missing": missing, "no split": unsplit, "not reached once within the depth": times != 1}
        return pd.DataFrame({"fault": np.repeat(list(found), [f.sum() for f in found.values()])}).assign(tree=pdf["tree"][0])[["tree", "fault"]]

    return (nodes.select("tree", "node", "n", "stats", "left", "right", "threshold", "feature").groupBy("tree")
            .applyInPandas(run, "tree int, fault string"))


def walk(rows: DataFrame, nodes: DataFrame, keys: list[str], features: str, limit: int) -> DataFrame:
    """(``keys``, votes, prediction): every row led through every tree by ``limit`` joins
    with the nodes; ``votes`` are the trees' class shares, summed, and the
    prediction the first class of most votes. ``keys`` must name a row; rows that repeat
    them are one. Nodes are broadcast up to ``BROADCAST_NODES`` of them; the trees of a
    larger forest are joined whole to blocks of rows, which take the same steps there."""
    sizes = sorted((r["tree"], r["count"]) for r in nodes.groupBy("tree").count().collect())
    state = rows.dropDuplicates(keys).select(*keys, vector_to_array(F.col(features)).alias("_x"))
    if sum(size for _, size in sizes) <= BROADCAST_NODES:
        out = _votes_by_level(state, nodes, keys, [tree for tree, _ in sizes], limit)
    else:
        out = _votes_by_tree(state, nodes, keys, limit)
    most = F.array_max("votes")
    first = F.array_position(F.transform("votes", lambda v: v >= most), F.lit(True)) - 1
    return out.select(*keys, "votes", first.cast("double").alias("prediction"))


def _votes_by_level(state: DataFrame, nodes: DataFrame, keys: list[str], trees: list[int], limit: int) -> DataFrame:
    step = F.broadcast(nodes.select("tree", "node", "feature", "threshold", "left", "right"))
    leaf = F.broadcast(nodes.select("tree", "node", "stats"))
    state = state.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in trees]).cast("array<int>"))).withColumn("node", F.lit(0))
    for _ in range(limit):
        below = F.get(F.col("_x"), F.col("feature")) <= F.col("threshold")
        then: Column = F.when(F.col("left").isNull(), F.col("node")).when(below, F.col("left")).otherwise(F.col("right"))
        state = state.join(step, ["tree", "node"]).select(*keys, "_x", "tree", then.alias("node"))
    reached = state.join(leaf, ["tree", "node"])
    total = F.aggregate("stats", F.lit(0.0), lambda a, s: a + s)
    shares = reached.select(*keys, F.posexplode(F.transform("stats", lambda s: s / total)).alias("class", "share"))
    votes = shares.groupBy(*keys, "class").agg(F.sum("share").alias("votes"))
    return votes.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("class", "votes"))), lambda v: v["votes"]).alias("votes"))


def _votes_by_tree(state: DataFrame, nodes: DataFrame, keys: list[str], limit: int) -> DataFrame:
    spark = state.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, left, right = _tree(pdf)
        stats = np.stack(pdf["stats"].to_numpy())
        shares = np.divide(stats, stats.sum(1)[:, None], out=np.full(stats.shape, np.nan), where=stats.sum(1)[:, None] != 0)
        parts = (pdf["feature"].fillna(-1).to_numpy(np.int32), pdf["threshold"].to_numpy(np.float64), left.astype(np.int32), right.astype(np.int32), shares)
        return pd.DataFrame([[pdf["tree"][0], *(a.tobytes() for a in parts)]], columns=["tree", *PACKED])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_row").to_numpy(zero_copy_only=False)
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else None
            for at in range(0, len(ids), BLOCK_ROWS):
                own = slice(at, at + BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[at])], pa.int64()), *[pa.array([np.ascontiguousarray(a[own]).tobytes()], pa.binary()) for a in (ids, x)]],
                                                 names=["block", "ids", "x"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                feature, left, right = (np.frombuffer(r[c], np.int32) for c in ("feature", "left", "right"))
                threshold, shares = np.frombuffer(r["threshold"]), np.frombuffer(r["shares"]).reshape(len(left), -1)
                x = np.frombuffer(r["x"]).reshape(len(r["ids"]) // 8, -1)
                at, i = np.zeros(len(x), np.int64), np.arange(len(x))
                for _ in range(limit):
                    at = np.where(left[at] < 0, at, np.where(x[i, feature[at]] <= threshold[at], left[at], right[at]))
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["tree"]], pa.int32()),
                                                  pa.array([r["ids"]], pa.binary()), pa.array([shares[at].tobytes()], pa.binary())], names=["block", "tree", "ids", "votes"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(pdf["ids"].iat[0], np.int64)
        total = sum(np.frombuffer(v) for v in pdf.sort_values("tree")["votes"])
        return pd.DataFrame({"_row": ids, "votes": list(total.reshape(len(ids), -1))})

    numbered = written(state.withColumn("_row", F.monotonically_increasing_id()), "walked-rows")
    packed = written(nodes.select("tree", "node", "feature", "threshold", "left", "right", "stats").groupBy("tree").applyInPandas(
        pack, "tree int, " + ", ".join(f"{c} binary" for c in PACKED)), "walked-trees")
    blocks = written(numbered.select("_row", "_x").mapInArrow(block, "block long, ids binary, x binary"), "walked-blocks")
    nodes_of = F.length("left") / 4
    votes = (meeting(packed, blocks, nodes_of).mapInArrow(meet, "block long, tree int, ids binary, votes binary")
             .groupBy("block").applyInPandas(add, "_row long, votes array<double>"))
    return numbered.drop("_x").join(votes, "_row").select(*keys, "votes")


def meeting(trees: DataFrame, blocks: DataFrame, nodes_of: Column) -> DataFrame:
    """Every tree with every block, both written tables, in so many tasks that each has about
    ``MEETING_BYTES`` of them (or one tree), which bounds what it sends to Python at a time."""
    t = trees.agg(F.count(F.lit(1)).alias("n"), F.sum(nodes_of * 40).alias("bytes")).first()
    b = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("x") + F.length("ids")).alias("bytes")).first()
    tasks = ((t["bytes"] or 0) * b["n"] + (b["bytes"] or 0) * t["n"]) / MEETING_BYTES
    wanted = min(t["n"], math.ceil(tasks / max(1, blocks.rdd.getNumPartitions())))
    return (trees.repartition(wanted) if wanted > trees.rdd.getNumPartitions() else trees).crossJoin(blocks)


def merged_leaves(left: np.ndarray, right: np.ndarray, prediction: np.ndarray, leaf: np.ndarray, by_level: list[np.ndarray]) -> np.ndarray:
    """Which nodes are leaves once sibling leaves of one prediction are one, as MLlib has it."""
    leaf = leaf.copy()
    for at in reversed(by_level):
        at = at[~leaf[at]]
        a, b = left[at], right[at]
        leaf[at] = leaf[a] & leaf[b] & (prediction[a] == prediction[b])
    return leaf


def cut_shares(left: np.ndarray, right: np.ndarray, stats: np.ndarray, prediction: np.ndarray, cuts: list[int]) -> np.ndarray:
    """For every node of a tree (rows) and each depth of ``cuts`` (columns) the share of
    class 1 that rows on their way to this node meet where they stop in the tree cut there."""
    total = stats.sum(1)
    share = np.divide(stats[:, 1], total, out=np.zeros(len(total)), where=total != 0)
    by_level = [at for at, _ in levels(left, right, len(left))]
    shares = np.empty((len(left), len(cuts)))
    for j, cut in enumerate(cuts):
        leaf = left < 0
        for at in by_level[cut:cut + 1]:
            leaf[at] = True
        leaf = merged_leaves(left, right, prediction, leaf, by_level[:cut])
        stop = np.arange(len(left))  # the node at which a row on its way to this one stops
        for at in by_level:
            at = at[left[at] >= 0]
            for kids in (left[at], right[at]):
                stop[kids] = np.where(leaf[stop[at]], stop[at], kids)
        shares[:, j] = share[stop]
    return shares


def cut_leaves(nodes: DataFrame, cuts: list[int]) -> DataFrame:
    """(tree, leaf, shares): for every leaf of every tree (numbered from the left, as
    ``leafCol`` numbers them) the share of class 1 that its rows meet in the tree cut at
    each depth of ``cuts``. Of a cut tree, sibling leaves of one prediction become one, as
    MLlib has it."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, left, right = _tree(pdf)
        shares = cut_shares(left, right, np.stack(pdf["stats"].to_numpy()), pdf["prediction"].to_numpy(), cuts)[left < 0]
        return pd.DataFrame({"tree": pdf["tree"][0], "leaf": np.arange(len(shares)), "shares": list(shares)})

    return (nodes.select("tree", "node", "left", "right", "stats", "prediction").groupBy("tree")
            .applyInPandas(run, "tree int, leaf int, shares array<double>"))


def cut_scores(model, rows: DataFrame, points: list[tuple[int, int]], label: str = "label") -> DataFrame:
    """(point, label, score): every row's votes for class 1 in each of the forests
    ``points``, (number of first trees, depth of the cut), of one fitted forest. The
    leaf that a row reaches in every tree tells them all. ``rows`` must be a scan."""
    if hasattr(model, "trees_table"):
        return model.cut_scores(rows, points, label)
    cuts = sorted({depth for _, depth in points})
    nodes = forest_nodes(rows.sparkSession, model)
    leaves = cut_leaves(nodes, cuts)
    if model.totalNumNodes <= BROADCAST_NODES:
        leaves = F.broadcast(leaves)
    model = model.copy()
    model.setLeafCol("_leaf")
    # rows are numbered before they become a row for each tree; those stay in the row's
    # task, in the order of the trees, and are summed there
    numbered = model.transform(rows).select(F.monotonically_increasing_id().alias("_row"), F.col(label).alias("label"),
                                            vector_to_array(F.col("_leaf")).alias("_leaves"))
    reached = (numbered.select("_row", "label", F.posexplode("_leaves").alias("tree", "leaf"))
               .withColumn("leaf", F.col("leaf").cast("int")).join(leaves, ["tree", "leaf"]))
    sums = [F.sum(F.when(F.col("tree") < trees, F.col("shares")[cuts.index(depth)]).otherwise(0.0)) for trees, depth in points]
    scores = reached.groupBy("_row", "label").agg(F.array(*sums).alias("_s"))
    return scores.select(F.posexplode("_s").alias("point", "score"), "label").select("point", "label", "score")
