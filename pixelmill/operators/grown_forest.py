"""Random forests grown into a table, not into the driver.

MLlib's forest lives on the driver while it grows, when it is saved and when it scores, and
sends statistics of every open node there at each level. A forest that is grown to its end
has a tenth of a node for each row and tree, so 200 trees of depth 30 outgrow any driver.
Here a tree is a row of a table in the shared folder. The settings are
``RandomForestClassifier``'s and mean the same: up to ``maxBins`` bins a feature, cut by a
sample of 10,000 rows, Poisson bags, some of the features tried at each node, the split
of the greatest gain in Gini impurity, leaves of at least ``minInstancesPerNode`` rows, sibling leaves
of one prediction made one. The draws are others.

Rows are packed into blocks of one byte a feature. A node of more than ``LOCAL_BYTES`` of
them is split by histograms, summed in every task and then over tasks, all trees at once.
What is below that goes as a whole to one task, which grows the rest of the tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.forest import cut_shares, levels, meeting, merged_leaves
from pixelmill.session import scratch_path

#: Packed rows of a node that one task holds, at most, to grow what is below it.
LOCAL_BYTES = 16 << 20
#: Nodes whose histograms a task holds at a time (8 KB each for 64 features): those that
#: are split by all tasks together, and those of a level of one tree.
NODES_AT_A_TIME = 1024
#: Rows by which features are cut into bins, as many as MLlib takes.
SAMPLE_ROWS = 10_000
BLOCK_ROWS = 10_000
BLOCKS = "block long, n int, ids binary, x binary, y binary, w binary"
TREES = ("tree int, feature array<int>, bin array<int>, threshold array<double>, left array<int>, right array<int>, "
         "s0 array<double>, s1 array<double>, n array<long>")
ARRAYS = ["feature", "bin", "left", "right", "s0", "s1", "n"]


def bin_edges(rows: DataFrame, bins: int, seed: int) -> np.ndarray:
    """The values that cut each feature of ``rows`` (x: array) into ``bins`` bins, as a matrix
    with a row for each feature; infinite where it has fewer values."""
    n = rows.count()
    if not n:
        raise ValueError("no rows to grow a forest on")
    some = rows if n <= SAMPLE_ROWS else rows.sample(SAMPLE_ROWS / n, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in batches if b.num_rows]
        if not parts:
            return
        x = np.concatenate(parts)
        out = np.full((x.shape[1], bins - 1), np.inf)
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            cuts = (values[1:] + values[:-1]) / 2 if len(values) <= bins else np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins))
            out[j, :len(cuts)] = cuts
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["e"])

    found = some.select("x").repartition(1).mapInArrow(run, "e binary").first()
    if found is None:  # a sample of few rows may be empty
        return bin_edges(rows.limit(SAMPLE_ROWS), bins, seed)
    return np.frombuffer(found["e"]).reshape(-1, bins - 1)


def pack(rows: DataFrame, edges: np.ndarray, name: str) -> DataFrame:
    """``rows`` (id, x, y, w) as ``BLOCKS`` of up to ``BLOCK_ROWS`` rows, written to the shared
    folder: of each feature the number of its bin, so that x <= edges[bin] and bin <= its bin
    say the same."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "y", "w"))
            if not len(ids):
                continue
            if not np.isin(y, (0, 1)).all():
                raise ValueError("a grown forest tells labels 0 and 1 apart")
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            binned = np.stack([np.searchsorted(e, v) for e, v in zip(edges, x.T)], 1).astype(np.uint8 if edges.shape[1] < 256 else np.uint16)
            for at in range(0, len(ids), BLOCK_ROWS):
                own = slice(at, at + BLOCK_ROWS)
                packed = [ids[own].astype(np.int64), binned[own], y[own].astype(np.uint8), w[own].astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[at])], pa.int64()), pa.array([len(packed[0])], pa.int32()),
                                                  *[pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in packed]],
                                                 names=["block", "n", "ids", "x", "y", "w"])

    path = scratch_path(rows.sparkSession, name)
    rows.mapInArrow(run, BLOCKS).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _unpacked(r, edges_of: int) -> tuple[np.ndarray, ...]:
    """ids, x, y, w of one block."""
    ids = np.frombuffer(r["ids"], np.int64)
    x = np.frombuffer(r["x"], np.uint8 if edges_of < 256 else np.uint16).reshape(len(ids), -1)
    return ids, x, np.frombuffer(r["y"], np.uint8), np.frombuffer(r["w"], np.float64)


def bag(ids: np.ndarray, tree: int, seed: int, rate: float) -> np.ndarray:
    """How often a tree draws each row: a Poisson number of mean ``rate`` by a hash of tree
    and row (splitmix64), the same wherever and however often it is asked for."""
    mask = (1 << 64) - 1
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + (tree + 1) * 0x8CB92BA72F3D8DD7) & mask)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    upto, term = [math.exp(-rate)], math.exp(-rate)
    while upto[-1] < 1 - 1e-15 and len(upto) < 200:
        term *= rate / len(upto)
        upto.append(upto[-1] + term)
    return np.searchsorted(np.array(upto), u, side="right")


class Growth:
    """What all nodes of a forest have in common."""

    def __init__(self, edges: np.ndarray, tried: int, depth: int, least: int, least_gain: float, seed: int, rate: float | None):
        self.edges, self.tried, self.depth, self.least, self.least_gain, self.seed, self.rate = edges, tried, depth, least, least_gain, seed, rate
        self.bins = edges.shape[1] + 1

    def counts(self, ids: np.ndarray, tree: int) -> np.ndarray:
        return np.ones(len(ids), np.int64) if self.rate is None else bag(ids, tree, self.seed, self.rate)

    def features(self, tree: int, node: int, size: int) -> np.ndarray:
        """The features tried at ``size`` nodes, those of a level from ``node`` on."""
        d = len(self.edges)
        if self.tried >= d:
            return np.tile(np.arange(d), (size, 1))
        drawn = np.random.default_rng([self.seed & 0xFFFFFFFF, tree, node]).random((size, d))
        return np.argpartition(drawn, self.tried - 1, axis=1)[:, :self.tried]

    def histograms(self, x, rows, y, c, w, at, tried, same=None) -> np.ndarray:
        """(2, classes, nodes, features tried, bins): how many of the rows are in each bin, and
        their weight. ``at`` is the node of each of ``rows``; ``same`` is the weight of all rows of
        each class, if they share one."""
        size, k = tried.shape
        span = size * k * self.bins
        cell = ((at * k * self.bins + y * span)[:, None] + np.arange(k) * self.bins + x[rows[:, None], tried[at]]).ravel()
        counted = lambda v: np.bincount(cell, np.repeat(v, k), 2 * span).reshape(2, size, k, self.bins)
        n = counted(c)
        return np.stack([n, counted(w * c) if same is None else n * same[:, None, None, None]])

    def best(self, h: np.ndarray, tried: np.ndarray) -> dict[str, np.ndarray]:
        """The best split of each node by its histograms: feature (negative for none), bin,
        and counts and weights (of each class) of the node and of its left child."""
        (n, w), (left_n, left_w) = h[:, :, :, 0].sum(3), h.cumsum(4)[..., :-1]
        below = left_n[0] + left_n[1]
        ok = (below >= self.least) & ((n[0] + n[1])[:, None, None] - below >= self.least)
        rest = w[:, :, None, None] - left_w
        with np.errstate(divide="ignore", invalid="ignore"):
            score = sum((v[0] ** 2 + v[1] ** 2) / (v[0] + v[1]) for v in (left_w, rest))
            score = np.where(ok & np.isfinite(score), score, -np.inf).reshape(n.shape[1], -1)
            i, at, all_w = np.arange(len(score)), score.argmax(1), w[0] + w[1]
            gain = (score[i, at] - (w[0] ** 2 + w[1] ** 2) / all_w) / all_w
        good = (gain > 0) & (gain >= self.least_gain)
        k, b = np.divmod(at, self.bins - 1)
        return {"feature": np.where(good, tried[i, k], -1), "bin": np.where(good, b, -1), "n": n.T, "w": w.T, "left_n": left_n[:, i, k, b].T, "left_w": left_w[:, i, k, b].T}

    def open(self, n: np.ndarray, depth) -> np.ndarray:
        """Whether nodes of ``n`` (rows of each class) may be split at all."""
        return (n.min(1) > 0) & (n.sum(1) >= 2 * self.least) & (np.asarray(depth) < self.depth)

    def grow(self, x, y, w, c, tree: int, root: int = 0, depth: int = 0) -> dict[str, np.ndarray]:
        """The tree below a node at ``depth``, ``ARRAYS`` by node: rows ``x`` (bins), drawn ``c``
        times. Level by level, for all nodes of a level at once."""
        rows = np.flatnonzero(c)
        y, w, c = y[rows].astype(np.int64), w[rows], c[rows].astype(np.float64)
        at, done, total = np.zeros(len(rows), np.int64), [], 1
        n, s = (np.bincount(y, v, 2)[None] for v in (c, w * c))
        each = [np.unique(w[y == k]) for k in (0, 1)]
        same = np.array([v[0] for v in each]) if all(len(v) == 1 for v in each) else None
        while True:
            size = len(n)
            node = {name: np.full(size, -1, np.int64) for name in ("feature", "bin", "left", "right")} | {"n": n, "w": s}
            done.append(node)
            wanted = np.flatnonzero(self.open(n, depth))
            if not len(wanted):
                break
            rank = np.full(size, -1)
            rank[wanted] = np.arange(len(wanted))
            rank = rank[at]
            rows, y, w, c, at = (v[rank >= 0] for v in (rows, y, w, c, rank))
            tried, found = self.features(tree, root + total, len(wanted)), []
            for i in range(0, len(wanted), NODES_AT_A_TIME):  # rows are in the order of their nodes
                own = slice(*np.searchsorted(at, (i, i + NODES_AT_A_TIME)))
                some = tried[i:i + NODES_AT_A_TIME]
                found.append(self.best(self.histograms(x, rows[own], y[own], c[own], w[own], at[own] - i, some, same), some))
            got = {name: np.concatenate([f[name] for f in found]) for name in found[0]}
            split = got["feature"] >= 0
            inner, kids = wanted[split], total + 2 * np.arange(split.sum())
            for name, v in (("feature", got["feature"][split]), ("bin", got["bin"][split]), ("left", kids), ("right", kids + 1)):
                node[name][inner] = v
            if not len(inner):
                break
            n, s = children(got, split)
            goes = 2 * (np.cumsum(split) - 1)[at] + (x[rows, got["feature"][at]] > got["bin"][at])
            order = np.flatnonzero(split[at])
            order = order[np.argsort(goes[order], kind="stable")]
            rows, y, w, c, at = (v[order] for v in (rows, y, w, c, goes))
            total, depth = total + 2 * len(inner), depth + 1
        out = {name: np.concatenate([d[name] for d in done]) for name in done[0]}
        return {k: out[k] for k in ("feature", "bin", "left", "right")} | {"s0": out["w"][:, 0], "s1": out["w"][:, 1], "n": out["n"].sum(1).astype(np.int64)}


def children(got: dict, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and weights of the children of the nodes ``split``, left and right in turn."""
    n = np.stack([got["left_n"], got["n"] - got["left_n"]], 1)[split].reshape(-1, 2)
    w = np.stack([got["left_w"], got["w"] - got["left_w"]], 1)[split].reshape(-1, 2)
    return n, np.where(n > 0, w, 0.0)


def _walked(x: np.ndarray, feature, bins, left, right) -> np.ndarray:
    """The leaf that each row of bins reaches."""
    end, rows, at = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(rows):
        going = left[at] >= 0
        end[rows[~going]] = at[~going]
        rows, at = rows[going], at[going]
        at = np.where(x[rows, feature[at]] <= bins[at], left[at], right[at])
    return end


def _tree_row(tree: int, t: dict, edges: np.ndarray) -> dict:
    """A row of ``TREES``: sibling leaves of one prediction are one, nodes numbered anew."""
    left, right = t["left"], t["right"]
    by_level = [at for at, _ in levels(left, right, len(left))]
    leaf = merged_leaves(left, right, (t["s1"] > t["s0"]).astype(float), left < 0, by_level)
    alive = np.zeros(len(left), bool)
    alive[0] = True
    for at in by_level:
        at = at[alive[at] & ~leaf[at]]
        alive[left[at]] = alive[right[at]] = True
    new = np.cumsum(alive) - 1
    t = t | {name: np.where(leaf, -1, new[t[name]] if name in ("left", "right") else t[name]) for name in ("feature", "bin", "left", "right")}
    t = {name: v[alive] for name, v in t.items()}
    inner = t["feature"] >= 0
    threshold = np.where(inner, edges[t["feature"], t["bin"]], np.nan)
    ints = {name: t[name].astype(np.int32) for name in ("feature", "bin", "left", "right")}
    return {"tree": tree, "feature": ints["feature"], "bin": ints["bin"], "threshold": threshold, "left": ints["left"], "right": ints["right"],
            "s0": t["s0"], "s1": t["s1"], "n": t["n"]}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["tree", "feature", "bin", "threshold", "left", "right", "s0", "s1", "n"])


def _grown_whole(blocks: DataFrame, growth: Growth, trees: int) -> DataFrame:
    """The trees of a table of up to ``LOCAL_BYTES``: it is broadcast, and each task grows some."""
    spark, width = blocks.sparkSession, growth.bins - 1
    tasks = min(trees, 2 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                own.setdefault(r["id"], []).append((r["block"], _unpacked(r, width)))
        for first, parts in own.items():
            ids, x, y, w = (np.concatenate(v) for v in zip(*(p for _, p in sorted(parts, key=lambda p: p[0]))))
            for tree in range(first, trees, tasks):
                row = _tree_row(tree, growth.grow(x, y, w, growth.counts(ids, tree), tree), growth.edges)
                yield _record(row)

    return spark.range(0, tasks, 1, tasks).crossJoin(F.broadcast(blocks)).mapInArrow(run, TREES)


def _record(row: dict) -> pa.RecordBatch:
    kinds = {"feature": pa.int32(), "bin": pa.int32(), "left": pa.int32(), "right": pa.int32(), "n": pa.int64()}
    arrays = [pa.array([row["tree"]], pa.int32())] + [pa.array([v], pa.list_(kinds.get(k, pa.float64()))) for k, v in row.items() if k != "tree"]
    return pa.RecordBatch.from_arrays(arrays, names=list(row))


class _Tops:
    """The large nodes of all trees and their children: on the driver and in its tasks.
    There are about ``trees`` * bytes of the table / ``LOCAL_BYTES`` of them."""

    def __init__(self, trees: int):
        self.t = [{"feature": [-1], "bin": [-1], "left": [-1], "right": [-1], "s0": [0.0], "s1": [0.0], "n": [0], "depth": [0], "below": [False]} for _ in range(trees)]

    def add(self, tree: int, node: int, feature: int, bins: int, n: np.ndarray, w: np.ndarray, depth: int) -> list[int]:
        """Splits a node; its children."""
        t, first = self.t[tree], len(self.t[tree]["n"])
        t["feature"][node], t["bin"][node], t["left"][node], t["right"][node] = feature, bins, first, first + 1
        for i in range(2):
            for name, v in (("feature", -1), ("bin", -1), ("left", -1), ("right", -1), ("s0", w[i, 0]), ("s1", w[i, 1]), ("n", int(n[i].sum())), ("depth", depth + 1), ("below", False)):
                t[name].append(v)
        return [first, first + 1]

    def arrays(self, tree: int) -> dict[str, np.ndarray]:
        return {name: np.array(v) for name, v in self.t[tree].items()}


def _drawn(r, growth: Growth, tops: list[dict]) -> Iterator[tuple]:
    """For every tree the rows of a block that it draws, and the node of the top they are in."""
    ids, x, y, w = _unpacked(r, growth.bins - 1)
    for tree, top in enumerate(tops):
        c = growth.counts(ids, tree)
        rows = np.flatnonzero(c)
        yield tree, ids, x, y, w, c, rows, _walked(x[rows], top["feature"], top["bin"], top["left"], top["right"])


def _grown_by_levels(blocks: DataFrame, growth: Growth, trees: int, row_bytes: int) -> DataFrame:
    """The trees of a larger table: its large nodes are split by sums over all tasks, level by
    level; the rows of every other node meet in a task that grows what is below."""
    tops, depth = _Tops(trees), 0
    large = [(t, 0) for t in range(trees)]
    while large and depth < growth.depth:
        after = []
        for i in range(0, len(large), NODES_AT_A_TIME):
            some = large[i:i + NODES_AT_A_TIME]
            for r in _splits(blocks, growth, [tops.arrays(t) for t in range(trees)], some).collect():
                tree, node = r["tree"], r["node"]
                n, w, left_n, left_w = (np.array(r[k]) for k in ("n", "w", "left_n", "left_w"))
                own = tops.t[tree]
                own["s0"][node], own["s1"][node], own["n"][node] = float(w[0]), float(w[1]), int(n.sum())
                if r["feature"] < 0:
                    continue
                kid_n = np.stack([left_n, n - left_n])
                kid_w = np.where(kid_n > 0, np.stack([left_w, w - left_w]), 0.0)
                for i_kid, kid in enumerate(tops.add(tree, node, r["feature"], r["bin"], kid_n, kid_w, depth)):
                    if growth.open(kid_n[i_kid:i_kid + 1], depth + 1)[0]:
                        if kid_n[i_kid].sum() * row_bytes > LOCAL_BYTES:
                            after.append((tree, kid))
                        else:
                            own["below"][kid] = True
        large, depth = after, depth + 1
    return _finished(blocks, growth, [tops.arrays(t) for t in range(trees)])


def _splits(blocks: DataFrame, growth: Growth, tops: list[dict], some: list[tuple[int, int]]) -> DataFrame:
    """The best splits of the nodes ``some``: a row each."""
    by_tree: dict[int, list[int]] = {}
    for tree, node in some:
        by_tree.setdefault(tree, []).append(node)
    tried = {(t, n): growth.features(t, n, 1) for t, n in some}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                for tree, _, x, y, w, c, rows, at in _drawn(r, growth, tops):
                    if tree not in by_tree:
                        continue
                    slot = np.full(len(tops[tree]["left"]), -1)
                    slot[by_tree[tree]] = np.arange(len(by_tree[tree]))
                    rows, at = rows[slot[at] >= 0], slot[at][slot[at] >= 0]
                    own = np.concatenate([tried[tree, n] for n in by_tree[tree]])
                    h = growth.histograms(x, rows, y[rows].astype(np.int64), c[rows].astype(np.float64), w[rows], at, own)
                    sums[tree] = sums[tree] + h if tree in sums else h
        for tree, h in sums.items():
            for i, node in enumerate(by_tree[tree]):
                yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([node], pa.int32()),
                                                  pa.array([np.ascontiguousarray(h[:, :, i]).tobytes()], pa.binary())], names=["tree", "node", "h"])

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        own = tried[int(pdf["tree"].iat[0]), int(pdf["node"].iat[0])]
        h = sum(np.frombuffer(b) for b in pdf["h"]).reshape(2, 2, 1, own.shape[1], growth.bins)
        got = growth.best(h, own)
        row = {"tree": pdf["tree"].iat[0], "node": pdf["node"].iat[0], "feature": int(got["feature"][0]), "bin": int(got["bin"][0])}
        return pd.DataFrame([row | {k: got[k][0].tolist() for k in ("n", "w", "left_n", "left_w")}])

    fields = "tree int, node int, feature int, bin int, n array<double>, w array<double>, left_n array<double>, left_w array<double>"
    return blocks.mapInArrow(add, "tree int, node int, h binary").groupBy("tree", "node").applyInPandas(best, fields)


def _finished(blocks: DataFrame, growth: Growth, tops: list[dict]) -> DataFrame:
    """The trees: their tops, and below them what the rows of each node give."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for tree, ids, x, y, w, c, rows, at in _drawn(r, growth, tops):
                    rows, at = rows[tops[tree]["below"][at]], at[tops[tree]["below"][at]]
                    for node in np.unique(at):
                        own = rows[at == node]
                        packed = [np.ascontiguousarray(v[own]).tobytes() for v in (ids, x, y, w)]
                        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([int(node)], pa.int32()), pa.array([int(ids[own[0]])], pa.int64()),
                                                          *[pa.array([p], pa.binary()) for p in packed]], names=["tree", "node", "block", "ids", "x", "y", "w"])

    part = "tree int, node int, " + ", ".join(f"{k} array<{'double' if k[0] == 's' else 'long'}>" for k in ARRAYS)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(pdf["tree"].iat[0]), int(pdf["node"].iat[0])
        ids, x, y, w = (np.concatenate(v) for v in zip(*(_unpacked(r, growth.bins - 1) for r in pdf.sort_values("block").to_dict("records"))))
        got = growth.grow(x, y, w, growth.counts(ids, tree), tree, root=node << 32, depth=int(tops[tree]["depth"][node]))
        return pd.DataFrame([{"tree": tree, "node": node} | {k: got[k] for k in ARRAYS}])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iat[0])
        out = {k: [tops[tree][k].astype(np.float64 if k[0] == "s" else np.int64)] for k in ARRAYS}
        size = len(tops[tree]["n"])
        for r in pdf[pdf["node"] >= 0].sort_values("node").to_dict("records"):
            # the root of what is below takes the place of the node, the others follow
            for k in ARRAYS:
                v = np.asarray(r[k])
                if k in ("left", "right"):
                    v = np.where(v > 0, v + size - 1, -1)
                out[k][0][r["node"]] = v[0]
                out[k].append(v[1:])
            size += len(r["n"]) - 1
        return _frame([_tree_row(tree, {k: np.concatenate(v) for k, v in out.items()}, growth.edges)])

    below = (blocks.mapInArrow(deal, "tree int, node int, block long, ids binary, x binary, y binary, w binary")
             .groupBy("tree", "node").applyInPandas(grow, part))
    nulls = [F.lit(None).cast(f"array<{'double' if k[0] == 's' else 'long'}>").alias(k) for k in ARRAYS]
    every = blocks.sparkSession.range(len(tops)).select(F.col("id").cast("int").alias("tree"), F.lit(-1).alias("node"), *nulls)
    return below.unionByName(every).groupBy("tree").applyInPandas(whole, TREES)


def summed_votes(trees: DataFrame, blocks: DataFrame, points: list[tuple[int, int]], width: int) -> DataFrame:
    """(block, ids, y, votes): of every block the votes of class 1 at each of ``points``,
    (number of first trees, depth of the cut). Trees meet blocks in tasks, which add up
    what their own trees say."""
    cuts = sorted({depth for _, depth in points})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                if (tree := batch.column("tree")[i].as_py()) != last:
                    last = tree
                    feature, bins, left, right, s0, s1 = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in ("feature", "bin", "left", "right", "s0", "s1"))
                    shares = cut_shares(left, right, np.stack([s0, s1], 1), (s1 > s0).astype(float), cuts)
                r = {k: batch.column(k)[i].as_py() for k in ("block", "ids", "x", "y")}
                x = np.frombuffer(r["x"], np.uint8 if width < 256 else np.uint16).reshape(len(r["y"]), -1)
                if r["block"] not in sums:
                    sums[r["block"]] = (r["ids"], r["y"], np.zeros((len(points), len(x))))
                got = shares[_walked(x, feature, bins, left, right)]
                for j, (first, depth) in enumerate(points):
                    if tree < first:
                        sums[r["block"]][2][j] += got[:, cuts.index(depth)]
        for block, (ids, y, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([v], pa.binary()) for v in (ids, y, total.tobytes())]],
                                             names=["block", "ids", "y", "votes"])

    pairs = meeting(trees.drop("threshold", "n"), blocks.drop("n", "w"), F.size("left"))
    return pairs.mapInArrow(run, "block long, ids binary, y binary, votes binary")


def _by_block(votes: DataFrame, points: int, fields: str, out) -> DataFrame:
    """What ``out`` makes of a block's ids, labels and summed votes (points, rows)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in pdf["votes"]).reshape(points, -1)
        return out(np.frombuffer(pdf["ids"].iat[0], np.int64), np.frombuffer(pdf["y"].iat[0], np.uint8), total)

    return votes.groupBy("block").applyInPandas(run, fields)


class GrownForestModel(Model, HasFeaturesCol, HasRawPredictionCol, HasProbabilityCol, HasPredictionCol):
    """A forest whose trees are the rows (``TREES``) of a table in the shared folder."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level of a tree", TypeConverters.toInt)

    def __init__(self, spark, path: str, edges: np.ndarray, settings: dict):
        super().__init__()
        self.spark, self.path, self.edges = spark, path, edges
        self._set(**settings)

    @property
    def getNumTrees(self) -> int:
        return self.getOrDefault("numTrees")

    def trees_table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def nodes(self) -> DataFrame:
        """The rows of :func:`pixelmill.operators.forest.forest_nodes`."""
        each = F.posexplode(F.arrays_zip("feature", "threshold", "left", "right", "s0", "s1", "n")).alias("node", "v")
        inner = F.col("v.left") >= 0
        of = lambda name: F.when(inner, F.col(f"v.{name}")).alias(name)
        return self.trees_table().select("tree", each).select(
            "tree", "node", *[of(c) for c in ("feature", "threshold", "left", "right")], F.array("v.s0", "v.s1").alias("stats"), F.col("v.n").alias("n"),
            F.when(F.col("v.s1") > F.col("v.s0"), 1.0).otherwise(0.0).alias("prediction"))

    def _blocks(self, rows: DataFrame, label, number) -> DataFrame:
        x = vector_to_array(F.col(self.getOrDefault("featuresCol")))
        src = rows.select(number.alias("id"), x.alias("x"), label.cast("double").alias("y"), F.lit(1.0).alias("w"))
        return pack(src, self.edges, "forest-scored")

    def cut_scores(self, rows: DataFrame, points: list[tuple[int, int]], label: str) -> DataFrame:
        """:func:`pixelmill.operators.forest.cut_scores` of this forest."""
        blocks = self._blocks(rows, F.col(label), F.monotonically_increasing_id())
        votes = summed_votes(self.trees_table(), blocks, points, self.edges.shape[1])

        def out(ids, y, total):
            return pd.DataFrame({"point": np.repeat(np.arange(len(points), dtype=np.int32), len(ids)), "label": np.tile(y, len(points)).astype(np.int32), "score": total.ravel()})

        return _by_block(votes, len(points), "point int, label int, score double", out)

    def _transform(self, rows: DataFrame) -> DataFrame:
        """Numbers the rows in a table of its own, which the votes are joined to."""
        path = scratch_path(self.spark, "numbered")
        rows.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
        numbered = self.spark.read.parquet(path)
        blocks = self._blocks(numbered, F.lit(0), F.col("_row"))
        trees = self.getNumTrees
        votes = summed_votes(self.trees_table(), blocks, [(trees, self.getOrDefault("maxDepth"))], self.edges.shape[1])
        scored = scratch_path(self.spark, "votes")
        _by_block(votes, 1, "_row long, _v double", lambda ids, y, total: pd.DataFrame({"_row": ids, "_v": total[0]})).write.parquet(scored)
        one = F.col("_v")
        raw, share = F.array(F.lit(float(trees)) - one, one), F.array(1 - one / trees, one / trees)
        return (numbered.join(self.spark.read.parquet(scored), "_row")
                .withColumn(self.getOrDefault("rawPredictionCol"), array_to_vector(raw)).withColumn(self.getOrDefault("probabilityCol"), array_to_vector(share))
                .withColumn(self.getOrDefault("predictionCol"), F.when(one > float(trees) - one, 1.0).otherwise(0.0)).drop("_row", "_v"))


class GrownForestClassifier(RandomForestClassifier):
    """``RandomForestClassifier`` for labels 0 and 1 whose forest is a table."""

    @classmethod
    def like(cls, stage: RandomForestClassifier) -> GrownForestClassifier:
        """With the settings of ``stage``."""
        return stage._copyValues(cls())

    def _tried(self, features: int) -> int:
        how = self.getOrDefault("featureSubsetStrategy")
        if how == "auto":
            how = "all" if self.getOrDefault("numTrees") == 1 else "sqrt"
        known = {"all": features, "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))), "onethird": math.ceil(features / 3)}
        if how in known:
            return known[how]
        return min(features, int(how)) if how.isdigit() else max(1, math.ceil(float(how) * features))

    def _fit(self, rows: DataFrame) -> GrownForestModel:
        get = self.getOrDefault
        if get("impurity") != "gini" or get("minWeightFractionPerNode") or self.isDefined("thresholds") or not get("bootstrap") and get("subsamplingRate") < 1:
            raise ValueError("a forest is grown into a table by Gini impurity, from bags or all rows, without thresholds or a least weight of a node")
        spark, weight = rows.sparkSession, self.isDefined("weightCol") and get("weightCol")
        src = rows.select(F.monotonically_increasing_id().alias("id"), vector_to_array(F.col(get("featuresCol"))).alias("x"),
                          F.col(get("labelCol")).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
        edges = bin_edges(src, get("maxBins"), get("seed"))
        blocks = pack(src, edges, "forest-rows")
        row_bytes = len(edges) * (1 if edges.shape[1] < 256 else 2) + 17
        growth = Growth(edges, self._tried(len(edges)), get("maxDepth"), get("minInstancesPerNode"), get("minInfoGain"), get("seed"),
                        get("subsamplingRate") if get("bootstrap") else None)
        n = blocks.agg(F.sum("n")).first()[0]
        path = scratch_path(spark, "grown")
        grown = _grown_whole(blocks, growth, get("numTrees")) if n * row_bytes <= LOCAL_BYTES else _grown_by_levels(blocks, growth, get("numTrees"), row_bytes)
        grown.write.parquet(path)
        names = ("featuresCol", "rawPredictionCol", "probabilityCol", "predictionCol", "numTrees", "maxDepth")
        return GrownForestModel(spark, path, edges, {name: get(name) for name in names})
