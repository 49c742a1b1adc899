"""Hard negatives by an inverted multi-index.

Every vector is cut into two halves; a codebook for each half sorts the rows into
cells (codeword of the first half, codeword of the second). For an anchor, a
half's score against any row of a codeword is at most its product with the
codeword plus its own length times the codeword's radius (the farthest row of the
index part). A heap merges the two sorted lists of half bounds and hands out
cells by falling sum. A search stops where the bound of the next cell certifies
that what it looks for is complete: the best rows of the anchor's label, or
the best rows of other labels inside each positive's window of scores.

Codebooks are fitted on a bounded sample and only decide the order of the
search: every row is in the index and the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm import blocks
from pixelmill.llm.blocks import against_all, packed, unpacked
from pixelmill.llm.common import multi_arange, written

SCALE = 256.0
#: Rows that the codebooks and first bounds are taken from, at most.
SAMPLE_ROWS = 4096
#: Codewords of each half.
CODEWORDS = 24
ROUNDS = 8
#: Rows whose scores are computed together while cells are visited.
TILE_ROWS = 512
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies within these percentages of its positive's.
LOW, HIGH = 50, 95
INDEX = {"cell": np.int64, "vec_id": np.int64, "label": np.int64}
ANCHORS = {"anchor": np.int64, "vec_id": np.int64, "label": np.int64}
#: The least id of ties: below it nothing is worse.
LAST = np.iinfo(np.int64).max


def labelled_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     label_col: str | Column = "label") -> DataFrame:
    """(vec_id, label, dim, v array<double>): the usable rows, components as
    floor(256 x). Null ids, null labels, null vectors and null or non-finite
    components take no part; rows that repeat id, label and vector are one."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"),
                          (vectors[label_col] if isinstance(label_col, str) else label_col).cast("long").alias("label"),
                          vectors[vector_col].cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
            .select("vec_id", "label", F.size("x").alias("dim"),
                    F.transform("x", lambda c: F.floor(c * SCALE).cast("double")).alias("v")).distinct())


def _codebook(rows: np.ndarray, codewords: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows."""
    distinct = np.unique(rows, axis=0)
    k = min(codewords, len(distinct))
    centres = distinct[np.linspace(0, len(distinct) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * rows @ centres.T, axis=1)


class Codebooks:
    """Per dimension the codewords of both halves, and the sample (first bounds)."""

    def __init__(self, sample: list[tuple[int, int, int, list[float]]]):
        self.halves: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sample: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim in {d for _, _, d, _ in sample}:
            own = [r for r in sample if r[2] == dim]
            rows = np.array([v for *_, v in own], np.float64).reshape(len(own), dim)
            self.halves[dim] = _codebook(rows[:, :dim // 2], CODEWORDS), _codebook(rows[:, dim // 2:], CODEWORDS)
            self.sample[dim] = np.array([i for i, *_ in own], np.int64), np.array([x for _, x, *_ in own], np.int64), rows

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Dimensions outside the sample have one codeword: the origin."""
        return self.halves.get(dim) or (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))

    def cells(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.of(rows.shape[1])
        cut = rows.shape[1] // 2
        return _nearest(rows[:, :cut], a) * len(b) + _nearest(rows[:, cut:], b)


def fit_codebooks(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Codebooks:
    """Codebooks of ``sample_rows`` rows, chosen by a hash of their content."""
    order = F.xxhash64("vec_id", "label", "v")
    return Codebooks([tuple(r) for r in rows.orderBy(order, "vec_id").limit(sample_rows)
                      .select("vec_id", "label", "dim", "v").collect()])


def build_index(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Packed parts of the index, each a run of neighbouring cells."""
    sent = rows.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                cell[at] = sent.value.cells(blocks.matrix(batch.column("v").take(pa.array(at))).reshape(len(at), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    celled = (rows.select("vec_id", "label", "dim", "v")
              .mapInArrow(run, "vec_id long, label long, dim int, v array<double>, cell long"))
    # a range may end inside a cell, so a hot cell is many parts
    return packed(celled.repartitionByRange("dim", "cell", "vec_id").sortWithinPartitions("dim", "cell", "vec_id"),
                  INDEX, blocks.PART_ROWS)


class Part:
    """The index rows of one dimension in a slot, by cell."""

    def __init__(self, rows: list[dict], codebooks: Codebooks):
        cell, ids, labels, vectors = (np.concatenate(c) for c in zip(*[unpacked(r, INDEX) for r in rows]))
        order = np.argsort(cell, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.books = codebooks.of(self.vectors.shape[1])
        self.cut = self.vectors.shape[1] // 2
        n_cells = len(self.books[0]) * len(self.books[1])
        self.starts = np.searchsorted(cell[order], np.arange(n_cells + 1))
        first, second = np.divmod(cell[order], len(self.books[1]))
        self.radii = []
        for words, code, half in ((self.books[0], first, self.vectors[:, :self.cut]), (self.books[1], second, self.vectors[:, self.cut:])):
            radius = np.full(len(words), -np.inf)  # a codeword without rows is never visited
            np.maximum.at(radius, code, np.sqrt(((half - words[code]) ** 2).sum(1)))
            self.radii.append(radius)

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """For each half the greatest score that a row of each codeword can have
        (with room for rounding)."""
        out = []
        for words, radius, half in zip(self.books, self.radii, (q[:self.cut], q[self.cut:])):
            length = np.sqrt(half @ half)
            dot = words @ half
            reach = np.where(np.isfinite(radius), radius, 0) * length
            out.append(np.where(np.isfinite(radius), dot + reach + 1e-9 * (np.abs(dot) + reach) + 1e-6, -np.inf))
        return out

    def visits(self, q: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) of every cell with rows, by falling bound: a heap over the
        first half's codewords, each with its place in the second half's list."""
        a, b = self.bounds(q)
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        u = [x for x in a[by_a].tolist() if x > -np.inf]
        w = [x for x in b[by_b].tolist() if x > -np.inf]
        by_a, by_b, width, starts = by_a.tolist(), by_b.tolist(), len(self.books[1]), self.starts
        heap = [(-(u[0] + w[0]), 0, 0)] if u and w else []
        while heap:
            least, i, j = heapq.heappop(heap)
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + w[0]), i + 1, 0))
            if j + 1 < len(w):
                heapq.heappush(heap, (-(u[i] + w[j + 1]), i, j + 1))
            cell = by_a[i] * width + by_b[j]
            if starts[cell + 1] > starts[cell]:
                yield -least, cell

    def scored(self, q: np.ndarray, needed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of cells by falling bound, some cells at a time, until
        ``needed(bound)`` says that no row of the next cell can matter."""
        cells: list[int] = []
        held = 0
        for bound, cell in self.visits(q):
            if not needed(bound):
                break
            cells.append(cell)
            held += self.starts[cell + 1] - self.starts[cell]
            if held >= TILE_ROWS:
                yield self._scores(q, cells)
                cells, held = [], 0
        if cells:
            yield self._scores(q, cells)

    def _scores(self, q: np.ndarray, cells: list[int]) -> tuple[np.ndarray, np.ndarray]:
        low = self.starts[cells]
        rows = multi_arange(low, self.starts[np.array(cells) + 1] - low)
        return rows, self.vectors[rows] @ q


class Best:
    """The ``k`` greatest (score, then smallest id), and the score that counts."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.score, self.id = np.empty(0), np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        use = score >= self.floor
        if use.any():
            s, i = np.concatenate([self.score, score[use]]), np.concatenate([self.id, ids[use]])
            first = np.lexsort((i, -s))[:self.k]
            self.score, self.id = s[first], i[first]
            if len(first) == self.k:
                self.floor = self.score[-1]


def _kth(scores: np.ndarray, k: int) -> float:
    """The k-th greatest of some rows: no result of all rows can end below it."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf


def _load(codebooks):
    def load(rows: list[dict]) -> dict[int, Part]:
        return {dim: Part([r for r in rows if r["dim"] == dim], codebooks.value) for dim in {r["dim"] for r in rows}}
    return load


def positives(index: DataFrame, anchors: DataFrame, codebooks: Codebooks, k: int = POSITIVES) -> DataFrame:
    """(anchor, place, positive_id, positive_score): per anchor its ``k`` best other
    rows of its label (all, if fewer), ties by smaller id; ``place`` from 1."""
    sent = index.sparkSession.sparkContext.broadcast(codebooks)

    def search(parts: dict[int, Part], block: dict) -> Iterator[pa.RecordBatch]:
        part = parts.get(block["dim"])
        if part is None:
            return
        number, ids, labels, vectors = unpacked(block, ANCHORS)
        s_ids, s_labels, s_rows = sent.value.sample.get(block["dim"], (ids[:0], labels[:0], vectors[:0]))
        out = []
        for at, q in enumerate(vectors):
            seed = _kth((s_rows @ q)[(s_labels == labels[at]) & (s_ids != ids[at])], k)
            best = Best(k, seed)
            for rows, scores in part.scored(q, lambda bound: bound >= best.floor):
                same = (part.labels[rows] == labels[at]) & (part.ids[rows] != ids[at])
                best.add(scores[same], part.ids[rows[same]])
            out.append((np.full(len(best.id), number[at]), best.id, best.score.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                         names=["anchor", "positive_id", "positive_score"])

    found = against_all(index, anchors, _load(sent), search, "anchor long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives_each: int = POSITIVES,
                   negatives_each: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per anchor and positive the first ``negatives_each`` rows of another label
    (all, if fewer) whose score is within ``low`` to ``high`` percent of the positive's:
    (anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score).

    Both inputs are tables of :func:`labelled_vectors`. Higher scores come first,
    ties go to the smaller id. A row never meets rows of its own id or of another
    dimension; different vectors or labels under one id are different rows, and
    each is searched if it is an anchor. Positives of negative score have no
    window. An empty table gives no rows; further columns are not read. Scores are
    exact while every product is below 2**53."""
    rows = written(rows, "vectors")
    codebooks = fit_codebooks(rows, sample_rows)
    index = written(build_index(rows, codebooks), "multi-index")
    anchors = written(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    ordered = anchors.repartitionByRange("dim", "anchor").sortWithinPartitions("dim", "anchor")
    blocks_of = written(packed(ordered, ANCHORS, blocks.QUERY_ROWS), "anchor-blocks")
    found = written(positives(index, blocks_of, codebooks, positives_each), "positives")

    # one query row per anchor and positive, those of an anchor side by side
    windows = (found.where("positive_score >= 0").select("anchor", F.col("place").cast("long").alias("place"), "positive_id", "positive_score")
               .join(anchors, "anchor"))
    keys = {"anchor": np.int64, "place": np.int64, "positive_id": np.int64, "positive_score": np.int64, "vec_id": np.int64, "label": np.int64}
    asked = packed(windows.repartitionByRange("dim", "anchor", "place").sortWithinPartitions("dim", "anchor", "place"), keys, blocks.QUERY_ROWS)
    sent = rows.sparkSession.sparkContext.broadcast(codebooks)

    def search(parts: dict[int, Part], block: dict) -> Iterator[pa.RecordBatch]:
        part = parts.get(block["dim"])
        if part is None:
            return
        number, place, pos_id, pos_score, ids, labels, vectors = unpacked(block, keys)
        least, most = -(-low * pos_score // 100), high * pos_score // 100
        s_ids, s_labels, s_rows = sent.value.sample.get(block["dim"], (ids[:0], labels[:0], vectors[:0]))
        out = []
        cuts = np.flatnonzero(np.diff(number)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)]):
            q = vectors[a]
            known = (s_rows @ q)[(s_labels != labels[a]) & (s_ids != ids[a])]
            wanted = []
            for w in range(a, b):
                inside = known[(known >= least[w]) & (known <= most[w])]
                wanted.append((w, Best(negatives_each, max(float(least[w]), _kth(inside, negatives_each)))))
            # the windows stop one by one; the search ends with the last
            for at, scores in part.scored(q, lambda bound: any(bound >= best.floor for _, best in wanted)):
                other = (part.labels[at] != labels[a]) & (part.ids[at] != ids[a])
                scores, at = scores[other], part.ids[at[other]]
                for w, best in wanted:
                    use = scores <= most[w]
                    best.add(scores[use], at[use])
            out += [(np.full(len(best.id), number[w]), np.full(len(best.id), place[w]), np.full(len(best.id), ids[w]),
                     np.full(len(best.id), pos_id[w]), np.full(len(best.id), pos_score[w]), best.id, best.score.astype(np.int64))
                    for w, best in wanted]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                             names=["anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    negatives = against_all(index, written(asked, "windows"), _load(sent), search,
                            "anchor long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    return (negatives.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives_each)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
