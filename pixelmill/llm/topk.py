"""Exact top-k search by inner product, pruned block by block.

Vectors become integers floor(256 x). The index holds, for every block of
neighbouring ids, its forward index (the block's vectors) and the greatest and
least value of every term (vector component). For a query, the sum of each
term's best product bounds every score in a block; blocks are scored in order
of falling bound until the bound of the next is below the k-th score found.

A sample of rows gives every query a first bound: no k-th score of all rows is below
the k-th of some. So a task starts with a threshold that holds everywhere, and
sends on only what reaches it. Queries are a table, packed into blocks that meet
every part of the index (:mod:`pixelmill.llm.blocks`): the plan is the same for
any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.blocks import against_all, packed, unpacked
from pixelmill.llm.common import written

SCALE = 256.0
BLOCK_ROWS = 128
#: Vectors that one index row (a run of neighbouring blocks) holds at most.
SHARD_ROWS = 4096
#: Queries searched at a time, at most.
QUERY_BATCH = 1024
#: Rows that the first bounds are taken from, at most.
SAMPLE_ROWS = 4096
INDEX = {"vec_id": np.int64}
QUERIES = {"query": np.int64, "vec_id": np.int64}


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): the usable vectors in whole numbers, one row
    for each different (id, vector). Null vectors, null or non-finite components
    and null ids take no part."""
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
            .select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("double")).alias("v")).distinct())


def build_index(rows: DataFrame) -> DataFrame:
    """Index rows (dim, n, vec_id, vectors): up to ``SHARD_ROWS`` neighbouring ids of one
    dimension, packed."""
    return packed(rows.withColumn("dim", F.size("v")).repartitionByRange("dim", "vec_id").sortWithinPartitions("dim", "vec_id"),
                  INDEX, SHARD_ROWS)


class Shard:
    """The index rows of one dimension that a task holds, in blocks."""

    def __init__(self, rows: list[dict]):
        self.ids, self.rows = (np.concatenate(c) for c in zip(*[unpacked(r, INDEX) for r in rows]))
        self.starts = np.arange(0, len(self.ids), BLOCK_ROWS)
        self.high = np.maximum.reduceat(self.rows, self.starts, axis=0)
        self.low = np.minimum.reduceat(self.rows, self.starts, axis=0)

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        """The k best rows for every query that reach its ``floor``: (query index, row
        id, score)."""
        # sum over terms of the largest product that a block allows
        bound = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        best_s = np.full((len(q), k), -np.inf)
        best_i = np.full((len(q), k), np.iinfo(np.int64).max)
        alive = np.arange(len(q))
        for step in range(len(self.starts)):
            at = order[alive, step]
            # a block whose bound equals the k-th score may still hold a smaller id
            go = bound[alive, at] >= np.maximum(best_s[alive, -1], floor[alive])
            alive, at = alive[go], at[go]
            if not len(alive):
                break
            for b in np.unique(at):
                who = alive[at == b]
                block = slice(self.starts[b], min(self.starts[b] + BLOCK_ROWS, len(self.ids)))
                scores = q[who] @ self.rows[block].T
                scores[q_ids[who][:, None] == self.ids[block][None, :]] = -np.inf
                s = np.concatenate([best_s[who], scores], axis=1)
                i = np.concatenate([best_i[who], np.broadcast_to(self.ids[block], scores.shape)], axis=1)
                first = np.lexsort((i, -s), axis=1)[:, :k]
                best_s[who] = np.take_along_axis(s, first, 1)
                best_i[who] = np.take_along_axis(i, first, 1)
        found = np.argwhere((best_s > -np.inf) & (best_s >= floor[:, None]))
        return found[:, 0], best_i[found[:, 0], found[:, 1]], best_s[found[:, 0], found[:, 1]]


def sample_of(vectors: DataFrame, sample_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dimension: (ids, vectors)} of ``sample_rows`` rows at most, by a hash of their
    content."""
    rows = (vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample_rows).select("vec_id", "v").collect())
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r["v"]), []).append(r)
    return {d: (np.array([r["vec_id"] for r in own], np.int64), np.array([r["v"] for r in own], np.float64).reshape(len(own), d))
            for d, own in by_dim.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per query the ``k`` rows of highest inner product (all, if fewer), without
    its own: (query_id, rank from 1, vec_id, score). Ties go to the smaller id.

    Both inputs are tables of :func:`integer_vectors`; other columns are not read. Rows
    that repeat id and vector count once; different vectors under one id are each
    searched (and searched for), none of them finding its own id. A query only
    meets vectors of its dimension; empty vectors score 0. An empty table gives no
    rows. Scores are exact while every inner product is below 2**53."""
    vectors = written(vectors.select("vec_id", "v"), "topk-vectors")
    index = written(build_index(vectors), "topk-index")
    sent = vectors.sparkSession.sparkContext.broadcast(sample_of(vectors, sample_rows))
    numbered = written(queries.select("vec_id", "v").withColumn("dim", F.size("v")).withColumn("query", F.monotonically_increasing_id()), "topk-queries")
    blocks = written(packed(numbered.repartitionByRange("dim", "query").sortWithinPartitions("dim", "query"), QUERIES, QUERY_BATCH), "query-blocks")

    def load(rows: list[dict]) -> dict[int, Shard]:
        return {dim: Shard([r for r in rows if r["dim"] == dim]) for dim in {r["dim"] for r in rows}}

    def search(shards: dict[int, Shard], block: dict) -> Iterator[pa.RecordBatch]:
        shard = shards.get(block["dim"])
        if shard is None:
            return
        number, ids, q = unpacked(block, QUERIES)
        s_ids, s_rows = sent.value.get(block["dim"], (ids[:0], q[:0]))
        floor = np.full(len(q), -np.inf)
        if len(s_ids) > k:
            known = q @ s_rows.T
            known[ids[:, None] == s_ids[None, :]] = -np.inf
            floor = np.partition(known, len(s_ids) - k, axis=1)[:, len(s_ids) - k]
        who, i, s = shard.search(ids, q, floor, k)
        yield pa.RecordBatch.from_arrays([pa.array(number[who]), pa.array(ids[who]), pa.array(i), pa.array(s.astype(np.int64))],
                                         names=["query", "query_id", "vec_id", "score"])

    found = against_all(index, blocks, load, search, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
