"""Helpers that the corpus operators share: table access, written tables in the
shared folder, Arrow text batches as flat byte buffers, 64-bit hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pixelmill.session import scratch_path

CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage, so that executors lost later never re-run what produced
    it. The shuffle files of the job are dropped as soon as it has ended."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP_CONF, None)
    if before is not None:
        spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Gives freed memory back to the system at the end of a task's work: the
    worker lives on, next to other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n + 1 offsets
    of its rows in it. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str | int, max_bytes: int,
           max_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of ``column`` and of
    ``max_rows`` rows at most (one row at least), so that memory does not depend
    on the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            for at in range(a, b, max_rows):
                yield batch.slice(at, min(max_rows, b - at))
    release_memory()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (public-domain splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n``."""
    if len(_powers.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        p = np.full(size, _BASE, np.uint64)
        q = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _powers["p"], _powers["q"] = np.cumprod(p), np.cumprod(q)
    return _powers["p"], _powers["q"]


class SpanHash:
    """64-bit hashes of any spans of a byte buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        p, self._inverse = _power_table(len(data) + 1)
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:len(data)])
        self._sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def rolling(self, width: int) -> np.ndarray:
        """Unmixed hashes of all spans of ``width`` bytes, by their start."""
        n = max(0, len(self._sums) - width)
        return (self._sums[len(self._sums) - n:] - self._sums[:n]) * self._inverse[:n]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09-0x0D, which separate words."""
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word of every row, and for each row the
    number of the first of its words (n + 1 numbers). A word never crosses rows."""
    word = ~is_space(data)
    before = np.concatenate([[False], word[:-1]]) if len(data) else word
    after = np.concatenate([word[1:], [False]]) if len(data) else word
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = False
    after[edges[1:] - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def multi_arange(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] numbers), start[1], ..."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - start, length)


def by_group(rows: DataFrame, keys: list[str], columns: list[str], work: Callable, schema: str,
             weight: str, limit: int) -> DataFrame:
    """``work`` over whole groups of rows that agree in ``keys`` (numbers), several
    groups at a time while they stay under ``limit`` bytes of the ``weight`` column:
    a pa.Table in, record batches out. Only one run of groups is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # rows are sorted: a group begins where any key changes
            values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for v in values:
                change[1:] |= v[1:] != v[:-1]
            if held:
                last = held[-1]
                change[0] = any(last.column(k)[-1].as_py() != v[0] for k, v in zip(keys, values))
            lengths = pc.fill_null(pc.binary_length(batch.column(weight)), 0).to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            done = 0
            for b in np.flatnonzero(change).tolist():
                if size + upto[b] - upto[done] >= limit:
                    yield from work(pa.Table.from_batches(held + ([batch.slice(done, b - done)] if b > done else [])))
                    held, size, done = [], 0, b
            # a copy of the rest, so that the batch itself is not kept
            held.append(pa.Table.from_batches([batch.slice(done)]).take(np.arange(batch.num_rows - done))
                        .combine_chunks().to_batches()[0])
            size += upto[-1] - upto[done]
        if held:
            yield from work(pa.Table.from_batches(held))
        release_memory()

    return (rows.select(*dict.fromkeys([*keys, *columns])).repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, schema))
