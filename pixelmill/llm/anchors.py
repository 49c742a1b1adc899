"""Where texts may repeat: windows routed by content-defined anchors.

A window is a fixed number of consecutive units (words or bytes) of one text.
The gram with the least hash in a window (the rightmost of equals) is its
anchor; it depends on the window's content alone, so equal windows have equal
anchors. Anchors that occur once in the corpus cannot belong to a repeated window. For
each other anchor, a segment is cut out: the run of neighbouring windows with that
anchor. In a periodic stretch the anchor recurs from window to window; such windows are
one run too, which is cut into pieces of ``PIECE`` windows. Segments of one anchor meet
in one group; groups of a very frequent anchor, or of much text, are split into chunks.

Texts are read in parts of ``PART`` bytes that overlap by a window, and segments leave
a task in batches of bounded size, so memory does not grow with what a text repeats.

Whole texts that are equal to another are set aside before (only the document
with the smallest id goes on), so groups of exact copies cost nothing here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import SpanHash, by_group, mix, multi_arange, slices, text_buffer, word_spans, written
from pixelmill.llm.exact_dedup import BROADCAST_IDS

#: A null id stands before all others.
NULL_ID = -(1 << 63)
#: Segments that a group holds on average, at most; frequent anchors are cut into chunks.
CHUNK = 5_000
SCAN_BYTES = 1 << 20
#: Segment bytes that are worked on at a time, whole groups together.
RUN_BYTES = 1 << 20
#: Segment bytes that a group holds on average, at most.
CHUNK_BYTES = 2 << 20
#: Windows of one segment, at most.
PIECE = 1 << 14
#: Bytes of a longer text that are read at a time.
PART = 4 << 20


#: Bits of a position in a packed (order, position); the order has the others.
PLACE_BITS = np.uint64(24)


def sliding_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value of every ``width`` consecutive values, in an
    order by the upper 40 bits of their product with an odd constant; of equals
    the rightmost. Order and position share a word, so that one minimum finds both;
    minima of runs come from forward and backward minima of blocks."""
    n, most = len(v), 1 << int(PLACE_BITS)
    if n < width:
        return np.empty(0, np.int64)
    if n >= most:  # in overlapping parts, whose positions fit
        step = most // 2
        return np.concatenate([sliding_argmin(v[at:at + step + width - 1], width) + at
                               for at in range(0, n - width + 1, step)])
    places = np.uint64(most - 1)
    packed = (v * np.uint64(0x9FB21C651E98DF25)) & ~places
    packed |= places - np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = packed
    blocks = full.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(backward[:n - width + 1], forward[width - 1:n])
    return (places - (least & places)).astype(np.int64)


class Words:
    """Windows of words; grams of words."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def runs(self, data: np.ndarray, offsets: np.ndarray):
        """For every run of windows: its row, anchor, first window (in units of its
        row), windows, places of the anchor, and first and last byte in its row."""
        start, end, first = word_spans(data, offsets)
        hashes = SpanHash(data)(start, end)
        grams = np.zeros(max(0, len(start) - self.gram + 1), np.uint64)
        for i in range(self.gram):
            grams = (grams ^ hashes[i:i + len(grams)]) * np.uint64(0x9E3779B97F4A7C15)
            grams ^= grams >> np.uint64(29)
        begin, count, times, anchor = _runs(grams, first, self.window, self.gram)
        owner = np.searchsorted(first, begin, "right") - 1
        return (owner, anchor, begin - first[owner], count, times, start[begin] - offsets[owner],
                end[begin + count + self.window - 2] - offsets[owner])

    def parts(self, data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """One long text in parts that share a window less one unit: (first unit, first
        byte, bytes)."""
        start, end, _ = word_spans(data, np.array([0, len(data)]))
        step = max(1, PART * len(start) // max(1, len(data)))
        for at in range(0, max(1, len(start) - self.window + 1), step):
            last = min(at + step + self.window - 1, len(start))
            if last > at:
                yield at, int(start[at]), data[start[at]:end[last - 1]]


class Bytes:
    """Windows of bytes; grams of bytes."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def runs(self, data: np.ndarray, offsets: np.ndarray):
        begin, count, times, anchor = _runs(SpanHash(data).rolling(self.gram), offsets, self.window, self.gram)
        owner = np.searchsorted(offsets, begin, "right") - 1
        begin = begin - offsets[owner]
        return owner, anchor, begin, count, times, begin, begin + count + self.window - 1

    def parts(self, data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        for at in range(0, max(1, len(data) - self.window + 1), PART):
            yield at, at, data[at:at + PART + self.window - 1]


def _runs(grams: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Runs of neighbouring windows whose anchors hash alike: first window (in units of
    the buffer), number of windows, places of the anchor, hash of the anchor. A run
    holds ``PIECE`` windows at most."""
    per_text = np.maximum(np.diff(first) - window + 1, 0)
    starts = multi_arange(first[:-1], per_text)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none
    anchor = sliding_argmin(grams, window - gram + 1)[starts]
    moved = np.ones(len(starts), bool)
    moved[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    place = np.flatnonzero(moved)
    # neighbouring places of one anchor are one run
    fresh = np.ones(len(place), bool)
    value = grams[anchor[place]]
    fresh[1:] = (value[1:] != value[:-1]) | (starts[place[1:]] != starts[place[1:] - 1] + 1)
    head = np.flatnonzero(fresh)
    begin, times = place[head], np.diff(np.append(head, len(place)))
    count = np.diff(np.append(begin, len(starts)))
    pieces = -(-count // PIECE)
    if (pieces > 1).any():
        at = np.repeat(np.arange(len(begin)), pieces)
        off = multi_arange(np.zeros(len(begin), np.int64), pieces) * PIECE
        head, begin, count, times = head[at], begin[at] + off, np.minimum(count[at] - off, PIECE), times[at]
    return starts[begin], count, times, mix(value[head]).view(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, t): the text as bytes (null: empty), its hash, and the id with null
    replaced. A document is an (id, h); rows that repeat both are one."""
    t = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    return (docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), t.alias("t"))
            .select("id", F.xxhash64("t").alias("h"), "t"))


def later_copies(keyed_docs: DataFrame) -> DataFrame:
    """(id, h, first_id) of the documents whose whole text stands under a smaller
    id already, and ``copied``: the (id, h) of texts that have such copies."""
    seen = keyed_docs.select("id", "h", F.sha2("t", 256).alias("sha")).distinct()
    seen = written(seen, "texts")
    groups = seen.groupBy("sha").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return written(seen.join(groups, "sha").select("id", "h", "first_id"), "copies")


def without_copies(keyed_docs: DataFrame, copies: DataFrame) -> DataFrame:
    later = copies.where("id <> first_id").select(F.col("id").alias("_i"), F.col("h").alias("_h"))
    if later.count() <= BROADCAST_IDS:
        later = F.broadcast(later)
    return keyed_docs.join(later, (F.col("id") == F.col("_i")) & (F.col("h") == F.col("_h")), "left_anti")


_RUN = ("anchor", "start", "windows", "times", "low", "high")
SEGMENTS = "anchor long, n long, bytes long, id long, h long, start int, windows int, times int, segment binary"


def segments(keyed_docs: DataFrame, windows: Words | Bytes) -> DataFrame:
    """(anchor, n, chunk, chunks, id, h, start, windows, times, segment) for every run of
    windows whose anchor stands at ``n`` > 1 places, ``times`` of them in this run;
    ``start`` is its first window."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32())

    def runs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        data, offsets = text_buffer(batch.column("t").cast(pa.large_binary()))
        if batch.num_rows > 1 or len(data) <= PART:
            return windows.runs(data, offsets)
        found = []
        for unit, byte, part in windows.parts(data):
            owner, anchor, start, count, times, low, high = windows.runs(part, np.array([0, len(part)]))
            found.append((owner, anchor, start + unit, count, times, low + byte, high + byte))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else windows.runs(data[:0], np.array([0, 0]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SCAN_BYTES):
            owner, *values = runs_of(batch)
            cuts = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, kind)) for x, kind in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), *lists], names=["id", "h", *_RUN])

    runs = written(keyed_docs.mapInArrow(scan, "id long, h long, anchor array<long>, start array<int>, windows array<int>, "
                                               "times array<int>, low array<int>, high array<int>"), "anchor-runs")
    counts = (runs.select(F.explode(F.arrays_zip("anchor", "times", "low", "high")).alias("x")).groupBy(F.col("x.anchor").alias("anchor"))
              .agg(F.sum("x.times").alias("n"), F.sum((F.col("x.high") - F.col("x.low")).cast("long")).alias("bytes")))
    counts = written(counts.where("n > 1"), "anchors")
    each = (runs.select("id", "h", F.explode(F.arrays_zip(*_RUN)).alias("x")).select("id", "h", "x.*").join(counts, "anchor"))
    per_doc = (each.groupBy("id", "h").agg(F.collect_list(F.struct("anchor", "n", "bytes", "start", "windows", "times", "low", "high")).alias("xs")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The segments of every text, as rows: some megabytes at a time."""
        for batch in slices(batches, "t", SCAN_BYTES):
            xs = batch.column("xs")
            x = pa.Table.from_batches([pa.RecordBatch.from_struct_array(xs.flatten())])
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(xs).to_numpy(zero_copy_only=False))
            ids, hashes = batch.column("id").take(pa.array(row)), batch.column("h").take(pa.array(row))
            low, high = x["low"].to_numpy(), x["high"].to_numpy()
            part = np.cumsum(high - low, dtype=np.int64) // (2 * SCAN_BYTES)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(low)]
            texts = batch.column("t")
            for a, b in zip(edges, edges[1:]):
                held, at, found = None, -1, []
                for r, p, q in zip(row[a:b].tolist(), low[a:b].tolist(), high[a:b].tolist()):
                    if r != at:
                        held, at = texts[r].as_py(), r
                    found.append(held[p:q])
                some = x.slice(a, b - a).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [*[some[c].combine_chunks() for c in ("anchor", "n", "bytes")], ids.slice(a, b - a), hashes.slice(a, b - a),
                     *[some[c].combine_chunks() for c in ("start", "windows", "times")], pa.array(found, pa.binary())],
                    names=["anchor", "n", "bytes", "id", "h", "start", "windows", "times", "segment"])

    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    # the text itself is never repeated per segment
    out = (keyed_docs.join(per_doc, ["id", "h"]).select("id", "h", "t", "xs").mapInArrow(cut, SEGMENTS).withColumn("chunks", chunks)
           .withColumn("chunk", F.pmod(F.xxhash64("id", "h", "start"), F.col("chunks").cast("long")).cast("int")))
    return written(out.drop("bytes"), "segments")


def grouped(rows: DataFrame, columns: list[str], work: Callable, schema: str, run_bytes: int | None = None) -> DataFrame:
    """:func:`by_group` for segments."""
    return by_group(rows, ["anchor", "chunk"], columns, work, schema, "segment", run_bytes or RUN_BYTES)


def each_group(table: pa.Table) -> Iterator[pa.Table]:
    """The groups (anchor, chunk) of a sorted table, one by one."""
    anchor, chunk = table["anchor"].to_numpy(), table["chunk"].to_numpy()
    cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (chunk[1:] != chunk[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, table.num_rows]):
        yield table.slice(a, b - a)


def removed_runs(spans: DataFrame) -> DataFrame:
    """(id, h, starts, counts): the runs of windows found for each document."""
    return spans.groupBy("id", "h").agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("counts"))


def restored_id(id_col: Column) -> Column:
    return F.when(id_col != NULL_ID, id_col)
