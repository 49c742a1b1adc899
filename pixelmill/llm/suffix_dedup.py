"""Repeated byte strings, by interval expansion on Burrows-Wheeler transforms.

A window is ``WINDOW`` bytes. Windows that may repeat are routed by their
anchors (see :mod:`pixelmill.llm.anchors`). The distinct segments of a shard are
sorted into a suffix array, from which the transform is read; breadth-first
backward extension then finds the common prefix lengths of neighbouring
suffixes by increasing value and stops at ``WINDOW``: neighbours whose value is
still unknown share a window. A window that occurs at two places or more is
repeated, and every byte it covers is removed.

Where an anchor is so frequent that its group is cut into chunks, each chunk
reports its windows with their occurrences; totals over all chunks decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.anchors import (Bytes, each_group, grouped, keyed, later_copies, removed_runs, restored_id,
                                   segments, without_copies)
from pixelmill.llm.common import multi_arange, slices, written

WINDOW, GRAM = 200, 32
RUN_BYTES = 1 << 20
BATCH_BYTES = 2 << 20
#: Symbols are 0 (end of a segment) and byte + 1; so many fit in one sort key.
PACKED = 7


def suffix_array(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a collection in order, by prefix doubling up to ``depth``
    symbols at least. ``ends`` are the positions of the end marks (symbol 0),
    each smaller than all bytes and than the end marks after it."""
    n = len(symbols)
    mark = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
    left = ends[mark] - np.arange(n)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(PACKED, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(PACKED):
        key = (key << np.uint64(9)) | np.where(left >= k, padded[k:k + n], 0)
    order = np.argsort(key)
    # keys that hold an end mark tie with each other alone: the mark decides
    short = np.flatnonzero(left[order] < PACKED)
    tied = order[short]
    order[short] = tied[np.lexsort((tied, key[tied]))]
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    fresh[short] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    have = PACKED
    while have < depth:
        # places of suffixes that still share their rank with another
        shared = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(shared):
            break
        open_ = order[shared]
        at, then = rank[open_], rank[open_ + have]
        by = np.argsort(at * n + then)
        open_, at, then = open_[by], at[by], then[by]
        split = np.ones(len(open_), bool)
        split[1:] = (at[1:] != at[:-1]) | (then[1:] != then[:-1])
        order[shared] = open_
        fresh[shared] = split
        rank[open_] = np.maximum.accumulate(np.where(split, shared, 0))
        have *= 2
    return order


def shared_prefixes(symbols: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ``below``): ``below[j]`` tells that suffixes j - 1 and j
    share fewer than ``depth`` symbols."""
    order = suffix_array(symbols, ends, depth)
    n, marks = len(order), len(ends)
    bwt = np.where(order > 0, symbols[order - 1], 0)
    # where the suffix that is one symbol longer stands: counts of the transform alone
    step = np.empty(n, np.int64)
    step[np.argsort(bwt, kind="stable")] = np.arange(n)
    first = symbols[order]
    lcp = np.full(n + 1, -1, np.int16)
    lcp[0] = 0
    starts = np.flatnonzero(np.diff(first, prepend=-1))
    # the empty string's extensions: one interval per byte, one per end mark
    low = np.concatenate([np.arange(marks), starts[first[starts] > 0]])
    high = np.concatenate([np.arange(marks), np.append(starts[1:], n)[first[starts] > 0] - 1])
    lcp[high + 1] = 0
    for value in range(1, depth):
        if not len(low):
            break
        size = high - low + 1
        at = multi_arange(low, size)
        interval = np.repeat(np.arange(len(low)), size)
        inside = bwt[at] > 0  # a segment is never extended beyond its start
        to, interval = step[at[inside]], interval[inside]
        by = np.argsort(to, kind="stable")
        to, interval = to[by], interval[by]
        if not len(to):
            break
        cut = (to[1:] != to[:-1] + 1) | (interval[1:] != interval[:-1]) | (first[to[1:]] != first[to[:-1]])
        low = to[np.concatenate([[True], cut])]
        high = to[np.concatenate([cut, [True]])]
        new = lcp[high + 1] < 0
        low, high = low[new], high[new]
        lcp[high + 1] = value
    return order, lcp[:n] >= 0


class _Shard:
    """Distinct segments of some whole groups, where each occurs, and the class
    of every window: windows of one class are equal."""

    def __init__(self, table: pa.Table, skip_lone: bool = True):
        known: dict[bytes, int] = {}
        self.segments: list[bytes] = []
        self.places: list[set[tuple[int, int, int]]] = []
        self.anchors: list[int] = []
        per_anchor: dict[int, int] = {}
        for anchor, raw, i, h, start, times in zip(*(table.column(c).to_pylist() for c in ("anchor", "segment", "id", "h", "start", "times"))):
            at = known.setdefault(raw, len(self.segments))
            if times > 1:  # a segment with several places of its anchor can repeat inside itself
                per_anchor[anchor] = per_anchor.get(anchor, 0) + 2
            if at == len(self.segments):
                self.segments.append(raw)
                self.places.append(set())
                self.anchors.append(anchor)
                per_anchor[anchor] = per_anchor.get(anchor, 0) + 1
            self.places[at].add((i, h, start))
        # an anchor with one distinct segment, in which it stands once, needs no
        # comparison: its windows occur wherever the segment does, and nowhere else
        self.lone = [skip_lone and per_anchor[a] == 1 for a in self.anchors]

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every window of the segments that are not alone: its segment, its
        offset and its class."""
        used = [k for k, lone in enumerate(self.lone) if not lone]
        if not used:
            none = np.empty(0, np.int64)
            return none, none, none
        lengths = np.array([len(self.segments[k]) + 1 for k in used])
        ends = np.cumsum(lengths) - 1
        symbols = np.frombuffer(b"\0".join(self.segments[k] for k in used) + b"\0", np.uint8).astype(np.int16) + 1
        symbols[ends] = 0
        order, below = shared_prefixes(symbols, ends, WINDOW)
        owner = np.searchsorted(ends, order)
        offset = order - (ends - lengths + 1)[owner]
        whole = ends[owner] - order >= WINDOW
        return np.array(used)[owner[whole]], offset[whole], np.cumsum(below)[whole]

    def totals(self, segment: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Occurrences of every window's class, at all places."""
        times = np.array([len(p) for p in self.places], np.int64)
        if not len(kind):
            return np.empty(0, np.int64)
        return np.bincount(kind, weights=times[segment])[kind].astype(np.int64)

    def spans(self, segment: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
        """Runs of the given windows, at every place of their segments."""
        out: list[tuple[int, int, int, int]] = []
        by = np.lexsort((offset, segment))
        segment, offset = segment[by], offset[by]
        cut = np.flatnonzero((np.diff(segment) != 0) | (np.diff(offset) != 1)) + 1
        begins = np.concatenate([[0], cut]) if len(segment) else cut
        counts = np.diff(np.append(begins, len(segment)))
        runs = [(int(segment[b]), int(offset[b]), int(c)) for b, c in zip(begins, counts)]
        runs += [(k, 0, len(s) - WINDOW + 1) for k, s in enumerate(self.segments)
                 if self.lone[k] and len(self.places[k]) > 1]
        for k, o, c in runs:
            out += [(i, h, start + o, c) for i, h, start in self.places[k]]
        columns = list(zip(*out)) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(
            columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["id", "h", "start", "windows"])


SPANS = "id long, h long, start int, windows int"


def _whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
    shard = _Shard(table)
    segment, offset, kind = shard.classes()
    repeated = shard.totals(segment, kind) > 1
    yield shard.spans(segment[repeated], offset[repeated])


def _digests(shard: _Shard, segment: np.ndarray, offset: np.ndarray, kind: np.ndarray):
    """One window of every class as 16 bytes, and the class index of every window."""
    _, one, back = np.unique(kind, return_index=True, return_inverse=True)
    named = [hashlib.blake2b(shard.segments[s][o:o + WINDOW], digest_size=16).digest()
             for s, o in zip(segment[one].tolist(), offset[one].tolist())]
    return one, named, back


def _chunk_totals(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for group in each_group(table):
        shard = _Shard(group, skip_lone=False)
        segment, offset, kind = shard.classes()
        one, named, _ = _digests(shard, segment, offset, kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array([group[c][0].as_py()] * len(one), t) for c, t in (("anchor", pa.int64()), ("chunk", pa.int32()))]
            + [pa.array(named, pa.binary()), pa.array(shard.totals(segment, kind)[one], pa.int64())],
            names=["anchor", "chunk", "window", "n"])


def _chunk_spans(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Chunks together with their repeated windows (rows with a null ``windows``)."""
    for group in each_group(table):
        told = set(group.filter(pc.is_null(group.column("windows"))).column("segment").to_pylist())
        shard = _Shard(group.filter(pc.is_valid(group.column("windows"))), skip_lone=False)
        segment, offset, kind = shard.classes()
        _, named, back = _digests(shard, segment, offset, kind)
        repeated = np.array([x in told for x in named], bool)[back] if named else np.empty(0, bool)
        yield shard.spans(segment[repeated], offset[repeated])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(spans, copies): for each document (id, h) the runs of windows (starts,
    counts) that occur elsewhere, and the documents whose whole text does."""
    base = keyed(docs, id_col, text_col)
    copies = later_copies(base)
    rows = segments(without_copies(base, copies), Bytes(WINDOW, GRAM))
    columns = ["id", "h", "start", "windows", "times", "segment"]
    spans = grouped(rows.where("chunks = 1"), columns, _whole, SPANS, RUN_BYTES)
    frequent = rows.where("chunks > 1")
    if not frequent.isEmpty():
        counted = written(grouped(frequent, columns, _chunk_totals, "anchor long, chunk int, window binary, n long",
                                  RUN_BYTES), "windows")
        repeated = counted.groupBy("anchor", "window").agg(F.sum("n").alias("n")).where("n > 1")
        none = lambda kind: F.lit(None).cast(kind)
        told = (counted.join(repeated.select("anchor", "window"), ["anchor", "window"], "left_semi")
                .select("anchor", "chunk", none("long").alias("id"), none("long").alias("h"), none("int").alias("start"),
                        none("int").alias("windows"), none("int").alias("times"), F.col("window").alias("segment")))
        both = frequent.select("anchor", "chunk", *columns).unionByName(told)
        spans = spans.unionByName(grouped(both, columns, _chunk_spans, SPANS, RUN_BYTES))
    return removed_runs(written(spans, "spans")), copies


def _without(text: bytes, starts, counts, everything: bool) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, the rest)."""
    if everything and len(text) >= WINDOW:
        return len(text), 1, b""
    if not len(starts):
        return 0, 0, text
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, np.array(starts, np.int64), 1)
    np.add.at(edge, np.array(starts, np.int64) + np.array(counts, np.int64) + WINDOW - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept`` (binary: the bytes that stay).

    A byte goes if a window that covers it also starts anywhere else, in the
    same text included; the first occurrence goes too. Matches never cross texts,
    and windows are judged on the input. Null, empty and short texts lose
    nothing. Rows that share an id but not the text are different documents;
    rows that share both are one, of which each row is returned. A null id stays
    null. Very long texts and long periodic stretches are read in parts. An empty
    table gives no rows; extra columns are not read."""
    spans, copies = repeated_spans(docs, id_col, text_col)
    base = keyed(docs, id_col, text_col)
    marked = spans.join(copies.select("id", "h", F.lit(True).alias("copy")), ["id", "h"], "full_outer").groupBy("id", "h").agg(
        F.first("starts").alias("starts"), F.first("counts").alias("counts"), F.max("copy").alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", BATCH_BYTES):
            texts = batch.column("t").to_pylist()
            found = [_without(t, s or (), c or (), bool(e)) for t, s, c, e in
                     zip(texts, *(batch.column(x).to_pylist() for x in ("starts", "counts", "copy")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                 pa.array([f[2] for f in found], pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = (base.join(marked, ["id", "h"], "left").select("id", "t", "starts", "counts", "copy")
           .mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary"))
    return out.select(restored_id(F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
