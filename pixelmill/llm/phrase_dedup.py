"""Repeated passages of words, located by sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words. Windows that may repeat are routed by
their anchors (see :mod:`pixelmill.llm.anchors`). The work has two passes:

1. Confirm: windows are counted by their hashes among the windows of their anchor;
   of those that recur, neighbours whose first places are neighbours too are
   written as one passage with its first place (smallest id, then earliest start).
2. Compile and stream: passages meet the stretches of all documents with the same
   anchors, in shards of bounded size. Each shard compiles an automaton of its
   passages' windows, word by word, and streams the stretches through it. Every
   hit but a window's first place is removed. Only the automaton, which compares words
   and not hashes, decides what a hit is.

Where an anchor's group is cut into chunks, the windows of each chunk are counted
across chunks, and every chunk gets the recurring ones that it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.anchors import Words, grouped, keyed, later_copies, removed_runs, restored_id, segments, without_copies
from pixelmill.llm.common import SpanHash, mix, multi_arange, slices, text_buffer, word_spans, written

WINDOW, GRAM = 20, 6
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BATCH_BYTES = 2 << 20
SPANS = "id long, h long, start int, windows int"
PASSAGES = "anchor long, chunk int, id long, h long, start int, segment binary"
COUNTED = "anchor long, chunk int, value long, n long, id long, h long, start int"
#: The letter of a word that no passage of the shard holds, and that of word 0; code
#: points from there on leave out the surrogates.
UNKNOWN, FIRST_LETTER, SURROGATES, AFTER = "\x01", 2, 0xD800, 0xE000


class _Windows:
    """All windows of a table of segments: word spans, and for every window its segment,
    number in the segment, key (anchor, hash of its words) and place."""

    def __init__(self, table: pa.Table):
        self.data, offsets = text_buffer(table["segment"].cast(pa.large_binary()))
        self.start, self.end, self.first = word_spans(self.data, offsets)
        hashes = SpanHash(self.data)(self.start, self.end)
        value = np.zeros(max(0, len(hashes) - WINDOW + 1), np.uint64)
        for i in range(WINDOW):
            value = (value ^ hashes[i:i + len(value)]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        per_segment = np.maximum(np.diff(self.first) - WINDOW + 1, 0)
        self.segment = np.repeat(np.arange(len(per_segment)), per_segment)
        self.number = multi_arange(np.zeros(len(per_segment), np.int64), per_segment)
        self.value = value[self.first[self.segment] + self.number]
        self.anchor, self.id, self.h, self.begin = (table[c].to_numpy() for c in ("anchor", "id", "h", "start"))
        self.chunk = table["chunk"].to_numpy()
        # segments in the order of their places; rows that repeat a place are one
        order = np.lexsort((self.begin, self.h, self.id))
        fresh = np.zeros(len(order), bool)
        fresh[1:] = ((np.diff(self.id[order]) != 0) | (np.diff(self.h[order]) != 0) | (np.diff(self.begin[order]) != 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh)
        self.place = (rank[self.segment] << 32) | self.number
        salt = mix(self.anchor.view(np.uint64) + self.chunk.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        self.key = mix(self.value ^ salt[self.segment])

    def grouped(self) -> tuple[np.ndarray, np.ndarray]:
        """(the window at the first place of every key, places of the key)."""
        order = np.lexsort((self.place, self.key))
        key, place = self.key[order], self.place[order]
        head = np.ones(len(order), bool)
        head[1:] = key[1:] != key[:-1]
        other = head.copy()
        other[1:] |= place[1:] != place[:-1]
        at = np.flatnonzero(head)
        counts = np.add.reduceat(other.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
        return order[at], counts

    def passages(self, chosen: np.ndarray, joined: bool = True) -> pa.RecordBatch:
        """The chosen windows with their words; neighbours are ``joined`` to passages."""
        chosen = chosen[np.lexsort((self.number[chosen], self.segment[chosen]))]
        segment, number = self.segment[chosen], self.number[chosen]
        head = np.ones(len(chosen), bool)
        if joined:
            head[1:] = (segment[1:] != segment[:-1]) | (number[1:] != number[:-1] + 1)
        at = np.flatnonzero(head)
        last = np.append(at[1:], len(chosen)) - 1 if len(at) else at
        seg, word = segment[at], self.first[segment[at]] + number[at]
        low, high = self.start[word], self.end[self.first[seg] + number[last] + WINDOW - 1]
        raw = self.data.tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array(self.anchor[seg]), pa.array(self.chunk[seg], pa.int32()), pa.array(self.id[seg]), pa.array(self.h[seg]),
             pa.array((self.begin[seg] + number[at]).astype(np.int32)),
             pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary())],
            names=["anchor", "chunk", "id", "h", "start", "segment"])


def _confirmed(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The recurring passages of whole groups."""
    windows = _Windows(table)
    firsts, counts = windows.grouped()
    yield windows.passages(firsts[counts > 1])


def _counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The windows of every chunk: hash, places and the first of them."""
    w = _Windows(table)
    firsts, counts = w.grouped()
    seg = w.segment[firsts]
    yield pa.RecordBatch.from_arrays(
        [pa.array(w.anchor[seg]), pa.array(w.chunk[seg], pa.int32()), pa.array(w.value[firsts].view(np.int64)), pa.array(counts),
         pa.array(w.id[seg]), pa.array(w.h[seg]), pa.array((w.begin[seg] + w.number[firsts]).astype(np.int32))],
        names=["anchor", "chunk", "value", "n", "id", "h", "start"])


def _spelled(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The windows of chunks at the places that are told (rows without ``windows``)."""
    told = table.filter(pc.is_null(table["windows"]))
    asked = set(zip(*(told[c].to_pylist() for c in ("id", "h", "start"))))
    w = _Windows(table.filter(pc.is_valid(table["windows"])))
    firsts, _ = w.grouped()
    seg = w.segment[firsts]
    places = zip(w.id[seg].tolist(), w.h[seg].tolist(), (w.begin[seg] + w.number[firsts]).tolist())
    yield w.passages(firsts[np.array([p in asked for p in places], bool)], joined=False)


def _letters(n: int) -> str:
    """The letter of word number ``n`` of a shard."""
    code = FIRST_LETTER + n
    return chr(code if code < SURROGATES else code + AFTER - SURROGATES)


def _located(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Compiles the passages of a shard (rows without ``windows``) and streams its
    stretches of documents through the automaton: the runs of windows that are hit and
    do not stand at their first place."""
    told = table.filter(pc.is_null(table["windows"]))
    if not told.num_rows:
        return
    letters: dict[bytes, str] = {}
    automaton = ahocorasick.Automaton()
    for raw, i, h, start in zip(*(told[c].to_pylist() for c in ("segment", "id", "h", "start"))):
        text = "".join([letters.get(w) or letters.setdefault(w, _letters(len(letters))) for w in WORD.findall(raw)])
        for j in range(len(text) - WINDOW + 1):
            automaton.add_word(text[j:j + WINDOW], (i, h, start + j))
    automaton.make_automaton()
    rows = table.filter(pc.is_valid(table["windows"]))
    known: dict[bytes, list[tuple[int, tuple[int, int, int]]]] = {}
    out: set[tuple[int, int, int, int]] = set()
    for raw, i, h, start in zip(*(rows[c].to_pylist() for c in ("segment", "id", "h", "start"))):
        hits = known.get(raw)
        if hits is None:
            text = "".join([letters.get(w, UNKNOWN) for w in WORD.findall(raw)])
            hits = known[raw] = [(end - WINDOW + 1, first) for end, first in automaton.iter(text)]
        begin = end = -1
        for j, first in hits:
            if first == (i, h, start + j):
                continue
            if j != end:
                if end > begin:
                    out.add((i, h, start + begin, end - begin))
                begin = j
            end = j + 1
        if end > begin:
            out.add((i, h, start + begin, end - begin))
    columns = list(zip(*out)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                     names=["id", "h", "start", "windows"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(spans, copies): for each document (id, h) the runs of windows (starts,
    counts) that also start earlier, and the later copies of whole texts, in
    which every window does."""
    base = keyed(docs, id_col, text_col)
    copies = later_copies(base)
    rows = segments(without_copies(base, copies), Words(WINDOW, GRAM)).drop("n", "times")
    columns = ["id", "h", "start", "windows", "segment"]
    passages = grouped(rows.where("chunks = 1"), ["id", "h", "start", "segment"], _confirmed, PASSAGES)
    frequent = rows.where("chunks > 1")
    if not frequent.isEmpty():
        counted = written(grouped(frequent, ["id", "h", "start", "segment"], _counted, COUNTED), "windows")
        recurring = (counted.groupBy("anchor", "value")
                     .agg(F.sum("n").alias("n"), F.min(F.struct("id", "h", "start", "chunk")).alias("first")).where("n > 1"))
        recurring = written(recurring.select("anchor", "value", "first"), "recurring")
        asked = recurring.select("anchor", "first.chunk", "first.id", "first.h", "first.start", F.lit(None).cast("int").alias("windows"),
                                 F.lit(b"").alias("segment"))
        spelled = written(grouped(frequent.select("anchor", "chunk", *columns).unionByName(asked), columns, _spelled, PASSAGES), "spelled")
        # every chunk gets the recurring windows that it holds
        held = (counted.select("anchor", "chunk", "value").join(recurring, ["anchor", "value"])
                .select("anchor", "chunk", "first.id", "first.h", "first.start"))
        passages = passages.unionByName(held.join(spelled.drop("chunk"), ["anchor", "id", "h", "start"]).select("anchor", "chunk", "id", "h", "start", "segment"))
    passages = written(passages, "passages")
    told = passages.withColumn("windows", F.lit(None).cast("int"))
    stretches = rows.join(passages.select("anchor", "chunk").distinct(), ["anchor", "chunk"], "left_semi")
    both = stretches.select("anchor", "chunk", *columns).unionByName(told.select("anchor", "chunk", *columns))
    return removed_runs(written(grouped(both, columns, _located, SPANS), "spans")), copies


def _kept_words(text: bytes, starts, counts, everything: bool) -> tuple[list[bytes], list[bytes]]:
    words = WORD.findall(text)
    gone = np.zeros(len(words) + 1, np.int32)
    if everything and len(words) >= WINDOW:
        return words, []
    np.add.at(gone, np.array(starts, np.int64), 1)
    np.add.at(gone, np.array(starts, np.int64) + np.array(counts, np.int64) + WINDOW - 1, -1)
    keep = np.cumsum(gone[:-1]) == 0
    return words, [w for w, k in zip(words, keep.tolist()) if k]


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (binary:
    the words that stay, joined by one space).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. A word
    goes if a window that covers it also starts earlier: at a smaller id, or
    earlier in the same text. Windows are judged on the input. Null, empty and
    short texts lose nothing. Null ids stand before all others. Rows that share
    an id but not the text are told apart by a hash of the text; rows that share
    both are one document, of which each row is returned. Very long texts are read in
    parts. An empty table gives no rows; extra columns are not read."""
    spans, copies = repeated_spans(docs, id_col, text_col)
    later = copies.where("id <> first_id").select("id", "h", F.lit(True).alias("copy"))
    base = keyed(docs, id_col, text_col)
    marked = spans.join(later, ["id", "h"], "full_outer").groupBy("id", "h").agg(
        F.first("starts").alias("starts"), F.first("counts").alias("counts"), F.max("copy").alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", BATCH_BYTES):
            found = [_kept_words(t, s or (), c or (), bool(e)) for t, s, c, e in
                     zip(*(batch.column(x).to_pylist() for x in ("t", "starts", "counts", "copy")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(w) for w, _ in found], pa.int64()),
                 pa.array([len(w) - len(k) for w, k in found], pa.int64()),
                 pa.array([b" ".join(k) for _, k in found], pa.binary())],
                names=["id", "n_words", "n_removed", "kept"])

    out = (base.join(marked, ["id", "h"], "left").select("id", "t", "starts", "counts", "copy")
           .mapInArrow(run, "id long, n_words long, n_removed long, kept binary"))
    return out.select(restored_id(F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")
