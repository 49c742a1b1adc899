"""Masked pseudo-likelihood scores from a bidirectional window network.

Every word of a text is predicted from the ``SPAN`` words on each side of it,
itself masked; the conditional log-probabilities add up to the text's score.

The network is small and trained in numpy: position-wise embeddings of the
context are summed into one tanh layer, and a two-level softmax (class, then
word in class) gives the probability of the word. The classes tell the most
frequent words of all documents apart; every other word is id 0 to the network and
has the probability of id 0 times its own share of that id's occurrences, from the
word counts of all documents. Training is data-parallel: each partition of
the corpus runs its own pass from the current weights and the weights are
averaged over all partitions by the words they saw, for ``ROUNDS`` rounds. A
round trains on every ``ROUNDS``-th word of each text, the next round on the words
after those, so the rounds together train on every word of the input once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import SpanHash, slices, text_buffer, word_spans, written

CLASSES = SLOTS = 32
#: Words that the network tells apart; id 0 stands for all others.
VOCABULARY = CLASSES * SLOTS
SPAN = 3
HIDDEN = 32
ROUNDS = 2
RATE = 0.15
BATCH = 4096
SCORE_ROWS = 1 << 15
SCAN_BYTES = 4 << 20
#: Words are hashed in pieces of so many bytes, which stay in the processor's cache.
HASH_BYTES = 1 << 17
#: Ids are looked up by so many leading bits of the hash.
LEAD_BITS = 16
#: exp of a number no larger than this, of either sign, and sums of such stay in the range of float32.
LARGE = 60
#: Counts of words of id 0 are broadcast if the word makes up one occurrence in so
#: many or more (so there are at most so many); those of the others are joined.
HOT_SHARE = 1 << 20
#: Sums of logarithms are added up in this unit, so that their order has no effect.
UNIT = 1 << 30
#: Weights travel in blocks of so many numbers, summed over so many lanes first.
BLOCK, LANES = 1 << 14, 64

PARTS = {"embed": (2 * SPAN, VOCABULARY + 1, HIDDEN), "bias": (HIDDEN,), "to_class": (HIDDEN, CLASSES),
         "class_bias": (CLASSES,), "to_slot": (CLASSES, HIDDEN, SLOTS), "slot_bias": (CLASSES, SLOTS)}


class Net:
    """The network's weights, as views of one flat vector."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in PARTS.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at:at + size].reshape(shape))
            at += size

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in PARTS.values())

    @classmethod
    def fresh(cls, counts: np.ndarray) -> "Net":
        """Small fixed random weights; biases that give the words' frequencies."""
        net = cls((np.random.default_rng(7).normal(size=cls.size()) * 0.1).astype(np.float32))
        share = (counts.reshape(CLASSES, SLOTS) + 1.0) / (counts.sum() + counts.size)
        net.bias[:] = 0
        net.class_bias[:] = np.log(share.sum(1))
        net.slot_bias[:] = np.log(share / share.sum(1, keepdims=True))
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.embed[0].take(context[0], 0, mode="clip")
        total += self.bias
        part = np.empty_like(total)
        for p in range(1, 2 * SPAN):
            total += self.embed[p].take(context[p], 0, out=part, mode="clip")
        return np.tanh(total, out=total)

    def classes(self, h: np.ndarray) -> np.ndarray:
        """Inputs of the first softmax."""
        out = h @ self.to_class
        out += self.class_bias
        return out

    def slots(self, h: np.ndarray, kind: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Inputs of the second softmax, for rows sorted by class."""
        out = self.slot_bias.take(kind, 0)
        part = np.empty_like(out)
        for c, rows in _runs(cuts):
            np.matmul(h[rows], self.to_slot[c], out=part[rows])
        out += part
        return out

    def log_probabilities(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        order, kind, slot, cuts = _by_class(word)
        h = self.hidden(context.take(order, 1))
        out = np.empty(len(word), h.dtype)
        out[order] = _log_softmax_at(self.classes(h), kind) + _log_softmax_at(self.slots(h, kind, cuts), slot)
        return out

    def gradient(self, context: np.ndarray, word: np.ndarray) -> "Net":
        """Of the mean log-probability."""
        g = Net(np.zeros_like(self.flat))
        order, kind, slot, cuts = _by_class(word)
        context = context.take(order, 1)
        h = self.hidden(context)
        # sums over rows are products with a row of ones
        ones = np.ones(len(word), h.dtype)
        d = _left_over(self.classes(h), kind)
        np.matmul(h.T, d, out=g.to_class)
        np.matmul(ones, d, out=g.class_bias)
        dh = d @ self.to_class.T
        d = _left_over(self.slots(h, kind, cuts), slot)
        part = np.empty_like(dh)
        for c, rows in _runs(cuts):
            own = d[rows]
            np.matmul(h[rows].T, own, out=g.to_slot[c])
            np.matmul(ones[rows], own, out=g.slot_bias[c])
            np.matmul(own, self.to_slot[c].T, out=part[rows])
        dh += part
        h *= h
        dh *= np.subtract(1, h, out=h)
        np.matmul(ones, dh, out=g.bias)
        # id 0 is most of the words: one product, the other ids sorted and summed,
        # two numbers (one complex) at a time
        g.embed[:, 0] = (context == 0).astype(dh.dtype) @ dh
        at = np.flatnonzero(context)
        step, rows = np.divmod(at, len(word))
        ids = (context.ravel()[at] + step * (VOCABULARY + 1)).astype(np.min_scalar_type(-2 * SPAN * (VOCABULARY + 1)))
        by_id = np.argsort(ids, kind="stable")
        ids = ids[by_id]
        starts = np.flatnonzero(np.diff(ids, prepend=-1))
        if len(starts):
            pairs = dh.take(rows[by_id], 0, mode="clip").view(np.result_type(dh.dtype, np.complex64))
            g.embed.reshape(-1, HIDDEN)[ids[starts]] = np.add.reduceat(pairs, starts, axis=0).view(dh.dtype)
        g.flat /= len(word)
        return g


def _in_range(x: np.ndarray) -> None:
    """Takes its largest number from every row if ``exp`` or its sums may leave their range."""
    if max(x.max(), -x.min()) > LARGE:
        x -= x.max(1, keepdims=True)


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    _in_range(x)
    own = x.take(np.arange(0, x.size, x.shape[1]) + at)
    return own - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))


def _left_over(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gradient of the log-softmax at ``at``: one there, less the probabilities."""
    _in_range(x)
    np.exp(x, out=x)
    x /= -(x @ np.ones(x.shape[1], x.dtype))[:, None]
    x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at] += 1
    return x


def _by_class(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order by class; class and slot in that order; where each class begins."""
    order = np.argsort((word // SLOTS).astype(np.int16), kind="stable")
    kind, slot = np.divmod(word[order], SLOTS)
    return order, kind, slot, np.searchsorted(kind, np.arange(CLASSES + 1))


def _runs(cuts: np.ndarray) -> Iterator[tuple[int, slice]]:
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        yield c, slice(cuts[c], cuts[c + 1])


class Vocabulary:
    """Ids of the most frequent words, looked up by the hash of the word.

    ``others`` has the counts of all words (word, n), ``hot`` and ``hot_counts``
    those of the more frequent words of id 0. Without ``others``, the words of
    id 0 are not told apart."""

    def __init__(self, hashes: list[int], counts: list[int], total: int, others: DataFrame | None = None,
                 hot: np.ndarray = np.empty(0, np.int64), hot_counts: np.ndarray = np.empty(0, np.int64)):
        known = np.array(hashes, np.int64).view(np.uint64)
        self.order = np.argsort(known)
        self.known = known[self.order]
        leads = np.arange(1 << LEAD_BITS, dtype=np.uint64) << np.uint64(64 - LEAD_BITS)
        self.lead = np.searchsorted(self.known, leads)
        self.most = int(np.diff(self.lead, append=len(known)).max())
        self.counts = np.zeros(VOCABULARY)
        self.counts[1:len(counts) + 1] = counts
        self.counts[0] = total - sum(counts)
        self.others, self.total = others, total
        order = np.argsort(hot.view(np.uint64))
        self.hot, self.hot_logs = hot.view(np.uint64)[order], np.log(hot_counts[order])

    def __getstate__(self) -> dict:
        return {**self.__dict__, "others": None}

    def log_shares(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words of id 0: the logarithm of their share in it, and which of them
        are not in the broadcast table (these count as if they occurred once)."""
        logs = np.full(len(hashes), -np.log(max(self.counts[0], 1)))
        if not len(self.hot):
            return logs, np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hot, hashes), len(self.hot) - 1)
        found = self.hot[at] == hashes
        logs[found] += self.hot_logs[at[found]]
        return logs, ~found

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        out = np.empty(len(hashes), np.int64)
        for a in range(0, len(hashes), BATCH):
            some = hashes[a:a + BATCH]
            # the first known hash of the same leading bits, then on to the one itself
            at = self.lead.take(some >> np.uint64(64 - LEAD_BITS))
            for _ in range(self.most - 1):
                at += self.known.take(at, mode="clip") < some
            found = self.known.take(at, mode="clip") == some
            out[a:a + BATCH] = np.where(found, self.order.take(at, mode="clip") + 1, 0)
        return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = word_spans(data, offsets)
    out = np.empty(len(start), np.uint64)
    cuts = np.flatnonzero(np.diff(start // HASH_BYTES, prepend=-1, append=-1)).tolist()
    for a, b in zip(cuts, cuts[1:]):
        low = start[a]
        out[a:b] = SpanHash(data[low:end[b - 1]])(start[a:b] - low, end[a:b] - low)
    return out, first


def contexts(ids: np.ndarray, first: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(2 SPAN, places): the ids around each place; VOCABULARY outside the text."""
    owner = np.searchsorted(first, places, "right") - 1
    low, high = first[owner], first[owner + 1]
    out = np.empty((2 * SPAN, len(places)), np.int64)
    for p, step in enumerate([*range(-SPAN, 0), *range(1, SPAN + 1)]):
        at = places + step
        out[p] = np.where((at >= low) & (at < high), ids[np.clip(at, 0, len(ids) - 1)], VOCABULARY)
    return out


def places_of_round(first: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """Places of the words whose number in their own text is ``number`` modulo ``rounds``."""
    own = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    return np.flatnonzero(own % rounds == number)


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """The most frequent words of all texts (ties: the smaller hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SCAN_BYTES):
            words, n = np.unique(word_hashes(*text_buffer(batch.column(0)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    counts = (docs.select(docs[text_col].alias("text")).mapInArrow(run, "word long, n long")
              .groupBy("word").agg(F.sum("n").alias("n")))
    counts = written(counts, "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.col("n").desc(), "word").limit(VOCABULARY - 1).collect()
    # the frequent words are among them, but never looked up
    hot = counts.where(F.col("n") * HOT_SHARE >= total).select("word", "n").toArrow()
    return Vocabulary([r["word"] for r in top], [r["n"] for r in top], total, counts,
                      hot.column("word").to_numpy(), hot.column("n").to_numpy())


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of weight blocks per key, held one block per key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for block, lane, n, w in zip(*(batch.column(c).to_pylist() for c in ("block", "lane", "n", "w"))):
                key = (block, lane if "lane" in keys else 0)
                x = sums.setdefault(key, [0, np.zeros(len(w) // 8)])
                x[0] += n
                x[1] += np.frombuffer(w, np.float64)
        yield _weight_rows([(b, lane, n, w) for (b, lane), (n, w) in sums.items()])

    return rows.repartition(*keys).mapInArrow(run, "block int, lane int, n long, w binary")


def _weight_rows(rows: list[tuple]) -> pa.RecordBatch:
    b, lane, n, w = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(lane, pa.int32()), pa.array(n, pa.int64()),
                                       pa.array([x.tobytes() for x in w], pa.binary())], names=["block", "lane", "n", "w"])


def train(docs: DataFrame, words: Vocabulary, text_col: str = "text", rounds: int = ROUNDS) -> Net:
    """Averages the passes of all partitions, ``rounds`` times; every word of
    every text is trained on in exactly one of the rounds."""
    context = docs.sparkSession.sparkContext
    net = Net.fresh(words.counts)
    for number in range(rounds):
        sent = context.broadcast((net.flat, words))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            flat, vocabulary = sent.value
            own = Net(flat.copy())
            square, step, seen, lane = np.full_like(flat, 1e-4), np.empty_like(flat), 0, -1
            for batch in slices(batches, "text", SCAN_BYTES):
                hashes, first = word_hashes(*text_buffer(batch.column(0)))
                if lane < 0 and len(hashes):
                    lane = int(hashes[0] % np.uint64(LANES))
                ids = vocabulary.ids(hashes)
                places = places_of_round(first, number, rounds)
                for at in range(0, len(places), BATCH):
                    some = places[at:at + BATCH]
                    g = own.gradient(contexts(ids, first, some), ids[some]).flat
                    square += np.multiply(g, g, out=step)
                    g *= RATE
                    g /= np.sqrt(square, out=step)
                    own.flat += g
                    seen += len(some)
            yield _weight_rows([(b, lane, seen, own.flat[b * BLOCK:(b + 1) * BLOCK].astype(np.float64) * seen)
                                for b in range(-(-Net.size() // BLOCK))] if seen else [])

        parts = docs.select(docs[text_col].alias("text")).mapInArrow(run, "block int, lane int, n long, w binary")
        total = written(_summed(_summed(parts, ["block", "lane"]), ["block"]), f"weights-{number}")
        flat = net.flat.copy()
        for r in total.collect():  # as large as the model
            flat[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["w"], np.float64) / r["n"]
        net = Net(flat)
    return net


def score(docs: DataFrame, net: Net, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``log_likelihood`` (sum over all words
    of the whole text) and ``mean_log_likelihood``.

    A word of id 0 has P(id 0) times its share of that id's occurrences; a word
    that the vocabulary has never met counts as if it had occurred once.

    Null, empty and blank texts: no words, 0.0 and a null mean. Repeated rows
    each give a row; a null id stays null; extra columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast((net.flat, words))
    split = words.others is not None
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, vocabulary = sent.value
        own, row = Net(flat), TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", SCAN_BYTES):
            hashes, first = word_hashes(*text_buffer(batch.column(1)))
            ids = vocabulary.ids(hashes)
            logs = np.zeros(len(ids) + 1)
            for at in range(0, len(ids), SCORE_ROWS):
                places = np.arange(at, min(at + SCORE_ROWS, len(ids)))
                logs[places] = own.log_probabilities(contexts(ids, first, places), ids[places])
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            if split:
                places = np.flatnonzero(ids == 0)
                shares, rest = vocabulary.log_shares(hashes[places])
                logs[places] += shares
                places = places[rest]
                yield _other_words(rows[np.searchsorted(first, places, "right") - 1], hashes[places], batch.column(0).type)
            n = np.diff(first)
            total = np.where(n > 0, np.add.reduceat(logs, first[:-1]), 0.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column(0), pa.array(n, pa.int64()), pa.array(total), pa.nulls(len(rows), pa.int64())],
                names=["row", "key", "n", "logs", "word"])

    # of every text a row, and of every word that it has yet to get the count of (and no key)
    out = (docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
           .mapInArrow(run, f"row long, key {kind.simpleString()}, n long, logs double, word long"))
    if split:
        out = written(out, "scores")
    texts = out.where(F.col("word").isNull()).drop("word")
    if split:
        # a word that occurs once adds log 1
        counts = words.others.where((F.col("n") > 1) & (F.col("n") * HOT_SHARE < words.total))
        counts = counts.select("word", (F.log("n") * UNIT).cast("long").alias("log_count"))
        more = (out.where(F.col("word").isNotNull()).select("row", "word", "n").join(counts, "word")
                .groupBy("row").agg((F.sum(F.col("n") * F.col("log_count")) / UNIT).alias("more")))
        texts = (texts.join(more, "row", "left")
                 .withColumn("logs", F.col("logs") + F.coalesce(F.col("more"), F.lit(0.0))))
    return texts.select(F.col("key").alias(id_col), F.col("n").alias("n_words"), F.col("logs").alias("log_likelihood"),
                        F.when(F.col("n") > 0, F.col("logs") / F.col("n")).alias("mean_log_likelihood"))


def _other_words(rows: np.ndarray, hashes: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """(row, null key, n, null, word): each word of each text once."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[at]), pa.nulls(len(at), kind), pa.array(np.diff(at, append=len(rows)), pa.int64()),
         pa.nulls(len(at), pa.float64()), pa.array(hashes[at].view(np.int64))], names=["row", "key", "n", "logs", "word"])


def masked_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fits on all texts and scores all texts; an empty table gives no rows."""
    words = vocabulary(docs, text_col)
    return score(docs, train(docs, words, text_col), words, id_col, text_col)
