"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become hashed byte trigram frequencies (log, inverse document frequency,
unit length) and three shares that describe their form, and are projected on the
leading singular directions of a bounded sample of labelled texts. The labelled vectors are broadcast; every document is
compared with all of them in exact blocked cosine products, and its nearest
neighbours vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import SpanHash, slices, text_buffer, word_spans

#: Labelled texts of each label that the model is fitted on, at most.
SAMPLE_PER_LABEL = 2048
BUCKETS = 2048
DIMENSIONS = 48
NEIGHBOURS = 15
#: Similarities are raised to this power as vote weights.
SHARPNESS = 8.0
#: Similarities are told apart in steps of 2**-20; of equals, voters that come first count.
STEPS = 1 << 20
THRESHOLD = 0.7
#: Weights of the shares: words equal to the word before, capitals, ASCII signs.
FORM_WEIGHTS = (2.0, 1.0, 1.0)
WIDTH = BUCKETS + len(FORM_WEIGHTS)
BATCH_BYTES = 1 << 20
BATCH_ROWS = 1024


def trigram_counts(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed byte trigram counts, one row per text; no trigram crosses texts."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, buckets), np.float32)
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - int(buckets).bit_length() + 1)
    owner = np.repeat(np.arange(n), np.diff(offsets))[:-2]
    whole = np.arange(2, len(data)) < offsets[1:][owner]
    flat = owner[whole] * buckets + code[whole]
    return np.bincount(flat, minlength=n * buckets).reshape(n, buckets).astype(np.float32)


def form_shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, 0 to 1: words that equal the word before them, ASCII capitals
    among all bytes, ASCII signs among all bytes."""
    start, end, first = word_spans(data, offsets)
    value = SpanHash(data)(start, end)
    again = np.zeros(len(value) + 1, np.int64)
    if len(value) > 1:
        same = value[1:] == value[:-1]
        inner = first[(first > 0) & (first < len(value))]
        same[inner - 1] = False  # the first word of a text has none before it
        again[2:] = np.cumsum(same)
    capital = (data >= 0x41) & (data <= 0x5A)
    sign = (data > 0x20) & (data < 0x7F) & ~capital & ~((data >= 0x61) & (data <= 0x7A)) & ~((data >= 0x30) & (data <= 0x39))
    share = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets]) / np.maximum(np.diff(offsets), 1)
    return np.stack([np.diff(again[first]) / np.maximum(np.diff(first), 1), share(capital), share(sign)], 1).astype(np.float32)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts, then the weighted shares."""
    return np.concatenate([trigram_counts(data, offsets), form_shares(data, offsets) * np.float32(FORM_WEIGHTS)], axis=1)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    terms = _unit(np.log1p(raw[:, :len(idf)]) * idf)
    return np.concatenate([terms, raw[:, len(idf):]], axis=1)


@dataclass
class Voters:
    """The fitted model: a few MB, whatever the size of the corpus."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, raw: np.ndarray) -> np.ndarray:
        return _unit(weighted(raw, self.idf).astype(np.float64) @ self.basis)

    def scores(self, latent: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors; the share of label 1 where
        nothing is similar (as for an empty text)."""
        if not len(self.labels):
            return np.full(len(latent), self.prior)
        cosine = latent @ self.vectors.T
        n = len(self.labels)
        k = min(NEIGHBOURS, n)
        # ties go to the voter that comes first, so no two ranks are equal; what is
        # summed and in which order does not depend on the batch
        step = np.rint(cosine * STEPS).astype(np.int64)
        near = np.sort(np.argpartition(-(step * n + (n - 1 - np.arange(n))), k - 1, axis=1)[:, :k], axis=1)
        weight = np.maximum(np.take_along_axis(step, near, 1) / STEPS, 0) ** SHARPNESS
        total = weight.sum(1)
        voted = (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, voted, self.prior), 0.0, 1.0)


def _features(texts: DataFrame) -> DataFrame:
    """(key, label, features) of rows (key, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES, BATCH_ROWS):
            packed = pa.array([c.tobytes() for c in features(*text_buffer(batch.column(2)))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["key", "label", "features"])

    return texts.select("key", "label", "text").mapInArrow(run, "key string, label int, features binary")


def sampled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample_per_label: int = SAMPLE_PER_LABEL) -> tuple[DataFrame | None, dict[int, int]]:
    """(key, label, text) of up to ``sample_per_label`` ids of each label 0 and 1, one row
    for each id, and the number of ids of each label. Ids are chosen by a hash; of the rows
    that share an id, the text of least hash speaks for it. Null ids and other labels
    are left out; ids that repeat in ``labels`` count by their least label. Null texts
    count as empty."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("label")))
    sizes = {r[0]: r[1] for r in known.groupBy("label").agg(F.count(F.lit(1))).collect()}
    chosen = None
    for label in sorted(sizes):
        some = (known.where(F.col("label") == label).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample_per_label))
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return None, sizes
    texts = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    one = texts.groupBy("_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("x"))
    return one.select(F.col("_id").cast("string").alias("key"), "label", "x.text"), sizes


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample_per_label: int = SAMPLE_PER_LABEL) -> Voters:
    """Fits on the rows of :func:`sampled_texts`: what reaches the driver is bounded by
    ``sample_per_label`` rows of each label, whatever repeats. Without labels, every
    text scores one half."""
    texts, sizes = sampled_texts(docs, labels, id_col, text_col, label_col, sample_per_label)
    rows = sorted(_features(texts).collect(), key=lambda r: (r["key"], r["label"])) if texts is not None else []
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    if not rows:
        return Voters(np.ones(BUCKETS, np.float32), np.eye(WIDTH, 1),
                      np.zeros((0, 1)), np.zeros(0), prior)
    classes = np.array([r["label"] for r in rows], np.float64)
    raw = np.empty((len(rows), WIDTH), np.float32)
    for i in range(len(rows)):
        raw[i], rows[i] = np.frombuffer(rows[i]["features"], np.float32), None
    parts = range(0, len(raw), BATCH_ROWS)  # the driver holds one copy of the sample
    idf = np.log((1 + len(raw)) / (1 + sum((raw[i:i + BATCH_ROWS, :BUCKETS] > 0).sum(0) for i in parts))).astype(np.float32) + 1
    gram = np.zeros((WIDTH, WIDTH), np.float32)
    for i in parts:
        rows = weighted(raw[i:i + BATCH_ROWS], idf)
        gram += rows.T @ rows
    _, directions = np.linalg.eigh(gram)
    basis = np.ascontiguousarray(directions[:, ::-1][:, :DIMENSIONS]).astype(np.float64)
    del gram, directions
    model = Voters(idf, basis, np.zeros((0, DIMENSIONS)), classes, prior)
    model.vectors = np.concatenate([model.latent(raw[i:i + BATCH_ROWS]) for i in parts])
    return model


def score(docs: DataFrame, model: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col`` and ``score`` (0 to 1), from the whole text alone.
    Null and empty texts score the share of label 1 among all labelled rows.
    Repeated rows each give a row, equal texts the same score; ids, null ones too, are
    passed through. Whole texts are read, however long. An empty table gives no rows;
    extra columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "text", BATCH_BYTES, BATCH_ROWS):
            latent = m.latent(features(*text_buffer(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(latent), pa.float64())],
                                             names=["key", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
            .mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", id_col))


def accepted(docs: DataFrame, model: Voters, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns kept.
    One narrow pass: the score is computed next to the row it decides on."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, at, BATCH_BYTES, BATCH_ROWS):
            s = m.scores(m.latent(features(*text_buffer(batch.column(at)))))
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
