"""How five text filters act on each other, from a sparse document-term matrix.

All words of all texts get codes from one global dictionary: a word's code is
its 63-bit hash, and words that share a hash (found by grouping all words by their
hash) get codes of their own, so that codes and words correspond one to one and
a text is encoded without a join. Documents become rows of a document-term matrix
in CSR shards; a row's sum is its number of words and its number of nonzeros that of
its distinct words, which decide filters A and B. The other flags are attached,
documents are counted by the set of filters they fail, and all orders of the filters
are read off these counts.

Filters, each a failure: A under 200 words; B fewer distinct words than half of all
words; C capitals A-Z above 2% of the code points; D a sign of ``#$%&*|``; E the text
of a smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import SpanHash, multi_arange, slices, text_buffer, word_spans, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT = 200, 50, 2
SIGNS = b"#$%&*|"
#: Text bytes of one CSR shard. The work on a shard takes some 40 times its bytes (hashes are
#: eight bytes a character), and two workers a task do it.
SHARD_BYTES = 1 << 20
#: Words that share a hash with another word and are broadcast, at most (2**32 random
#: words hold 0.5 such words, 2**40 some 33,000).
MAX_SHARED = 1 << 18
CODE_BITS = np.uint64((1 << 63) - 1)
OWN_CODE = -(1 << 63)
SHARD = ("doc_id array<long>, part array<string>, sha array<binary>, failed array<int>, "
         "n int, row_start binary, columns binary, counts binary")


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (SpanHash(data)(start, end) & CODE_BITS).view(np.int64)


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The spans as one binary array."""
    flat = data[multi_arange(start, length)]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SHARD_BYTES):
        data, offsets = text_buffer(batch.column("text"))
        start, end, _ = word_spans(data, offsets)
        if not len(start):
            continue
        code = _hashes(data, start, end)
        order = np.argsort(code, kind="stable")
        sorted_code, s, length = code[order], start[order], (end - start)[order]
        head = np.concatenate([[True], sorted_code[1:] != sorted_code[:-1]])
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        # words that differ from the first of their hash are told as well
        odd = length != length[first]
        size = np.where(odd, 0, length)
        differs = data[multi_arange(s, size)] != data[multi_arange(s[first], size)]
        odd[np.repeat(np.arange(len(s)), size)[differs]] = True
        told = np.flatnonzero(head | odd)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sorted_code[told]), _gather(data, s[told], length[told]).cast(pa.binary())], names=["hash", "word"])


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(hash, word): the distinct words of all texts, as bytes, and their hashes."""
    return docs.select(docs[text_col].alias("text")).mapInArrow(_distinct_words, "hash long, word binary").distinct()


def shared_codes(words: DataFrame) -> dict[bytes, int]:
    """Codes of the words that share a hash with a lesser word."""
    crowded = words.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    crowded = written(crowded, "shared-hashes")
    if crowded.isEmpty():
        return {}
    rows = words.join(crowded, "hash").limit(MAX_SHARED + 1).collect()
    if len(rows) > MAX_SHARED:
        raise ValueError(f"more than {MAX_SHARED} words share their hash with another word")
    least: dict[int, bytes] = {}
    for r in rows:
        least[r["hash"]] = min(least.get(r["hash"], bytes(r["word"])), bytes(r["word"]))
    # hashes are never negative, so these codes are free
    return {w: OWN_CODE + i for i, w in enumerate(sorted(bytes(r["word"]) for r in rows if bytes(r["word"]) != least[r["hash"]]))}


def csr_shards(docs: DataFrame, codes: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text",
               part_col: str = "source") -> DataFrame:
    """Shards of the document-term matrix: per document its id, part, the SHA-256 of
    its text and the bits of the filters C and D that it fails (``doc_id``, ``part``,
    ``sha``, ``failed``), then the rows in CSR form (``row_start``: n + 1 int64,
    ``columns``: word codes as int64, ``counts``: int32)."""
    sent = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        crowded = None
        for batch in slices(batches, "text", SHARD_BYTES):
            data, offsets = text_buffer(batch.column("text"))
            start, end, first = word_spans(data, offsets)
            code = _hashes(data, start, end)
            if own:
                if crowded is None:
                    crowded = np.array(sorted({_word_hash(w) for w in own}), np.int64)
                for i in np.flatnonzero(np.isin(code, crowded)).tolist():
                    code[i] = own.get(data[start[i]:end[i]].tobytes(), code[i])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            order = np.lexsort((code, owner))
            code, owner = code[order], owner[order]
            head = np.ones(len(code), bool)
            head[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(head)
            counts = np.diff(np.append(at, len(code))).astype(np.int32)
            row_start = np.searchsorted(owner[at], np.arange(batch.num_rows + 1)).astype(np.int64)
            total = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets])
            capitals = total((data >= 0x41) & (data <= 0x5A))
            points = total((data & 0xC0) != 0x80)
            signs = total(np.isin(data, np.frombuffer(SIGNS, np.uint8)))
            failed = (4 * (100 * capitals > MAX_CAPITALS_PCT * points) + 8 * (signs > 0)).astype(np.int32)
            whole = pa.array([0, batch.num_rows], pa.int32())
            one = lambda x: pa.array([x.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[pa.ListArray.from_arrays(whole, pa.concat_arrays([batch.column(c)])) for c in ("doc_id", "part", "sha")],
                 pa.ListArray.from_arrays(whole, pa.array(failed)), pa.array([batch.num_rows], pa.int32()),
                 one(row_start), one(code[at]), one(counts)],
                names=["doc_id", "part", "sha", "failed", "n", "row_start", "columns", "counts"])

    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col], F.lit("")).alias("part"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), text.alias("text"))
    return rows.mapInArrow(run, SHARD)


def _word_hash(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(_hashes(data, np.array([0]), np.array([len(data)]))[0])


def document_rows(shards: DataFrame) -> DataFrame:
    """(doc_id, part, sha, failed, words, distinct_words): one row per document, the
    bits of A and B set from its row sum and number of nonzeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row_start = np.frombuffer(batch.column("row_start")[i].as_py(), np.int64)
                counts = np.frombuffer(batch.column("counts")[i].as_py(), np.int32)
                words = np.diff(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[row_start])
                distinct = np.diff(row_start)
                failed = (batch.column("failed")[i].values.to_numpy() | (words < MIN_WORDS)
                          | 2 * (100 * distinct < MIN_DISTINCT_PCT * words)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c)[i].values for c in ("doc_id", "part", "sha")], pa.array(failed), pa.array(words), pa.array(distinct)],
                    names=["doc_id", "part", "sha", "failed", "words", "distinct_words"])

    return shards.mapInArrow(run, "doc_id long, part string, sha binary, failed int, words long, distinct_words long")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "source") -> DataFrame:
    """(part, failed, n, good, toxic): documents by the set of filters that they fail
    (bit i: filter i of ``FILTERS``), and how many of them are labelled good and toxic.

    Null texts count as empty, null parts as the empty string. Rows that repeat an id
    are each counted. A null id is neither smaller than another nor larger, and has
    no label; an id with several labels is good (toxic) if any of them says so.
    Texts are compared by their SHA-256; extra columns are not read."""
    codes = shared_codes(dictionary(docs, text_col))
    rows = document_rows(csr_shards(docs, codes, id_col, text_col, part_col))
    # rows that repeat everything are one with a count, so that no id or text is a hot key
    rows = rows.groupBy("doc_id", "sha", "part", "failed").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows, "document-flags")
    firsts = rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.groupBy(labels[id_col].cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    flagged = rows.join(firsts, ["doc_id", "sha"], "left").join(marks, "doc_id", "left").select(
        "part", F.col("failed").bitwiseOR(F.when(later, 16).otherwise(0)).alias("failed"), "n",
        (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return flagged.groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(counts: DataFrame) -> DataFrame:
    """All orders of the filters over a table of :func:`failure_counts`, per part:
    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley). One row per part, order and step, zeros included. Only a part's
    counts (at most 32 rows) are shuffled. An empty table gives no rows."""
    n_orders = factorial(len(FILTERS))
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    steps = (counts.repartition("part").withColumn("filter_order", F.explode(orders))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))))
    bit = lambda place: f"shiftleft(1, ascii(substr(filter_order, {place}, 1)) - {ord(FILTERS[0])})"
    before = " + ".join(f"if(step > {i}, {bit(i)}, 0)" for i in range(1, len(FILTERS)))
    steps = steps.withColumn("own", F.expr(bit("step"))).withColumn("before", F.expr(before))
    bad = F.col("failed").bitwiseAND(F.col("own")) != 0
    gone = F.col("failed").bitwiseAND(F.col("before")) != 0
    total = lambda which, value="n": F.sum(F.when(which, F.col(value)).otherwise(0))
    # a document that fails k filters is removed by each of them in 120 / k orders
    share = (F.col("n") * F.lit(n_orders) / F.bit_count("failed")).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~bad & ~gone).alias("kept"), total(bad & ~gone).alias("removed"), total(bad & gone).alias("redundant"),
        total(F.col("failed") == F.col("own")).alias("unique_fails"),
        total(bad & ~gone, "good").alias("good_lost"), total(bad & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(bad, share).otherwise(0)).alias("shapley"))
