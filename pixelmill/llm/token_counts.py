"""Token counts: pieces are counted once per distinct pre-token, joined to the
pre-token frequencies of each document and summed; ids are never materialised.

1. One pass over all texts gives the corpus frequency of every pre-token.
2. The tokenizer encodes every distinct pre-token once and alone.
3. A second pass turns each document into pre-token frequencies. Pre-tokens
   that hold at least one in ``HOT_SHARE`` of all occurrences (so there are at
   most ``HOT_SHARE`` of them, whatever the input) are looked up in a broadcast
   table; the others are joined by a shuffle, in which no key can be hot.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import slices, written

BATCH_BYTES = 8 << 20
#: A pre-token is broadcast if it makes up one occurrence in so many or more.
HOT_SHARE = 1 << 20
#: ... and has at most so many bytes.
HOT_BYTES = 64
#: Distinct pre-tokens that a task counts before it hands its counts on; those of more
#: characters are handed on with their batch.
COUNTER_ENTRIES = 400_000
COUNTER_CHARS = 64


class PreTokens:
    """Splits texts as a byte-level tokenizer file does: at its added tokens
    first, then by the splitting pattern."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level tokenizers without normaliser or prefix space are supported")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in white space or whole words are not supported")
        self.added = sorted({t["content"] for t in added}, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.pattern = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        if not any(a in text for a in self.added):
            return self.pattern.findall(text)
        out = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.pattern.findall(part)
        return out


_made: dict[tuple, object] = {}


def _splitter(vocabulary: str, pattern: str) -> PreTokens:
    key = ("split", vocabulary, pattern, os.path.getmtime(vocabulary))
    if key not in _made:
        _made[key] = PreTokens(vocabulary, pattern)
    return _made[key]


def _tokenizer(vocabulary: str):
    key = ("tokenizer", vocabulary, os.path.getmtime(vocabulary))
    if key not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        made = Tokenizer.from_file(vocabulary)
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        _made[key] = made
    return _made[key]


def pretoken_frequencies(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(piece, n): every distinct pre-token of all texts and its occurrences."""

    def flush(counter: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.string()),
                                           pa.array(counter.values(), pa.int64())], names=["piece", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counter = _splitter(vocabulary, pattern), Counter()
        for batch in slices(batches, "text", BATCH_BYTES):
            for text in batch.column(0).to_pylist():
                if text:
                    counter.update(split(text))
            long = {p: counter.pop(p) for p in [p for p in counter if len(p) > COUNTER_CHARS]}
            if long:
                yield flush(long)
            if len(counter) > COUNTER_ENTRIES:
                yield flush(counter)
                counter = Counter()
        yield flush(counter)

    return (docs.select(docs[text_col].alias("text")).mapInArrow(run, "piece string, n long")
            .groupBy("piece").agg(F.sum("n").alias("n")))


def piece_counts(frequencies: DataFrame, vocabulary: str) -> DataFrame:
    """(piece, n, pieces): ``pieces`` is the number of tokens of the pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _tokenizer(vocabulary)
        for batch in slices(batches, "piece", BATCH_BYTES):
            said = made.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x.ids) for x in said], pa.int64())],
                names=["piece", "n", "pieces"])

    return frequencies.select("piece", "n").mapInArrow(run, "piece string, n long, pieces long")


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (more than ``limit`` tokens), without begin, end or padding tokens.

    Null and empty texts: 0 bytes, 0 tokens. Repeated rows each give a row; a
    null id stays null. Whole texts are read, however long; an empty table gives no
    rows. Extra columns are not read."""
    spark = docs.sparkSession
    pieces = written(piece_counts(pretoken_frequencies(docs, vocabulary, pattern, text_col), vocabulary),
                     "pre-tokens")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    common = pieces.where((F.col("n") * HOT_SHARE >= total) & (F.octet_length("piece") <= HOT_BYTES))
    hot = spark.sparkContext.broadcast({r[0]: r[1] for r in common.select("piece", "pieces").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, get = _splitter(vocabulary, pattern), hot.value.get
        for batch in slices(batches, "text", BATCH_BYTES):
            partial, rare, times = [], [], []
            for text in batch.column("text").to_pylist():
                parts = split(text) if text else []
                found = list(map(get, parts))
                if None in found:
                    rest = Counter([p for p, v in zip(parts, found) if v is None])
                    partial.append(sum([v for v in found if v is not None]))
                    rare.append(list(rest.keys()))
                    times.append(list(rest.values()))
                else:
                    partial.append(sum(found))
                    rare.append([])
                    times.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("key"),
                 pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64()),
                 pa.array(partial, pa.int64()), pa.array(rare, pa.list_(pa.string())),
                 pa.array(times, pa.list_(pa.int64()))],
                names=["row", "key", "n_bytes", "partial", "rare", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    per_row = (docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("key"),
                           docs[text_col].alias("text"))
               .mapInArrow(run, f"row long, key {kind}, n_bytes long, partial long, "
                                "rare array<string>, times array<long>"))
    # a row without rare pre-tokens keeps one line, under a key of its own that matches nothing
    lines = (per_row.select("row", "key", "n_bytes", "partial", F.explode_outer(F.arrays_zip("rare", "times")).alias("x"))
             .select("row", "key", "n_bytes", "partial", F.col("x.times").alias("times"),
                     F.coalesce("x.rare", F.concat(F.lit("\x00"), F.col("row").cast("string"))).alias("piece")))
    summed = (lines.join(pieces.select("piece", "pieces"), "piece", "left")
              .groupBy("row", "key", "n_bytes", "partial")
              .agg(F.coalesce(F.sum(F.when(F.col("times").isNotNull(), F.col("times") * F.col("pieces"))),
                              F.lit(0)).alias("rest")))
    n = F.col("partial") + F.col("rest")
    return summed.select(F.col("key").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
