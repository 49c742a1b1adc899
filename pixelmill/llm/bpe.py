"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model file is serialised here, directly from a rank table: one piece per
token, its bytes mapped to one printable character each, scored by the negative
rank (so the best-scored merge is the lowest rank), identity normalisation, no
dummy prefix and no white-space handling. Nothing is trained.

Each match of the splitting pattern is encoded on its own. Per batch, every
distinct match is encoded once; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelmill.llm.common import slices

BATCH_BYTES = 2 << 20
#: Pieces that a worker keeps, at most, and the characters of each; a longer one is only
#: known while its batch is.
CACHE_ENTRIES = 1 << 17
CACHE_CHARS = 64
#: First code point of the 256 characters that stand for bytes (Latin Extended-A
#: onwards: no white space, nothing that sentencepiece treats specially).
FIRST_CHAR = 0x100


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_CHARS = {b: chr(FIRST_CHAR + b) for b in range(256)}


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_CHARS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protobuf field: int -> varint, float -> 32 bits, bytes -> length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Piece i is the token of rank i; the obligatory
    unknown piece comes last. Ranks must be 0 .. n - 1."""
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0 .. n - 1, each once")
    # Fixed numbers of the public model format: ModelProto.pieces 1 (piece 1,
    # score 2, type 3 with 1 normal, 2 unknown), trainer_spec 2 (model_type 3
    # with 2 BPE, unk_id 40, bos_id 41, eos_id 42, pad_id 43),
    # normalizer_spec 3 (name 1, add_dummy_prefix 3,
    # remove_extra_whitespaces 4, escape_whitespaces 5).
    absent = (1 << 64) - 1
    out = [_field(1, _field(1, to_chars(t).encode()) + _field(2, -float(i)) + _field(3, 1))
           for i, t in enumerate(ordered)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, -float(len(ordered))) + _field(3, 2)))
    out.append(_field(2, _field(3, 2) + _field(40, len(ordered)) + _field(41, absent)
                      + _field(42, absent) + _field(43, absent)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encodes texts to ids and decodes ids to bytes, one process's copy."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(vocabulary)
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.token = sorted(ranks, key=ranks.__getitem__)
        #: piece -> (number of ids, ids as text, bytes that the ids decode to)
        self.cache: dict[str, tuple[int, str, bytes]] = {}
        self.long: list[str] = []

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def learn(self, pieces: set[str]) -> dict[str, tuple[int, str, bytes]]:
        """Encodes and decodes every given distinct piece; what was met before
        is kept, up to a fixed number of entries of a fixed length."""
        for p in self.long:
            self.cache.pop(p, None)
        if len(self.cache) > CACHE_ENTRIES:
            self.cache = {}
        self.long = [p for p in pieces if len(p) > CACHE_CHARS]
        new = [p for p in pieces if p not in self.cache]
        if new:
            found = self.model.encode([to_chars(p.encode()) for p in new], out_type=int, num_threads=1)
            self.cache.update((p, (len(ids), " ".join(map(str, ids)), self.decode(ids)))
                              for p, ids in zip(new, found))
        return self.cache

    def encode(self, text: str) -> list[int]:
        parts = self.split(text)
        known = self.learn(set(parts))
        return [int(i) for p in parts for i in known[p][1].split()]

    def decode(self, ids) -> bytes:
        return b"".join([self.token[i] for i in ids])


_codecs: dict[tuple, Codec] = {}


def codec(vocabulary: str, pattern: str) -> Codec:
    """The worker's codec, built once for each vocabulary file version."""
    key = (vocabulary, pattern, os.path.getmtime(vocabulary))
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary, pattern)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Per row: ``id_col`` and ``ids`` (array<int>). A null or empty text has
    no ids; rows keep their number and repeat if they do in the input. Whole texts are
    read, however long; an empty table gives no rows; extra columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in slices(batches, "text", BATCH_BYTES):
            ids = pa.array([c.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _two(docs, id_col, text_col).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", id_col)


def decode(rows: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """Per row: ``id_col`` and ``bytes`` (binary), the bytes of its ids. Null
    ids give no bytes; an id outside the vocabulary raises IndexError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in batches:
            out = pa.array([c.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["key", "bytes"])

    kind = rows.schema[id_col].dataType.simpleString()
    return (rows.select(rows[id_col].alias("key"), rows[ids_col].alias("ids"))
            .mapInArrow(run, f"key {kind}, bytes binary").withColumnRenamed("key", id_col))


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns needed, under fixed names: extra columns of the
    input, whatever their names, never reach the Python side."""
    return docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Encodes every text, decodes its ids again and returns what both gave as
    digests: ``id_col``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by one
    space), ``decoded_sha256`` (decoded bytes). One narrow pass, no shuffle.

    Null and empty texts: 0 tokens and the digest of nothing. Repeated rows
    each give a row. A null id stays null. Whole texts are read, however long; an
    empty table gives no rows; extra columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in slices(batches, "text", BATCH_BYTES):
            split = [c.split(t) if t else [] for t in batch.column(1).to_pylist()]
            get = c.learn(set().union(*split)).__getitem__
            counts, said, decoded = [], [], []
            for parts in split:
                n, text, data = zip(*map(get, parts)) if parts else ((),) * 3
                counts.append(sum(n))
                said.append(hashlib.sha256(" ".join(text).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(data)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (_two(docs, id_col, text_col)
            .mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("key", id_col))
