"""A corpus pipeline of the operators in ``pixelmill.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is
written as Parquet and read again as the next stage's documents. All stages but
the last return the columns of ``documents``, further columns included. Whole texts are
read, however long; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelmill.llm import bpe, exact_dedup, hyperminhash, mixing, quality, queries
from pixelmill.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts score the share of
    label 1 among the labelled ids; rows with a null id are judged like others, repeated
    rows alike."""
    return quality.accepted(docs, queries.quality_model(spark, sf_dir, docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays, once. A null text is equal to an
    empty one; a null id is below all others."""
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates the document with the smallest id stays.
    Texts without words are linked with nothing and stay."""
    return hyperminhash.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: texts without words never; the
    null source is a source of its own; rows that agree in id and source go together."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of their decoding, a row for each row."""
    return bpe.digests(docs, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: The classifier's scores cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
