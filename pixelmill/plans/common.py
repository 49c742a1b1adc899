"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.functions.hashing import sql_hash_uniform
from pixelmill.operators import sampling as B
from pixelmill.operators.labels import binary_label
from pixelmill.sources.tables import table

DIGITS = 6


class Registry:
    """Named queries of one module and their optional DuckDB twins."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict = {}

    def __call__(self, name: str, sql: str | None = None):
        def deco(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql.strip()
            return fn
        return deco

    def add(self, name: str, fn, sql: str | None = None) -> None:
        self(name, sql)(fn)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column for cross-engine comparison (sums of
    doubles differ in the last bits when the order of addition differs)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def severity_frame(spark, sf_dir: str) -> DataFrame:
    """Embeddings as a labelled sample table: ``label % 5`` stands in for the
    0-4 severity grade and P1 derives the binary target from it."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", (F.col("label") % 5).alias("severity")).withColumn(
        "label", binary_label("severity"))


SQL_SEVERITY = ("(SELECT vec_id, embedding, label % 5 AS severity, "
                "CASE WHEN label % 5 >= 1 THEN 1 ELSE 0 END AS label FROM embeddings)")


SPLIT_SEED = 42


def sql_split(key: str) -> str:
    """The hash split of a key in DuckDB."""
    u = sql_hash_uniform(SPLIT_SEED, key)
    c = B.split_thresholds((0.7, 0.1, 0.2))
    return f"CASE WHEN {u} < {c[0]!r} THEN 'train' WHEN {u} < {c[1]!r} THEN 'val' ELSE 'test' END"


# the seven Hu invariants for DuckDB, from normalised central moments n20 .. n03
SQL_HU = [
    "n20 + n02",
    "(n20 - n02) * (n20 - n02) + 4 * n11 * n11",
    "(n30 - 3 * n12) * (n30 - 3 * n12) + (3 * n21 - n03) * (3 * n21 - n03)",
    "(n30 + n12) * (n30 + n12) + (n21 + n03) * (n21 + n03)",
    "(n30 - 3 * n12) * (n30 + n12) * ((n30 + n12) * (n30 + n12) - 3 * (n21 + n03) * (n21 + n03))"
    " + (3 * n21 - n03) * (n21 + n03) * (3 * (n30 + n12) * (n30 + n12) - (n21 + n03) * (n21 + n03))",
    "(n20 - n02) * ((n30 + n12) * (n30 + n12) - (n21 + n03) * (n21 + n03))"
    " + 4 * n11 * (n30 + n12) * (n21 + n03)",
    "(3 * n21 - n03) * (n30 + n12) * ((n30 + n12) * (n30 + n12) - 3 * (n21 + n03) * (n21 + n03))"
    " - (n30 - 3 * n12) * (n21 + n03) * (3 * (n30 + n12) * (n30 + n12) - (n21 + n03) * (n21 + n03))",
]
