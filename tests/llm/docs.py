"""Small awkward tables for the corpus operators."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])


def table(spark, rows, extra=()):
    """rows: (doc_id, text[, source]); extra: names of further columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None) + tuple(range(len(extra))) for r in rows]
    schema = T.StructType(SCHEMA.fields + [T.StructField(c, T.LongType()) for c in extra])
    return spark.createDataFrame(full, schema)


LONG = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
AWKWARD = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (4, "one two"), (5, "one two"), (6, None),
           (None, "no id"), (None, None), (7, LONG), (8, LONG), (9, "naïve – ünïcödé 漢字 <|endoftext|> don't  x y"),
           (10, "a\x00b"), (11, "x" * 30_000)]
#: Names that operators use inside.
CLASHING = ("key", "row", "name", "_id", "_dropped", "_copies", "score", "copies", "label", "hash", "pos")
