"""Splitting, class balancing and class weights.

All randomness is a hash of (seed, source key), so:
* a row's split is fixed by its source id: copies made by oversampling always
  land in the same split as their original (no train/test leak);
* results do not depend on partitioning or on task retries.

Per-class parameters are aggregated to one row per class and joined back.
The number of classes is the size bound of those tables (checked), so they are
broadcast; nothing else is.

Rows without a class (null label) belong to no class: they are neither counted
nor returned by the balancing and weighting operators; :func:`without_class`
gives them as a table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.functions.hashing import hash_uniform
from pixelmill.session import scratch_path


MAX_GROUPS = 10_000


def bounded_table(df: DataFrame, max_rows: int = MAX_GROUPS) -> DataFrame:
    """Compute a small per-class / per-group table once and return it as a
    local relation, so that later branches broadcast it instead of re-running
    the aggregation (and re-scanning the input) each time. The row bound is
    checked: a table over ``max_rows`` is an error, never a silent broadcast."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} groups, found more")
    return df.sparkSession.createDataFrame(rows, df.schema)


# --- B3 / A2 -----------------------------------------------------------------

def split_thresholds(weights) -> list[float]:
    """Cumulative cut points of normalised weights (all but the last)."""
    total = float(sum(weights))
    cuts, acc = [], 0.0
    for w in weights[:-1]:
        acc += w / total
        cuts.append(acc)
    return cuts


def hash_split(df: DataFrame, key: str, seed=42,
               weights=(0.7, 0.1, 0.2), names=("train", "val", "test"),
               out: str = "split") -> DataFrame:
    """One hash-uniform draw per source key, cut at the cumulative weights.

    Equivalent in distribution to ``randomSplit([0.8, 0.2])`` followed by
    ``randomSplit([0.875, 0.125])`` on the first part, but one narrow pass."""
    u = hash_uniform(seed, key)
    expr = None
    for cut, name in zip(split_thresholds(weights), names[:-1]):
        expr = (F.when(u < F.lit(cut), F.lit(name)) if expr is None
                else expr.when(u < F.lit(cut), F.lit(name)))
    expr = expr.otherwise(F.lit(names[-1])) if expr is not None else F.lit(names[-1])
    return df.withColumn(out, expr)


def split_counts(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """A2: rows per (split, class) in one aggregation instead of one job each."""
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))


# --- P4 / W2 ---------------------------------------------------------------------

def class_subset(df: DataFrame, label: str, value) -> DataFrame:
    """Rows of one class (pushed to the scan when the label is a column)."""
    return df.where(F.col(label) == F.lit(value))


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union-all by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


# --- A4 / B4 ---------------------------------------------------------------------

def without_class(df: DataFrame, label: str = "label") -> DataFrame:
    """The rows that have no class."""
    return df.where(F.col(label).isNull())


def _class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def balance_targets(df: DataFrame, label: str = "label", factor: float = 2.0) -> DataFrame:
    """A4: per class: count, target = floor(factor * largest class count) and
    the sampling fraction target / count. Empty classes do not appear, so there
    is no division by zero. Lazy; the window runs over one row per class."""
    largest = F.max("n").over(Window.partitionBy())
    return (_class_counts(df, label)
            .withColumn("target", F.floor(largest * F.lit(float(factor))).cast("long"))
            .withColumn("fraction", F.col("target") / F.col("n")))


def class_weights(df: DataFrame, label: str = "label", out: str = "class_weight") -> DataFrame:
    """B4: 'balanced' weights n / (k * n_c) attached to every row that has a class."""
    counts = bounded_table(_class_counts(df, label))
    rows = counts.collect()
    n, k = sum(r["n"] for r in rows), len(rows)
    weights = counts.select(label, (F.lit(float(n)) / (F.lit(k) * F.col("n"))).alias(out))
    return df.join(F.broadcast(weights), on=label, how="inner")


# --- copies, spread across tasks ---------------------------------------------------

COPY_CHUNK = 1 << 14


def replicate(df: DataFrame, count_col: str, keys: list[str], out: str = "copy",
              chunk: int = COPY_CHUNK, max_count: int | None = None) -> DataFrame:
    """Each row repeated ``count_col`` times, numbered 1..count (long) in ``out``.

    Rows needing at most ``chunk`` copies are expanded where they are. A row
    needing more (a tiny class oversampled to a huge target) is first cut into
    chunk descriptors, which are hash-distributed by (keys, chunk) before being
    expanded, so the copies of one row never pile up in one task. Both ways give
    the same rows, columns and types; ``max_count`` only tells that the second is not needed."""
    n = F.col(count_col).cast("long")
    one = F.lit(1).cast("long")
    light = df.where((n > 0) & (n <= chunk)).withColumn(out, F.explode(F.sequence(one, n)))
    if max_count is not None and max_count <= chunk:
        return light
    size = F.lit(chunk).cast("long")
    heavy = (df.where(n > chunk)
             .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size).cast("long"))))
             .repartition(*[F.col(k) for k in keys], F.col("_chunk"))
             .withColumn(out, F.explode(F.sequence(F.col("_chunk") * size + 1,
                                                   F.least((F.col("_chunk") + 1) * size, n))))
             .drop("_chunk"))
    return light.unionByName(heavy)


# --- W1: exact per-group top-k by hash, without a per-group single task ---------

#: Rows that the bucket of a group's cut holds on average.
EDGE_ROWS = 4096


def rank_cuts(rows: DataFrame, group: str, order: str, ties: list[str], sizes: DataFrame,
              k_col: str = "k", n_col: str = "n") -> DataFrame:
    """Per group the place in (order, *ties) up to which its ``k`` smallest rows
    reach: (group, _all, _cut). ``_all`` means the whole group, no cut none of it.

    ``order`` is a uniform [0, 1) column. Rows are counted in even buckets of
    it, as many per group as give ``EDGE_ROWS`` rows each; the bucket of the k-th row
    is found on the counts and only that one is ranked. ``sizes``: one row per
    group (group, k, n), a checked small table, as is the result."""
    sized = F.broadcast(sizes.select(group, F.col(k_col).cast("long").alias("_k"), F.col(n_col).cast("long").alias("_n")))
    buckets = F.ceil(F.col("_n") / F.lit(EDGE_ROWS))
    b = (rows.select(group, order, *ties).join(sized, group)
         .withColumn("_bucket", F.floor(F.col(order) * buckets).cast("long")))
    upto = F.sum("_c").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    reach = (b.groupBy(group, "_bucket", "_k").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", upto)
             .where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k")))
             .select(group, F.col("_bucket").alias("_edge"), (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_need")))
    edges = bounded_table(reach)
    place = Window.partitionBy(group).orderBy(order, *ties)
    cut = (b.join(F.broadcast(edges), group).where(F.col("_bucket") == F.col("_edge"))
           .withColumn("_r", F.row_number().over(place)).where(F.col("_r") == F.col("_need"))
           .select(group, F.struct(order, *ties).alias("_cut")))
    return bounded_table(sizes.join(cut, group, "left").select(
        group, (F.col(k_col) >= F.col(n_col)).alias("_all"), "_cut"))


def up_to_cut(df: DataFrame, cuts: DataFrame, group: str, order: str, ties: list[str]) -> DataFrame:
    """The rows of ``df`` within the cuts of :func:`rank_cuts`: one narrow pass."""
    inside = F.col("_all") | F.coalesce(F.struct(order, *ties) <= F.col("_cut"), F.lit(False))
    return df.join(F.broadcast(cuts), group).where(inside).drop("_all", "_cut")


def smallest_per_group(df: DataFrame, group: str, order: str, ties: list[str],
                       k: DataFrame, k_col: str = "k") -> DataFrame:
    """Keep, per ``group``, the ``k`` rows with the smallest (order, *ties)."""
    sizes = bounded_table(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).join(k.select(group, k_col), group))
    return up_to_cut(df, rank_cuts(df, group, order, ties, sizes, k_col), group, order, ties).select(*df.columns)


# --- B1: Poisson bootstrap --------------------------------------------------------

def poisson_table(lam: float) -> tuple[int, list[float]]:
    """(least, cumulative): P(X <= least + i) of a Poisson variable, over the
    24 standard deviations around its mean that hold all but 1e-30 of it."""
    if lam <= 0:
        return 0, [1.0]
    width = 12.0 * math.sqrt(lam) + 12.0
    least, most = max(0, math.floor(lam - width)), math.ceil(lam + width)
    j = np.arange(least, most + 1, dtype=np.float64)
    log_j = np.log(np.maximum(j, 1.0))
    # log j! from the first value on, so that no large factorial is formed
    log_p = -lam + j * math.log(lam) - (math.lgamma(least + 1) + np.concatenate([[0.0], np.cumsum(log_j[1:])]))
    return least, np.cumsum(np.exp(log_p)).tolist()


def _draws(spark, params: list, label_field: T.StructField) -> DataFrame:
    """(label, least, cumulative) per class: the lookup of its Poisson draws."""
    schema = T.StructType([label_field, T.StructField("_least", T.LongType()),
                           T.StructField("_cumulative", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame([(r[label_field.name], *poisson_table(r["fraction"])) for r in params], schema)


def bootstrap_balance(df: DataFrame, key: str, label: str = "label", factor: float = 2.0,
                      seed: int = 42) -> DataFrame:
    """B1: oversample every class with replacement toward ``factor`` x the
    largest class, then cap each class at that target.

    Each row gets Poisson(target / n_c) copies from its own hash draw, looked up
    in a cumulative table of its class; the cap keeps the copies with the
    smallest order hash per class. The narrow rows (key, class, copy, order) are
    drawn and written once, the cut of each class is found on them, and one
    pass over the input then expands the copies up to the cut. Output adds
    ``copy`` (long, from 1)."""
    spark = df.sparkSession
    df = df.where(F.col(label).isNotNull())
    targets = bounded_table(balance_targets(df, label, factor))
    params = targets.collect()
    draws = F.broadcast(_draws(spark, params, df.schema[label]))
    most = max((len(poisson_table(r["fraction"])[1]) + poisson_table(r["fraction"])[0] for r in params), default=0)

    def copies(rows: DataFrame) -> DataFrame:
        u = hash_uniform(seed, key)
        drawn = (rows.join(draws, label).withColumn("_u", u)
                 .withColumn("_k", F.col("_least") + F.size(F.filter("_cumulative", lambda c: c <= F.col("_u"))))
                 .drop("_least", "_cumulative", "_u"))
        return (replicate(drawn, "_k", [key], max_count=most).drop("_k")
                .withColumn("_o", hash_uniform(f"{seed}:order", key, "copy")))

    path = scratch_path(spark, "drawn-copies")
    copies(df.select(key, label)).write.parquet(path)
    narrow = spark.read.parquet(path)
    sizes = bounded_table(narrow.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
                          .join(F.broadcast(targets.select(label, F.col("target").alias("k"))), label))
    cuts = rank_cuts(narrow, label, "_o", [key, "copy"], sizes)
    return up_to_cut(copies(df), cuts, label, "_o", [key, "copy"]).select(*df.columns, "copy")


def exact_balance(df: DataFrame, key: str, label: str = "label", factor: float = 2.0,
                  seed: int = 42) -> DataFrame:
    """B2: exactly ``target`` rows per class: every row ``target // n_c`` times,
    plus the ``target % n_c`` rows with the smallest hash once more. The cut of
    each class is found on keys and classes alone; one pass over the input then
    expands every row to its copies (numbered from 1, long)."""
    df = df.where(F.col(label).isNotNull())
    targets = bounded_table(balance_targets(df, label, factor)
                            .withColumn("whole", F.floor(F.col("target") / F.col("n")).cast("long"))
                            .withColumn("k", F.col("target") - F.col("whole") * F.col("n")))
    order = hash_uniform(seed, key)
    narrow = df.select(key, label).withColumn("_o", order)
    cuts = rank_cuts(narrow, label, "_o", [key], targets)
    more = F.coalesce(F.struct("_o", key) <= F.col("_cut"), F.lit(False))
    most = max([r["whole"] for r in targets.collect()], default=0) + 1
    counted = (df.withColumn("_o", order).join(F.broadcast(targets.select(label, "whole").join(cuts, label)), label)
               .withColumn("_k", F.col("whole") + F.when(more, F.lit(1)).otherwise(F.lit(0))))
    return replicate(counted, "_k", [key], max_count=most).select(*df.columns, "copy")
