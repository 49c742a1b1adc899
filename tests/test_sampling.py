import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.functions.hashing import hash_uniform
from pixelmill.operators import sampling as B


def _labelled(spark, n0=300, n1=45):
    rows = [(i, 0) for i in range(n0)] + [(n0 + i, 1) for i in range(n1)]
    return spark.createDataFrame(rows, "id long, label int")


def test_split_is_partition_and_stable(spark):
    df = _labelled(spark)
    a = {(r["id"], r["split"]) for r in B.hash_split(df, "id").collect()}
    b = {(r["id"], r["split"]) for r in B.hash_split(df.repartition(7), "id").collect()}
    assert a == b
    assert len(a) == df.count()
    splits = {s for _, s in a}
    assert splits <= {"train", "val", "test"}


def test_split_keeps_copies_together(spark):
    df = _labelled(spark)
    bal = B.exact_balance(df, "id", "label")
    s = B.hash_split(bal, "id")
    per_id = s.groupBy("id").agg(F.countDistinct("split").alias("k"))
    assert per_id.where("k > 1").count() == 0


def test_exact_balance_hits_target(spark):
    df = _labelled(spark)
    out = B.exact_balance(df, "id", "label").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in out} == {0: 600, 1: 600}


def test_smallest_per_group_matches_window(spark, monkeypatch):
    monkeypatch.setattr(B, "EDGE_ROWS", 40)
    rng = np.random.default_rng(0)
    rows = [(int(i), int(g)) for i, g in zip(range(2000), rng.integers(0, 3, 2000))]
    df = spark.createDataFrame(rows, "id long, g int").withColumn("u", hash_uniform(7, "id"))
    k = spark.createDataFrame([(0, 5), (1, 400), (2, 10_000)], "g int, k long")
    got = {r["id"] for r in B.smallest_per_group(df, "g", "u", ["id"], k).collect()}
    w = Window.partitionBy("g").orderBy("u", "id")
    want = {r["id"] for r in df.join(k, "g").withColumn("r", F.row_number().over(w))
            .where(F.col("r") <= F.col("k")).collect()}
    assert got == want


def test_poisson_table_is_the_distribution():
    for lam in (0.3, 2.5, 900.0):
        least, cumulative = B.poisson_table(lam)
        j = least + np.arange(len(cumulative))
        p = np.diff(cumulative, prepend=0.0)
        assert abs(cumulative[-1] - 1) < 1e-9
        mean = (j * p).sum()
        assert abs(mean - lam) < 1e-6 * max(1, lam) and abs(((j - mean) ** 2 * p).sum() - lam) < 1e-5 * max(1, lam)
        assert abs(p[max(0, int(lam) - least)] - math.exp(
            -lam + int(lam) * math.log(lam) - math.lgamma(int(lam) + 1))) < 1e-9


def test_draw_of_a_huge_rate(spark):
    """One row at a rate of 1e9: its draw is a lookup, not a sequence."""
    least, cumulative = B.poisson_table(1e9)
    draws = B._draws(spark, [{"label": 1, "fraction": 1e9}], T.StructField("label", T.IntegerType()))
    k = draws.select((F.col("_least") + F.size(F.filter("_cumulative", lambda c: c <= 0.5))).alias("k")).first()["k"]
    assert abs(k - 1e9) < 1e5 and len(cumulative) < 10**6 and isinstance(k, int)


def test_null_classes_are_left_out_and_reported(spark):
    rows = [(i, 0) for i in range(10)] + [(100 + i, 1) for i in range(5)] + [(200 + i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, label int")
    assert {r["label"]: r["target"] for r in B.balance_targets(df).collect()} == {0: 20, 1: 20}
    assert {r["class_weight"] for r in B.class_weights(df).collect()} == {0.75, 1.5}
    for balance in (B.exact_balance, B.bootstrap_balance):
        assert {r["label"] for r in balance(df, "id").collect()} == {0, 1}
    assert B.without_class(df).count() == 30


def test_replicate_branches_agree(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(40)], "id long, k int")
    a, b = (B.replicate(df, "k", ["id"], chunk=c) for c in (3, 100))
    assert a.schema == b.schema == B.replicate(df, "k", ["id"], chunk=100, max_count=6).schema
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bootstrap_balance_capped(spark):
    df = _labelled(spark)
    counts = {r["label"]: r["count"] for r in B.bootstrap_balance(df, "id", "label").groupBy("label").count().collect()}
    assert all(c <= 600 for c in counts.values())
    assert counts[1] > 500  # Poisson(600/45) copies of 45 rows reaches the cap


def test_class_weights_balanced(spark):
    df = _labelled(spark)
    w = {r["label"]: r["class_weight"] for r in B.class_weights(df, "label").select("label", "class_weight").distinct().collect()}
    n = 345
    assert abs(w[0] - n / (2 * 300)) < 1e-12 and abs(w[1] - n / (2 * 45)) < 1e-12


def test_leaky_order_spreads_copies(spark):
    from pixelmill.plans import train as Tr
    df = _labelled(spark)
    leaky = Tr.prepare(df, key="id", label="label", leaky=True)
    spread = leaky.groupBy("id").agg(F.countDistinct("split").alias("k")).where("k > 1").count()
    clean = Tr.prepare(df, key="id", label="label")
    assert spread > 0
    assert clean.groupBy("id").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0


def test_replicate_spreads_heavy_rows(spark):
    df = spark.createDataFrame([(1, 3), (2, 0), (3, 250)], "id long, k long")
    out = B.replicate(df, "k", ["id"], chunk=100)
    got = {(r["id"], r["copy"]) for r in out.collect()}
    want = {(1, c) for c in range(1, 4)} | {(3, c) for c in range(1, 251)}
    assert got == want and out.count() == len(want)


def test_exact_balance_single_row_class(spark):
    rows = [(i, 0) for i in range(500)] + [(10_000, 1)]
    df = spark.createDataFrame(rows, "id long, label int")
    out = B.exact_balance(df, "id", "label").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in out} == {0: 1000, 1: 1000}
