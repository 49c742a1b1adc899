import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.llm import blocks, topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def _brute(rows, queries, k):
    vectors = {(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows
               if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for qi, q in vectors:
        if not queries(qi):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != qi and len(v) == len(q))
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def _run(spark, rows, k=5, step=5):
    v = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in topk.top_k(v, v.where(f"pmod(vec_id, {step}) = 0"), k).collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "SHARD_ROWS", 32)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)]) for i in range(300)]
    assert _run(spark, rows) == _brute(rows, lambda i: i % 5 == 0, 5)


def test_query_batches_agree(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    whole = _run(spark, rows)
    monkeypatch.setattr(topk, "QUERY_BATCH", 16)
    assert _run(spark, rows) == whole == _brute(rows, lambda i: i % 5 == 0, 5)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (5, None), (10, [nan, 1.0]), (15, [inf, 1.0]), (20, [None, 1.0]),
            (None, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 2.0, 3.0]), (25, []), (30, []),
            (35, [1.0, 2.0]), (0, [3.0, 1.0])]
    assert _run(spark, rows) == _brute(rows, lambda i: i % 5 == 0, 5)
    assert _run(spark, []) == []


def test_one_id_with_many_vectors_does_not_fill_a_block(spark, monkeypatch):
    """Queries are cut by their number, so a hot id is many blocks, in one plan."""
    rng = random.Random(3)
    rows = [(5, [rng.gauss(0, 1) for _ in range(4)]) for _ in range(200)] + [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(20)]
    packs, pack = [], topk.packed
    monkeypatch.setattr(topk, "packed", lambda df, keys, n: packs.append(pack(df, keys, n)) or packs[-1])
    monkeypatch.setattr(topk, "QUERY_BATCH", 16)
    assert _run(spark, rows) == _brute(rows, lambda i: i % 5 == 0, 5)
    sizes = [r["n"] for r in packs[1].collect()]
    assert sum(sizes) == 204 and max(sizes) <= 16


def test_the_sample_has_no_effect_but_on_what_is_sent(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 16)
    monkeypatch.setattr(blocks, "PARTS_PER_SLOT", 1)
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(300)]
    v = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    q = v.where("pmod(vec_id, 5) = 0")
    want = _brute(rows, lambda i: i % 5 == 0, 5)
    for n in (0, 4, 20, 1000):
        assert sorted(tuple(r) for r in topk.top_k(v, q, 5, sample_rows=n).collect()) == want


def test_extra_columns_are_not_read(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    v = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    wider = v
    for c in ("dim", "query", "n", "vectors", "slot", "kind", "score", "rank", "query_id"):
        wider = wider.withColumn(c, F.lit("x"))
    got = topk.top_k(wider, wider.where("pmod(vec_id, 5) = 0"), 5).collect()
    assert sorted(tuple(r) for r in got) == _brute(rows, lambda i: i % 5 == 0, 5)
