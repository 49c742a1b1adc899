import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from pixelmill.llm import blocks, hard_negatives

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())])


def _brute(rows, step):
    fine = {(i, lab, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for ai, al, av in fine:
        if ai % step:
            continue
        others = sorted((-sum(a * b for a, b in zip(av, v)), i, lab == al) for i, lab, v in fine if i != ai and len(v) == len(av))
        for s, i, _ in [x for x in others if x[2]][:5]:
            found = [(t, j) for t, j, same in others if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(ai, i, n, j, -s, -t) for n, (t, j) in enumerate(found, 1)]
    return sorted(out)


def _run(spark, rows, step=5, schema=SCHEMA, **options):
    v = hard_negatives.labelled_vectors(spark.createDataFrame(rows, schema))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(v, v.where(f"pmod(vec_id, {step}) = 0"), **options).collect())


def _near(seed, n, dim, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("seed, dim", [(1, 8), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, dim):
    monkeypatch.setattr(blocks, "PART_ROWS", 64)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 16)
    monkeypatch.setattr(blocks, "PARTS_PER_SLOT", 2)
    rows = _near(seed, 400, dim)
    got = _run(spark, rows)
    assert got == _brute(rows, 5) and len(got) > 200


def test_ties(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)], rng.randrange(2)) for i in range(200)]
    assert _run(spark, rows) == _brute(rows, 5)


def test_the_sample_of_the_codebooks_has_no_effect(spark):
    rows = _near(4, 200, 6)
    assert _run(spark, rows, sample_rows=3) == _run(spark, rows, sample_rows=200) == _brute(rows, 5)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [1.0, 2.5], 1), (0, [1.0, 2.0], 2), (5, None, 1), (10, [nan, 1.0], 1), (15, [inf, 1.0], 1),
            (20, [None, 1.0], 1), (None, [1.0, 1.0], 1), (25, [1.0, 1.0], None), (1, [2.0, 2.0], 1), (2, [1.0, 1.5], 2), (3, [1.0, 1.5], 3),
            (4, [2.0, 2.0], 1), (6, [1.0, 2.0, 3.0], 1), (30, [], 1), (31, [], 1), (32, [], 2), (35, [-1.0, -2.0], 1), (36, [0.0, 0.0], 1),
            (40, [0.5], 1), (41, [0.5], 1), (42, [0.4], 2), (-5, [1.0, 2.0], 1)]
    expected = _brute(rows, 5)
    assert _run(spark, rows) == expected and len(expected) > 10
    wider = T.StructType(SCHEMA.fields + [T.StructField(c, T.LongType()) for c in ("v", "dim", "anchor", "x", "cell", "slot", "place", "kind")])
    assert _run(spark, [(*r, *range(8)) for r in rows], schema=wider) == expected
    assert _run(spark, []) == []


def test_cells_come_by_falling_bound_and_bounds_hold():
    rng = np.random.default_rng(5)
    rows = rng.integers(-300, 300, (500, 6)).astype(float)
    books = hard_negatives.Codebooks([(i, 0, 6, r.tolist()) for i, r in enumerate(rows[:100])])
    packed = {"cell": books.cells(rows).tobytes(), "vec_id": np.arange(500).tobytes(), "label": np.zeros(500, np.int64).tobytes(),
              "vectors": rows.tobytes(), "n": 500, "dim": 6}
    part = hard_negatives.Part([packed], books)
    for q in rows[:20]:
        seen = list(part.visits(q))
        assert [b for b, _ in seen] == sorted((b for b, _ in seen), reverse=True)
        assert sorted(c for _, c in seen) == np.flatnonzero(np.diff(part.starts)).tolist()
        for bound, cell in seen:
            assert (part.vectors[part.starts[cell]:part.starts[cell + 1]] @ q).max() <= bound


def test_the_search_stops_before_all_cells():
    rows = np.array(_near(6, 3000, 8)[0][1])  # one centre only gives the scale
    rng = np.random.default_rng(7)
    vectors = np.floor(256 * (rng.choice(rng.normal(size=(30, 8)) * 3, 3000) + rng.normal(size=(3000, 8)) * 0.1)) + rows[0] * 0
    books = hard_negatives.Codebooks([(i, 0, 8, v.tolist()) for i, v in enumerate(vectors[:500])])
    part = hard_negatives.Part([{"cell": books.cells(vectors).tobytes(), "vec_id": np.arange(3000).tobytes(), "label": np.zeros(3000, np.int64).tobytes(),
                                 "vectors": vectors.tobytes(), "n": 3000, "dim": 8}], books)
    best, scored = hard_negatives.Best(5, -np.inf), 0
    for at, scores in part.scored(vectors[0], lambda bound: bound >= best.floor):
        best.add(scores, part.ids[at])
        scored += len(at)
    assert sorted(best.score.tolist()) == np.sort(vectors @ vectors[0])[-5:].tolist() and scored < 2000
