"""What a pass sends to the driver does not grow with its tasks."""

import numpy as np
from pyspark.sql import functions as F

from pixelmill.operators import linear_fits as Lf


def _blocks(spark, tasks):
    rows = spark.range(0, 400, 1, tasks).select(
        (F.col("id") % 3).cast("int").alias("fold"), F.array(*[F.sin(F.col("id") * k) for k in (1, 2, 3)]).alias("x"),
        (F.col("id") % 2).cast("double").alias("y"), F.lit(1.0).alias("w"))

    def pack(batches):
        import pyarrow as pa
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"fold": r["fold"], "n": 1, **{c: np.array(r[c], np.float64).tobytes() for c in "xyw"}}],
                                                 schema=pa.schema([("fold", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in "xyw"]]))

    return rows.mapInArrow(pack, "fold int, n int, x binary, y binary, w binary")


def test_the_driver_gets_one_row_a_model(spark, monkeypatch):
    scale = [Lf.Scale(f, np.zeros(3), np.ones(3), 260.0, 260.0) for f in range(3)]
    fits = [Lf.Fit(s, 0.1) for s in scale for _ in range(2)]
    for i, f in enumerate(fits):
        f._trial = np.array([0.3, -0.2, 0.1 * i, 0.05])
    x = np.stack([np.sin(np.arange(400) * k) for k in (1, 2, 3)], 1)
    z, y, fold = np.hstack([x, np.ones((400, 1))]), np.arange(400) % 2, np.arange(400) % 3
    got = {}
    for tasks in (1, 9, 70):
        blocks = _blocks(spark, tasks)
        sent, collect = [], type(blocks).collect
        with monkeypatch.context() as m:
            m.setattr(type(blocks), "collect", lambda self: sent.append(collect(self)) or sent[-1])
            got[tasks] = Lf._pass(blocks, Lf.LOGISTIC, fits, 3)
        assert sum(map(len, sent)) == len(fits)
        # loss, gradient and one triangle of the curvature
        assert max(len(r["s"]) for r in sent[0]) == 8 * (1 + 4 + 4 * 5 // 2)
    for i, f in enumerate(fits):
        loss, slope, bend = Lf._parts(Lf.LOGISTIC, z @ f._trial, y, 1.0)
        own = fold != f.scale.left_out
        whole = np.concatenate([[loss[own].sum()], slope[own] @ z[own], ((z[own] * bend[own, None]).T @ z[own]).reshape(-1)])
        assert all(np.allclose(g[i], whole) for g in got.values())
