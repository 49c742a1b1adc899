"""The flagship query: one DataFrame plan from raw arrays to a split summary.

embeddings -> per-row moments (narrow) -> binary label -> hash split (narrow)
-> one aggregation by (split, label) with map-side partial aggregation.
Only the final (split x class) rows cross the shuffle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.functions.hashing import sql_hash_uniform
from pixelmill.operators import sampling as B
from pixelmill.operators import signal as M
from pixelmill.plans.common import SQL_SEVERITY, rounded, severity_frame

SEED = 42


def feature_split_summary(spark, sf_dir: str):
    s = severity_frame(spark, sf_dir)
    m = M.array_moments(s, "embedding", ["vec_id", "label"], "v")
    split = B.hash_split(m, "vec_id", SEED)
    out = split.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("v_mean").alias("avg_mean"),
        F.avg("v_std").alias("avg_std"),
        F.avg("v_skew").alias("avg_skew"),
        F.min("v_min").alias("min_value"),
        F.max("v_max").alias("max_value"),
    )
    return rounded(out)


def _sql() -> str:
    cuts = B.split_thresholds((0.7, 0.1, 0.2))
    u = sql_hash_uniform(SEED, "vec_id")
    split = f"CASE WHEN {u} < {cuts[0]!r} THEN 'train' WHEN {u} < {cuts[1]!r} THEN 'val' ELSE 'test' END"
    return f"""
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x FROM {SQL_SEVERITY} s),
m AS (SELECT vec_id, avg(x) AS mean FROM e GROUP BY vec_id),
c AS (SELECT e.vec_id, e.label, m.mean, avg((x - m.mean) * (x - m.mean)) AS m2,
             avg((x - m.mean) * (x - m.mean) * (x - m.mean)) AS m3, min(x) AS mn, max(x) AS mx
      FROM e JOIN m ON e.vec_id = m.vec_id GROUP BY e.vec_id, e.label, m.mean),
f AS (SELECT vec_id, label, mean, sqrt(m2) AS std,
             CASE WHEN m2 <= (1e-15 * mean) * (1e-15 * mean) THEN 0.0 ELSE m3 / pow(m2, 1.5) END AS skew,
             mn, mx, {split} AS split FROM c)
SELECT split, label, count(*) AS n, round(avg(mean), 6) AS avg_mean, round(avg(std), 6) AS avg_std,
       round(avg(skew), 6) AS avg_skew, round(min(mn), 6) AS min_value, round(max(mx), 6) AS max_value
FROM f GROUP BY split, label
"""


SQL = _sql()
