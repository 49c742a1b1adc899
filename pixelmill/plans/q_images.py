"""Registered queries: image rows, image features and image scoring.

The driver tables hold no image files, so images are derived from the
``embeddings`` table by Spark itself (each 64-value array becomes an 8 x 8 x 3
image in the image-source layout). The same extractor runs unchanged on files
read by the image source (see the tests and ``plans/prepare.py``).
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pixelmill.operators import images as I
from pixelmill.operators import sampling as B
from pixelmill.operators.features import assembler
from pixelmill.operators.scoring import answer_requests
from pixelmill.plans.common import SQL_HU, SQL_SEVERITY, Registry, rounded, severity_frame, sql_split
from pixelmill.plans.q_models import SQL_ANSWERS, answer_checks, saved_models, wanted_model
from pixelmill.schemas import CANNY_HIGH, CANNY_LOW, FEATURE_NAMES
from pixelmill.session import scratch_path
from pixelmill.sources.tables import table

register = Registry()
QUERIES, SQL = register.queries, register.sql

SIDE = 8
SEED = 42


def derived_images(spark, sf_dir):
    # one file holds many images: spread the short arrays, so that no pixels need to be
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(
        spark.sparkContext.defaultParallelism, "vec_id")
    return I.images_from_arrays(e, "embedding", SIDE, ["vec_id"])


def _sql_level(expr: str) -> str:
    return f"CAST(least(greatest(floor(({expr} - (-0.5)) / 1.0 * 256), 0), 255) AS INTEGER)"


@register("image_rows", f"""
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x,
                  CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i, len(embedding) AS n FROM embeddings),
p AS (SELECT a.vec_id, a.i, a.n,
             {_sql_level('a.x')} AS b, {_sql_level('g.x')} AS g, {_sql_level('r.x')} AS r
      FROM e a JOIN e g ON g.vec_id = a.vec_id AND g.i = (a.i + a.n // 3) % a.n
               JOIN e r ON r.vec_id = a.vec_id AND r.i = (a.i + (2 * a.n) // 3) % a.n)
SELECT vec_id, 'array://' || CAST(vec_id AS VARCHAR) AS origin, CAST(max(n) // {SIDE} AS INTEGER) AS height,
       {SIDE} AS width, 3 AS "nChannels",
       string_agg(lpad(upper(to_hex(b)), 2, '0') || lpad(upper(to_hex(g)), 2, '0') || lpad(upper(to_hex(r)), 2, '0'), ''
                  ORDER BY i) AS data_hex
FROM p GROUP BY vec_id
""")
def q_image_rows(spark, sf_dir):
    """The image-source rows built from the embeddings (layout checked in SQL)."""
    im = derived_images(spark, sf_dir)
    return im.select("vec_id", "image.origin", "image.height", "image.width", "image.nChannels",
                     F.hex("image.data").alias("data_hex"))


def image_feature_table(spark, sf_dir):
    feats = I.extract_features(derived_images(spark, sf_dir), ["vec_id"])
    lab = severity_frame(spark, sf_dir).select("vec_id", "label")
    return feats.join(lab, "vec_id")


@register("score_images", f"""
SELECT vec_id, label, {sql_split('vec_id')} AS split, {SQL_ANSWERS}
FROM {SQL_SEVERITY} e
""")
def q_score_images(spark, sf_dir):
    """R2 + R4: images -> features -> the saved (assembler + scaler + classifier)
    pipeline that each request names -> decision fields; requests for a model that is
    not there are answered with the reason."""
    path = scratch_path(spark, "image-features")
    B.hash_split(image_feature_table(spark, sf_dir), "vec_id", SEED).write.partitionBy("split").parquet(path)
    t = spark.read.parquet(path)
    models, _ = saved_models(spark, t.where(F.col("split") == "train"),
                             pre=[assembler(list(FEATURE_NAMES), "features", "skip")])
    keys = ["vec_id", "label", "split"]
    return answer_checks(answer_requests(models, t.withColumn("wanted", wanted_model("vec_id")), "wanted", keys), keys)


# --- I2, I11 on the native 8 x 8 grids -----------------------------------------------------

_SQL_SOURCE = f"""
e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x,
             CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i, len(embedding) AS n FROM embeddings),
src AS (SELECT a.vec_id, a.i // {SIDE} AS sy, a.i % {SIDE} AS sx,
               {_sql_level('a.x')} AS b, {_sql_level('g.x')} AS g, {_sql_level('r.x')} AS r
        FROM e a JOIN e g ON g.vec_id = a.vec_id AND g.i = (a.i + a.n // 3) % a.n
                 JOIN e r ON r.vec_id = a.vec_id AND r.i = (a.i + (2 * a.n) // 3) % a.n)"""
SMALL = 5


def _sql_resize_down() -> str:
    def blend(w, lo, hi):
        return ", ".join(f"{lo}.{c} * (1 - {w}) + {hi}.{c} * {w} AS {c}" for c in "rgb")

    rgb = " || ".join(f"lpad(upper(to_hex(CAST(floor({c} + 0.5) AS INTEGER))), 2, '0')" for c in "rgb")
    return f"""
WITH {_SQL_SOURCE},
ax AS (SELECT o, CAST(least(greatest(floor(f), 0), {SIDE - 1}) AS BIGINT) AS i0,
              CAST(least(least(greatest(floor(f), 0), {SIDE - 1}) + 1, {SIDE - 1}) AS BIGINT) AS i1,
              CASE WHEN floor(f) < 0 THEN 0.0::DOUBLE ELSE f - floor(f) END AS w
       FROM (SELECT o, (CAST(o AS DOUBLE) + 0.5::DOUBLE) * ({SIDE}::DOUBLE / {SMALL}::DOUBLE) - 0.5::DOUBLE AS f
             FROM range({SMALL}) t(o)) q),
v AS (SELECT s0.vec_id, ax.o AS oy, s0.sx, {blend('ax.w', 's0', 's1')}
      FROM ax JOIN src s0 ON s0.sy = ax.i0 JOIN src s1 ON s1.vec_id = s0.vec_id AND s1.sx = s0.sx AND s1.sy = ax.i1),
h AS (SELECT v0.vec_id, v0.oy, ax.o AS ox, {blend('ax.w', 'v0', 'v1')}
      FROM ax JOIN v v0 ON v0.sx = ax.i0 JOIN v v1 ON v1.vec_id = v0.vec_id AND v1.oy = v0.oy AND v1.sx = ax.i1)
SELECT vec_id, string_agg({rgb}, '' ORDER BY oy, ox) AS rgb_hex FROM h GROUP BY vec_id"""


@register("resize_down", _sql_resize_down())
def q_resize_down(spark, sf_dir):
    """I2, shrinking: every derived image as 5 x 5 RGB bytes."""
    small = I.resized(derived_images(spark, sf_dir), ["vec_id"], SMALL, SMALL)
    return small.select("vec_id", F.hex("rgb").alias("rgb_hex"))


def _sql_grid_canny() -> str:
    last = SIDE - 1
    offsets = ", ".join(f"({dy}, {dx}, {dx * (2 - abs(dy))}, {dy * (2 - abs(dx))})"
                        for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    tangent = round(math.tan(math.pi / 8) * (1 << 15))
    return f"""
WITH RECURSIVE {_SQL_SOURCE},
gr AS (SELECT vec_id, sy, sx, (r * 4899 + g * 9617 + b * 1868 + 8192) // 16384 AS gray FROM src),
so AS (SELECT p.vec_id, p.sy AS y, p.sx AS x, CAST(sum(o.kx * n.gray) AS BIGINT) AS gx, CAST(sum(o.ky * n.gray) AS BIGINT) AS gy
       FROM gr p CROSS JOIN (VALUES {offsets}) AS o(dy, dx, kx, ky)
       JOIN gr n ON n.vec_id = p.vec_id AND n.sy = least(greatest(p.sy + o.dy, 0), {last})
                AND n.sx = least(greatest(p.sx + o.dx, 0), {last})
       GROUP BY ALL),
se AS (SELECT *, abs(gx) + abs(gy) AS c,
              CASE WHEN abs(gy) * 32768 < abs(gx) * {tangent} THEN 'h'
                   WHEN abs(gy) * 32768 > abs(gx) * {tangent} + abs(gx) * 65536 THEN 'v'
                   WHEN gx * gy >= 0 THEN 'd' ELSE 'u' END AS sector FROM so),
nb AS (SELECT *, CASE sector WHEN 'h' THEN 0 ELSE -1 END AS ay,
              CASE sector WHEN 'v' THEN 0 WHEN 'u' THEN 1 ELSE -1 END AS ax FROM se),
cand AS (SELECT p.vec_id, p.y, p.x, p.c FROM nb p
         LEFT JOIN se a ON a.vec_id = p.vec_id AND a.y = p.y + p.ay AND a.x = p.x + p.ax
         LEFT JOIN se b ON b.vec_id = p.vec_id AND b.y = p.y - p.ay AND b.x = p.x - p.ax
         WHERE p.c > {CANNY_LOW} AND p.c > coalesce(a.c, 0)
           AND (p.c > coalesce(b.c, 0) OR (p.sector IN ('h', 'v') AND p.c = coalesce(b.c, 0)))),
edge AS (SELECT vec_id, y, x FROM cand WHERE c > {CANNY_HIGH}
         UNION SELECT n.vec_id, n.y, n.x FROM edge e
               JOIN cand n ON n.vec_id = e.vec_id AND abs(n.y - e.y) <= 1 AND abs(n.x - e.x) <= 1)
SELECT gr.vec_id, string_agg(CASE WHEN edge.vec_id IS NULL THEN '0' ELSE '1' END, '' ORDER BY sy, sx) AS edges
FROM gr LEFT JOIN edge ON edge.vec_id = gr.vec_id AND edge.y = gr.sy AND edge.x = gr.sx GROUP BY gr.vec_id"""


@register("grid_canny", _sql_grid_canny())
def q_grid_canny(spark, sf_dir):
    """The edge map of every derived image at its own 8 x 8 size."""
    return I.edge_map(derived_images(spark, sf_dir), ["vec_id"])


# --- I1-I10 against SQL -----------------------------------------------------------------
# The derived images are 8 x 8; upscaling to 256 x 256 uses weights that are
# multiples of 1/64 on integer pixels, so the bilinear values are exact in
# double arithmetic in both engines; HSV and grey are integer arithmetic. All
# features except the two edge measures therefore have an exact SQL twin.

EDGE_FEATURES = ("edge_density", "edge_mean")
COLOR_FEATURES = [n for n in FEATURE_NAMES if n not in EDGE_FEATURES]


def _sql_image_color_features() -> str:
    def level(e):
        return f"CAST(least(greatest(floor(({e} + 0.5) * 256), 0), 255) AS INTEGER)"

    def stats(ch, name):
        mean = f"(CAST(sum({ch}) AS DOUBLE) / 65536)"
        m2 = f"(CAST(sum({ch} * {ch}) AS DOUBLE) / 65536 - {mean} * {mean})"
        m3 = (f"(CAST(sum(CAST({ch} AS BIGINT) * {ch} * {ch}) AS DOUBLE) / 65536"
              f" - 3 * {mean} * CAST(sum({ch} * {ch}) AS DOUBLE) / 65536 + 2 * {mean} * {mean} * {mean})")
        return {f"{name}_mean": mean, f"{name}_m2": m2, f"{name}_m3": m3}

    aggs = {}
    for ch, name in (("r", "R"), ("g", "G"), ("b", "B"), ("h", "H"), ("s", "S"), ("v", "V"), ("gray", "GRAY")):
        aggs.update(stats(ch, name))
    for k in range(10):
        aggs[f"intensity_hist_{k}"] = f"CAST(count(*) FILTER (WHERE (gray * 10) // 256 = {k}) AS DOUBLE) / 65536"
    aggs["min_intensity"] = "CAST(min(gray) AS DOUBLE)"
    aggs["max_intensity"] = "CAST(max(gray) AS DOUBLE)"
    for p, q in ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)):
        aggs[f"m{p}{q}"] = f"CAST(sum(CAST(gray AS BIGINT) * {'*'.join(['ox'] * p + ['oy'] * q) or '1'}) AS HUGEINT)"
    agg_sql = ",\n       ".join(f"{v} AS {k}" for k, v in aggs.items())

    def skew(name):
        m, m2, m3 = f"{name}_mean", f"{name}_m2", f"{name}_m3"
        return f"CASE WHEN {m2} <= (1e-15 * {m}) * (1e-15 * {m}) THEN 0.0 ELSE {m3} / pow({m2}, 1.5) END"

    cols = []
    for name in ("R", "G", "B", "H", "S", "V"):
        cols += [f"{name}_mean AS {name}_mean", f"sqrt({name}_m2) AS {name}_std", f"{skew(name)} AS {name}_skew"]
    cols += [f"intensity_hist_{k}" for k in range(10)]
    cols += ["sqrt(GRAY_m2) AS contrast", "GRAY_mean AS brightness", "min_intensity", "max_intensity"]
    ent = " + ".join(f"CASE WHEN intensity_hist_{k} > 0 THEN -intensity_hist_{k} * ln(intensity_hist_{k}) "
                     f"ELSE 0.0 END" for k in range(10))
    cols.append(f"{ent} AS entropy")
    # central moments scaled by powers of m00 are exact in 128-bit integers
    cen = {
        "mu20": "CAST(m00 * m20 - m10 * m10 AS DOUBLE) / m00",
        "mu02": "CAST(m00 * m02 - m01 * m01 AS DOUBLE) / m00",
        "mu11": "CAST(m00 * m11 - m10 * m01 AS DOUBLE) / m00",
        "mu30": "CAST(m00 * m00 * m30 - 3 * m00 * m10 * m20 + 2 * m10 * m10 * m10 AS DOUBLE) / (CAST(m00 AS DOUBLE) * m00)",
        "mu03": "CAST(m00 * m00 * m03 - 3 * m00 * m01 * m02 + 2 * m01 * m01 * m01 AS DOUBLE) / (CAST(m00 AS DOUBLE) * m00)",
        "mu21": "CAST(m00 * m00 * m21 - 2 * m00 * m10 * m11 - m00 * m01 * m20 + 2 * m10 * m10 * m01 AS DOUBLE)"
                " / (CAST(m00 AS DOUBLE) * m00)",
        "mu12": "CAST(m00 * m00 * m12 - 2 * m00 * m01 * m11 - m00 * m10 * m02 + 2 * m01 * m01 * m10 AS DOUBLE)"
                " / (CAST(m00 AS DOUBLE) * m00)",
    }
    final = ", ".join(f"round({c}, 6) AS {c}" for c in COLOR_FEATURES)
    return f"""
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x,
                  CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i, len(embedding) AS n FROM embeddings),
src AS (SELECT a.vec_id, a.i // {SIDE} AS sy, a.i % {SIDE} AS sx,
               {level('a.x')} AS b, {level('g.x')} AS g, {level('r.x')} AS r
        FROM e a JOIN e g ON g.vec_id = a.vec_id AND g.i = (a.i + a.n // 3) % a.n
                 JOIN e r ON r.vec_id = a.vec_id AND r.i = (a.i + (2 * a.n) // 3) % a.n),
ax AS (SELECT o, CAST(least(greatest(floor(f), 0), {SIDE - 1}) AS BIGINT) AS i0,
              CAST(least(least(greatest(floor(f), 0), {SIDE - 1}) + 1, {SIDE - 1}) AS BIGINT) AS i1,
              CASE WHEN floor(f) < 0 THEN 0.0 ELSE f - floor(f) END AS w
       FROM (SELECT o, (CAST(o AS DOUBLE) + 0.5) * ({SIDE}.0 / 256.0) - 0.5 AS f FROM range(256) t(o)) q),
hp AS (SELECT s0.vec_id, s0.sy, ax.o AS ox,
              (1 - ax.w) * s0.r + ax.w * s1.r AS r, (1 - ax.w) * s0.g + ax.w * s1.g AS g,
              (1 - ax.w) * s0.b + ax.w * s1.b AS b
       FROM ax JOIN src s0 ON s0.sx = ax.i0
               JOIN src s1 ON s1.vec_id = s0.vec_id AND s1.sy = s0.sy AND s1.sx = ax.i1),
px AS (SELECT h0.vec_id, ay.o AS oy, h0.ox,
              CAST(floor((1 - ay.w) * h0.r + ay.w * h1.r + 0.5) AS BIGINT) AS r,
              CAST(floor((1 - ay.w) * h0.g + ay.w * h1.g + 0.5) AS BIGINT) AS g,
              CAST(floor((1 - ay.w) * h0.b + ay.w * h1.b + 0.5) AS BIGINT) AS b
       FROM ax ay JOIN hp h0 ON h0.sy = ay.i0
                  JOIN hp h1 ON h1.vec_id = h0.vec_id AND h1.ox = h0.ox AND h1.sy = ay.i1),
hv AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS diff,
              CAST(floor((r * 4899 + g * 9617 + b * 1868 + 8192) / 16384.0) AS BIGINT) AS gray FROM px),
hs AS (SELECT *,
              CAST(floor((diff * CASE WHEN v = 0 THEN 0 ELSE floor(1044480.0 / v + 0.5) END + 2048) / 4096.0)
                   AS BIGINT) AS s,
              CAST(floor(((CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * diff ELSE r - g + 4 * diff END)
                          * CASE WHEN diff = 0 THEN 0 ELSE floor(737280.0 / (6.0 * diff) + 0.5) END + 2048)
                         / 4096.0) AS BIGINT) AS h0
       FROM hv),
pix AS (SELECT vec_id, oy, ox, r, g, b, v, s, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS h, gray FROM hs),
a AS (SELECT vec_id,
       {agg_sql}
      FROM pix GROUP BY vec_id),
c AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in cen.items())} FROM a),
nn AS (SELECT *, mu20 / pow(m00, 2) AS n20, mu02 / pow(m00, 2) AS n02, mu11 / pow(m00, 2) AS n11,
              mu30 / pow(m00, 2.5) AS n30, mu21 / pow(m00, 2.5) AS n21, mu12 / pow(m00, 2.5) AS n12,
              mu03 / pow(m00, 2.5) AS n03 FROM c),
f AS (SELECT vec_id, {", ".join(cols)},
             {", ".join(f"-sign({h}) * log10(abs({h}) + 1e-10) AS hu_moment_{i}" for i, h in enumerate(SQL_HU))}
      FROM nn)
SELECT vec_id, {final} FROM f
"""


@register("image_color_features", _sql_image_color_features())
def q_image_color_features(spark, sf_dir):
    """I1-I10 checked against SQL: the 40 colour, histogram, intensity and
    shape features of every derived image (the same extractor as
    ``image_features``)."""
    feats = I.extract_features(derived_images(spark, sf_dir), ["vec_id"])
    return rounded(feats.select("vec_id", *COLOR_FEATURES))


@register("image_features", f"SELECT *, TRUE AS edges_agree FROM ({_sql_image_color_features()}) f")
def q_image_features(spark, sf_dir):
    """The 42 features of every derived image. The edge pair, which has no
    closed SQL form at 256 x 256 (``grid_canny`` checks the edges themselves), is
    held against itself: a share in [0, 1] and 255 times that share."""
    f = I.extract_features(derived_images(spark, sf_dir), ["vec_id"])
    share, mean = F.col("edge_density"), F.col("edge_mean")
    agree = (share >= 0) & (share <= 1) & (F.abs(mean - 255 * share) < 1e-9)
    return rounded(f.select("vec_id", *COLOR_FEATURES, agree.alias("edges_agree")))
