"""Registered queries: signal statistics, labels, joins, splits and balancing.

Each query is a (spark, sf_dir) -> DataFrame function paired with DuckDB SQL
that computes the same table independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.functions.hashing import hash_uniform, sql_hash_uniform
from pixelmill.operators import labels as L
from pixelmill.operators import sampling as B
from pixelmill.operators import signal as M
from pixelmill.plans.common import Registry, SQL_SEVERITY, SQL_HU, rounded, severity_frame, sql_split
from pixelmill.session import scratch_path
from pixelmill.sources.tables import preview, read_labels_csv, table, write_parquet

HIST_LO, HIST_HI, HIST_N = -0.5, 0.5, 10
GRID_W = 8
SEED = 42

register = Registry()
QUERIES, SQL = register.queries, register.sql


# --- M1-M4: array / grid statistics ------------------------------------------------

_SQL_UNNEST = "(SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@register("array_moments", f"""
WITH e AS {_SQL_UNNEST},
m AS (SELECT vec_id, avg(x) AS mean FROM e GROUP BY vec_id),
c AS (SELECT e.vec_id, m.mean, avg((x - m.mean) * (x - m.mean)) AS m2,
             avg((x - m.mean) * (x - m.mean) * (x - m.mean)) AS m3, min(x) AS mn, max(x) AS mx
      FROM e JOIN m ON e.vec_id = m.vec_id GROUP BY e.vec_id, m.mean)
SELECT vec_id, round(mean, 6) AS v_mean, round(sqrt(m2), 6) AS v_std,
       round(CASE WHEN m2 <= (1e-15 * mean) * (1e-15 * mean) THEN 0.0 ELSE m3 / pow(m2, 1.5) END, 6) AS v_skew,
       round(mn, 6) AS v_min, round(mx, 6) AS v_max
FROM c
""")
def q_array_moments(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(M.array_moments(e, "embedding", ["vec_id"], "v"))


def _sql_bins():
    return (f"CASE WHEN x >= {HIST_LO} AND x <= {HIST_HI} "
            f"THEN least(floor((x - ({HIST_LO})) * {float(HIST_N)} / {HIST_HI - HIST_LO}), {HIST_N - 1}) "
            f"ELSE -1 END")


def _sql_hist_cols(fmt="round({e}, 6) AS hist_{k}"):
    cols = []
    for k in range(HIST_N):
        e = (f"CAST(count(*) FILTER (WHERE bin = {k}) AS DOUBLE) / "
             f"count(*) FILTER (WHERE bin >= 0)")
        cols.append(fmt.format(e=e, k=k))
    return ",\n       ".join(cols)


@register("array_histogram", f"""
WITH b AS (SELECT vec_id, {_sql_bins()} AS bin FROM {_SQL_UNNEST})
SELECT vec_id,
       {_sql_hist_cols()}
FROM b GROUP BY vec_id
""")
def q_array_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(M.array_histogram(e, "embedding", ["vec_id"], HIST_LO, HIST_HI, HIST_N))


@register("array_entropy", f"""
WITH b AS (SELECT vec_id, {_sql_bins()} AS bin FROM {_SQL_UNNEST}),
c AS (SELECT vec_id, bin, count(*) AS n FROM b WHERE bin >= 0 GROUP BY vec_id, bin),
p AS (SELECT vec_id, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY vec_id) AS p FROM c)
SELECT vec_id, round(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0.0 END), 6) AS entropy
FROM p GROUP BY vec_id
""")
def q_array_entropy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(M.array_entropy(e, "embedding", ["vec_id"], HIST_LO, HIST_HI, HIST_N))


def _sql_hu():
    """Hu invariants written out for DuckDB from raw moment sums."""
    eta = {
        "n20": "mu20 / pow(m00, 2)", "n02": "mu02 / pow(m00, 2)", "n11": "mu11 / pow(m00, 2)",
        "n30": "mu30 / pow(m00, 2.5)", "n21": "mu21 / pow(m00, 2.5)",
        "n12": "mu12 / pow(m00, 2.5)", "n03": "mu03 / pow(m00, 2.5)",
    }
    eta_sql = ", ".join(f"{v} AS {k}" for k, v in eta.items())
    hu_sql = ",\n       ".join(
        f"round(-sign({h}) * log10(abs({h}) + 1e-10), 6) AS hu_moment_{i}" for i, h in enumerate(SQL_HU))
    return f"""
WITH e AS (SELECT vec_id, abs(CAST(unnest(embedding) AS DOUBLE)) AS v,
                  CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i FROM embeddings),
g AS (SELECT vec_id, v, CAST(i % {GRID_W} AS DOUBLE) AS x, CAST(i // {GRID_W} AS DOUBLE) AS y FROM e),
r AS (SELECT vec_id, sum(v) AS m00, sum(x * v) AS m10, sum(y * v) AS m01, sum(x * x * v) AS m20,
             sum(x * y * v) AS m11, sum(y * y * v) AS m02, sum(x * x * x * v) AS m30,
             sum(x * x * y * v) AS m21, sum(x * y * y * v) AS m12, sum(y * y * y * v) AS m03
      FROM g GROUP BY vec_id),
c AS (SELECT vec_id, m00,
             m20 - (m10 / m00) * m10 AS mu20, m02 - (m01 / m00) * m01 AS mu02,
             m11 - (m10 / m00) * m01 AS mu11,
             m30 - 3 * (m10 / m00) * m20 + 2 * (m10 / m00) * (m10 / m00) * m10 AS mu30,
             m21 - 2 * (m10 / m00) * m11 - (m01 / m00) * m20 + 2 * (m10 / m00) * (m10 / m00) * m01 AS mu21,
             m12 - 2 * (m01 / m00) * m11 - (m10 / m00) * m02 + 2 * (m01 / m00) * (m01 / m00) * m10 AS mu12,
             m03 - 3 * (m01 / m00) * m02 + 2 * (m01 / m00) * (m01 / m00) * m01 AS mu03
      FROM r),
n AS (SELECT vec_id, {eta_sql} FROM c)
SELECT vec_id,
       {hu_sql}
FROM n
"""


@register("grid_hu_moments", _sql_hu())
def q_grid_hu_moments(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(M.grid_hu_moments(e, "embedding", ["vec_id"], GRID_W, intensity=F.abs))


# --- P1, A1, A3, S3: labels and class folders -----------------------------------------

@register("binary_label", f"SELECT vec_id, severity, label FROM {SQL_SEVERITY} s")
def q_binary_label(spark, sf_dir):
    return severity_frame(spark, sf_dir).select("vec_id", "severity", "label")


@register("class_counts", f"SELECT label, count(*) AS n FROM {SQL_SEVERITY} s GROUP BY label")
def q_class_counts(spark, sf_dir):
    return L.class_counts(severity_frame(spark, sf_dir), "label")


@register("severity_distribution",
          f"SELECT severity, count(*) AS n FROM {SQL_SEVERITY} s WHERE severity IS NOT NULL "
          f"GROUP BY severity ORDER BY n DESC, severity")
def q_severity_distribution(spark, sf_dir):
    return L.distribution(severity_frame(spark, sf_dir), "severity")


# the folder names in the SQL are fixed values, as in schemas.CLASS_FOLDERS
@register("class_folder_path", """
WITH f AS (SELECT vec_id, label AS diagnosis,
                  CASE label WHEN 0 THEN 'No_DR' WHEN 1 THEN 'Mild' WHEN 2 THEN 'Moderate'
                             WHEN 3 THEN 'Severe' WHEN 4 THEN 'Proliferate_DR' ELSE 'No_DR' END AS class_folder
           FROM embeddings),
p AS (SELECT *, 'images/' || class_folder || '/' || CAST(vec_id AS VARCHAR) || '.png' AS image_path FROM f)
SELECT vec_id, diagnosis, class_folder, image_path,
       regexp_extract(image_path, '([^/]+)/[^/]+$', 1) AS parsed_folder,
       regexp_extract(image_path, '([^/]+)\\.[^./]+$', 1) AS parsed_key
FROM p
""")
def q_class_folder_path(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("diagnosis"))
    folder = L.class_folder("diagnosis")
    p = e.withColumn("class_folder", folder).withColumn(
        "image_path", L.image_path("images", F.col("class_folder"), "vec_id"))
    pf, pk = L.parse_image_path("image_path")
    return p.withColumn("parsed_folder", pf).withColumn("parsed_key", pk)


# --- J1 / J2: label-to-item joins --------------------------------------------------------

@register("label_join", """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def q_label_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return L.join_labels(docs, labels, ["doc_id"])


@register("unmatched_labels", """
SELECT l.doc_id, l.quality, l.toxic FROM labels l
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')
""")
def q_unmatched_labels(spark, sf_dir):
    """J2 against one part of the item store, the English items: every label of the given
    tables has an item, so that the labels of all others stand for orphans."""
    items = table(spark, sf_dir, "documents").where(F.col("lang") == "en").select("doc_id")
    return L.unmatched(table(spark, sf_dir, "labels"), items, ["doc_id"])


@register("unlabelled_items", """
SELECT d.doc_id, d.source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def q_unlabelled_items(spark, sf_dir):
    return L.unmatched(table(spark, sf_dir, "documents").select("doc_id", "source"),
                       table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


# --- P2 / P3 / S11 ------------------------------------------------------------------------

_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@register("numeric_projection", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag AS label
FROM lineitem
""")
def q_numeric_projection(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    feats = L.numeric_feature_columns(li, _KEYS)
    return li.select("l_orderkey", "l_linenumber", *feats, F.col("l_returnflag").alias("label"))


@register("preview", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def q_preview(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return preview(docs, "doc_id", 5)


# --- B3 / A2: hash split ----------------------------------------------------------------------

def _split_frame(spark, sf_dir):
    return B.hash_split(severity_frame(spark, sf_dir).select("vec_id", "label"), "vec_id", SEED)


@register("hash_split", f"SELECT vec_id, label, {sql_split('vec_id')} AS split FROM {SQL_SEVERITY} s")
def q_hash_split(spark, sf_dir):
    return _split_frame(spark, sf_dir)


@register("split_counts", f"""
SELECT split, label, count(*) AS n FROM
  (SELECT label, {sql_split('vec_id')} AS split FROM {SQL_SEVERITY} s) t
GROUP BY split, label
""")
def q_split_counts(spark, sf_dir):
    return B.split_counts(_split_frame(spark, sf_dir))


# --- B4 / A4 / P4 / W2: class weights and balancing ---------------------------------------

@register("class_weights", """
WITH c AS (SELECT quality, count(*) AS nc FROM labels GROUP BY quality),
t AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
SELECT l.doc_id, l.quality, l.toxic, round(CAST(t.n AS DOUBLE) / (t.k * c.nc), 6) AS class_weight
FROM labels l JOIN c ON l.quality = c.quality CROSS JOIN t
""")
def q_class_weights(spark, sf_dir):
    return rounded(B.class_weights(table(spark, sf_dir, "labels"), "quality"))


@register("balance_targets", """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality)
SELECT quality, n, CAST(floor(max(n) OVER () * 2.0) AS BIGINT) AS target,
       round(floor(max(n) OVER () * 2.0) / n, 6) AS fraction
FROM c
""")
def q_balance_targets(spark, sf_dir):
    return rounded(B.balance_targets(table(spark, sf_dir, "labels"), "quality"))


@register("class_union", """
SELECT doc_id, quality, toxic FROM labels WHERE quality = 0
UNION ALL
SELECT doc_id, quality, toxic FROM labels WHERE quality = 1
""")
def q_class_union(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return B.union_all(B.class_subset(lab, "quality", 0), B.class_subset(lab, "quality", 1))


def _sql_poisson_bootstrap() -> str:
    u = sql_hash_uniform(SEED, "l.doc_id")
    order = sql_hash_uniform(f"{SEED}:order", "doc_id", "copy")
    return f"""
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
t AS (SELECT quality, n, CAST(floor(max(n) OVER () * 2.0) AS BIGINT) AS target FROM c),
p AS (SELECT l.doc_id, l.quality, l.toxic, t.target, CAST(t.target AS DOUBLE) / t.n AS lam, {u} AS u
      FROM labels l JOIN t ON l.quality = t.quality),
s AS (SELECT doc_id, quality, toxic, target, u, j,
             exp(-lam + j * ln(lam) - lgamma(j + 1)) AS pmf
      FROM p, range(0, CAST(ceil(lam + 12.0 * sqrt(lam) + 12.0) AS BIGINT) + 1) AS r(j)),
cdf AS (SELECT doc_id, quality, toxic, target, u, j,
               sum(pmf) OVER (PARTITION BY doc_id ORDER BY j) AS c FROM s),
k AS (SELECT doc_id, quality, toxic, target, count(*) FILTER (WHERE c <= u) AS k
      FROM cdf GROUP BY doc_id, quality, toxic, target),
x AS (SELECT doc_id, quality, toxic, target, CAST(copy AS BIGINT) AS copy
      FROM k, range(1, k + 1) AS r(copy) WHERE k > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {order}, doc_id, copy) AS rn FROM x)
SELECT doc_id, quality, toxic, copy FROM o WHERE rn <= target
"""


@register("bootstrap_balance", _sql_poisson_bootstrap())
def q_bootstrap_balance(spark, sf_dir):
    return B.bootstrap_balance(table(spark, sf_dir, "labels"), "doc_id", "quality", 2.0, SEED)


def _sql_exact_balance() -> str:
    u = sql_hash_uniform(SEED, "doc_id")
    return f"""
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
t AS (SELECT quality, n, CAST(floor(max(n) OVER () * 2.0) AS BIGINT) AS target FROM c),
p AS (SELECT l.doc_id, l.quality, l.toxic, t.target // t.n AS whole, t.target - (t.target // t.n) * t.n AS rest
      FROM labels l JOIN t ON l.quality = t.quality),
w AS (SELECT doc_id, quality, toxic, CAST(copy AS BIGINT) AS copy FROM p, range(1, whole + 1) AS r(copy)),
e AS (SELECT doc_id, quality, toxic, CAST(whole + 1 AS BIGINT) AS copy, rest,
             row_number() OVER (PARTITION BY quality ORDER BY {u}, doc_id) AS rn FROM p)
SELECT * FROM w
UNION ALL
SELECT doc_id, quality, toxic, copy FROM e WHERE rn <= rest
"""


@register("exact_balance", _sql_exact_balance())
def q_exact_balance(spark, sf_dir):
    return B.exact_balance(table(spark, sf_dir, "labels"), "doc_id", "quality", 2.0, SEED)


# --- S1, S5, S7, S8: sinks read back -------------------------------------------------------

@register("label_csv_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS id_code, quality AS diagnosis FROM labels")
def q_label_csv_round_trip(spark, sf_dir):
    """Label rows written as headed CSV files and scanned with the fixed schema."""
    path = scratch_path(spark, "labels-csv")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id_code"),
                                                 F.col("quality").alias("diagnosis"))
    rows.write.option("header", True).csv(path)
    return read_labels_csv(spark, path)


@register("parquet_sink", f"SELECT vec_id, label, {sql_split('vec_id')} AS split FROM {SQL_SEVERITY} s")
def q_parquet_sink(spark, sf_dir):
    """The split table written partitioned by split and scanned again."""
    path = scratch_path(spark, "split-table")
    write_parquet(_split_frame(spark, sf_dir), path, partition_by=["split"])
    return spark.read.parquet(path)
