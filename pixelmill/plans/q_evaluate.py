"""Registered queries: metrics, comparison tables, insights and request checks.

Scores come from fixed linear scorers over ``embeddings`` so every metric has
an exact SQL twin without training a model (trained models are covered by the
``*_cv`` queries). Every scorer reads the whole vector; they differ in their
integer weights ((i * (2m + f + 3)) mod 7) - 3 for element i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators import compare as C
from pixelmill.operators import metrics as E
from pixelmill.plans.common import Registry, rounded, severity_frame
from pixelmill.plans.train import results_from_files
from pixelmill.schemas import FRAMEWORK_SPARK, FRAMEWORK_TWIN, METRIC_SCHEMA, MODEL_NAMES
from pixelmill.session import scratch_path
from pixelmill.sources.tables import table, write_metrics_csv

register = Registry()
QUERIES, SQL = register.queries, register.sql


# --- scorers -----------------------------------------------------------------------------

FRAMEWORKS = (FRAMEWORK_SPARK, FRAMEWORK_TWIN)


def scorer_spec():
    """[(position, model, framework, m, f)] for 3 scorers x 2 frameworks."""
    return [(2 * m + f + 1, f"linear_{m + 1}", FRAMEWORKS[f], m, f) for m in range(3) for f in range(2)]


def linear_score(arr: str, m: int, f: int):
    """Weighted sum over the whole array, whatever its length."""
    prods = F.transform(F.col(arr), lambda x, i: x.cast("double") * ((i * (2 * m + f + 3)) % 7 - 3))
    return F.aggregate(prods, F.lit(0.0), lambda a, b: a + b)


def _predicted(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", F.when(F.col("score") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def scored(spark, sf_dir) -> DataFrame:
    """(vec_id, label, score, prediction) from the first scorer."""
    s = severity_frame(spark, sf_dir)
    return _predicted(s.select("vec_id", "label", linear_score("embedding", 0, 0).alias("score")))


def stacked(spark, sf_dir) -> DataFrame:
    """All six scorers' predictions stacked: (model, framework, position, work,
    vec_id, label, score, prediction). One scan; each row fans out six ways.
    ``work`` is a deterministic cost: elements read times the scorer's position."""
    s = severity_frame(spark, sf_dir)
    arr = F.array(*[F.struct(F.lit(pos).alias("position"), F.lit(model).alias("model"),
                             F.lit(fw).alias("framework"), (F.size("embedding") * pos).cast("long").alias("work"),
                             linear_score("embedding", m, f).alias("score"))
                    for pos, model, fw, m, f in scorer_spec()])
    return _predicted(s.select("vec_id", "label", F.explode(arr).alias("_s")).select(
        "_s.model", "_s.framework", "_s.position", "_s.work", "vec_id", "label", "_s.score"))


_SQL_ELEMS = ("(SELECT vec_id, CASE WHEN label % 5 >= 1 THEN 1 ELSE 0 END AS label, "
              "CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i "
              "FROM embeddings)")


def _sql_scored() -> str:
    return f"""(SELECT vec_id, label, score, CAST(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS prediction FROM
  (SELECT vec_id, label, sum(x * (((i * 3) % 7) - 3)) AS score FROM {_SQL_ELEMS} e
   GROUP BY vec_id, label) t)"""


def _sql_stacked() -> str:
    values = ", ".join(f"({pos}, '{model}', '{fw}', {m}, {f})" for pos, model, fw, m, f in scorer_spec())
    return f"""(SELECT model, framework, position, work, vec_id, label, score,
       CAST(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS prediction FROM
  (SELECT sc.model, sc.framework, sc.position, count(*) * sc.position AS work, e.vec_id, e.label,
          sum(e.x * (((e.i * (2 * sc.m + sc.f + 3)) % 7) - 3)) AS score
   FROM {_SQL_ELEMS} e, (VALUES {values}) AS sc(position, model, framework, m, f)
   GROUP BY sc.model, sc.framework, sc.position, sc.m, sc.f, e.vec_id, e.label) t)"""


def _sql_metrics(src: str, by: list[str], digits: int | None = 6) -> str:
    """Weighted metrics + AUC for DuckDB, grouped by ``by`` (rounded to
    ``digits`` unless None)."""

    def rnd(e: str) -> str:
        return e if digits is None else f"round({e}, {digits})"

    g = ", ".join(by)
    gsel = g + ", " if by else ""
    on = " AND ".join(f"a.{c} = b.{c}" for c in by) or "TRUE"
    part = f"PARTITION BY {g}" if by else ""
    return f"""
WITH p AS {src},
cl AS (SELECT {gsel}CAST(label AS DOUBLE) AS c, count(*) AS support FROM p GROUP BY ALL),
pr AS (SELECT {gsel}prediction AS c, count(*) AS predicted FROM p GROUP BY ALL),
tp AS (SELECT {gsel}prediction AS c, count(*) AS tp FROM p WHERE CAST(label AS DOUBLE) = prediction GROUP BY ALL),
pc AS (SELECT {gsel}c, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
       FROM cl FULL JOIN pr USING ({g + ', ' if by else ''}c) LEFT JOIN tp USING ({g + ', ' if by else ''}c)),
pm AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pre,
                 CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM pc),
pf AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0.0 END AS f1 FROM pm),
w AS (SELECT {gsel}sum(tp) / sum(support) AS accuracy, sum(pre * support) / sum(support) AS precision,
             sum(rec * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1_score
      FROM pf GROUP BY ALL),
d AS (SELECT {gsel}score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM p GROUP BY ALL),
r AS (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM d),
u AS (SELECT {gsel}sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc_roc FROM r GROUP BY ALL)
SELECT {', '.join('a.' + c for c in by) + ', ' if by else ''}{rnd('a.accuracy')} AS accuracy,
       {rnd('a.precision')} AS precision, {rnd('a.recall')} AS recall,
       {rnd('a.f1_score')} AS f1_score, {rnd('b.auc_roc')} AS auc_roc
FROM w a JOIN u b ON {on}"""


# --- A5-A11, A15, C8, P6 ------------------------------------------------------------------

@register("confusion_matrix", f"""
SELECT CAST(label AS INTEGER) AS label, count(*) FILTER (WHERE prediction = 0.0) AS pred_0,
       count(*) FILTER (WHERE prediction = 1.0) AS pred_1,
       count(*) FILTER (WHERE prediction NOT IN (0.0, 1.0) OR prediction IS NULL) AS pred_other
FROM {_sql_scored()} p GROUP BY 1
""")
def q_confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(scored(spark, sf_dir))


@register("weighted_metrics", f"""
WITH m AS ({_sql_metrics(_sql_scored(), [])})
SELECT accuracy, precision, recall, f1_score FROM m
""")
def q_weighted_metrics(spark, sf_dir):
    return rounded(E.weighted_metrics(scored(spark, sf_dir)))


@register("auc_rank", f"""
WITH p AS {_sql_scored()},
d AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM p GROUP BY score),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM d)
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc_roc FROM r
""")
def q_auc_rank(spark, sf_dir):
    return rounded(E.auc_roc(scored(spark, sf_dir)))


@register("class_report", f"""
WITH p AS {_sql_scored()},
cl AS (SELECT CAST(label AS DOUBLE) AS c, count(*) AS support FROM p GROUP BY 1),
pr AS (SELECT prediction AS c, count(*) AS predicted FROM p GROUP BY 1),
tp AS (SELECT prediction AS c, count(*) AS tp FROM p WHERE CAST(label AS DOUBLE) = prediction GROUP BY 1),
pc AS (SELECT c, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
       FROM cl FULL JOIN pr USING (c) LEFT JOIN tp USING (c)),
pm AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pre,
                 CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM pc WHERE support > 0),
pf AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0.0 END AS f1 FROM pm)
SELECT CAST(CAST(c AS INTEGER) AS VARCHAR) AS "row", round(pre, 6) AS precision, round(rec, 6) AS recall,
       round(f1, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM pf
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'macro avg', round(avg(pre), 6), round(avg(rec), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', round(sum(pre * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pf
""")
def q_class_report(spark, sf_dir):
    return rounded(E.class_report(scored(spark, sf_dir)))


@register("metrics_by_model", f"""
WITH m AS ({_sql_metrics(_sql_stacked(), ['model', 'framework'])})
SELECT * FROM m
""")
def q_metrics_by_model(spark, sf_dir):
    return rounded(E.evaluate(stacked(spark, sf_dir), by=["model", "framework"]))


@register("decision_projection", f"""
SELECT vec_id, prediction, CASE WHEN CAST(prediction AS INTEGER) >= 1 THEN 1 ELSE 0 END AS flag,
       CAST(prediction AS INTEGER) AS class_predicted,
       CASE WHEN CAST(prediction AS INTEGER) >= 1 THEN 'Rétinopathie diabétique détectée'
            ELSE 'Pas de rétinopathie diabétique' END AS diagnosis
FROM {_sql_scored()} p
""")
def q_decision_projection(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("vec_id", "prediction", *E.decision("prediction"))


# --- comparison table and its reports (A12-A14, P7-P10, R5, R6) ----------------------------

def evaluated(spark, sf_dir, by=("model", "framework", "position")) -> DataFrame:
    """Metrics of the six scorers plus their work measure (thousands)."""
    ev = E.evaluate(stacked(spark, sf_dir), by=list(by), sums={"training_time": "work"})
    return ev.withColumn("training_time", F.col("training_time") / 1000.0)


def comparison(spark, sf_dir) -> DataFrame:
    """(Model, Framework, Accuracy, F1-Score, AUC-ROC, Training Time, position).

    The fixed scorers have no fitting step; their time column holds the
    deterministic work measure so the reports below are reproducible."""
    return C.to_comparison(evaluated(spark, sf_dir), F.col("framework"), keep=["position"])


def _sql_comparison() -> str:
    return f"""(WITH s AS {_sql_stacked()},
m AS ({_sql_metrics(_sql_stacked(), ['model', 'framework', 'position'], None)}),
w AS (SELECT model, framework, sum(work) / 1000.0 AS training_time FROM s GROUP BY ALL)
SELECT m.model AS "Model", m.framework AS "Framework", m.position AS position, m.accuracy AS "Accuracy",
       m.f1_score AS "F1-Score", m.auc_roc AS "AUC-ROC", w.training_time AS "Training Time"
FROM m JOIN w ON m.model = w.model AND m.framework = w.framework)"""


@register("comparison_table", f"""
SELECT "Model", "Framework", position, round("Accuracy", 6) AS "Accuracy", round("F1-Score", 6) AS "F1-Score",
       round("AUC-ROC", 6) AS "AUC-ROC", round("Training Time", 6) AS "Training Time" FROM {_sql_comparison()} c
""")
def q_comparison_table(spark, sf_dir):
    return rounded(comparison(spark, sf_dir))


@register("metric_pivot", f"""
WITH c AS {_sql_comparison()},
l AS (SELECT "Model", "Framework", 'Accuracy' AS metric, "Accuracy" AS value FROM c
      UNION ALL SELECT "Model", "Framework", 'F1-Score', "F1-Score" FROM c
      UNION ALL SELECT "Model", "Framework", 'AUC-ROC', "AUC-ROC" FROM c
      UNION ALL SELECT "Model", "Framework", 'Training Time', "Training Time" FROM c)
SELECT "Model", metric,
       round(max(value) FILTER (WHERE "Framework" = 'Spark MLlib'), 6) AS "Spark MLlib",
       round(max(value) FILTER (WHERE "Framework" = 'scikit-learn'), 6) AS "scikit-learn"
FROM l GROUP BY "Model", metric
""")
def q_metric_pivot(spark, sf_dir):
    return rounded(C.metric_pivot(comparison(spark, sf_dir)))


@register("best_model", f"""
WITH c AS {_sql_comparison()}
(SELECT 'F1-Score' AS criterion, "Model", "Framework", round("F1-Score", 6) AS value FROM c
 ORDER BY "F1-Score" DESC, position LIMIT 1)
UNION ALL
(SELECT 'Accuracy', "Model", "Framework", round("Accuracy", 6) FROM c ORDER BY "Accuracy" DESC, position LIMIT 1)
""")
def q_best_model(spark, sf_dir):
    return rounded(C.best_by(comparison(spark, sf_dir), "F1-Score", "Accuracy"))


@register("framework_time", f"""
WITH c AS {_sql_comparison()},
a AS (SELECT avg("Training Time") FILTER (WHERE "Framework" = 'Spark MLlib') AS a,
             avg("Training Time") FILTER (WHERE "Framework" = 'scikit-learn') AS b,
             count(*) FILTER (WHERE "Framework" = 'Spark MLlib') AS na,
             count(*) FILTER (WHERE "Framework" = 'scikit-learn') AS nb FROM c)
SELECT 'Spark MLlib' AS framework_a, round(a, 6) AS avg_time_a, 'scikit-learn' AS framework_b,
       round(b, 6) AS avg_time_b, CASE WHEN a < b THEN 'Spark MLlib' ELSE 'scikit-learn' END AS faster,
       round(abs(a - b), 6) AS gap
FROM a WHERE na > 0 AND nb > 0
""")
def q_framework_time(spark, sf_dir):
    return rounded(C.framework_time(comparison(spark, sf_dir)))


@register("insights", f"""
WITH c AS {_sql_comparison()},
b AS (SELECT * FROM c ORDER BY "F1-Score" DESC, position LIMIT 1),
a AS (SELECT * FROM c ORDER BY "Accuracy" DESC, position LIMIT 1),
t AS (SELECT avg("Training Time") FILTER (WHERE "Framework" = 'Spark MLlib') AS ta,
             avg("Training Time") FILTER (WHERE "Framework" = 'scikit-learn') AS tb,
             count(*) FILTER (WHERE "Framework" = 'Spark MLlib') AS na,
             count(*) FILTER (WHERE "Framework" = 'scikit-learn') AS nb FROM c)
SELECT 1 AS rank, 'Meilleur Modèle' AS title,
       printf('%s (%s) avec un F1-Score de %.2f%%', "Model", "Framework", round("F1-Score" * 100, 8)) AS text FROM b
UNION ALL
SELECT 2, 'Performance', printf('%s est plus rapide de %.2f secondes en moyenne',
       CASE WHEN ta < tb THEN 'Spark MLlib' ELSE 'scikit-learn' END, round(abs(ta - tb), 8)) FROM t WHERE na > 0 AND nb > 0
UNION ALL
SELECT 3, 'Meilleure Précision', printf('%s atteint %.2f%% d''accuracy', "Model", round("Accuracy" * 100, 8)) FROM a
""")
def q_insights(spark, sf_dir):
    return C.insights(comparison(spark, sf_dir))


@register("metric_text", f"""
WITH c AS {_sql_comparison()}
SELECT "Model", "Framework", printf('%.2f%%', round("Accuracy" * 100, 8)) AS accuracy_text,
       printf('%.2f%%', round("F1-Score" * 100, 8)) AS f1_text, printf('%.2f%%', round("AUC-ROC" * 100, 8)) AS auc_text,
       printf('%.2f', round("Training Time", 8)) AS time_text
FROM c
""")
def q_metric_text(spark, sf_dir):
    return C.metric_text(comparison(spark, sf_dir))


def _sql_result_text() -> str:
    pct = ", ".join(f"printf('%.2f%%', round({c} * 100, 8)) AS {c}_text"
                    for c in ("accuracy", "precision", "recall", "f1_score", "auc_roc"))
    return f"""
WITH m AS ({_sql_metrics(_sql_stacked(), ['model', 'framework'], None)}),
w AS (SELECT model, framework, sum(work) / 1000.0 AS training_time FROM {_sql_stacked()} s GROUP BY ALL)
SELECT m.model AS model, {pct},
       CASE WHEN w.training_time IS NOT NULL AND w.training_time <> 0
            THEN printf('%.2f', round(w.training_time, 8)) || 's' ELSE '' END AS time_text
FROM m JOIN w ON m.model = w.model AND m.framework = w.framework
WHERE m.framework = 'Spark MLlib'
"""


@register("result_text", _sql_result_text())
def q_result_text(spark, sf_dir):
    """P9 on the per-model metric rows of one framework (the result cards)."""
    ev = evaluated(spark, sf_dir, by=("model", "framework"))
    return C.result_text(C.framework_rows(ev, FRAMEWORK_SPARK, "framework"))


@register("display_names", """
WITH n AS (SELECT DISTINCT 'spark_' || event_type || '_model' AS name FROM events),
a AS (SELECT name, regexp_replace(regexp_replace(name, 'spark_', ''), '_', ' ') AS s FROM n)
SELECT name, array_to_string(list_transform(string_split(s, ' '),
              lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS display_name
FROM a
""")
def q_display_names(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    names = ev.select(F.concat(F.lit("spark_"), "event_type", F.lit("_model")).alias("name")).distinct()
    return names.select("name", C.display_name("name").alias("display_name"))


@register("results_bundle", f"""
WITH m AS ({_sql_metrics(_sql_stacked(), ['model', 'framework'])}),
w AS (SELECT model, framework, sum(work) / 1000.0 AS training_time FROM {_sql_stacked()} s GROUP BY ALL),
mm AS (SELECT m.*, w.training_time FROM m JOIN w USING (model, framework)),
c AS {_sql_comparison()}
SELECT 'spark' AS source, model, NULL::VARCHAR AS framework, accuracy, precision, recall, f1_score, auc_roc,
       round(training_time, 6) AS training_time, NULL::INTEGER AS position
FROM mm WHERE framework = 'Spark MLlib'
UNION ALL
SELECT 'sklearn', model, NULL, accuracy, precision, recall, f1_score, auc_roc, round(training_time, 6), NULL
FROM mm WHERE framework = 'scikit-learn'
UNION ALL
SELECT 'comparison', "Model", "Framework", round("Accuracy", 6), NULL, NULL, round("F1-Score", 6),
       round("AUC-ROC", 6), round("Training Time", 6), position FROM c
""")
def q_results_bundle(spark, sf_dir):
    return rounded(C.bundle_of(evaluated(spark, sf_dir)))


@register("results_from_files", f"SELECT * EXCLUDE (position) FROM ({SQL['results_bundle']}) b")
def q_results_from_files(spark, sf_dir):
    """S7 + S8 + R5: the two metric tables and the comparison written as CSV,
    read back with their schemas and bundled."""
    root = scratch_path(spark, "results")
    ev = evaluated(spark, sf_dir)
    fields = [f.name for f in METRIC_SCHEMA.fields]
    write_metrics_csv(ev.where(F.col("framework") == FRAMEWORK_SPARK).select(*fields), f"{root}/spark_results")
    write_metrics_csv(ev.where(F.col("framework") == FRAMEWORK_TWIN).select(*fields), f"{root}/sklearn_results")
    write_metrics_csv(comparison(spark, sf_dir).orderBy("position").drop("position"), f"{root}/comparison_results")
    return rounded(results_from_files(spark, root))


# requested model names: some events ask for a saved model, some for none
REQUESTED = {"view": MODEL_NAMES[0], "click": MODEL_NAMES[1], "error": None}
_SQL_REQUESTED = ("CASE event_type " + " ".join(
    f"WHEN '{k}' THEN {'NULL' if v is None else repr(v)}" for k, v in REQUESTED.items()) + " ELSE event_type END")


@register("unknown_model_rejects", f"""
WITH r AS (SELECT event_id, {_SQL_REQUESTED} AS model FROM events)
SELECT event_id, model, CASE WHEN model IS NULL THEN 'Modèle non spécifié'
       ELSE 'Modèle ' || model || ' non disponible' END AS reason,
       '{",".join(sorted(MODEL_NAMES))}' AS available_models
FROM r WHERE model IS NULL OR model NOT IN ({", ".join(f"'{m}'" for m in MODEL_NAMES)})
""")
def q_unknown_model_rejects(spark, sf_dir):
    model = F.col("event_type")
    for name, wanted in REQUESTED.items():
        model = F.when(F.col("event_type") == name, F.lit(wanted)).otherwise(model)
    req = table(spark, sf_dir, "events").select("event_id", model.alias("model"))
    cat = spark.createDataFrame([(m,) for m in MODEL_NAMES], "name string")
    return C.unknown_model_rejects(req, "model", cat).select("event_id", "model", "reason", "available_models")
