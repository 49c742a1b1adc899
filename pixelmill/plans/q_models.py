"""Registered queries: scaling, model selection, model store and scoring.

A fitted model cannot be written in SQL. The queries of this module therefore
return what must hold for any correct fit and is known to SQL: how many models
were fitted on how many rows, the identities between metrics, whether the fit is
proved (a linear model stands at its optimum, a forest's nodes give its votes), and for
every scored row that its decision fields follow from its prediction. Every query
prepares its own data.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pixelmill.operators import features as Fe
from pixelmill.operators import forest as Fo
from pixelmill.operators import kernel as Ke
from pixelmill.operators import metrics as Me
from pixelmill.operators import models as Mo
from pixelmill.operators import optimality as Op
from pixelmill.operators import scoring as Sc
from pixelmill.plans import train as Tr
from pixelmill.plans.common import SQL_SEVERITY, Registry, rounded, sql_split
from pixelmill.schemas import MODEL_NAMES
from pixelmill.session import scratch_path
from pixelmill.sources.tables import table
from pixelmill.streaming import routing as Ro
from pixelmill.streaming import scoring as St

register = Registry()
QUERIES, SQL = register.queries, register.sql

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]


def _sql_scaled(std_fn: str, centre: bool, zero_to_one: bool) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, {std_fn}({c}) AS s_{c}" for c in NUMERIC)
    cols = []
    for c in NUMERIC:
        x = f"(l.{c} - s.m_{c})" if centre else f"l.{c}"
        if zero_to_one:
            e = f"{x} / CASE WHEN s.s_{c} = 0 THEN 1.0 ELSE s.s_{c} END"
        else:
            e = f"CASE WHEN s.s_{c} = 0 THEN 0.0 ELSE {x} / s.s_{c} END"
        cols.append(f"round({e}, 6) AS z_{c}")
    return (f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l.l_orderkey, l.l_linenumber, "
            f"{', '.join(cols)} FROM lineitem l, s")


@register("standardize_sample", _sql_scaled("stddev_samp", True, False))
def q_standardize_sample(spark, sf_dir):
    """F1 + F2 + F5: assemble, centre and scale with MLlib (sample std)."""
    li = table(spark, sf_dir, "lineitem")
    return rounded(Fe.scaled_columns(li, NUMERIC, KEYS, with_mean=True, with_std=True))


@register("standardize_scale_only", _sql_scaled("stddev_samp", False, False))
def q_standardize_scale_only(spark, sf_dir):
    """MLlib scaler without centring."""
    li = table(spark, sf_dir, "lineitem")
    return rounded(Fe.scaled_columns(li, NUMERIC, KEYS, with_mean=False, with_std=True))


@register("standardize_pop", _sql_scaled("stddev_pop", True, True))
def q_standardize_pop(spark, sf_dir):
    """population-std standardisation as column expressions."""
    li = table(spark, sf_dir, "lineitem")
    return rounded(Fe.standardize_columns(li, NUMERIC, KEYS, ddof=0))


# --- C1-C8: the original three grids ---------------------------------------------------

#: Fits at a time: the tables of these queries are small.
PARALLELISM = 6
_KEY = "vec_id"


def prepared_table(spark, sf_dir):
    """The split, balanced training table of ``sf_dir``, written once per query."""
    return Tr.prepare(Tr.labelled_vectors(spark, sf_dir))


#: What a certified fit may leave: violation of the optimality conditions (logistic
#: regression), objective above its least value (SVM, of which the bound takes 0.003).
RESIDUALS = {"lr": 1e-5, "svm": 0.01}


def fit_proved(kind: str, model, train, test, weight=None) -> bool:
    """Whether a fitted pipeline is what its objective or its own nodes say: a linear
    model stands at its optimum; a forest's nodes add up, keep to its depth and, walked by
    joins, give its votes and predictions for every row of ``test``."""
    if kind != "rf":
        return bool(Op.residual(model, train, weight=weight) <= RESIDUALS[kind])
    forest = model.stages[-1]
    depth = forest.getOrDefault("maxDepth")
    nodes = Fo.forest_nodes(test.sparkSession, forest)
    if not Fo.structure_faults(nodes, depth).isEmpty():
        return False
    scored = model.transform(test)
    own = scored.dropDuplicates([_KEY]).select(_KEY, vector_to_array("rawPrediction").alias("_raw"), F.col("prediction").alias("_p"))
    both = own.join(Fo.walk(scored, nodes, [_KEY], forest.getOrDefault("featuresCol"), depth), _KEY, "full_outer")
    near = F.forall(F.zip_with("votes", "_raw", lambda a, b: F.abs(a - b) < 1e-9), lambda x: x)
    return both.where(~F.coalesce(near & (F.col("prediction") == F.col("_p")), F.lit(False))).isEmpty()


def _checks(fit, metrics, prepared, train_splits, proved):
    """One row: sizes of the selection, identities of its metrics and the proof of its fit."""
    n = {r["split"]: r["n"] for r in prepared.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    test = F.lit(float(n.get("test", 0)))
    hits = F.col("accuracy") * test
    within = lambda c: (F.col(c) >= 0) & (F.col(c) <= 1)
    val = prepared.where(F.col("split") == "val")
    ranked = Me.auc_roc(Tr.test_predictions(fit, val)).first()["auc_roc"]
    return metrics.select(
        "model", F.lit(len(fit.params)).alias("n_points"), F.lit(fit.n_fits).alias("n_fits"),
        F.lit(sum(n.get(s, 0) for s in train_splits)).cast("long").alias("n_train"),
        F.lit(n.get("val", 0)).cast("long").alias("n_val"), F.lit(n.get("test", 0)).cast("long").alias("n_test"),
        (F.abs(hits - F.round(hits)) < 1e-6).alias("hits_are_whole"),
        (F.abs(F.col("recall") - F.col("accuracy")) < 1e-9).alias("recall_is_accuracy"),
        (within("precision") & within("f1_score") & within("auc_roc")).alias("metrics_in_range"),
        F.lit(abs(max(fit.avg_metrics) - fit.avg_metrics[fit.params.index(fit.extra["best_params"])]) < 1e-12
              and all(0 <= m <= 1 for m in fit.avg_metrics)).alias("best_is_greatest"),
        # MLlib's value against the rank formula
        F.lit(bool(abs(fit.extra.get("val_auc", ranked) - ranked) < 1e-9)).alias("val_auc_is_rank_auc"),
        F.lit(proved).alias("fit_proved"))


def _sql_checks(model: str, points: int, splits: tuple[str, ...]) -> str:
    split = sql_split(_KEY)
    return f"""
WITH s AS (SELECT label, {split} AS split FROM {SQL_SEVERITY} e),
c AS (SELECT label, count(*) AS n FROM s WHERE split = 'train' GROUP BY label),
n AS (SELECT 'train' AS split, CAST(count(*) * floor(2.0 * max(n)) AS BIGINT) AS n FROM c
      UNION ALL SELECT split, count(*) FROM s WHERE split <> 'train' GROUP BY split)
SELECT '{model}' AS model, {points} AS n_points, {3 * points + 1} AS n_fits,
       CAST(sum(n) FILTER (WHERE split IN ({", ".join(f"'{x}'" for x in splits)})) AS BIGINT) AS n_train,
       CAST(sum(n) FILTER (WHERE split = 'val') AS BIGINT) AS n_val,
       CAST(sum(n) FILTER (WHERE split = 'test') AS BIGINT) AS n_test,
       TRUE AS hits_are_whole, TRUE AS recall_is_accuracy, TRUE AS metrics_in_range, TRUE AS best_is_greatest,
       TRUE AS val_auc_is_rank_auc, TRUE AS fit_proved
FROM n"""


def _cv_query(which: str):
    def run(spark, sf_dir):
        prepared = prepared_table(spark, sf_dir)
        fit, metrics = Tr.run_spark_grid(prepared, which, PARALLELISM)
        train, test = (prepared.where(F.col("split") == s) for s in ("train", "test"))
        return _checks(fit, metrics, prepared, ("train",), fit_proved(which, fit.model, train, test))
    run.__name__ = f"q_{which}_cv"
    return run


def _twin_query(which: str):
    def run(spark, sf_dir):
        """A single-machine grid re-aimed at MLlib (train + val merged,
        balanced class weights)."""
        prepared = prepared_table(spark, sf_dir)
        pool = Tr.twin_pool(prepared)
        fit, metrics = Tr.run_twin_grid(prepared, which, PARALLELISM, pool=pool)
        proved = fit_proved(which, fit.model, pool, prepared.where(F.col("split") == "test"), "class_weight")
        return _checks(fit, metrics, prepared, ("train", "val"), proved)
    run.__name__ = f"q_twin_{which}_cv"
    return run


_POINTS = {"lr": 9, "rf": 2, "svm": 1}
_TWIN_POINTS = {"lr": 4, "rf": 24, "svm": 3}
for _kind, (_name, *_) in Mo.KINDS.items():
    register.add(f"{_kind}_cv", _cv_query(_kind), _sql_checks(_name, _POINTS[_kind], ("train",)))
    register.add(f"twin_{_kind}_cv", _twin_query(_kind), _sql_checks(_name, _TWIN_POINTS[_kind], ("train", "val")))


@register("forest_walk", f"""
SELECT vec_id, label, TRUE AS votes_equal, TRUE AS prediction_equal, CAST({Mo.RF_SETTINGS["numTrees"]} AS BIGINT) AS votes
FROM {SQL_SEVERITY} e
""")
def q_forest_walk(spark, sf_dir):
    """Every row led through the nodes of a fitted forest by joins, against the
    model's own votes."""
    model = Mo.classifier_pipeline("rf")[0].fit(_train_split(spark, sf_dir))
    forest = model.stages[-1]
    scored = model.transform(Tr.labelled_vectors(spark, sf_dir))
    walked = Fo.walk(scored, Fo.forest_nodes(spark, forest), [_KEY], forest.getOrDefault("featuresCol"), forest.getOrDefault("maxDepth"))
    own = scored.select(_KEY, "label", vector_to_array("rawPrediction").alias("_raw"), F.col("prediction").alias("_p"))
    total = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v)
    return own.join(walked, _KEY, "left").select(
        _KEY, "label", F.forall(F.zip_with("votes", "_raw", lambda a, b: F.abs(a - b) < 1e-9), lambda x: x).alias("votes_equal"),
        (F.col("prediction") == F.col("_p")).alias("prediction_equal"), F.round(total).cast("long").alias("votes"))


@register("kernel_svm", f"""
WITH s AS (SELECT vec_id, label, {sql_split(_KEY)} AS split FROM {SQL_SEVERITY} e)
SELECT vec_id, label, TRUE AS probability_follows_score, TRUE AS prediction_follows_score, 9 AS n_points, TRUE AS curve_is_best
FROM s WHERE split = 'test'
""")
def q_kernel_svm(spark, sf_dir):
    """C11 with its Gaussian kernels and probabilities: the selected model on every
    test row; the curve of its probabilities is the best one through the left-out scores."""
    prepared = prepared_table(spark, sf_dir)
    pool = Tr.twin_pool(prepared)
    fit = Ke.fit_kernel_grid(pool, pool.count())
    curve = fit.extra["platt"]
    test = Tr.score_column(fit.model.transform(prepared.where(F.col("split") == "test")))
    scored = Ke.with_probability(test, curve)
    # the probability turns where the curve crosses one half
    follows = (F.col("probability") > 0.5) == (curve[0] * F.col("score") + curve[1] > 0)
    best = fit.extra["platt_residual"] < 1e-6
    return scored.select(_KEY, "label", follows.alias("probability_follows_score"),
                         ((F.col("score") > 0) == (F.col("prediction") == 1)).alias("prediction_follows_score"),
                         F.lit(len(fit.params)).alias("n_points"), F.lit(best).alias("curve_is_best"))


# --- R1, R3, S9, S10: scoring with saved models ------------------------------------------

def fit_and_save(spark, train, root, pre=()):
    """The three pipelines fitted at their fixed settings and saved."""
    for kind, name in zip(Mo.KINDS, MODEL_NAMES):
        pipe, _ = Mo.classifier_pipeline(kind, pre=pre)
        Mo.save_model(pipe.fit(train), root, name)


def saved_models(spark, train, pre=()):
    """Fit the three pipelines at their fixed settings, save them under the shared
    folder, load them back through the catalogue (S9 + S10)."""
    root = scratch_path(spark, "models")
    fit_and_save(spark, train, root, pre)
    return Mo.load_models(spark, root, MODEL_NAMES)


def _train_split(spark, sf_dir):
    return prepared_table(spark, sf_dir).where(F.col("split") == "train")


@register("model_catalogue", """
SELECT * FROM (VALUES
  ('logistic_regression', 'StandardScalerModel,LogisticRegressionModel', 'loaded'),
  ('random_forest', 'StandardScalerModel,RandomForestClassificationModel', 'loaded'),
  ('svm', 'StandardScalerModel,LinearSVCModel', 'loaded')) AS t(name, stages, status)
""")
def q_model_catalogue(spark, sf_dir):
    _, catalogue = saved_models(spark, _train_split(spark, sf_dir))
    return catalogue.drop("path")


def decision_checks(scored, keys):
    """Per scored row: the fields that follow from its prediction, as checks.
    The score of a forest is its votes (half of them decide), that of a linear
    model a signed distance."""
    cut = F.when(F.col("model") == "random_forest", F.lit(Mo.RF_SETTINGS["numTrees"] / 2)).otherwise(F.lit(0.0))
    flag = F.when(F.col("prediction") >= 1, F.lit(1)).otherwise(F.lit(0))
    return scored.select(
        *keys, "model", (F.col("flag") == flag).alias("flag_ok"),
        (F.col("class_predicted") == F.col("prediction")).alias("class_ok"),
        ((F.col("score") > cut) == (F.col("prediction") == 1)).alias("score_ok"),
        F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$").alias("timestamp_ok"))


SQL_DECISION_CHECKS = "TRUE AS flag_ok, TRUE AS class_ok, TRUE AS score_ok, TRUE AS timestamp_ok"


@register("batch_score", f"""
SELECT vec_id, label, model, {SQL_DECISION_CHECKS}
FROM {SQL_SEVERITY} e, (VALUES {", ".join(f"('{m}')" for m in MODEL_NAMES)}) AS m(model)
""")
def q_batch_score(spark, sf_dir):
    """R1 + P6 + X8 over the whole table: every row scored by every saved model, in
    one scan."""
    models, _ = saved_models(spark, _train_split(spark, sf_dir))
    keys = ["vec_id", "label"]
    return decision_checks(Sc.score_all(models, Tr.labelled_vectors(spark, sf_dir), keys), keys)


# --- R2-R4: requests that name their model ------------------------------------------------

#: Requested models in turn; every fourth request names one that is not there.
WANTED = (*MODEL_NAMES, "missing_model")


def wanted_model(key: str):
    return F.element_at(F.array(*[F.lit(m) for m in WANTED]), (F.pmod(F.col(key), F.lit(len(WANTED))) + 1).cast("int"))


def answer_checks(answers, keys):
    """Per request: its sink and reason, and as checks that its fields follow from its
    prediction (scored) or are not there (rejected)."""
    cut = F.when(F.col("model") == "random_forest", F.lit(Mo.RF_SETTINGS["numTrees"] / 2)).otherwise(F.lit(0.0))
    flag = F.when(F.col("prediction") >= 1, F.lit(1)).otherwise(F.lit(0))
    right = ((F.col("flag") == flag) & (F.col("class_predicted") == F.col("prediction"))
             & ((F.col("score") > cut) == (F.col("prediction") == 1)) & F.col("diagnosis").isNotNull())
    absent = F.coalesce("prediction", "score", "flag", "class_predicted").isNull() & F.col("diagnosis").isNull()
    fields = F.when(F.col("sink") == Sc.SCORED, F.coalesce(right, F.lit(False))).otherwise(absent)
    return answers.select(*keys, "model", "sink", "reason", "available_models", fields.alias("fields_ok"),
                          F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$").alias("timestamp_ok"))


SQL_ANSWERS = f"""
       CASE vec_id % 4 {" ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(WANTED))} END AS model,
       CASE WHEN vec_id % 4 < 3 THEN 'scored' ELSE 'rejected' END AS sink,
       CASE WHEN vec_id % 4 = 3 THEN 'Modèle missing_model non disponible' END AS reason,
       CASE WHEN vec_id % 4 = 3 THEN '{",".join(sorted(MODEL_NAMES))}' END AS available_models,
       TRUE AS fields_ok, TRUE AS timestamp_ok"""


def vectors_stream(spark, sf_dir):
    """The embeddings table as a stream."""
    schema = table(spark, sf_dir, "embeddings").schema
    return St.parquet_stream(spark, f"{sf_dir}/embeddings*.parquet", schema, max_files_per_trigger=64)


def _as_input(df):
    """Arriving rows as the models' input."""
    from pixelmill.functions.signal import as_double_array
    from pixelmill.operators.labels import binary_label
    return df.select("vec_id", Fe.array_vector(as_double_array("embedding")).alias("features"),
                     binary_label(F.col("label") % 5).alias("label"))


@register("stream_requests", f"SELECT vec_id, label, {SQL_ANSWERS} FROM {SQL_SEVERITY} e")
def q_stream_requests(spark, sf_dir):
    """R2 + R3 + R4: the embeddings table read as a stream of requests, each answered
    by the saved model that it names or rejected, read back from both sinks."""
    root = scratch_path(spark, "models")
    fit_and_save(spark, _train_split(spark, sf_dir), root)
    out = Ro.route_stream(spark, Ro.ModelStore(spark, root), vectors_stream(spark, sf_dir), "wanted", ["vec_id", "label"],
                          prepare=lambda df: _as_input(df).withColumn("wanted", wanted_model("vec_id")))
    return answer_checks(Ro.answers(spark, out), ["vec_id", "label"])


@register("stream_score", f"""
SELECT vec_id, label, 'logistic_regression' AS model, {SQL_DECISION_CHECKS}, TRUE AS equals_batch
FROM {SQL_SEVERITY} e
""")
def q_stream_score(spark, sf_dir):
    """The embeddings table read as a stream, scored by the saved logistic
    regression, written to a Parquet sink with a checkpoint; every row is held
    against the batch score of the same model."""
    models, _ = saved_models(spark, _train_split(spark, sf_dir))
    model, name = models["logistic_regression"], "logistic_regression"
    keys = ["vec_id", "label"]
    streamed = St.stream_score(spark, model, vectors_stream(spark, sf_dir), keys, name, prepare=_as_input)
    batch = Sc.score(model, Tr.labelled_vectors(spark, sf_dir), keys, name).select(
        F.col("vec_id").alias("_id"), F.col("prediction").alias("_p"), F.col("score").alias("_s"))
    joined = streamed.join(batch, F.col("vec_id") == F.col("_id"), "left")
    same = F.coalesce((F.col("prediction") == F.col("_p")) & (F.abs(F.col("score") - F.col("_s")) < 1e-9), F.lit(False))
    return decision_checks(joined, keys + [same.alias("equals_batch")])
