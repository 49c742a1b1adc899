"""Model-comparison tables and insights.

Inputs are metric tables: one row per (model[, framework]). They are small by
nature (models x frameworks), but every step is still a DataFrame operation so
that the same code runs on a stacked table of any number of evaluations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.schemas import FRAMEWORK_SPARK, FRAMEWORK_TWIN, MODEL_PREFIX

METRIC_COLUMNS = ("Accuracy", "F1-Score", "AUC-ROC", "Training Time")

# --- fixed values: insight titles and sentence formats (must equal the original) ---
INSIGHT_BEST_TITLE = "Meilleur Modèle"
INSIGHT_SPEED_TITLE = "Performance"
INSIGHT_ACC_TITLE = "Meilleure Précision"
INSIGHT_BEST_TEXT = "%s (%s) avec un F1-Score de %s%%"
INSIGHT_SPEED_TEXT = "%s est plus rapide de %s secondes en moyenne"
INSIGHT_ACC_TEXT = "%s atteint %s%% d'accuracy"
UNKNOWN_MODEL_TEXT = "Modèle %s non disponible"
MISSING_MODEL_TEXT = "Modèle non spécifié"
# -------------------------------------------------------------------------------------


def q(name: str) -> Column:
    """Column by a name that may hold spaces or dashes."""
    return F.col(f"`{name}`")


def to_comparison(metrics: DataFrame, framework: str | Column, model_col: str = "model",
                  keep: list[str] | tuple = ()) -> DataFrame:
    """Metric rows -> comparison rows (renamed columns; the framework is a
    constant or a column of the rows)."""
    fw = framework if isinstance(framework, Column) else F.lit(framework)
    return metrics.select(
        F.col(model_col).alias("Model"), fw.alias("Framework"),
        F.col("accuracy").alias("Accuracy"), F.col("f1_score").alias("F1-Score"),
        F.col("auc_roc").alias("AUC-ROC"), F.col("training_time").alias("Training Time"), *keep)


def from_comparison(comp: DataFrame) -> DataFrame:
    """Comparison rows -> the metric-table column names (inverse of P8), so a
    results bundle never holds two columns that differ only in case."""
    return comp.select(
        F.col("Model").alias("model"), F.col("Framework").alias("framework"),
        q("Accuracy").alias("accuracy"), q("F1-Score").alias("f1_score"),
        q("AUC-ROC").alias("auc_roc"), q("Training Time").alias("training_time"),
        *[c for c in comp.columns if c not in ("Model", "Framework", *METRIC_COLUMNS)])


def framework_rows(comp: DataFrame, framework: str, col: str = "Framework") -> DataFrame:
    """Comparison rows of one framework."""
    return comp.where(F.col(col) == F.lit(framework))


def union_frameworks(parts: list[DataFrame]) -> DataFrame:
    """Stack per-framework comparison rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metric_pivot(comp: DataFrame, frameworks=(FRAMEWORK_SPARK, FRAMEWORK_TWIN),
                 metrics=METRIC_COLUMNS) -> DataFrame:
    """One row per (Model, metric), one column per framework.

    A (Model, Framework) pair that appears twice is an error, raised on the
    executors while the pivot runs."""
    long = comp.select("Model", "Framework", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), q(m).cast("double").alias("value")) for m in metrics
    ])).alias("_m")).select("Model", "Framework", "_m.metric", "_m.value")
    dup = F.count(F.lit(1)) > 1
    checked = long.groupBy("Model", "Framework", "metric").agg(
        F.when(dup, F.raise_error(F.lit("duplicate (Model, Framework) in comparison table")))
        .otherwise(F.first("value")).alias("value"))
    return checked.groupBy("Model", "metric").pivot("Framework", list(frameworks)).agg(F.first("value"))


def _best(metric: str, position: str) -> Column:
    """The row with the largest ``metric`` as an aggregate; the earliest wins ties."""
    return F.max_by(F.struct("Model", "Framework", q(metric).alias("value")),
                    F.struct(q(metric), -F.col(position)))


def best_by(comp: DataFrame, *metrics: str, position: str = "position") -> DataFrame:
    """For each metric the row with the largest value; the earliest row
    wins ties. One aggregation for all metrics; no rows for an empty table."""
    found = comp.agg(F.explode(F.array(*[
        F.struct(F.lit(m).alias("criterion"), _best(m, position).alias("b")) for m in metrics])).alias("x"))
    return found.where(F.col("x.b").isNotNull()).select("x.criterion", "x.b.Model", "x.b.Framework", "x.b.value")


def _times(a: str, b: str) -> list[Column]:
    t = q("Training Time")
    return [F.avg(F.when(F.col("Framework") == a, t)).alias("avg_a"),
            F.avg(F.when(F.col("Framework") == b, t)).alias("avg_b"),
            F.count_if(F.col("Framework") == a).alias("n_a"),
            F.count_if(F.col("Framework") == b).alias("n_b")]


def _faster(a: str, b: str) -> Column:
    return F.when(F.col("avg_a") < F.col("avg_b"), F.lit(a)).otherwise(F.lit(b))


def framework_time(comp: DataFrame, a: str = FRAMEWORK_SPARK, b: str = FRAMEWORK_TWIN) -> DataFrame:
    """Mean training time of two frameworks, the faster one and the gap.

    Empty when either framework has no rows. Ties go to the second framework
    (the original compares with a strict '<')."""
    return (comp.agg(*_times(a, b)).where((F.col("n_a") > 0) & (F.col("n_b") > 0))
            .select(F.lit(a).alias("framework_a"), F.col("avg_a").alias("avg_time_a"),
                    F.lit(b).alias("framework_b"), F.col("avg_b").alias("avg_time_b"),
                    _faster(a, b).alias("faster"),
                    F.abs(F.col("avg_a") - F.col("avg_b")).alias("gap")))


def fixed2(x: Column) -> Column:
    """Two-decimal text rounded on the exact binary value (as toFixed(2) and C
    printf do; ``format_string`` would round the shortest decimal form and turn
    41.734999... into 41.74). The value is first rounded to 8 decimals so
    last-bit noise of a sum at an exact tie (e.g. 0.41735) cannot decide the
    digit. ``format_number`` groups thousands: the commas are dropped."""
    return F.regexp_replace(F.format_number(F.round(x, 8), 2), ",", "")


def percent_text(x: Column) -> Column:
    """0.94985 -> '94.99' (two decimals of the percentage)."""
    return fixed2(x * 100)


def metric_text(comp: DataFrame) -> DataFrame:
    """P9, comparison rows: metrics as percentages with two decimals, the
    training time with two decimals."""
    return comp.select(
        "Model", "Framework",
        F.concat(percent_text(q("Accuracy")), F.lit("%")).alias("accuracy_text"),
        F.concat(percent_text(q("F1-Score")), F.lit("%")).alias("f1_text"),
        F.concat(percent_text(q("AUC-ROC")), F.lit("%")).alias("auc_text"),
        fixed2(q("Training Time")).alias("time_text"))


def result_text(metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """P9, per-model result cards: five metrics as percentages; the time
    ('12.37s') only when it is present and non-zero, else empty."""
    t = F.col("training_time")
    pct = {c: F.concat(percent_text(F.col(c)), F.lit("%"))
           for c in ("accuracy", "precision", "recall", "f1_score", "auc_roc")}
    return metrics.select(
        F.col(model_col).alias("model"), *[v.alias(f"{k}_text") for k, v in pct.items()],
        F.when(t.isNotNull() & (t != 0) & ~F.isnan(t), F.concat(fixed2(t), F.lit("s")))
        .otherwise(F.lit("")).alias("time_text"))


def display_name(name: Column | str) -> Column:
    """P10: drop the first 'spark_', turn the first '_' into a space, upper-case
    the first letter of each space-separated word (the rest is kept as is)."""
    n = F.col(name) if isinstance(name, str) else name
    n = F.regexp_replace(n, f"^(.*?){MODEL_PREFIX}", "$1")
    n = F.regexp_replace(n, "^([^_]*)_", "$1 ")
    words = F.split(n, " ")
    cap = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.array_join(cap, " ")


def insights(comp: DataFrame, position: str = "position",
             a: str = FRAMEWORK_SPARK, b: str = FRAMEWORK_TWIN) -> DataFrame:
    """Up to three insight rows (rank, title, text): best model by F1, the
    faster framework (only when both are present), best accuracy. The comparison
    is read once, in one aggregation."""
    row = lambda rank, title, text: F.struct(F.lit(rank).alias("rank"), F.lit(title).alias("title"), text.alias("text"))
    agg = comp.agg(*_times(a, b), _best("F1-Score", position).alias("f1"), _best("Accuracy", position).alias("acc"))
    rows = F.array(
        F.when(F.col("f1").isNotNull(), row(1, INSIGHT_BEST_TITLE, F.format_string(
            INSIGHT_BEST_TEXT, "f1.Model", "f1.Framework", percent_text(F.col("f1.value"))))),
        F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), row(2, INSIGHT_SPEED_TITLE, F.format_string(
            INSIGHT_SPEED_TEXT, _faster(a, b), fixed2(F.abs(F.col("avg_a") - F.col("avg_b")))))),
        F.when(F.col("acc").isNotNull(), row(3, INSIGHT_ACC_TITLE, F.format_string(
            INSIGHT_ACC_TEXT, "acc.Model", percent_text(F.col("acc.value"))))))
    return agg.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("x")).select("x.rank", "x.title", "x.text")


def results_bundle(**tables: DataFrame) -> DataFrame:
    """Several result tables stacked with a ``source`` tag; columns missing
    from a table are null."""
    out = None
    for name, df in tables.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def bundle_of(evaluated: DataFrame, a: str = FRAMEWORK_SPARK, b: str = FRAMEWORK_TWIN) -> DataFrame:
    """R5 from one table of metrics (model, framework, position, ...): every row as a row
    of its framework's result table and as one of the comparison. The metrics are
    computed once, as nothing is filtered or stacked."""
    none = lambda kind: F.lit(None).cast(kind)
    same = [F.col(c) for c in ("accuracy", "f1_score", "auc_roc", "training_time", "model")]
    own = F.struct(*same, F.col("precision"), F.col("recall"), none("string").alias("framework"), none("int").alias("position"),
                   F.when(F.col("framework") == a, F.lit("spark")).when(F.col("framework") == b, F.lit("sklearn")).alias("source"))
    compared = F.struct(*same, none("double").alias("precision"), none("double").alias("recall"), F.col("framework"),
                        F.col("position").cast("int").alias("position"), F.lit("comparison").alias("source"))
    rows = F.filter(F.array(own, compared), lambda r: r["source"].isNotNull())
    return evaluated.select(F.explode(rows).alias("_r")).select("_r.*")


MAX_MODELS = 10_000


def _named(catalogue: DataFrame, name_col: str) -> list[str]:
    """The model names of a catalogue (one row per saved model), checked to be few."""
    names = [r[0] for r in catalogue.select(name_col).distinct().limit(MAX_MODELS + 1).collect()]
    if len(names) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models in the catalogue")
    return sorted(n for n in names if n is not None)


def unknown_model_rejects(requests: DataFrame, model_col: str, catalogue: DataFrame,
                          name_col: str = "name") -> DataFrame:
    """Requests naming a model absent from the catalogue, with the reason
    and the list of available names. A request without a name is rejected too,
    with its own reason. The catalogue is bounded (``MAX_MODELS``), so the names
    become part of the plan: one narrow pass over the requests."""
    names = _named(catalogue, name_col)
    model = F.col(model_col)
    known = model.isin(*names) if names else F.lit(False)
    return (requests.where(model.isNull() | ~known)
            .withColumn("available_models", F.lit(",".join(names)))
            .withColumn("reason", F.when(model.isNull(), F.lit(MISSING_MODEL_TEXT))
                        .otherwise(F.format_string(UNKNOWN_MODEL_TEXT, model))))
