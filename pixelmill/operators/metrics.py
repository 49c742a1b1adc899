"""Classifier metrics as DataFrame aggregations.

Everything is lazy: no job runs while a metric is defined, and nothing is
collected. A stacked table of many models' predictions gets every model's
metrics in one plan (``by=["model"]``). :func:`evaluate` reads the predictions
once: one aggregate by (group, label, prediction, score) feeds the per-class
counts and the exact AUC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.schemas import DIAGNOSIS_NEGATIVE, DIAGNOSIS_POSITIVE


def _safe_div(a: Column, b: Column, default=0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def confusion_long(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                   by: list[str] | tuple = ()) -> DataFrame:
    """(by..., label, prediction, n) with label/prediction as doubles: at most
    groups x classes^2 rows, counted with map-side partial counts."""
    return (pred.groupBy(*by, F.col(label).cast("double").alias("label"),
                         F.col(prediction).cast("double").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes=(0, 1), by: list[str] | tuple = ()) -> DataFrame:
    """A5: rows = true class, one count column per predicted class (0 when
    absent) and ``pred_other`` for predictions outside ``classes``, null included."""
    p = F.col(prediction).cast("double")
    known = F.coalesce(p.isin(*[float(c) for c in classes]), F.lit(False))
    return (pred.groupBy(*by, F.col(label).cast("int").alias("label"))
            .agg(*[F.count_if(p == F.lit(float(c))).alias(f"pred_{c}") for c in classes],
                 F.count_if(~known).alias("pred_other")))


def per_class(conf: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Per (by..., class): support, predicted, tp, precision, recall, f1.

    Each confusion cell counts once as support of its true class and once as
    a prediction of its predicted class: one aggregation, no joins."""
    by = list(by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    roles = conf.select(*by, F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"),
                 hit.cast("long").alias("t")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"),
                 F.lit(0).cast("long").alias("t")))).alias("_r"))
    out = roles.groupBy(*by, F.col("_r.class").alias("class")).agg(
        F.sum("_r.s").alias("support"), F.sum("_r.p").alias("predicted"), F.sum("_r.t").alias("tp"))
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    out = out.withColumn("precision", prec).withColumn("recall", rec)
    return out.withColumn("f1_score", _safe_div(2 * F.col("precision") * F.col("recall"),
                                                F.col("precision") + F.col("recall")))


def _weighted(pc: DataFrame, by: list[str]) -> DataFrame:
    total = F.sum("support")
    return pc.groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f1_score") * F.col("support")) / total).alias("f1_score"),
    )


def weighted_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: list[str] | tuple = ()) -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (the
    definitions of MLlib's MulticlassClassificationEvaluator)."""
    by = list(by)
    return _weighted(per_class(confusion_long(pred, label, prediction, by), by), by)


def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class precision/recall/F1/support, then accuracy, macro and
    support-weighted averages, as one long table keyed by ``row``."""
    pc = per_class(confusion_long(pred, label, prediction)).where(F.col("support") > 0)
    classes = pc.select(F.col("class").cast("int").cast("string").alias("row"),
                        "precision", "recall", "f1_score", F.col("support").cast("long").alias("support"))
    tot = F.sum("support")
    wavg = lambda c: F.sum(F.col(c) * F.col("support")) / tot
    none = F.lit(None).cast("double")
    summary = pc.agg(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row"), none.alias("precision"), none.alias("recall"),
                 (F.sum("tp") / tot).alias("f1_score"), tot.cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"),
                 tot.cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), wavg("precision").alias("precision"),
                 wavg("recall").alias("recall"), wavg("f1_score").alias("f1_score"),
                 tot.cast("long").alias("support")))).alias("_x")).select("_x.*")
    return classes.unionByName(summary)


def auc_roc(pred: DataFrame, label: str = "label", score: str = "score",
            by: list[str] | tuple = ()) -> DataFrame:
    """A10: exact area under the ROC curve (ties count one half)."""
    by = list(by)
    key = by if by else ["_g"]
    src = pred if by else pred.withColumn("_g", F.lit(0))
    is_pos = F.col(label).cast("double") == 1.0
    out = _auc(src.groupBy(*key, F.col(score).cast("double").alias("_s"))
               .agg(F.count_if(is_pos).alias("_pos"), F.count_if(~is_pos).alias("_neg")), key)
    return out if by else out.drop("_g")


def _auc(scores: DataFrame, key: list[str]) -> DataFrame:
    """AUC per group from one row per (group, distinct score).

    AUC = sum over positives of (#negatives with a lower score + 1/2 #equal)
    / (#pos * #neg). The distinct scores are range-partitioned by (group,
    score); each range of a group takes its own running sum and shrinks to one
    row (area inside the range, positives, negatives), and the ranges of a group,
    at most one per partition, are put together in order. So the largest task
    holds one range, however the scores are distributed."""
    ranged = (scores.repartitionByRange(*key, "_s").withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*key, "_range").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    parts = (ranged.withColumn("_below", F.coalesce(F.sum("_neg").over(inside), F.lit(0)))
             .groupBy(*key, "_range").agg(
                 F.sum(F.col("_pos") * (F.col("_below") + 0.5 * F.col("_neg"))).alias("_area"),
                 F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = parts.groupBy(*key).agg(F.sum(F.col("_area") + F.col("_p") * F.col("_before")).alias("_num"),
                                  F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    denom = F.col("_p").cast("double") * F.col("_n")
    return out.select(*key, F.when(denom > 0, F.col("_num") / denom).alias("auc_roc"))


def evaluate(pred: DataFrame, label: str = "label", prediction: str = "prediction",
             score: str = "score", by: list[str] | tuple = (),
             sums: dict[str, str] | None = None) -> DataFrame:
    """Accuracy, weighted precision / recall / F1 and AUC per group,
    from one aggregate of the predictions."""
    key, sums = list(by) if by else ["_g"], sums or {}
    src = pred if by else pred.withColumn("_g", F.lit(0))
    cells = (src.groupBy(*key, F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("label"),
                         F.col(prediction).cast("double").alias("prediction"))
             .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()]))
    conf = cells.groupBy(*key, "label", "prediction").agg(F.sum("n").alias("n"))
    is_pos = F.col("label") == 1.0
    scores = cells.groupBy(*key, "_s").agg(
        F.coalesce(F.sum(F.when(is_pos, F.col("n"))), F.lit(0)).alias("_pos"),
        F.coalesce(F.sum(F.when(~is_pos, F.col("n"))), F.lit(0)).alias("_neg"))
    out = _weighted(per_class(conf, key), key).join(_auc(scores, key), key)
    if sums:
        out = out.join(cells.groupBy(*key).agg(*[F.sum(f"_sum_{name}").alias(name) for name in sums]), key)
    return out if by else out.drop("_g")


def decision(prediction: Column | str) -> list[Column]:
    """Binary flag, predicted class and decision text from a prediction."""
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    cls = p.cast("int")
    flag = F.when(cls >= 1, F.lit(1)).otherwise(F.lit(0))
    text = F.when(cls >= 1, F.lit(DIAGNOSIS_POSITIVE)).otherwise(F.lit(DIAGNOSIS_NEGATIVE))
    return [flag.alias("flag"), cls.alias("class_predicted"), text.alias("diagnosis")]


def positive_score(col: str) -> Column:
    """Class-1 score from an MLlib ``rawPrediction`` / ``probability`` vector."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))[1]
