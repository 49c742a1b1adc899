"""Entry point B: prepare a leak-free training table, select models by
cross-validation, evaluate on the held-out split.

Order of operations (fixes the original's leaks): split by source id first,
balance the training split only, fit scaling inside each pipeline on training
folds only. The prepared table is written once to the shared folder,
partitioned by split, and read back: CV reads it dozens of times, and a written
table both cuts the lineage and survives a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.signal import as_double_array
from pixelmill.operators import metrics as E
from pixelmill.operators import models as Mo
from pixelmill.operators import sampling as B
from pixelmill.operators.features import array_vector
from pixelmill.plans.common import severity_frame
from pixelmill.schemas import MODEL_NAMES
from pixelmill.session import scratch_path
from pixelmill.sources.tables import write_parquet

SEED = 42


def labelled_vectors(spark, sf_dir: str) -> DataFrame:
    """(vec_id, features VECTOR, label) from the embeddings table."""
    s = severity_frame(spark, sf_dir)
    return s.select("vec_id", array_vector(as_double_array("embedding")).alias("features"), "label")


def prepare(df: DataFrame, key: str = "vec_id", label: str = "label", factor: float = 2.0,
            balance: bool = True, path: str | None = None, leaky: bool = False) -> DataFrame:
    """Split -> balance train only -> fold ids -> one Parquet table by split
    (written to ``path``, default a fresh folder under the shared folder).

    ``leaky=True`` reproduces the original order for comparison only: every
    class is oversampled first and each *copy* is split on its own, so copies
    of one row reach train, validation and test alike."""
    spark = df.sparkSession
    if leaky:
        bal = B.exact_balance(df, key, label, factor, SEED)
        out = (B.hash_split(bal.withColumn("_copy_key", F.concat_ws(":", F.col(key).cast("string"),
                                                                      F.col("copy").cast("string"))),
                            "_copy_key", SEED)
               .drop("_copy_key").withColumn("fold", Mo.fold_column(key)))
        path = path or scratch_path(spark, "prepared-leaky")
        write_parquet(out, path, partition_by=["split"])
        return spark.read.parquet(path)
    split = B.hash_split(df, key, SEED)
    train = split.where(F.col("split") == "train")
    rest = split.where(F.col("split") != "train").withColumn("copy", F.lit(1).cast("long"))
    if balance:
        train = B.exact_balance(train, key, label, factor, SEED)
    else:
        train = train.withColumn("copy", F.lit(1).cast("long"))
    out = train.unionByName(rest).withColumn("fold", Mo.fold_column(key))
    path = path or scratch_path(spark, "prepared")
    write_parquet(out, path, partition_by=["split"])
    return spark.read.parquet(path)


def score_column(pred: DataFrame, raw: str = "rawPrediction") -> DataFrame:
    return pred.withColumn("score", E.positive_score(raw))


def test_predictions(result: Mo.FitResult, test: DataFrame, label: str = "label") -> DataFrame:
    """(label, prediction, score) of the selected model on the test split."""
    return score_column(result.model.transform(test)).select(F.col(label).alias("label"), "prediction", "score")


def test_metrics(result: Mo.FitResult, test: DataFrame, label: str = "label") -> DataFrame:
    """One metrics row of the selected model on the test split. The split
    is scored in one pass."""
    m = E.evaluate(test_predictions(result, test, label))
    return m.select(F.lit(result.name).alias("model"), "accuracy", "precision", "recall", "f1_score",
                    "auc_roc", F.lit(float(result.training_time)).alias("training_time"))


def test_tables(result: Mo.FitResult, test: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """C8 in full: confusion matrix and per-class report of a fitted model."""
    pred = test_predictions(result, test, label)
    name = F.lit(result.name).alias("model")
    return (E.confusion_matrix(pred).select(name, "*"), E.class_report(pred).select(name, "*"))


def run_spark_grid(prepared: DataFrame, which: str, parallelism: int | None = None, pre=()):
    """Fit one of the original MLlib grids; returns (FitResult, metrics row).
    ``pre`` stages (e.g. a VectorAssembler) become part of the saved model."""
    train = prepared.where(F.col("split") == "train")
    fit = Mo.fit_grid(which, train, pre=pre, fold_col="fold", parallelism=parallelism)
    fit.extra["val_auc"] = Mo.validation_auc(fit, prepared.where(F.col("split") == "val"))
    return fit, test_metrics(fit, prepared.where(F.col("split") == "test"))


def twin_pool(prepared: DataFrame) -> DataFrame:
    """Train + val merged (S12 stack) with balanced class weights, written once:
    every fit reads it."""
    pool = B.union_all(prepared.where(F.col("split") == "train"), prepared.where(F.col("split") == "val"))
    spark, path = prepared.sparkSession, scratch_path(prepared.sparkSession, "twin-pool")
    write_parquet(B.class_weights(pool, "label"), path)
    return spark.read.parquet(path)


def run_twin_grid(prepared: DataFrame, which: str, parallelism: int | None = None, pre=(), pool: DataFrame | None = None):
    """One re-aimed grid over :func:`twin_pool`."""
    pool = twin_pool(prepared) if pool is None else pool
    n = pool.count()  # one scalar: sets regParam = 1 / (C * n)
    fit = Mo.fit_twin(which, pool, n, pre=pre, fold_col="fold", parallelism=parallelism)
    return fit, test_metrics(fit, prepared.where(F.col("split") == "test"))


def report(prepared: DataFrame, out_dir: str, feature_cols: list[str] | None = None,
           twin: bool = True, parallelism: int | None = None):
    """Entry point B end to end: the three original grids (+ optionally the
    three re-aimed single-machine grids), saved models (S9), metric CSVs (S7),
    average metrics per grid point, validation AUCs (C6), confusion matrices and class
    reports of the fitted models, and the comparison table (P8 + W3), all written under
    ``out_dir``. Returns (spark rows, twin rows, comparison) as read back."""
    from pixelmill.operators import compare as C
    from pixelmill.operators.features import assembler
    from pixelmill.schemas import FRAMEWORK_SPARK, FRAMEWORK_TWIN
    from pixelmill.sources.tables import read_comparison_csv, read_metrics_csv, write_metrics_csv

    spark, root = prepared.sparkSession, out_dir.rstrip("/")
    pre = [assembler(feature_cols, "features", "skip")] if feature_cols else []
    test = prepared.where(F.col("split") == "test")
    names = dict(zip(("lr", "rf", "svm"), MODEL_NAMES))
    rows, twin_rows, grids, confusions, reports, validation = [], [], [], [], [], []
    for which, name in names.items():
        fit, m = run_spark_grid(prepared, which, parallelism, pre)
        Mo.save_model(fit.model, out_dir, name)
        confusion, classes = test_tables(fit, test)
        rows.append(m)
        grids.append(Mo.cv_table(spark, fit))
        confusions.append(confusion)
        reports.append(classes)
        validation.append((fit.name, float(fit.extra["val_auc"])))
        if twin:
            twin_rows.append(run_twin_grid(prepared, which, parallelism, pre)[1])
    for table, where in ((rows, "spark_results"), (twin_rows, "sklearn_results"), (grids, "cv_results"),
                         (confusions, "confusion_matrices"), (reports, "class_reports")):
        if table:
            write_metrics_csv(B.union_all(*table), f"{root}/{where}")
    write_metrics_csv(spark.createDataFrame(validation, "model string, val_auc double"), f"{root}/validation_results")
    spark_df = read_metrics_csv(spark, f"{root}/spark_results")
    twin_df = read_metrics_csv(spark, f"{root}/sklearn_results") if twin_rows else None
    parts = [C.to_comparison(spark_df, FRAMEWORK_SPARK)]
    if twin_rows:
        parts.append(C.to_comparison(twin_df, FRAMEWORK_TWIN))
    write_metrics_csv(C.union_frameworks(parts), f"{root}/comparison_results")
    return spark_df, twin_df, read_comparison_csv(spark, f"{root}/comparison_results")


def results_from_files(spark, out_dir: str) -> DataFrame:
    """The result files under ``out_dir`` as one tagged table; files that are
    not there add no rows."""
    from pixelmill.operators import compare as C
    from pixelmill.sources.tables import read_comparison_csv, read_metrics_csv

    root = out_dir.rstrip("/")
    return C.results_bundle(spark=read_metrics_csv(spark, f"{root}/spark_results"),
                            sklearn=read_metrics_csv(spark, f"{root}/sklearn_results"),
                            comparison=C.from_comparison(read_comparison_csv(spark, f"{root}/comparison_results")))
