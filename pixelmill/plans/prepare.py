"""Entry point A: image files + label CSV -> feature table -> split,
balanced, written by split.

    image scan -> (id, class folder) parsed from the path
      -> 42 features per image inside the scan task (mapInPandas, I12)
      -> join labels on the feature rows (J1; labels that produced no
         feature row are reported, J2)
      -> binary label (P1) -> hash split by id (B3)
      -> oversample the training split only (B1 / B2)
      -> Parquet partitioned by split (S5)

Pixels never cross a shuffle: images are reduced to 42 numbers where they
are read, and only those rows meet the labels. The split is decided per image
id before any copy is made, so copies never leak across splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators import images as I
from pixelmill.operators import sampling as B
from pixelmill.operators.labels import binary_label
from pixelmill.operators.models import fold_column
from pixelmill.schemas import FEATURE_NAMES
from pixelmill.sources.tables import read_labels_csv, write_parquet

SEED = 42


@dataclass
class Prepared:
    table: DataFrame          # features + label + split + copy + fold
    unmatched_labels: DataFrame
    path: str


def image_feature_table(spark: SparkSession, image_root: str, labels_csv: str) -> tuple[DataFrame, DataFrame]:
    """(features with their label, all labels as read)."""
    labels = read_labels_csv(spark, labels_csv)
    feats, _ = I.labelled_features(spark, image_root, labels)
    return feats.withColumn("label", binary_label("diagnosis")), labels


def prepare_images(spark: SparkSession, image_root: str, labels_csv: str, out_path: str,
                   balance: str = "exact", factor: float = 2.0) -> Prepared:
    feats, labels = image_feature_table(spark, image_root, labels_csv)
    # features are computed once and written: everything after reads the table
    staged = out_path.rstrip("/") + "/_features"
    write_parquet(feats, staged)
    feats = spark.read.parquet(staged)
    # J2 against the written feature keys: labels that produced no features
    known = feats.select(F.col("id_code").alias("_id"), F.col("diagnosis").alias("_grade"))
    missing = labels.join(known, (F.col("id_code") == F.col("_id")) & F.col("diagnosis").eqNullSafe(F.col("_grade")), "left_anti")
    split = B.hash_split(feats, "id_code", SEED)
    train = split.where(F.col("split") == "train")
    rest = split.where(F.col("split") != "train").withColumn("copy", F.lit(1).cast("long"))
    if balance == "exact":
        train = B.exact_balance(train, "id_code", "label", factor, SEED)
    elif balance == "bootstrap":
        train = B.bootstrap_balance(train, "id_code", "label", factor, SEED)
    else:
        train = train.withColumn("copy", F.lit(1).cast("long"))
    out = train.unionByName(rest).withColumn("fold", fold_column("id_code"))
    final = out_path.rstrip("/") + "/prepared"
    write_parquet(out, final, partition_by=["split"])
    return Prepared(spark.read.parquet(final), missing, final)


def feature_columns() -> list[str]:
    return list(FEATURE_NAMES)
