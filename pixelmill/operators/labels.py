"""Labels: derivation, class folders, label-to-item joins, distributions
(P1-P4, S3, J1, J2, A1, A3, W5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.schemas import CLASS_FOLDERS, DEFAULT_FOLDER


def binary_label(severity: Column | str, threshold: int = 1) -> Column:
    """1 when severity >= threshold, else 0 (a missing severity counts as 0)."""
    s = F.col(severity) if isinstance(severity, str) else severity
    return F.when(s >= threshold, F.lit(1)).otherwise(F.lit(0))


def class_folder(severity: Column | str) -> Column:
    """S3: severity grade -> class folder name; unknown grades -> default folder."""
    s = F.col(severity) if isinstance(severity, str) else severity
    pairs = []
    for k, v in sorted(CLASS_FOLDERS.items()):
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[s], F.lit(DEFAULT_FOLDER))


def image_path(root: str, folder: Column, key: Column | str, ext: str = ".png") -> Column:
    """S3: ``root/folder/key.ext``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.concat_ws("/", F.lit(root), folder, F.concat(k.cast("string"), F.lit(ext)))


def parse_image_path(path: Column | str) -> tuple[Column, Column]:
    """Inverse of :func:`image_path`: (folder, key) from ``.../folder/key.ext``."""
    p = F.col(path) if isinstance(path, str) else path
    return (F.regexp_extract(p, r"([^/]+)/[^/]+$", 1),
            F.regexp_extract(p, r"([^/]+)\.[^./]+$", 1))


def numeric_feature_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Every numeric column not in ``exclude`` (schema only, no job)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def join_labels(items: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled items (inner equi-join).

    Both sides can hold one row per item, so neither is broadcast by hand: AQE
    turns the sort-merge join into a broadcast join at run time only when a side
    is measured small, and splits skewed partitions otherwise."""
    return items.join(labels, on=keys, how="inner")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` with no partner in ``right`` (left anti-join)."""
    return left.join(right, on=keys, how="left_anti")


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """A1: rows per class (map-side partial counts, then one tiny shuffle)."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    """A3 + W5: value frequencies, nulls excluded, most frequent first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(col)))
