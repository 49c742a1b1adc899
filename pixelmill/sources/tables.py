"""Table scans and sinks.

Scans are plain ``spark.read`` calls with explicit schemas where the format has
none, so Catalyst prunes columns and pushes filters into the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pixelmill.schemas import COMPARISON_SCHEMA, LABEL_SCHEMA, METRIC_SCHEMA

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one named table under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_labels_csv(spark: SparkSession, path: str, schema: T.StructType = LABEL_SCHEMA) -> DataFrame:
    """Label CSV with a header, read with a fixed schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet table, optionally Hive-partitioned (e.g. by split)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """Metric rows as one headed CSV folder. One row per model (or per grid
    point, class or confusion cell of one), so a single file is enough."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_metrics_csv(spark: SparkSession, path: str,
                     schema: T.StructType = METRIC_SCHEMA) -> DataFrame:
    """Metric CSV; a missing path yields an empty table of the same schema."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def read_comparison_csv(spark: SparkSession, path: str) -> DataFrame:
    """S8 for the comparison table."""
    return read_metrics_csv(spark, path, COMPARISON_SCHEMA)


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Deterministic n-row preview (TakeOrdered, not an arbitrary head)."""
    return df.orderBy(key).limit(n)
