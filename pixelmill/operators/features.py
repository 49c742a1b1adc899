"""Feature vectors and scaling.

Two forms of every scaler:
* the MLlib stage (``VectorAssembler`` + ``StandardScaler``) used inside
  pipelines, so a saved model carries its scaling with it;
* a column-expression form for wide numeric tables: statistics come from one
  aggregation (one row), joined back on a constant key, then plain arithmetic
  inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assembler(cols: list[str], out: str = "features_raw", handle_invalid: str = "error") -> VectorAssembler:
    """dense feature vector in the given column order. ``handle_invalid``
    'skip' drops rows with null/NaN features instead of failing."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid)


def array_vector(col: str | Column) -> Column:
    """ARRAY<DOUBLE> -> ml Vector (for tables that already hold arrays)."""
    return array_to_vector(F.col(col) if isinstance(col, str) else col)


def vector_array(col: str | Column) -> Column:
    """ml Vector -> ARRAY<DOUBLE> (S12: plain, SQL-friendly form; no collect)."""
    return vector_to_array(F.col(col) if isinstance(col, str) else col)


def scaler(inp: str, out: str, with_mean: bool = True, with_std: bool = True) -> StandardScaler:
    """F2 (centre + scale) / F3 (scale only): MLlib scaler, sample std; a
    zero-variance feature maps to 0."""
    return StandardScaler(inputCol=inp, outputCol=out, withMean=with_mean, withStd=with_std)


def scaling_pipeline(cols: list[str], out: str = "features", with_mean: bool = True,
                     with_std: bool = True, handle_invalid: str = "error") -> Pipeline:
    """assemble + scale as one fitted unit."""
    return Pipeline(stages=[assembler(cols, "_raw", handle_invalid),
                            scaler("_raw", out, with_mean, with_std)])


def scaled_columns(df: DataFrame, cols: list[str], keys: list[str], with_mean: bool = True,
                   with_std: bool = True, prefix: str = "z_") -> DataFrame:
    """F1+F2/F3 on a columnar table through the MLlib pipeline, returned as columns."""
    model = scaling_pipeline(cols, "_z", with_mean, with_std).fit(df)
    arr = vector_array("_z")
    return model.transform(df).select(*keys, *[arr[i].alias(f"{prefix}{c}") for i, c in enumerate(cols)])


def standardize_columns(df: DataFrame, cols: list[str], keys: list[str], ddof: int = 0,
                        with_mean: bool = True, prefix: str = "z_") -> DataFrame:
    """F4 (ddof=0, the single-machine twin) or F2 (ddof=1) as expressions:
    (x - mean) / std, with a zero or missing std (constant column, single row)
    treated as 1 (the column becomes 0 after centring)."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = df.agg(*[F.avg(c).alias(f"_m_{i}") for i, c in enumerate(cols)],
                   *[std(c).alias(f"_s_{i}") for i, c in enumerate(cols)]).withColumn("_one", F.lit(1))
    # exactly one row of statistics, joined on a constant key (broadcast)
    j = df.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")
    out = []
    for i, c in enumerate(cols):
        std_i = F.coalesce(F.col(f"_s_{i}"), F.lit(0.0))
        s = F.when(std_i == 0, F.lit(1.0)).otherwise(std_i)
        x = F.col(c) - F.col(f"_m_{i}") if with_mean else F.col(c)
        out.append((x / s).alias(f"{prefix}{c}"))
    return j.select(*keys, *out)
