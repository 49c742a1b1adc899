"""DataFrame operators over numeric array columns (M1-M4).

Each operator is a narrow per-row projection: it keeps the key columns and
adds statistics. The intermediate structs are materialised in their own
projection so that Catalyst does not inline (and re-evaluate) them once per
output column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import signal as S


def array_moments(df: DataFrame, array_col: str, keys: list[str], prefix: str = "v") -> DataFrame:
    """M1: mean, population std, population skew, min, max of each row's array."""
    a = S.as_double_array(array_col)
    staged = df.select(*keys, a.alias("_a")).select(
        *keys, "_a", S.central_moments(F.col("_a")).alias("_cm"))
    mean, m2, m3 = F.col("_cm.mean"), F.col("_cm.m2"), F.col("_cm.m3")
    return staged.select(
        *keys,
        mean.alias(f"{prefix}_mean"),
        F.sqrt(m2).alias(f"{prefix}_std"),
        S.skew_from_moments(mean, m2, m3).alias(f"{prefix}_skew"),
        F.array_min("_a").alias(f"{prefix}_min"),
        F.array_max("_a").alias(f"{prefix}_max"),
    )


def array_histogram(df: DataFrame, array_col: str, keys: list[str], lo: float, hi: float,
                    bins: int = 10, prefix: str = "hist") -> DataFrame:
    """M2: normalised fixed-range histogram, one column per bin (null where no
    value is in range). The counts are staged once, in their own projection."""
    counts = df.select(*keys, S.as_double_array(array_col).alias("_a")).select(
        *keys, S.bin_counts(F.col("_a"), lo, hi, bins).alias("_c"))
    total = F.aggregate("_c", F.lit(0), lambda a, b: a + b)
    staged = counts.select(*keys, "_c", total.alias("_n"))
    return staged.select(*keys, *[F.when(F.col("_n") > 0, F.col("_c")[k] / F.col("_n")).alias(f"{prefix}_{k}")
                                  for k in range(bins)])


def array_entropy(df: DataFrame, array_col: str, keys: list[str], lo: float, hi: float,
                  bins: int = 10, name: str = "entropy") -> DataFrame:
    """M3: natural-log entropy of the M2 histogram."""
    h = array_histogram(df, array_col, keys, lo, hi, bins, "_h")
    return h.select(*keys, S.entropy([F.col(f"_h_{k}") for k in range(bins)]).alias(name))


def grid_hu_moments(df: DataFrame, array_col: str, keys: list[str], width: int,
                    prefix: str = "hu_moment", eps: float = 1e-10,
                    intensity=None) -> DataFrame:
    """M4: log-scaled Hu invariants of an intensity grid stored row-major.

    ``intensity`` optionally maps each element first (e.g. ``F.abs`` for signed
    signals, whose total mass could otherwise be close to zero)."""
    a = S.as_double_array(array_col)
    if intensity is not None:
        a = F.transform(a, intensity)
    staged = df.select(*keys, S.grid_raw_moments(a, width).alias("_m"))
    hu = S.hu_invariants(F.col("_m"))
    return staged.select(*keys, *[S.log_scale(h, eps).alias(f"{prefix}_{i}") for i, h in enumerate(hu)])
