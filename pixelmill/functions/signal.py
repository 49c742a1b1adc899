"""Per-row statistics of numeric array columns (M1-M4), as plain Column
expressions.

Every function here is evaluated row by row with Spark's higher-order array
functions (``transform`` / ``aggregate`` / ``filter``), so a table of arrays is
summarised with a narrow projection: no explode, no shuffle, no Python.  The
same definitions are used by the image kernels, which compute them in numpy on
decoded pixels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scipy-compatible "no variance" rule: m2 <= (resolution * mean)^2 counts as 0.
_F64_RESOLUTION = 1e-15


def as_double_array(arr: Column | str) -> Column:
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.transform(arr, lambda x: x.cast("double"))


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(arr: Column) -> Column:
    return array_sum(arr) / F.size(arr)


def central_moments(arr: Column) -> Column:
    """struct(mean, m2, m3): mean and 2nd/3rd population central moments.

    Two passes: the mean is computed once as the accumulator's start value, so
    the deviation pass is linear in the array length.
    """
    start = F.struct(array_mean(arr).alias("mean"), F.lit(0.0).alias("c2"), F.lit(0.0).alias("c3"))

    def step(acc, x):
        d = x - acc["mean"]
        return F.struct(acc["mean"].alias("mean"), (acc["c2"] + d * d).alias("c2"),
                        (acc["c3"] + d * d * d).alias("c3"))

    def finish(acc):
        n = F.size(arr)
        return F.struct(acc["mean"].alias("mean"), (acc["c2"] / n).alias("m2"),
                        (acc["c3"] / n).alias("m3"))

    return F.aggregate(arr, start, step, finish)


def skew_from_moments(mean: Column, m2: Column, m3: Column) -> Column:
    """Population (biased) skewness; 0 for a (numerically) constant array."""
    flat = m2 <= (F.lit(_F64_RESOLUTION) * mean) * (F.lit(_F64_RESOLUTION) * mean)
    return F.when(flat, F.lit(0.0)).otherwise(m3 / F.pow(m2, 1.5))


def bin_index(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Histogram bin of one value over [lo, hi] in ``bins`` equal bins; the last
    bin is closed; -1 when the value lies outside the range (it is not counted)."""
    raw = F.floor((x - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo))
    inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
    return F.when(inside, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(-1))


def bin_counts(arr: Column, lo: float, hi: float, bins: int) -> Column:
    """Counts of the in-range values per bin, as one array: a single pass of
    ``aggregate`` over the array (values outside [lo, hi] are ignored)."""
    def step(acc, x):
        b = bin_index(x, lo, hi, bins)
        return F.transform(acc, lambda n, i: n + F.when(i == b, F.lit(1)).otherwise(F.lit(0)))

    return F.aggregate(arr, F.array_repeat(F.lit(0), bins), step)


def entropy(probs: list[Column]) -> Column:
    """Natural-log Shannon entropy of a probability vector, with 0*ln0 = 0."""
    terms = [F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0)) for p in probs]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def grid_raw_moments(arr: Column | str, width: int) -> Column:
    """Spatial raw moments m_pq (p+q <= 3) of an intensity grid stored
    row-major in an array: x = index % width, y = index div width."""
    a = as_double_array(arr)
    cells = F.transform(a, lambda v, i: F.struct(
        v.alias("v"), (i % width).cast("double").alias("x"), F.floor(i / width).cast("double").alias("y")))
    keys = ["m00", "m10", "m01", "m20", "m11", "m02", "m30", "m21", "m12", "m03"]
    start = F.struct(*[F.lit(0.0).alias(k) for k in keys])

    def step(acc, c):
        v, x, y = c["v"], c["x"], c["y"]
        terms = {
            "m00": v, "m10": x * v, "m01": y * v,
            "m20": x * x * v, "m11": x * y * v, "m02": y * y * v,
            "m30": x * x * x * v, "m21": x * x * y * v, "m12": x * y * y * v, "m03": y * y * y * v,
        }
        return F.struct(*[(acc[k] + terms[k]).alias(k) for k in keys])

    return F.aggregate(cells, start, step)


def hu_invariants(m: Column) -> list[Column]:
    """The seven Hu moment invariants from a struct of raw moments."""
    m00 = m["m00"]
    xb, yb = m["m10"] / m00, m["m01"] / m00
    mu20 = m["m20"] - xb * m["m10"]
    mu02 = m["m02"] - yb * m["m01"]
    mu11 = m["m11"] - xb * m["m01"]
    mu30 = m["m30"] - 3 * xb * m["m20"] + 2 * xb * xb * m["m10"]
    mu21 = m["m21"] - 2 * xb * m["m11"] - yb * m["m20"] + 2 * xb * xb * m["m01"]
    mu12 = m["m12"] - 2 * yb * m["m11"] - xb * m["m02"] + 2 * yb * yb * m["m10"]
    mu03 = m["m03"] - 3 * yb * m["m02"] + 2 * yb * yb * m["m01"]
    s2, s3 = F.pow(m00, 2.0), F.pow(m00, 2.5)
    n20, n02, n11 = mu20 / s2, mu02 / s2, mu11 / s2
    n30, n21, n12, n03 = mu30 / s3, mu21 / s3, mu12 / s3, mu03 / s3
    a, b = n30 + n12, n21 + n03
    c, d = n30 - 3 * n12, 3 * n21 - n03
    return [
        n20 + n02,
        (n20 - n02) * (n20 - n02) + 4 * n11 * n11,
        c * c + d * d,
        a * a + b * b,
        c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b),
        (n20 - n02) * (a * a - b * b) + 4 * n11 * a * b,
        d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
    ]


def log_scale(h: Column, eps: float = 1e-10) -> Column:
    """-sign(h) * log10(|h| + eps): the usual dynamic-range squash for Hu moments."""
    return -F.signum(h) * F.log10(F.abs(h) + F.lit(eps))
