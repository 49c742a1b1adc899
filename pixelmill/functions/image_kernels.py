"""Per-image numpy kernels (I1-I11) run inside ``mapInPandas`` tasks.

One function, :func:`image_features`, maps a decoded 8-bit image to the 42
features in ``FEATURE_NAMES`` order. Spark partitions the images and moves them
in Arrow batches; the kernels only see one image at a time.

No OpenCV here: resizing, colour conversion and Canny are written from their
standard definitions (8-bit fixed-point where the usual 8-bit conversions use
it). Resizing and edge maps may differ from other libraries by one grey level
or by isolated edge pixels.
"""

from __future__ import annotations

import numpy as np

from pixelmill.schemas import (CANNY_HIGH, CANNY_LOW, FEATURE_NAMES, HIST_BINS, HIST_RANGE, HU_EPS,
                               IMAGE_SIDE)

#: Pixels worked on at a time where a step takes many arrays: they stay in the cache, and the
#: allocator keeps them.
_BAND = 4096
_RES = 1e-15  # "no variance" rule for skewness


# --- I1: decode --------------------------------------------------------------------

def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray | None:
    """Spark image-source bytes (row-major, BGR/BGRA/gray) -> RGB uint8 (H, W, 3)."""
    if height is None or height <= 0 or width is None or width <= 0 or data is None:
        return None
    arr = np.frombuffer(data, dtype=np.uint8)
    if arr.size != height * width * channels:
        return None
    arr = arr.reshape(height, width, channels)
    if channels == 1:
        return np.repeat(arr, 3, axis=2)
    return np.ascontiguousarray(arr[:, :, 2::-1])  # BGR(A) -> RGB, alpha dropped


# --- I2: bilinear resize -------------------------------------------------------------

def _axis_weights(src: int, dst: int):
    scale = src / dst
    f = (np.arange(dst) + 0.5) * scale - 0.5
    i0 = np.floor(f).astype(np.int64)
    w = f - i0
    w = np.where(i0 < 0, 0.0, w)
    i0 = np.clip(i0, 0, src - 1)
    i1 = np.clip(i0 + 1, 0, src - 1)
    return i0, i1, w


def resize_bilinear(img: np.ndarray, out_h: int = IMAGE_SIDE, out_w: int = IMAGE_SIDE) -> np.ndarray:
    """Half-pixel-centre bilinear resize with edge clamping, rounded to uint8
    (separable: rows first, then columns), in double precision at every size."""
    h, w = img.shape[:2]
    if (h, w) == (out_h, out_w):
        return img
    y0, y1, wy = _axis_weights(h, out_h)
    x0, x1, wx = _axis_weights(w, out_w)
    # columns first in memory, so that whole columns are copied, weighed and added in place
    planes = np.ascontiguousarray(img.transpose(1, 2, 0)).astype(np.float64)
    rows = planes[:, :, y0] * (1 - wy) + planes[:, :, y1] * wy
    out = np.empty((out_w, 3, out_h), np.uint8)
    for at in range(0, out_w, _BAND // out_h + 1):
        some = slice(at, at + _BAND // out_h + 1)
        band, next_ = rows[x0[some]], rows[x1[some]]
        band *= (1 - wx[some])[:, None, None]
        next_ *= wx[some][:, None, None]
        band += next_
        band += 0.5  # levels lie in [0, 255], so the cast rounds
        out[some] = band
    return np.ascontiguousarray(out.transpose(1, 2, 0)).transpose(1, 2, 0)


# --- I4 / I6: colour conversions -------------------------------------------------------

_SHIFT = 12
_HALF = 1 << (_SHIFT - 1)
# reciprocal tables for 8-bit HSV, built from their rule (round(k << 12 / d))
_SDIV = np.array([0] + [int(np.floor((255 << _SHIFT) / v + 0.5)) for v in range(1, 256)], dtype=np.int32)
_HDIV = np.array([0] + [int(np.floor((180 << _SHIFT) / (6.0 * d) + 0.5)) for d in range(1, 256)],
                 dtype=np.int32)


def rgb_to_hsv(rgb: np.ndarray) -> np.ndarray:
    """8-bit HSV: V = max, S = 255 (V - min) / V, H = hue in degrees / 2 in [0, 180).
    Integer fixed-point with 12 fractional bits and round-half-up."""
    out = np.empty((3, *rgb.shape[:2]), np.uint8)  # one plane after the other
    lines = _BAND // max(1, rgb.shape[1]) + 1
    for at in range(0, len(rgb), lines):
        r, g, b = (rgb[at:at + lines, :, i].astype(np.int32) for i in range(3))
        v = np.maximum(np.maximum(r, g), b)
        diff = v - np.minimum(np.minimum(r, g), b)
        s = np.take(_SDIV, v, mode="clip")
        s *= diff
        s += _HALF
        s >>= _SHIFT
        h = r - g + 4 * diff
        np.copyto(h, b - r + 2 * diff, where=v == g)
        np.copyto(h, g - b, where=v == r)
        h *= np.take(_HDIV, diff, mode="clip")
        h += _HALF
        h >>= _SHIFT
        h += (h < 0) * np.int32(180)
        for plane, x in enumerate((h, s, v)):
            out[plane, at:at + lines] = x
    return out.transpose(1, 2, 0)


def rgb_to_gray(rgb: np.ndarray) -> np.ndarray:
    """Y = 0.299 R + 0.587 G + 0.114 B in 14-bit fixed point, rounded."""
    r, g, b = (rgb[:, :, i].astype(np.int32) for i in range(3))
    return ((r * 4899 + g * 9617 + b * 1868 + (1 << 13)) >> 14).astype(np.uint8)


# --- I3 / I5 / I8: moments -----------------------------------------------------------------

_LEVELS = np.arange(256, dtype=np.float64)


def level_stats(counts: np.ndarray) -> tuple[float, float, float]:
    """Mean, population std and population skew (0 when the channel is flat) of
    an 8-bit channel from its 256-level histogram: sums grouped by level, one
    pass of bincount instead of three float passes over every pixel."""
    n = counts.sum()
    mean = counts @ _LEVELS / n
    d = _LEVELS - mean
    m2 = counts @ (d * d) / n
    m3 = counts @ (d * d * d) / n
    skew = 0.0 if m2 <= (_RES * mean) ** 2 else m3 / m2 ** 1.5
    return float(mean), float(np.sqrt(m2)), float(skew)


def level_counts(channel: np.ndarray) -> np.ndarray:
    return np.bincount(channel.ravel(), minlength=256).astype(np.float64)


# --- I7 / I9: histogram and entropy ----------------------------------------------------------

def entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


# --- I10: Hu moments -------------------------------------------------------------------------

def hu_moments(gray: np.ndarray) -> np.ndarray:
    """The seven Hu invariants of an intensity image (x = column, y = row).
    Central moments are separable sums: sum_y dy^q * (sum_x dx^p * I)."""
    img = gray.astype(np.float64)
    h, w = img.shape
    m00 = img.sum()
    if m00 == 0:
        return np.zeros(7)
    xs, ys = np.arange(w, dtype=np.float64), np.arange(h, dtype=np.float64)
    col_mass, row_mass = img.sum(axis=0), img.sum(axis=1)
    dx, dy = xs - col_mass @ xs / m00, ys - row_mass @ ys / m00
    by_p = [img @ dx ** p for p in range(4)]          # per row: sum_x dx^p I

    def eta(p, q):
        return (dy ** q) @ by_p[p] / m00 ** (1 + (p + q) / 2)

    n20, n02, n11 = eta(2, 0), eta(0, 2), eta(1, 1)
    n30, n21, n12, n03 = eta(3, 0), eta(2, 1), eta(1, 2), eta(0, 3)
    a, b = n30 + n12, n21 + n03
    c, d = n30 - 3 * n12, 3 * n21 - n03
    return np.array([
        n20 + n02,
        (n20 - n02) ** 2 + 4 * n11 ** 2,
        c ** 2 + d ** 2,
        a ** 2 + b ** 2,
        c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b),
        (n20 - n02) * (a * a - b * b) + 4 * n11 * a * b,
        d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
    ])


def log_scale(h: np.ndarray, eps: float = HU_EPS) -> np.ndarray:
    return -np.sign(h) * np.log10(np.abs(h) + eps)


# --- I11: Canny edges ------------------------------------------------------------------------

def _sobel(gray: np.ndarray):
    """Both derivatives, which lie within 1,020 either way."""
    p = np.pad(gray.astype(np.int16), 1, mode="edge")
    top, mid, bottom = p[:-2], p[1:-1], p[2:]
    smooth, steep = top + 2 * mid + bottom, bottom - top
    return smooth[:, 2:] - smooth[:, :-2], steep[:, :-2] + 2 * steep[:, 1:-1] + steep[:, 2:]


_TG22 = int(round(np.tan(np.pi / 8) * (1 << 15)))


def canny(gray: np.ndarray, low: float = CANNY_LOW, high: float = CANNY_HIGH) -> np.ndarray:
    """Edge map (0/255): 3x3 Sobel, L1 magnitude, non-maximum suppression along
    the quantised gradient direction, hysteresis (8-connected) between the
    low and high thresholds."""
    gx, gy = _sobel(gray)
    h, w = gx.shape
    m = np.zeros((h + 2, w + 2), dtype=np.int16)
    mag = m[1:-1, 1:-1]
    np.add(np.abs(gx), np.abs(gy), out=mag)
    # only pixels above the low threshold can be edges; the rest needs no direction
    y, x = np.nonzero(mag > low)
    gx, gy, at = gx[y, x].astype(np.int32), gy[y, x].astype(np.int32), (y + 1) * (w + 2) + x + 1
    m, up = m.ravel(), w + 2
    c = m[at]
    ax, ay = np.abs(gx), np.abs(gy)
    # direction sectors in integer arithmetic: tan(22.5 deg) in 15-bit fixed
    # point, tan(67.5 deg) = tan(22.5 deg) + 2
    tg22x = ax * _TG22
    horiz = (ay << 15) < tg22x                        # within 22.5 deg of x: compare left/right
    vert = ~horiz & ((ay << 15) > tg22x + (ax << 16))  # within 22.5 deg of y: compare up/down
    same_sign = (gx * gy) >= 0                         # else the diagonal of the gradient's sign
    step = np.where(horiz, 1, np.where(vert, up, np.where(same_sign, up + 1, up - 1)))
    before, after = m[at - step], m[at + step]
    keep = (c > before) & np.where(horiz | vert, c >= after, c > after)
    y, x, strong = y[keep], x[keep], c[keep] > high
    edges = np.zeros((h, w), np.uint8)
    if not strong.any():
        return edges
    if not strong.all():
        cand = np.zeros((h, w), bool)
        cand[y, x] = True
        parent = components(cand)[y, x]
        kept = np.zeros(cand.size + 1, bool)
        kept[parent[strong]] = True
        y, x = y[kept[parent]], x[kept[parent]]
    edges[y, x] = 255
    return edges


def components(mask: np.ndarray) -> np.ndarray:
    """For every pixel of a mask the number of its 8-connected component (the same for all
    its pixels; the size of the image elsewhere): a union of neighbours over an array of
    parents, whose rounds grow with the logarithm of a component's length."""
    number = np.full(mask.shape, -1, np.int64)
    number[mask] = np.arange(mask.sum())
    h, w = mask.shape
    ends = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        here, there = number[:h - dy, max(0, -dx):w - max(0, dx)], number[dy:, max(0, dx):w + min(0, dx)]
        both = (here >= 0) & (there >= 0)
        ends.append((here[both], there[both]))
    a, b = (np.concatenate(x) for x in zip(*ends))
    parent = np.arange(mask.sum())
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low != high
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    out = np.full(mask.shape, mask.size, np.int64)
    out[mask] = parent
    return out


# --- I12: the whole extractor ----------------------------------------------------------------

def image_features(rgb: np.ndarray) -> list[float]:
    """42 features, FEATURE_NAMES order, from an RGB uint8 image of any size."""
    img = resize_bilinear(rgb)
    out: list[float] = []
    for i in range(3):
        out += level_stats(level_counts(img[:, :, i]))
    hsv = rgb_to_hsv(img)
    for i in range(3):
        out += level_stats(level_counts(hsv[:, :, i]))
    gray = rgb_to_gray(img)
    gc = level_counts(gray)
    # 10 equal bins over [0, 256]: integer level v falls in bin floor(v * 10 / 256)
    hist = np.bincount((np.arange(256) * HIST_BINS) // 256, weights=gc, minlength=HIST_BINS) / gc.sum()
    out += [float(v) for v in hist]
    mean, std, _ = level_stats(gc)
    present = np.nonzero(gc)[0]
    out += [std, mean, float(present[0]), float(present[-1])]
    out.append(entropy(hist))
    out += [float(v) for v in log_scale(hu_moments(gray))]
    edges = canny(gray)
    n_edges = int(np.count_nonzero(edges))
    out += [n_edges / edges.size, 255 * n_edges / edges.size]
    assert len(out) == len(FEATURE_NAMES)
    return out
