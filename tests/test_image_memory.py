"""The work on one image stays in the cache, whatever the number of its steps."""

import tracemalloc

import numpy as np

from pixelmill.functions import image_kernels as K


def _dense_canny(gray, low, high):
    """The edge map pixel by pixel, from its definition."""
    h, w = gray.shape
    at = lambda y, x: int(gray[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    gx, gy = np.zeros((h, w), int), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            gx[y, x] = sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy[y, x] = sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    mag = np.pad(np.abs(gx) + np.abs(gy), 1)
    cand = set()
    for y in range(h):
        for x in range(w):
            c, ax, ay = mag[y + 1, x + 1], abs(gx[y, x]), abs(gy[y, x])
            tg = int(round(np.tan(np.pi / 8) * (1 << 15))) * ax
            if (ay << 15) < tg:
                keep = c > mag[y + 1, x] and c >= mag[y + 1, x + 2]
            elif (ay << 15) > tg + (ax << 16):
                keep = c > mag[y, x + 1] and c >= mag[y + 2, x + 1]
            elif gx[y, x] * gy[y, x] >= 0:
                keep = c > mag[y, x] and c > mag[y + 2, x + 2]
            else:
                keep = c > mag[y, x + 2] and c > mag[y + 2, x]
            if keep and c > low:
                cand.add((y, x))
    reached = [p for p in cand if mag[p[0] + 1, p[1] + 1] > high]
    kept = set(reached)
    while reached:
        y, x = reached.pop()
        for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if p in cand and p not in kept:
                kept.add(p)
                reached.append(p)
    return {(y, x) for y, x in kept}


def test_edges_are_those_of_the_definition():
    rng = np.random.default_rng(2)
    for h, w, spread in ((1, 1, 90), (1, 9, 90), (23, 17, 15), (23, 17, 40), (30, 30, 90), (12, 40, 0)):
        gray = np.clip(128 + rng.normal(0, max(spread, 1), (h, w)), 0, 255).astype(np.uint8)
        for low, high in ((50, 150), (100, 200), (20, 900)):
            edges = K.canny(gray, low, high)
            assert edges.dtype == np.uint8 and set(np.unique(edges)) <= {0, 255}
            assert set(zip(*(i.tolist() for i in np.nonzero(edges)))) == _dense_canny(gray, low, high)


def test_an_image_takes_little_memory():
    img = np.random.default_rng(1).integers(0, 256, (8, 8, 3)).astype(np.uint8)
    K.image_features(img)
    tracemalloc.start()
    K.image_features(img)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 << 20, peak
