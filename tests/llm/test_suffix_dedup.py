import random

import numpy as np
import pytest

from pixelmill.llm import anchors
from pixelmill.llm import suffix_dedup as sd
from tests.llm.docs import AWKWARD, CLASHING, table


def _brute(rows):
    docs = sorted({(i is not None, i or 0, i, t or "") for i, t in rows})
    texts = [t.encode() for *_, t in docs]
    seen = {}
    for t in texts:
        for s in range(len(t) - sd.WINDOW + 1):
            w = t[s:s + sd.WINDOW]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (_, _, i, _), t in zip(docs, texts):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - sd.WINDOW + 1):
            if seen[t[s:s + sd.WINDOW]] > 1:
                gone[s:s + sd.WINDOW] = True
        runs = sum(bool(gone[k] and (k == 0 or not gone[k - 1])) for k in range(len(t)))
        out.append((i, len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(map(str, out))


def _run(spark, rows, extra=()):
    got = sd.dedup_bytes(table(spark, rows, extra)).collect()
    return sorted(str((*tuple(r)[:4], bytes(r[4]))) for r in got)


def _corpus(seed, n=50):
    rng = random.Random(seed)
    letters = "abcdefghé \n"
    make = lambda k: "".join(rng.choices(letters, k=k))
    passages = [make(k) for k in (198, 199, 200, 201, 260, 500)]
    rows = []
    for i in range(n):
        t = make(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            t += (p[rng.randrange(60):] if rng.random() < 0.4 else p) + make(rng.randint(0, 40))
        if rng.random() < 0.15:
            t += "go " * rng.randint(60, 120)
        rows.append((i, t))
    rows += [(1000 + i, rows[i][1]) for i in (3, 4, 8)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [20_000, 3])
def test_equals_brute_force(spark, monkeypatch, chunk):
    """A chunk of 3 sends most anchors through the totals across chunks."""
    monkeypatch.setattr(anchors, "CHUNK", chunk)
    monkeypatch.setattr(sd, "RUN_BYTES", 3_000)
    rows = _corpus(chunk)
    assert _run(spark, rows) == _brute(rows)


def test_awkward_rows(spark):
    rows = [r for r in AWKWARD if len(r[1] or "") < 1000 and r != (4, "one two")]
    rows += [(4, "one two"), (None, "ab" * 150), (50, "ab" * 150), (51, "é" * 150), (52, "x" * 1000)]
    assert _run(spark, rows, CLASHING) == _brute(rows)
    assert _run(spark, []) == []
    long = [(7, AWKWARD[9][1]), (8, AWKWARD[10][1])]
    assert [r["n_removed"] for r in sd.dedup_bytes(table(spark, long)).collect()] == [len(long[0][1])] * 2


def test_long_texts_go_through_segments(spark, monkeypatch):
    """Different long texts with parts in common, read in parts and cut into pieces."""
    monkeypatch.setattr(anchors, "PART", 20_000)
    monkeypatch.setattr(anchors, "PIECE", 700)
    monkeypatch.setattr(anchors, "CHUNK_BYTES", 30_000)
    rng = random.Random(9)
    make = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    shared = [make(2_000), make(300), "-" * 6_000, "=+" * 2_500]
    rows = []
    for i in range(4):
        parts = [make(20_000), *rng.sample(shared, 3), make(15_000)]
        rows.append((i, "".join(parts)))
    rows += [(9, "-" * 30_000), (10, "abc" * 9_000), (11, make(250) * 40)]
    assert _run(spark, rows) == _brute(rows)


def test_megabytes_of_one_byte(spark):
    n = 5_000_000
    got = sd.dedup_bytes(table(spark, [(1, "x" * n), (2, "y" + "x" * n), (3, "clean text")])).collect()
    assert {r[0]: tuple(r)[1:4] for r in got} == {1: (n, n, 1), 2: (n + 1, n, 1), 3: (10, 0, 0)}


@pytest.mark.parametrize("seed", range(6))
def test_prefix_values_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 30))) for _ in range(12)] + ["ab" * 20, "a" * 25, "a" * 25]
    lengths = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lengths) - 1
    symbols = np.frombuffer(("\0".join(texts) + "\0").encode(), np.uint8).astype(np.int16) + 1
    symbols[ends] = 0
    for depth in (1, 3, 8, 20):
        order, below = sd.shared_prefixes(symbols, ends, depth)
        tails = [texts[k][p - (ends[k] - len(texts[k])):] for p, k in ((p, int(np.searchsorted(ends, p))) for p in order)]
        assert sorted(order.tolist()) == list(range(len(symbols)))
        for j in range(1, len(order)):
            a, b = tails[j - 1], tails[j]
            common = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert bool(below[j]) == (common < depth)
