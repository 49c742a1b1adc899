import random
import re

import numpy as np
import pytest

from pixelmill.llm import anchors
from pixelmill.llm import phrase_dedup as pd
from tests.llm.docs import AWKWARD, CLASHING, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _brute(rows):
    """rows with different (id, text), in any order."""
    docs = sorted({(-1 << 63 if i is None else i, t or "") for i, t in rows}, key=lambda r: r[0])
    words = [WORD.findall(t.encode()) for _, t in docs]
    first = {}
    for d, w in enumerate(words):
        for s in range(len(w) - pd.WINDOW + 1):
            first.setdefault(tuple(w[s:s + pd.WINDOW]), (d, s))
    out = []
    for d, (i, _) in enumerate(docs):
        w, gone = words[d], np.zeros(len(words[d]), bool)
        for s in range(len(w) - pd.WINDOW + 1):
            if first[tuple(w[s:s + pd.WINDOW])] != (d, s):
                gone[s:s + pd.WINDOW] = True
        out.append((None if i == -1 << 63 else i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(map(str, out))


def _run(spark, rows, extra=()):
    got = pd.dedup_passages(table(spark, rows, extra)).collect()
    return sorted(str((r[0], r[1], r[2], bytes(r[3]))) for r in got)


def _corpus(seed, n=60):
    rng = random.Random(seed)
    lexicon = [f"w{i}" for i in range(300)]
    passages = [rng.choices(lexicon, k=k) for k in (20, 21, 25, 40, 90)]
    rows = []
    for i in range(n):
        w = rng.choices(lexicon, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a:] if rng.random() < 0.3 else p
        if rng.random() < 0.2:
            w += ["go"] * rng.randint(15, 60)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(1000 + i, rows[i][1]) for i in (3, 4, 3 + 5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [20_000, 3])
def test_equals_brute_force(spark, monkeypatch, chunk):
    """A chunk of 3 sends most anchors through the counts across chunks."""
    monkeypatch.setattr(anchors, "CHUNK", chunk)
    monkeypatch.setattr(anchors, "RUN_BYTES", 2_000)
    rows = _corpus(chunk)
    assert _run(spark, rows) == _brute(rows)


def test_awkward_rows(spark):
    rows = [r for r in AWKWARD if r != (4, "one two")] + [(4, "one two"), (None, "a " * 30), (50, "a " * 30), (51, "é b " * 25)]
    assert _run(spark, rows, CLASHING) == _brute(rows)
    assert _run(spark, []) == []


def test_rows_that_repeat_are_one_document(spark):
    text = " ".join(f"x{i}" for i in range(30))
    assert _run(spark, [(1, text), (1, text)]) == _brute([(1, text)]) * 2


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(anchors, "PART", 4_000)
    monkeypatch.setattr(anchors, "PIECE", 50)
    monkeypatch.setattr(anchors, "CHUNK_BYTES", 5_000)
    rng = random.Random(4)
    lexicon = [f"w{i}" for i in range(900)]
    shared = [rng.choices(lexicon, k=k) for k in (25, 200)] + [["go"] * 700, ["tick", "tock"] * 200]
    rows = []
    for i in range(4):
        words = rng.choices(lexicon, k=1500)
        for p in rng.sample(shared, 3):
            at = rng.randrange(len(words))
            words[at:at] = p
        rows.append((i, " ".join(words)))
    rows.append((9, "go " * 3000))
    assert _run(spark, rows) == _brute(rows)


def test_millions_of_one_word(spark):
    n = 1_000_000
    got = pd.dedup_passages(table(spark, [(1, "go " * n), (2, "stop " + "go " * n)])).collect()
    assert {r[0]: (r[1], r[2], bytes(r[3])) for r in got} == {1: (n, n - 1, b"go"), 2: (n + 1, n, b"stop")}


def test_words_with_the_same_letters_in_other_shards_do_not_match(spark):
    """Hits compare words: a shard's letters stand for whole words."""
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:30] + b[:5])), (3, " ".join(b)), (4, " ".join(b[5:] + a[:5]))]
    assert _run(spark, rows) == _brute(rows)
