import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pixelmill.llm import hyperminhash as hm
from pixelmill.llm.common import text_buffer
from pixelmill.llm.components import connected_components
from tests.llm.docs import AWKWARD, CLASHING, table


def _set(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def _brute(rows):
    sets = [_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(map(str, out))


def _run(spark, rows, extra=()):
    return sorted(str(tuple(r)) for r in hm.near_groups(table(spark, rows, extra)).collect())


def _families(seed, families, copies, words, edits):
    """Families of near copies around the threshold, all sharing one passage."""
    rng, rows, lexicon = random.Random(seed), [], [f"w{i}" for i in range(5000)]
    passage = rng.choices(lexicon, k=20)
    for _ in range(families):
        base = rng.choices(lexicon, k=words) + passage
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(lexicon)
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [64, 2])
@pytest.mark.parametrize("words,edits", [(200, 9), (60, 4), (12, 1)])
def test_components_equal_brute_force(spark, monkeypatch, words, edits, small):
    monkeypatch.setattr(hm, "SMALL", small)
    rows = _families(words, 8, 15, words, edits)
    assert _run(spark, rows) == _brute(rows)


def test_chain_and_open_buckets(spark, monkeypatch):
    """A drifting chain: neighbours are linked, ends are not; buckets above 4
    members are worked on in blocks of 8."""
    monkeypatch.setattr(hm, "BLOCK", 8)
    monkeypatch.setattr(hm, "SMALL", 4)
    rng = random.Random(5)
    words, rows = [f"c{i}" for i in range(120)], []
    for i in range(40):
        rows.append((i, " ".join(words)))
        at = rng.randrange(110)
        words[at:at + 2] = [f"n{i}a", f"n{i}b"]
    rng.shuffle(rows)
    assert _run(spark, rows) == _brute(rows)


def test_awkward_rows(spark):
    rows = AWKWARD + [(40, "ONE two"), (41, "a b c d"), (42, "A B C D"), (43, "É b c d e f"), (44, "é b c d e f")]
    assert _run(spark, rows, CLASHING) == _brute(rows)
    assert _run(spark, []) == []
    docs = table(spark, rows, CLASHING)
    kept = hm.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 9, 10, 11, None, 41, 43, 44}


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 1000))]
    words = texts[0].split()
    for cut in (50, 200, 400):
        texts.append(" ".join(words[cut:] + [f"z{i}" for i in range(cut)]))
    owner, h = hm.shingle_sets(*text_buffer(pa.array(texts)))
    regs = hm.registers(owner, h, len(texts))
    sizes = np.bincount(owner).astype(float)
    value, near = hm.estimates(regs[0], regs, sizes[0], sizes)
    sets = [set(h[owner == i]) for i in range(len(texts))]
    true = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert np.allclose(value, true, atol=0.2) and near[0] and near[1] and not near[3]


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)]
    links += [(700, j) for j in range(701, 760)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    group = {}
    for a, b in links:
        if a != b:
            merged = group.get(a, {a}) | group.get(b, {b})
            for x in merged:
                group[x] = merged
    assert got == {x: min(g) for x, g in group.items()}
