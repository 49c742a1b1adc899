import hashlib
import random
import re
import tracemalloc
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from pixelmill.llm import filter_audit
from tests.llm.docs import AWKWARD, CLASHING, table

LABELS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "quality", "toxic")])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(rows, labels):
    docs = [(r[0], r[1] or "", (r[2] if len(r) > 2 else "a") or "") for r in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    fails = []
    for i, t, _ in docs:
        w = WORD.findall(t)
        fails.append({f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and first[t] < i)) if bad})
    out = {}
    for part in {p for _, _, p in docs}:
        own = [(d, f) for d, f in zip(docs, fails) if d[2] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d, f in left if x in f]
                bad = [d for d, f in own if x in f]
                left = [(d, f) for d, f in left if x not in f]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(bad) - len(gone), sum(f == {x} for _, f in own),
                                                   sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _run(spark, rows, labels, extra=()):
    got = filter_audit.audit(filter_audit.failure_counts(table(spark, rows, extra), spark.createDataFrame(labels, LABELS))).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got}
    assert len(out) == len(got)
    return out


def _corpus(seed, n=150):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma", "x#1", f"w{rng.randint(0, 400)}"][:rng.randint(2, 5)])
                      for _ in range(rng.choice([0, 3, 199, 200, 260]))) for _ in range(n)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(n)]
    return rows, [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, n, 2)]


def test_equals_brute_force(spark):
    rows, labels = _corpus(1)
    assert _run(spark, rows, labels) == _brute(rows, labels)


def test_awkward_rows(spark):
    rows = AWKWARD + [(20, "A" * 50, None), (21, "A" * 50, ""), (21, "other text", "b"), (-3, "A" * 50, "b")]
    labels = [(4, 1, 0), (4, 0, 1), (7, 1, None), (None, 1, 1), (999, 1, 1), (8, None, 1)]
    assert _run(spark, rows, labels, CLASHING) == _brute(rows, labels)
    assert _run(spark, [], []) == {}


def test_bounds_are_exact(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words[:199])), (2, " ".join(words)), (3, " ".join(words[:100] * 2)), (4, " ".join(words[:99] * 2 + ["a", "a"])),
            (5, "A" + "b" * 49), (6, "A" + "b" * 48), (7, "é" * 49 + "A"), (8, "a|b"), (9, "Ä" * 50)]
    assert _run(spark, rows, []) == _brute(rows, [])


def test_words_that_share_a_hash_get_codes_of_their_own(spark, monkeypatch):
    rows, labels = _corpus(2, 60)
    docs = table(spark, rows)
    # workers unpickle the module's functions by reference, so the weak hash is tested by hand as well
    words = filter_audit.dictionary(docs).collect()
    assert len({bytes(r["word"]) for r in words}) == len(words) == len({w for _, t, _ in rows for w in WORD.findall(t or "")})
    weak = spark.createDataFrame([(int(hashlib.md5(bytes(r["word"])).hexdigest(), 16) % 7, r["word"]) for r in words], "hash long, word binary")
    codes = filter_audit.shared_codes(weak)
    assert len(codes) == len(words) - len({r["hash"] for r in weak.collect()}) == len(set(codes.values())) and max(codes.values()) < 0
    # own codes replace the hashes of their words in the matrix
    some = {bytes(r["word"]): filter_audit.OWN_CODE + i for i, r in enumerate(words[:5])}
    shards = filter_audit.csr_shards(docs, some).collect()
    columns = np.concatenate([np.frombuffer(s["columns"], np.int64) for s in shards])
    assert {int(c) for c in columns if c < 0} == set(some.values())
    assert len(np.unique(columns)) == len(words)


def test_csr_shards_hold_the_counts(spark):
    rows = [(1, "a b a"), (2, None), (3, "b\tc\nb b")]
    shard, = filter_audit.csr_shards(table(spark, rows).coalesce(1), {}).collect()
    assert shard["n"] == 3 and np.frombuffer(shard["row_start"], np.int64).tolist() == [0, 2, 2, 4]
    code = {w: filter_audit._word_hash(w) for w in (b"a", b"b", b"c")}
    got = list(zip(np.frombuffer(shard["columns"], np.int64).tolist(), np.frombuffer(shard["counts"], np.int32).tolist()))
    assert sorted(got[:2]) == sorted([(code[b"a"], 2), (code[b"b"], 1)]) and sorted(got[2:]) == sorted([(code[b"b"], 3), (code[b"c"], 1)])


def test_the_memory_of_a_task_does_not_grow_with_its_batches():
    """Four workers of an executor do this at a time, next to its heap."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(400)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    tracemalloc.start()
    words = {w for out in filter_audit._distinct_words(iter([batch])) for w in out.column("word").to_pylist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words == {w.encode() for t in texts for w in t.split()}
    assert sum(map(len, texts)) > 8 << 20 and peak < 128 << 20, peak >> 20
