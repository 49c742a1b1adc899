import math
import os
import subprocess
import sys
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from pixelmill.llm import masked_lm as lm
from pixelmill.llm.common import SpanHash, text_buffer, word_spans
from tests.llm.docs import AWKWARD, CLASHING, table


def _toy():
    texts = ["a b c d e f g h", "b c d", "", "a a a b"]
    hashes, first = lm.word_hashes(*text_buffer(pa.array(texts)))
    known, counts = np.unique(hashes, return_counts=True)
    words = lm.Vocabulary(known.view(np.int64).tolist()[:-1], counts.tolist()[:-1], len(hashes))
    net = lm.Net.fresh(words.counts)
    net.flat[:] += np.random.default_rng(3).normal(size=net.flat.size).astype(np.float32) * 0.2
    return texts, words.ids(hashes), first, words, net


def test_gradient_equals_differences():
    _, ids, first, _, net = _toy()
    places = np.arange(len(ids))
    context = lm.contexts(ids, first, places)
    wide = lm.Net(net.flat.astype(np.float64))
    g = wide.gradient(context, ids).flat
    rng = np.random.default_rng(1)
    for at in [*rng.choice(np.flatnonzero(g), 20), *rng.integers(0, len(g), 5)]:
        moved = [wide.flat.copy(), wide.flat.copy()]
        moved[0][at] += 1e-5
        moved[1][at] -= 1e-5
        up, down = (lm.Net(m).log_probabilities(context, ids).mean() for m in moved)
        assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-4, abs_tol=1e-8)


def _naive(text_ids, net):
    """Word by word, and over all words of the vocabulary."""
    total = 0.0
    for t, word in enumerate(text_ids):
        x = net.bias.astype(float)
        for p, step in enumerate([*range(-lm.SPAN, 0), *range(1, lm.SPAN + 1)]):
            inside = 0 <= t + step < len(text_ids)
            x = x + net.embed[p][text_ids[t + step] if inside else lm.VOCABULARY]
        h = np.tanh(x)
        kinds = np.exp(h @ net.to_class + net.class_bias)
        slots = np.exp(h @ net.to_slot[word // lm.SLOTS] + net.slot_bias[word // lm.SLOTS])
        total += math.log(kinds[word // lm.SLOTS] / kinds.sum()) + math.log(slots[word % lm.SLOTS] / slots.sum())
    return total


def test_scores_equal_word_by_word(spark):
    texts, ids, first, words, net = _toy()
    got = lm.score(table(spark, list(enumerate(texts)), CLASHING), net, words).collect()
    assert len(got) == len(texts)
    for r in got:
        own = ids[first[r["doc_id"]]:first[r["doc_id"] + 1]].tolist()
        assert r["n_words"] == len(own)
        assert math.isclose(r["log_likelihood"], _naive(own, net), rel_tol=1e-4, abs_tol=1e-6)


def test_awkward_rows_and_empty_table(spark):
    got = lm.masked_scores(table(spark, AWKWARD, CLASHING)).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        assert math.isfinite(r["log_likelihood"]) and (r["mean_log_likelihood"] is None) == (r["n_words"] == 0)
    assert len({r["log_likelihood"] for r in got if r["doc_id"] in (4, 5)}) == 1
    assert lm.masked_scores(table(spark, [])).count() == 0


def test_training_helps_on_texts_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, unseen = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    words = lm.vocabulary(seen)
    total = lambda net: lm.score(unseen, net, words).agg({"log_likelihood": "sum"}).first()[0]
    assert total(lm.train(seen, words)) > total(lm.Net.fresh(words.counts))


def test_rounds_train_on_every_word_of_every_text():
    texts = ["a b c d e f g h i j k l m", "b", "", "a b", "c d e f g", " "]
    _, first = lm.word_hashes(*text_buffer(pa.array(texts)))
    for rounds in (1, lm.ROUNDS, 3):
        seen = [lm.places_of_round(first, r, rounds) for r in range(rounds)]
        assert sorted(np.concatenate(seen).tolist()) == list(range(first[-1]))
    assert [len(lm.places_of_round(first, 0, 2)), len(lm.places_of_round(first[:2], 0, 2))] == [7 + 1 + 1 + 3, 7]


def test_training_sees_as_many_words_as_the_texts_have(spark, monkeypatch):
    texts = ["a b c d e f g h i j k l m", "b", None, "a b", "c d e f g", " "] * 3
    docs, seen = table(spark, list(enumerate(texts))), []
    write = lm.written

    def spy(df, name):
        out = write(df, name)
        if name.startswith("weights-"):
            seen.append(out.agg({"n": "max"}).first()[0])
        return out

    words = lm.vocabulary(docs)
    monkeypatch.setattr(lm, "written", spy)
    lm.train(docs, words)
    assert sum(seen) == sum(len((t or "").split()) for t in texts)


def test_every_word_has_its_own_probability(spark, monkeypatch):
    # three words known to the network, the others by broadcast, by join or both
    common = ["the of and"] * 30
    texts = [*common, "the rare of", "the rare of", "the scarce of", "the single of", "the rare rare scarce scarce single x y z of",
             "", None, "rare scarce"]
    flat = " ".join(t or "" for t in texts).split()
    counts = {w: flat.count(w) for w in flat}
    docs = table(spark, list(enumerate(texts)), CLASHING)
    for share in (1, 30, 1 << 20):
        monkeypatch.setattr(lm, "HOT_SHARE", share)
        with monkeypatch.context() as small:
            small.setattr(lm, "VOCABULARY", 4)
            words = lm.vocabulary(docs)
        hashes, first = lm.word_hashes(*text_buffer(pa.array(texts)))
        ids = words.ids(hashes)
        others = sum(n for w, n in counts.items() if w not in ("the", "of", "and"))
        assert words.counts[0] == others and (ids == 0).sum() == others
        words.counts = np.resize(words.counts, lm.CLASSES * lm.SLOTS)
        net = lm.Net.fresh(words.counts)
        got = {r["doc_id"]: r for r in lm.score(docs, net, words).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            own = (text or "").split()
            shares = sum(math.log(counts[w] / others) for w in own if w not in ("the", "of", "and"))
            expected = _naive(ids[first[i]:first[i + 1]].tolist(), net) + shares
            assert math.isclose(got[i]["log_likelihood"], expected, rel_tol=1e-4, abs_tol=1e-6)
        assert got[30]["log_likelihood"] > got[32]["log_likelihood"] > got[33]["log_likelihood"]


def _real_batch():
    """A training batch of real texts: context, words and a network of their vocabulary."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0)
    hashes, first = lm.word_hashes(*text_buffer(texts))
    known, counts = np.unique(hashes, return_counts=True)
    top = np.argsort(-counts, kind="stable")[:lm.VOCABULARY - 1]
    words = lm.Vocabulary(known[top].view(np.int64).tolist(), counts[top].tolist(), len(hashes))
    net = lm.Net.fresh(words.counts)
    ids, places = words.ids(hashes), lm.places_of_round(first, 0, lm.ROUNDS)[:lm.BATCH]
    return net, lm.contexts(ids, first, places), ids[places]


def _plain_gradient(net, context, word):
    """As the formulas say, class by class and position by position."""
    g = lm.Net(np.zeros_like(net.flat))
    order = np.argsort((word // lm.SLOTS).astype(np.int16), kind="stable")
    kind, slot = np.divmod(word[order], lm.SLOTS)
    context = context[:, order]
    h = np.tanh(sum(net.embed[p][context[p]] for p in range(2 * lm.SPAN)) + net.bias)

    def left_over(x, at):
        x = np.exp(x - x.max(1, keepdims=True))
        x /= -x.sum(1, keepdims=True)
        x[np.arange(len(x)), at] += 1
        return x

    d = left_over(h @ net.to_class + net.class_bias, kind)
    g.to_class[:], g.class_bias[:] = h.T @ d, d.sum(0)
    dh = d @ net.to_class.T
    for c in range(lm.CLASSES):
        rows = slice(*np.searchsorted(kind, [c, c + 1]))
        d = left_over(h[rows] @ net.to_slot[c] + net.slot_bias[c], slot[rows])
        g.to_slot[c], g.slot_bias[c] = h[rows].T @ d, d.sum(0)
        dh[rows] += d @ net.to_slot[c].T
    dh *= 1 - h * h
    g.bias[:] = dh.sum(0)
    for p in range(2 * lm.SPAN):
        by_id = np.argsort(context[p].astype(np.int16), kind="stable")
        starts = np.flatnonzero(np.diff(context[p][by_id], prepend=-1))
        g.embed[p][context[p][by_id[starts]]] = np.add.reduceat(dh[by_id], starts, axis=0)
    g.flat /= len(word)
    return g


def test_gradient_of_a_batch_equals_the_plain_one():
    net, context, word = _real_batch()
    wide = lm.Net(net.flat.astype(np.float64))
    assert np.allclose(wide.gradient(context, word).flat, _plain_gradient(wide, context, word).flat, rtol=1e-9, atol=1e-15)
    assert np.allclose(net.gradient(context, word).flat, _plain_gradient(net, context, word).flat, rtol=1e-3, atol=1e-6)


def _share_of_plain_time(enough):
    """CPU time of a gradient as a share of the plain one's, the least of several runs each."""
    net, context, word = _real_batch()
    works = [net.gradient, lambda *a: _plain_gradient(net, *a)]
    least, tries = [math.inf, math.inf], 0
    while tries < 20 or (tries < 200 and least[0] >= enough * least[1]):
        for i, work in enumerate(works):
            began = time.process_time()
            work(context, word)
            least[i] = min(least[i], time.process_time() - began)
        tries += 1
    return least[0] / least[1]


def test_gradient_takes_less_time_than_the_plain_one():
    # on one thread, as in a Spark task: others would spin
    code = "from tests.llm.test_masked_lm import _share_of_plain_time as share; print(share(0.67))"
    out = subprocess.run([sys.executable, "-c", code], env={**os.environ, "OMP_NUM_THREADS": "1"}, capture_output=True,
                         cwd=Path(__file__).parents[2], text=True, check=True, timeout=120)
    assert float(out.stdout.split()[-1]) < 0.67


def test_softmax_stays_finite_for_large_inputs():
    net, context, word = _real_batch()
    for factor in (1, 30, 1000):
        large = lm.Net(net.flat * np.float32(factor))
        for dtype, tolerance in ((np.float32, 1e-3), (np.float64, 1e-9)):
            own = lm.Net(large.flat.astype(dtype))
            got = own.log_probabilities(context, word)
            h = np.tanh(sum(own.embed[p][context[p]].astype(float) for p in range(2 * lm.SPAN)) + own.bias)
            kind, slot = np.divmod(word, lm.SLOTS)
            expected = 0
            for x, at in ((h @ own.to_class + own.class_bias, kind),
                          (np.einsum("nh,nhs->ns", h, own.to_slot[kind]) + own.slot_bias[kind], slot)):
                x = x - x.max(1, keepdims=True)
                expected = expected + x[np.arange(len(x)), at] - np.log(np.exp(x).sum(1))
            assert np.isfinite(got).all() and np.isfinite(own.gradient(context, word).flat).all()
            assert np.allclose(got, expected, rtol=tolerance, atol=tolerance)


def test_word_hashes_hold_a_piece_of_the_text_at_a_time():
    texts = ["", "a b " * (lm.HASH_BYTES // 2), "x" * (3 * lm.HASH_BYTES) + " y", " ", None, "some words " * 300_000, "z"]
    data, offsets = text_buffer(pa.array(texts))
    start, end, first = word_spans(data, offsets)
    whole = SpanHash(data)(start, end)
    tracemalloc.start()
    try:
        got = lm.word_hashes(data, offsets)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(got[0], whole) and np.array_equal(got[1], first)
    # spaces, word edges, and 24 bytes a word; not five numbers a byte
    assert peak < 16 * len(data)


def test_ids_of_hashes_that_begin_alike():
    rng = np.random.default_rng(5)
    alike = (np.uint64(0xABCD) << np.uint64(48)) + rng.integers(0, 1 << 48, 50, dtype=np.uint64)
    ends = np.array([0, 2**64 - 1], np.uint64)
    known = np.unique(np.concatenate([alike[:20], rng.integers(0, 1 << 64, 500, dtype=np.uint64), ends]))
    for some in (known, known[1:-1], known[:1], known[:0]):
        words = lm.Vocabulary(some.view(np.int64).tolist(), [1] * len(some), len(some))
        asked = np.concatenate([known, alike, rng.integers(0, 1 << 64, 3 * lm.BATCH, dtype=np.uint64), known])
        number = {h: i + 1 for i, h in enumerate(some.tolist())}
        assert words.ids(asked).tolist() == [number.get(h, 0) for h in asked.tolist()]
