import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import anchors, common


@pytest.mark.parametrize("n,width", [(50, 7), (1000, 15), (1000, 169), (10, 10), (9, 10)])
def test_sliding_argmin_equals_brute_force(n, width):
    v = np.random.default_rng(n).integers(0, 50, n).astype(np.uint64)
    key = (v * np.uint64(0x9FB21C651E98DF25)) >> anchors.PLACE_BITS
    want = [s + width - 1 - int(np.argmin(key[s:s + width][::-1])) for s in range(n - width + 1)]
    assert anchors.sliding_argmin(v, width).tolist() == want


def test_long_texts_are_taken_in_parts(monkeypatch):
    v = np.random.default_rng(1).integers(0, 2 ** 63, 5000).astype(np.uint64) << np.uint64(1)
    whole = anchors.sliding_argmin(v, 15)
    monkeypatch.setattr(anchors, "PLACE_BITS", np.uint64(9))
    assert anchors.sliding_argmin(v, 15).tolist() == whole.tolist()


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    common_part = bytes(rng.integers(97, 123, 300).astype(np.uint8)).decode()
    texts = [bytes(rng.integers(97, 123, k).astype(np.uint8)).decode() + common_part for k in (0, 5, 400)]
    owner, anchor, start, count, times, low, high = anchors.Bytes(200, 32).runs(*common.text_buffer(pa.array(texts)))
    found = []
    for t, text in enumerate(texts):
        of = {}
        for a, s, c in zip(anchor[owner == t], start[owner == t], count[owner == t]):
            of.update({text[x:x + 200]: a for x in range(s, s + c)})
        assert len(of) == max(0, len(text) - 199)
        found.append([of[common_part[x:x + 200]] for x in range(101)])
    assert found[0] == found[1] == found[2] and times.max() == 1


def test_a_periodic_stretch_is_one_run_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 1000)
    for text in ("x" * 5000, "abc" * 2000):
        owner, anchor, start, count, times, low, high = anchors.Bytes(200, 32).runs(*common.text_buffer(pa.array([text])))
        assert len(set(anchor.tolist())) == 1 and times.min() > 1 and count.max() == 1000
        assert sum(count) == len(text) - 199 and start.tolist() == [0, *np.cumsum(count)[:-1].tolist()]
        assert (high - low == count + 199).all()


@pytest.mark.parametrize("kind", [anchors.Bytes(200, 32), anchors.Words(20, 6)])
def test_parts_of_a_long_text_give_the_same_windows(monkeypatch, kind):
    rng = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in rng.integers(0, 50, 3000)) + " go" * 500
    data, offsets = common.text_buffer(pa.array([text]))

    def anchored(runs, unit=0, byte=0):
        _, anchor, start, count, _, low, high = runs
        out = {}
        for a, s, c, lo, hi in zip(anchor.tolist(), start.tolist(), count.tolist(), low.tolist(), high.tolist()):
            out |= {unit + x: a for x in range(s, s + c)}
            piece = text.encode()[lo + byte:hi + byte]
            n = len(piece) - 199 if isinstance(kind, anchors.Bytes) else len(piece.split()) - 19
            assert n == c
        return out

    whole = anchored(kind.runs(data, offsets))
    monkeypatch.setattr(anchors, "PART", 3000)
    parts = {}
    for unit, byte, part in kind.parts(data):
        got = anchored(kind.runs(part, np.array([0, len(part)])), unit, byte)
        assert not parts.keys() & got.keys()
        parts |= got
    assert parts == whole and len(list(kind.parts(data))) > 3
    assert sum(len(p) for _, _, p in kind.parts(data[:0])) == 0


def test_span_hash_depends_on_content_alone():
    data = np.frombuffer(b"one two one twone", np.uint8)
    h = common.SpanHash(data)(np.array([0, 8, 4, 12]), np.array([3, 11, 7, 15]))
    assert h[0] == h[1] and h[0] != h[2] and h[2] == h[3]


def test_groups_stay_whole(spark):
    rows = spark.range(3000).select((F.col("id") % 37).alias("g"), F.lit("x" * 50).alias("t"), "id")

    def work(table):
        for g in set(table["g"].to_pylist()):
            n = pa.compute.sum(pa.compute.equal(table["g"], g)).as_py()
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([n])], names=["g", "n"])

    got = common.by_group(rows, ["g"], ["t", "id"], work, "g long, n long", "t", 6000).collect()
    assert sorted((r["g"], r["n"]) for r in got) == [(g, len(range(g, 3000, 37))) for g in range(37)]
