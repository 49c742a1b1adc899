import random
import re

import numpy as np
import pyarrow as pa

from pixelmill.llm import quality
from pixelmill.llm.common import text_buffer
from pixelmill.llm.queries import held_out, op1_quality_classifier
from tests.llm.docs import AWKWARD, CLASHING, table


def test_trigrams_stay_inside_texts():
    texts = ["abcabc", "", None, "ab", "abc", "é"]
    counts = quality.trigram_counts(*text_buffer(pa.array(texts)))
    assert counts.sum(1).tolist() == [4, 0, 0, 0, 1, 0]
    assert np.argmax(counts[4]) == np.argmax(counts[0])


def test_form_shares():
    texts = ["go go go stop", "go", "", "go stop", "AB!x"]
    shares = quality.form_shares(*text_buffer(pa.array(texts)))
    assert np.allclose(shares[:, 0], [0.5, 0, 0, 0, 0])
    assert np.allclose(shares[4, 1:], [0.5, 0.25])


def test_blocked_votes_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    m = quality.Voters(np.ones(1), np.eye(1), quality._unit(rng.normal(size=(200, 8))),
                       rng.integers(0, 2, 200).astype(float), 0.5)
    q = quality._unit(rng.normal(size=(50, 8)))
    for row, got in zip(q, m.scores(q)):
        near = sorted(((float(row @ v), y) for v, y in zip(m.vectors, m.labels)), reverse=True)[:quality.NEIGHBOURS]
        w = [max(c, 0) ** quality.SHARPNESS for c, _ in near]
        assert np.isclose(got, sum(a * y for a, (_, y) in zip(w, near)) / sum(w))


def _by_hand(texts, labelled):
    """Scores of ``texts`` by voters ``labelled`` [(text, label)], in plain Python; only the
    singular directions come from numpy."""
    def raw(text):
        b, out = text.encode(), [0.0] * quality.WIDTH
        for i in range(len(b) - 2):
            code = ((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761) % 2 ** 32
            out[code >> (32 - quality.BUCKETS.bit_length() + 1)] += 1
        words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
        again = sum(a == c for a, c in zip(words, words[1:]))
        capitals = sum(65 <= c <= 90 for c in b)
        signs = sum(32 < c < 127 and not chr(c).isalnum() for c in b)
        shares = (again / max(len(words), 1), capitals / max(len(b), 1), signs / max(len(b), 1))
        out[quality.BUCKETS:] = [w * x for w, x in zip(quality.FORM_WEIGHTS, shares)]
        return out

    known = [raw(t) for t, _ in labelled]
    idf = [np.log((1 + len(known)) / (1 + sum(k[j] > 0 for k in known))) + 1 for j in range(quality.BUCKETS)]

    def weighted(v):
        terms = [np.log1p(x) * i for x, i in zip(v, idf)]
        norm = sum(x * x for x in terms) ** 0.5 or 1
        return [x / norm for x in terms] + v[quality.BUCKETS:]

    rows = np.array([weighted(k) for k in known])
    basis = np.linalg.eigh(rows.T @ rows)[1][:, ::-1][:, :quality.DIMENSIONS]
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    voters = [unit(r @ basis) for r in rows]
    out = []
    for t in texts:
        q = unit(np.array(weighted(raw(t))) @ basis)
        near = sorted(((-float(q @ v), n) for n, v in enumerate(voters)))[:quality.NEIGHBOURS]
        w = [max(-c, 0) ** quality.SHARPNESS for c, _ in near]
        out.append(sum(x * labelled[n][1] for x, (_, n) in zip(w, near)) / sum(w))
    return out


def test_whole_texts_to_scores_equal_brute_force(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "Gam!", "delta", "EPS", "go go", "zé", f"x{rng.randint(0, 99)}"]) for _ in range(rng.randint(5, 60)))
    rows = [(i, text()) for i in range(160)]
    labels = spark.createDataFrame([(i, rng.randint(0, 1)) for i in range(100)], "doc_id long, quality int")
    docs = table(spark, rows)
    model = quality.fit(docs, labels)
    order = sorted(range(100), key=str)
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    want = _by_hand([t for _, t in rows], [(rows[i][1], label[i]) for i in order])
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    # the library's vectors are 32-bit numbers
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 0.02 and np.mean([abs(got[i] - w) for i, w in enumerate(want)]) < 1e-3


def test_voters_are_bounded_by_rows_of_the_sample(spark):
    rows = [(7, f"text {i} of one id") for i in range(5000)] + [(i, f"other text {i}") for i in range(100, 600)]
    labels = spark.createDataFrame([(7, 1)] * 50 + [(i, i % 2) for i in range(100, 600)] + [(None, 1), (9, 5)], "doc_id long, quality int")
    texts, sizes = quality.sampled_texts(table(spark, rows), labels, sample_per_label=64)
    got = texts.collect()
    assert sizes == {0: 250, 1: 251} and 120 <= len(got) <= 128 and len({r["key"] for r in got}) == len(got)
    whole, _ = quality.sampled_texts(table(spark, rows), labels, sample_per_label=1000)
    again, _ = quality.sampled_texts(table(spark, rows).repartition(7), labels, sample_per_label=1000)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, again.collect())) and whole.count() == 501
    assert len(quality.fit(table(spark, rows), labels, sample_per_label=64).labels) == len(got)


def test_ties_do_not_depend_on_file_layout(spark):
    """Equal texts with different labels: the voters that count are the same."""
    rows = [(i, "the same words in each of them") for i in range(60)] + [(i, f"different words {i} here") for i in range(60, 90)]
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(90)], "doc_id long, q boolean").selectExpr("doc_id", "int(q) AS quality")
    scores = []
    for parts in (1, 5):
        docs = table(spark, rows).repartition(parts)
        scores.append(sorted((r["doc_id"], r["score"]) for r in quality.score(docs, quality.fit(docs, labels.repartition(parts))).collect()))
    assert scores[0] == scores[1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op1_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95


def test_awkward_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels.where(~held_out(labels["doc_id"])))
    odd = table(spark, AWKWARD, CLASHING)
    got = quality.score(odd, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (1, 2, 6)} == {model.prior}
    kept = quality.accepted(odd, model)
    assert kept.schema == odd.schema and kept.count() == sum(r["score"] >= quality.THRESHOLD for r in got)
    assert quality.score(table(spark, []), model).count() == 0


def test_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(table(spark, AWKWARD), labels)
    assert {r["score"] for r in quality.score(table(spark, AWKWARD), model).collect()} == {0.5}
