from collections import Counter

import pytest

from pixelmill.llm import mixing
from tests.llm.docs import AWKWARD, CLASHING, table

ROWS = [(i, "w " * (1 + i * 7 % 40), "abcde"[i % 5] if i % 3 else "a") for i in range(200)]
ROWS += [(500 + i, "z " * 3, None) for i in range(4)] + [(600, None, "a"), (601, "", "empty"), (None, "x y", "b")]


def _targets(sizes):
    """Water filling, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in over} if over else {s: level * weight[s] for s in free}
        free -= over or free
    return target


@pytest.mark.parametrize("rows", [1, 20_000])
def test_targets_and_taken(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
    got = mixing.mix_counts(table(spark, ROWS, CLASHING)).collect()
    assert len(got) == len(ROWS)
    sizes = Counter()
    for _, text, source in ROWS:
        sizes[source] += len((text or "").split())
    target, taken = _targets(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 41
    assert sum(taken.values()) <= sum(sizes.values())


def test_reruns_and_partitions_agree(spark):
    docs = table(spark, ROWS)
    a = {tuple(r) for r in mixing.mix_counts(docs).collect()}
    assert a == {tuple(r) for r in mixing.mix_counts(docs.repartition(7)).collect()}


def test_mix_repeats_rows(spark):
    docs = table(spark, ROWS, CLASHING)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix_counts(docs).collect() if r["copies"]}
    assert Counter((r["doc_id"], r["source"]) for r in mixed.collect()) == Counter(counts)


def test_awkward_rows_and_empty_table(spark):
    got = mixing.mix_counts(table(spark, AWKWARD)).collect()
    assert len(got) == len({i for i, _ in AWKWARD})  # rows with one id and source are one document
    assert mixing.mix_counts(table(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mix_counts(table(spark, [(1, None), (2, "")])).collect()} == {0}
