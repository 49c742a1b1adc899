import hashlib

import pytest
from pyspark.sql import functions as F

from pixelmill.llm import exact_dedup as ed
from tests.llm.docs import AWKWARD, CLASHING, table

ROWS = AWKWARD + [(30, "abcdefgh" * 5), (31, "abcdefgh" * 5 + "x"), (32, "abcdefgh" * 5), (33, "abcd" * 9)]


def _brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = set()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out |= {(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    return out


@pytest.mark.parametrize("block", [4, ed.BLOCK_BYTES])
def test_groups_equal_brute_force(spark, block):
    rows = ROWS if block > 4 else [(i, t) for i, t in ROWS if len(t or "") < 100]
    got = ed.exact_groups(table(spark, rows, CLASHING), block_bytes=block).drop("n_rows").collect()
    assert {tuple(r) for r in got} == _brute(rows) and len(got) == len(_brute(rows))


def test_names_survive_hash_clashes(spark, monkeypatch):
    """Every block under one of two hashes: names then come from the contents."""
    monkeypatch.setattr(ed.F, "xxhash64", lambda *c, f=F.xxhash64: F.pmod(f(*c), F.lit(2)))
    rows = [(i, t) for i, t in ROWS if len(t or "") < 100 and i is not None]
    rows = [(i, f"{t}" if t else t) for i, t in dict(rows).items()]
    got = ed.exact_groups(table(spark, rows), block_bytes=4).drop("n_rows").collect()
    assert {tuple(r) for r in got} == _brute(rows)


def test_dedup_keeps_one_row_of_each_text(spark):
    docs = table(spark, ROWS, CLASHING)
    kept = ed.exact_dedup(docs)
    assert kept.columns == docs.columns
    got = kept.select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(
        str((max((i for i, u in ROWS if (u or "") == t and i is not None), default=None), t))
        for t in {t or "" for _, t in ROWS})


def test_empty_table(spark):
    assert ed.exact_groups(table(spark, [])).count() == 0
    assert ed.exact_dedup(table(spark, [])).count() == 0


def test_no_python_in_plan(spark):
    plan = ed.exact_groups(table(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_large_groups_meet_their_rows_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(ed, "HOT_GROUP", 2)
    monkeypatch.setattr(ed, "BROADCAST_GROUPS", most)
    rows = [(i, t) for i, t in ROWS if len(t or "") < 100] + [(100 + i, "many") for i in range(40)]
    got = ed.exact_groups(table(spark, rows)).drop("n_rows").collect()
    assert {tuple(r) for r in got} == _brute(rows) and len(got) == len(_brute(rows))
