import hashlib
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from pixelmill.llm import bpe, mixing, quality, queries
from pixelmill.llm.common import table as read
from tests.llm.docs import AWKWARD, CLASHING, table
from tests.llm.test_hyperminhash import _brute as near_brute

SF = "/root/testdata/sf0.001"


def _mixed(rows):
    """(doc_id, source, text) -> copies per doc_id, one queue entry at a time."""
    words = {i: len(t.split()) for i, _, t in rows}
    sizes = Counter()
    for i, s, _ in rows:
        sizes[s] += words[i]
    order = sorted(sizes)
    weight = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    total, target, free = float(sum(sizes.values())), {}, set(sizes)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in over} if over else {s: level * weight[s] for s in free}
        free -= over or free
    entries = []
    for s in sizes:
        upto = 0
        for u, i in sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i) for i, t, _ in rows if t == s and words[i]):
            upto += words[i]
            entries += [((c * sizes[s] + upto) / target[s], s, c, u, i) for c in range(3)]
    taken, used = Counter(), 0
    for *_, i in sorted(entries):
        used += words[i]
        if used > total:
            break
        taken[i] += 1
    return taken


def test_run_equals_brute_force(spark):
    docs = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "source", "text").collect()]
    all_docs = read(spark, SF, "documents")
    model = queries.quality_model(spark, SF, all_docs)
    good = {r["doc_id"] for r in quality.score(all_docs, model).collect() if r["score"] >= quality.THRESHOLD}
    docs = [d for d in docs if d[0] in good]
    last = {t: i for i, _, t in sorted(docs)}
    docs = [d for d in docs if last[d[2]] == d[0]]
    kept = {eval(r)[0] for r in near_brute([(i, t) for i, _, t in docs]) if eval(r)[3]}  # noqa: S307
    docs = [d for d in docs if d[0] in kept]
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(P.path(queries.RANKS)))
    text, want = {i: t for i, _, t in docs}, Counter()
    for i, copies in _mixed(docs).items():
        ids = lib.encode_ordinary(text[i])
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(text[i].encode()).hexdigest())] = copies
    assert Counter(tuple(r) for r in cp.run(spark, SF).collect()) == want


def test_stages_keep_the_columns_of_documents(spark):
    docs = read(spark, SF, "documents")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def _written(spark, tmp, rows, labels, extra=()):
    table(spark, rows, extra).write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    return str(tmp)


def test_awkward_documents_end_to_end(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, ties, clashing names."""
    good = [(100 + i, f"the quick brown fox number {i} jumps over lazy dogs near river bank {i * 7}", "ab"[i % 2]) for i in range(40)]
    bad = [(200 + i, "$$$ BUY! " * (i + 3), None) for i in range(10)]
    odd = [(i, t) for i, t in AWKWARD]
    rows = good + bad + odd + [good[3], (300, good[5][1], "a"), (None, good[7][1], None)]
    labels = [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad] + [(None, 1, 0), (1, None, None), (100, 1, 0)]
    sf = _written(spark, tmp_path / "sf", rows, labels, CLASHING)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(hashlib.sha256((r[1] or "").encode()).hexdigest())
    got = cp.run(spark, sf).collect()
    assert got and all(r["decoded_sha256"] in texts[r["doc_id"]] for r in got)
    kept = {r["doc_id"] for r in got}
    # clean texts without a copy stay or are passed over by the mix alone; copies of them go
    assert kept & {i for i, *_ in good} and 105 not in kept and not kept & {i for i, *_ in bad}
    copies = Counter(tuple(r) for r in got)
    assert max(copies.values()) <= mixing.MAX_COPIES


def test_no_documents_at_all(spark, tmp_path):
    assert cp.run(spark, _written(spark, tmp_path / "sf", [], [])).count() == 0
