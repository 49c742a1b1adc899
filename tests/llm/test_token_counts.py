import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pixelmill.llm import token_counts as tc
from tests.llm.docs import AWKWARD, CLASHING, table

FILE = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("share", [1 << 20, 4])
def test_counts_equal_library(spark, monkeypatch, share):
    """With a share of 4 nearly all pre-tokens go through the join."""
    monkeypatch.setattr(tc, "HOT_SHARE", share)
    rows = AWKWARD + [(20, "a  <|endoftext|>  b"), (21, "<|endoftext|><|endoftext|>"), (22, "it's 'tis can't've")]
    got = tc.token_counts(table(spark, rows, CLASHING), FILE, P.PATTERN).collect()
    lib = Tokenizer.from_file(FILE)
    want = []
    for doc_id, text in rows:
        n = len(lib.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 512))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_empty_table(spark):
    assert tc.token_counts(table(spark, []), FILE, P.PATTERN).count() == 0


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = Tokenizer.from_file(FILE)
    want = {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tc.token_counts(docs, FILE, P.PATTERN).collect()} == want
