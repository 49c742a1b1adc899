import hashlib
import random

import public_tokenizers as P
import tiktoken

from pixelmill.llm import bpe
from tests.llm.docs import AWKWARD, CLASHING, table

RANKS = P.path("byte_bpe_50k.tiktoken")


def _library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_encode_equals_library_on_random_text():
    rng, lib, own = random.Random(3), _library(), bpe.Codec(RANKS, P.PATTERN)
    pool = [chr(i) for i in range(0x2FFF)] + [" ", "\n", "'s", "12", "the"] * 300
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 80)))
        ids = own.encode(text)
        assert ids == lib.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_digests_of_awkward_rows(spark):
    lib = _library()
    got = bpe.digests(table(spark, AWKWARD, CLASHING), RANKS, P.PATTERN).collect()
    want = []
    for doc_id, text in AWKWARD:
        ids = lib.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_round_trip_and_empty_table(spark):
    docs = table(spark, AWKWARD)
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(str((r[0], bytes(r[1]))) for r in back) == sorted(str((i, (t or "").encode())) for i, t in AWKWARD)
    assert bpe.digests(table(spark, []), RANKS, P.PATTERN).count() == 0


def test_long_pieces_are_not_kept():
    codec = bpe.Codec(RANKS, P.PATTERN)
    for i in range(5):
        text = f"short words {i} " + chr(97 + i) * 50_000
        assert codec.decode(codec.encode(text)) == text.encode()
        assert sum(len(p) for p in codec.cache) < 60_000
    codec.learn({"a"})
    assert max(map(len, codec.cache)) <= bpe.CACHE_CHARS and codec.long == []
