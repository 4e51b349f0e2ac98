import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import awkward, empty

from corpusrisk.llm.byte_bpe import ByteBPE, byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def public(bpe):
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids(enc, text):
    return np.array(enc.encode_ordinary(text), dtype="<u4").tobytes()


def odd_texts():
    rnd = random.Random(1)
    some = ["", "  \n\n x", "a" * 3000, "é" * 777, "<|endoftext|> " * 20, "日本語" * 30, "0123456789" * 50, "\U0001f600" * 100, "a\x00\x1f\x85\xa0 b's"]
    some += ["".join(chr(rnd.randrange(32, 0x2FFF)) for _ in range(500))]
    return some + ["".join(rnd.choice("abcdeé#' ") for _ in range(rnd.randrange(1, 200))) for _ in range(200)]


def test_equal_to_public_library(bpe, public):
    texts = odd_texts()
    coded = bpe.encode_many(texts)
    assert coded == [ids(public, t) for t in texts]
    assert [bpe.decode(c) for c in coded] == [t.encode() for t in texts]


def test_long_and_short_trees_agree(bpe):
    rnd = random.Random(2)
    for n in (2, 3, 4, 5, 8, 9, 31, 63, 64):
        pieces = [bytes(rnd.choice(b"abcdefgh\xc3\xa9") for _ in range(n)) for _ in range(20)]
        assert bpe.merge_batch(pieces, 64) == [bpe.merge_long(p) for p in pieces]


def test_operator(spark, public):
    df = awkward(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) for r in byte_bpe(df, PATH, P.PATTERN).collect())
    want = sorted(
        (r.doc_id is None, r.doc_id or 0, len(c := ids(public, r.text or "")) // 4, c, hashlib.sha256(c).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in df.collect()
    )
    assert [(a, b, c, bytes(d), e, f) for a, b, c, d, e, f in got] == want
    assert byte_bpe(empty(spark), PATH, P.PATTERN).collect() == []
