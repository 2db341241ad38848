import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(texts):
    ids, ends = bpe.encode_texts(texts, PATH, public_tokenizers.PATTERN)
    data, cuts = bpe.ranks(PATH).decode(ids, ends)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])], [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


@given(st.lists(st.text(), max_size=6))
@settings(max_examples=150, deadline=None)
def test_as_the_library(library, texts):
    got, back = ours(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert back == [t.encode() for t in texts]


def test_long_and_odd(library):
    rng = random.Random(3)
    texts = ["", " " * 3000, "a" * 5000, "".join(rng.choice("abcdeé") for _ in range(4000)), "é" * 700, "x" * 257, "ab" * 128, "<|endoftext|>", "日本語テキスト" * 60, "\n\n\t  end  "]
    got, back = ours(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert back == [t.encode() for t in texts]


def test_frames(spark, library):
    docs = spark.createDataFrame([(1, "Hello wörld", "x"), (2, None, "x"), (2, None, "x"), (None, "", None), (5, "Hello wörld", "y")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()), key=str)

    def row(i, t):
        ids = library.encode_ordinary(t)
        return i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()

    assert got == sorted([row(1, "Hello wörld"), row(2, ""), row(2, ""), row(None, ""), row(5, "Hello wörld")], key=str)
    codes = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert sorted((r[0] or 0, bytes(r[1]).decode()) for r in bpe.decode(codes, PATH).collect()) == [(0, ""), (1, "Hello wörld"), (2, ""), (2, ""), (5, "Hello wörld")]
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), PATH).collect()


def test_very_long_pieces(library):
    """Pieces of 257 to 100,000 bytes: one word, one run of spaces, words of few letters, and characters of several bytes."""
    rng = random.Random(7)
    texts = ["".join(rng.choice(a) for _ in range(n)) for n in (257, 300, 511, 512, 513, 1024, 4097) for a in ("ab", "etaoinshr", "éü日本", "aA1")]
    texts += ["ab" * 50_000, " " * 100_000 + "x", "the" * 20_000, "".join(rng.choice("etaoin") for _ in range(100_000)), "\n" * 9000]
    got, back = ours(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert back == [t.encode() for t in texts]
