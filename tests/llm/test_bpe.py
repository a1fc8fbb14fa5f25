"""Operator 7 against tiktoken."""

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
import regex

from quern.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def known():
    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "   ", "it's we'll I'd 'tis ''s", "a\x1cb \x1d \x85 x", "   x\n\n  y \n", "😀👍🏽 <|endoftext|>", "a" * 3000, " " * 500 + "x", "\x00\x01", "１２３ ⅷ²", "über straße 漢字", "the the the", "the the the"]


def test_digests_equal_tiktoken(table, known):
    docs = table([*enumerate(TEXTS), (None, "null id"), (99, None)])
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    for i, t in [*enumerate(TEXTS), (None, "null id"), (99, "")]:
        ids = known.encode_ordinary(t)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.digests(table([])).count() == 0


def test_split_equals_pattern(rng):
    find = regex.compile(P.PATTERN).findall
    letters = list("ab sd  \n\t'''rvelmstd 12é½ⅷ!?#\xa0 \x1c\x1f\x85漢😀́")
    assert bpe.SPLIT == P.PATTERN
    for _ in range(500):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(rng.randint(0, 6))]
        pieces, off = bpe.split(pa.array(texts, pa.large_string()))
        assert [pieces.to_pylist()[off[i] : off[i + 1]] for i in range(len(texts))] == [find(t) for t in texts]


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(2000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot_to_id.tolist()) == list(range(2000))
    import xxhash

    assert h.candidates(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)).tolist() == list(range(2000))
