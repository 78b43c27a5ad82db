import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from daqframe.llm.bpe import Vocabulary, encoder, round_trip
from tests.llm.conftest import prose

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(odd_rows):
    rng = random.Random(3)
    alphabet = "aeiou stnrdlth'’\n\t  .,!?0123456789éßñü漢字\U0001f600​\x85\xa0\x1c\x1f "
    made = ["".join(rng.choices(alphabet, k=rng.randrange(1, 200))) for _ in range(400)]
    made += ["".join(rng.choices("abcdefghij", k=n)) for n in (500, 511, 512, 513, 700, 3000)] + ["a" * 2000, " " * 700, "漢" * 900, "<|endoftext|> don't we'LL"]
    return [t or "" for _, t in odd_rows] + made


def test_ids_equal_those_of_the_tiktoken_library(odd_rows):
    own, want, given = encoder(RANKS, public_tokenizers.PATTERN), reference(), texts(odd_rows)
    got = list(own.encode(given))
    assert got == [want.encode_ordinary(t) for t in given]
    assert [own.vocabulary.decode(x) for x in got] == [t.encode() for t in given]


def test_trees_alone_give_the_same_ids():
    own, rng = encoder(RANKS, public_tokenizers.PATTERN).vocabulary, random.Random(5)
    pieces = [bytes(rng.choices(b"aeinrst lo", k=rng.randrange(2, 17))) for _ in range(500)]
    assert [own.merge_long(p) for p in pieces] == own.merge_many(pieces, 16)


def test_digests(spark, documents, odd_rows):
    rows = odd_rows + [(1, "repeated id"), (None, "x"), (900, prose(1, 5000, 3000))]
    want, expected = reference(), []
    for i, t in rows:
        ids = want.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = round_trip(documents(rows), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert round_trip(documents([]), RANKS, public_tokenizers.PATTERN).collect() == []


def test_vocabularies_beyond_the_packing_are_refused():
    bytes_only = {bytes([b]): b for b in range(256)}
    assert Vocabulary(bytes_only | {b"ab": 256}).merge_long(b"abab") == [256, 256]
    with pytest.raises(ValueError, match="packed"):
        Vocabulary(bytes_only | {b"ab": 1 << 16})
