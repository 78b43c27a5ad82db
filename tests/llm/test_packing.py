import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from daqframe.llm.packing import packed, pieces, sweeps, tokenizer
from tests.llm.conftest import prose

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_those_of_the_tokenizers_library(odd_rows):
    reference = Tokenizer.from_file(VOCABULARY)
    reference.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = "aeiou stnr'’\n\t  .,!?0123456789éßñ漢字\U0001f600​\x85\xa0\x1c"
    texts = [t or "" for _, t in odd_rows] + ["".join(rng.choices(alphabet, k=80)) for _ in range(300)] + ["<|endoftext|> don't we'LL"]
    assert all(list(tokenizer(VOCABULARY).encode_to_numpy(t, disallowed_special=())) == reference.encode(t, add_special_tokens=False).ids for t in texts)


def test_added_tokens_are_those_of_the_library_by_default(spark, documents):
    reference = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", " ", "\n\n", "  ", "a", " don't", "é漢", "\U0001f600", "12", "<"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y"] + ["".join(rng.choices(parts, k=12)) for _ in range(300)]
    want = {i: (*reference.encode(t, add_special_tokens=False).ids, 0) for i, t in enumerate(texts)}
    assert want[0] == (64, 220, 50256, 275, 0)
    got = pieces(documents(list(enumerate(texts))), VOCABULARY, with_ids=True).collect()
    assert {r.doc_id: tuple(r.ids) for r in got} == want
    assert all(r.length == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes()) for r in got)


def best_fit_decreasing(lengths, capacity):
    gaps = Counter()
    opened = 0
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n and gaps[g]]
        g = min(fits) if fits else capacity
        if fits:
            gaps[g] -= 1
        else:
            opened += 1
        gaps[g - n] += 1
    return opened


@pytest.mark.parametrize("seed", range(8))
def test_sweeps_are_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    lengths = rng.integers(1, capacity + 1, 400) if seed % 2 else np.minimum(rng.geometric(0.08, 600), capacity)
    counts = dict(Counter(lengths.tolist()))
    runs, opened = sweeps(counts, capacity)
    assert opened == best_fit_decreasing(lengths.tolist(), capacity)
    used = defaultdict(set)
    for rank, n in enumerate(sorted(lengths.tolist(), reverse=True)):
        first, sequence, each, length, offset = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1]
        assert length == n
        at = offset + (rank - first) % each * length
        place = set(range(at, at + n))
        assert not place & used[sequence + (rank - first) // each]
        used[sequence + (rank - first) // each] |= place
    assert len(used) == opened and all(v == set(range(len(v))) and len(v) <= capacity for v in used.values())


def test_packed_pieces(spark, documents, odd_rows):
    rows = odd_rows + [(500 + i, prose(i, 10 + 300 * (i % 5))) for i in range(30)] + [(500, "again"), (None, "x")]
    got = packed(documents(rows), VOCABULARY, 512).collect()
    encode = tokenizer(VOCABULARY)
    want = []
    for i, t in rows:
        ids = [*encode.encode_ordinary(t or ""), 0]
        cuts = [0, *range((len(ids) - 1) % 512 + 1, len(ids) + 1, 512)]
        want += [(i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(n for _, n in v) <= 512
    assert len(places) == best_fit_decreasing([w[3] for w in want], 512)
    assert [tuple(r.ids) for r in pieces(documents([(1, "hello")]), VOCABULARY, with_ids=True).collect()] == [(*encode.encode_ordinary("hello"), 0)]
    assert packed(documents([]), VOCABULARY).collect() == []
