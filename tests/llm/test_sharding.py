import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from daqframe.llm.sharding import Feistel, assign_shards, row_at, shard_and_slot


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 64, 65, 1000, 4097])
def test_permutation_and_inverse(n):
    rows = np.arange(n)
    place = Feistel(n, 3).place(rows)
    assert sorted(place) == list(rows)
    assert list(Feistel(n, 3).row(place)) == list(rows)
    shard, slot = shard_and_slot(rows, n, 8, 3)
    assert list(row_at(shard, slot, n, 8, 3)) == list(rows)


def test_shards(spark, documents, odd_rows):
    rows = odd_rows + [(7, "x" * 5000), (None, "no id"), (None, "no id")]
    got = assign_shards(documents(rows), 8, 1).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(len(slots[s]) for s in range(8)) <= 1
    again = assign_shards(documents(rows[::-1]).repartition(3), 8, 1).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert assign_shards(documents([])).collect() == []


M = 2**64 - 1


def plain_mix(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & M
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & M
    return x ^ x >> 32


def plain_place(row, n, seed, rounds=8):
    """The permutation one number at a time."""
    a = math.isqrt(max(n - 1, 0)) + 1
    b = max(1, -(-n // a))
    keys = [plain_mix((i + plain_mix(seed)) & M) for i in range(1, rounds + 1)]
    while True:
        left, right = divmod(row, b)
        for i in range(0, rounds, 2):
            left = (left + plain_mix((right + keys[i]) & M) % a) % a
            right = (right + plain_mix((left + keys[i + 1]) & M) % b) % b
        row = left * b + right
        if row < n:
            return row


@pytest.mark.parametrize("seed", [0, 4])
def test_shards_and_slots_equal_a_plain_permutation(spark, documents, odd_rows, seed):
    rows = odd_rows + [(7, "x" * 50), (None, "no id"), (None, "a"), (900, "t"), (900, "u")]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    want = []
    for number, (i, t) in enumerate(ordered):
        place = plain_place(number, len(rows), seed)
        want.append((i, zlib.crc32((t or "").encode()), number, place % 8, place // 8))
    got = assign_shards(documents(rows).repartition(3), 8, seed).collect()
    assert sorted(((r.doc_id, r.text_crc32, r.row_number, r.shard, r.slot) for r in got), key=str) == sorted(want, key=str)
