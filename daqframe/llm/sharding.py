"""A reproducible shuffle into shards by a Feistel permutation over global row numbers.

Rows are numbered by (doc_id, text hash), then the permutation sends row number r to place p; the shard is
p mod shards and the slot p div shards. Nothing but the row count, the seed and the shard count is needed to
compute a row's place, or with :func:`row_at` the row of a place, so a reader can seek to any shard and slot.

The permutation works on pairs (l, r) of Z_a x Z_b with a * b just over the row count; places beyond the count
are walked on along their cycle until they fall inside, which ends since the permutation is a bijection.
The law that holds is ``rows``: shard counts differ by one at most. Slots are gapless by construction. Groups of
equal texts are not kept together, which that law would not allow for a large group; text_crc32 shows them.

Defined results: a null text has size 1 and the checksum of no bytes; rows equal in doc_id and text may swap
places, which shows in no column; null doc_ids sort first; an empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daqframe.llm.sampling import narrow
from daqframe.llm.session import ranked
from daqframe.llm.textblock import mix

ROUNDS = 8


class Feistel:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n = n
        self.a = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + mix(np.array([seed], np.uint64)))

    def _turn(self, half: np.ndarray, i: int, modulus: int) -> np.ndarray:
        return (mix(half.astype(np.uint64) + self.keys[i]) % np.uint64(modulus)).astype(np.int64)

    def _step(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for i in range(0, len(self.keys), 2):
            left = (left + self._turn(right, i, self.a)) % self.a
            right = (right + self._turn(left, i + 1, self.b)) % self.b
        return left * self.b + right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for i in range(len(self.keys) - 2, -1, -2):
            right = (right - self._turn(left, i + 1, self.b)) % self.b
            left = (left - self._turn(right, i, self.a)) % self.a
        return left * self.b + right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, np.int64))
        out = np.flatnonzero(x >= self.n)
        while len(out):
            x[out] = step(x[out])
            out = out[x[out] >= self.n]
        return x

    def place(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, self._step)

    def row(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, self._back)


def shard_and_slot(row: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    place = Feistel(n, seed).place(row)
    return place % shards, place // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The global row number that lies at a shard's slot."""
    return Feistel(n, seed).row(np.asarray(slot, np.int64) * shards + shard)


def assign_shards(documents: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every document. The text itself is never shuffled."""
    octets = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = narrow(documents).select("doc_id", (F.octet_length(octets) + 1).cast("long").alias("size"), F.crc32(octets).alias("text_crc32"))
    numbered = ranked(rows, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")])
    n = numbered.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("rank").to_numpy(zero_copy_only=False)
            shard, slot = shard_and_slot(row, n, shards, seed) if len(row) else (row, row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), batch.column("rank"), pa.array(shard.astype(np.int32)), pa.array(slot)],
                names=["doc_id", "size", "text_crc32", "row_number", "shard", "slot"],
            )

    return numbered.select("doc_id", "size", "text_crc32", "rank").mapInArrow(run, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")
