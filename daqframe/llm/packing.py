"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

A document's tokens are those of a public byte-level BPE, then id 0. Longer documents are cut into pieces of the
capacity; the first piece may be shorter. Pieces are then packed by bulk-synchronous best fit:

* The pieces are range-sorted by length, longest first, and ranked, so that pieces of one length are one stretch of ranks.
* Gaps are kept sorted by size, as runs of sequences with equal gaps. A round takes the longest length left, sweeps from its
  successor, the smallest gap that holds it, to larger gaps, and lets pieces and gaps meet by rank: the i-th piece goes to
  the i-th place. Where no gap holds it, new sequences open. Gaps are updated and the next round follows.
* A piece finds its place by its rank.

Lengths and gaps are at most the capacity, so there are at most as many sorted lengths and gap sizes as the capacity has values, whatever the number of documents; a gap
size may hold several runs of sequences, but their number doesn't grow with the documents either (under 5,000 in all for any multiple of one set of lengths). The sweeps run on
the driver over these runs; ranks, pieces and tokens stay distributed. The outcome is that of best-fit decreasing over all pieces.

Defined results: a null or empty text is one piece, id 0 alone; repeated rows are packed each; an empty table gives an empty
result; columns other than doc_id and text are not read. The file's added tokens are found in a text and get their ids, as the
tokenizers library does by default and with add_special_tokens=False.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daqframe.llm.sampling import narrow
from daqframe.llm.session import checkpointed, ranked

CAPACITY = 2048
END = 0


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str, pattern: str | None = None):
    """The byte-level BPE of a tokenizers file, run by tiktoken: the same ids in a fraction of the time.

    The file's added tokens are special tokens here: found where the caller allows them, as ``tokens_of`` does.

    A file of this kind spells each byte as a printable character: those that print stand for themselves, the others for 256 and on.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    tokens, added = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
        raise ValueError("added tokens that look at their surroundings are not supported")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in token): i for token, i in tokens.items() if token not in added}
    return tiktoken.Encoding("bytes", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def tokens_of(text: str | None, encode) -> np.ndarray:
    """The ids of a text; added tokens split it and stand for themselves."""
    return encode.encode_to_numpy(text or "", allowed_special="all")


def pieces(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece; with_ids: also its ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary)
        for batch in batches:
            doc, out, lists = [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.append(tokens_of(text.as_py(), encode), np.uint32(END)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    part = ids[max(end - capacity, 0) if piece else 0 : end]
                    doc.append(row)
                    out.append((piece, end - len(part), len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        lists.append(part.astype(np.int32))
            columns = np.array(out, np.int64).reshape(-1, 4)
            arrays = [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(columns[:, 0].astype(np.int32)), *(pa.array(columns[:, k]) for k in (1, 2, 3))]
            if with_ids:
                arrays.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return narrow(documents).mapInArrow(run, schema)


def sweeps(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places for counts[length] pieces of each length, as runs by rank (longest first), and the number of sequences.

    A run (rank, sequence, each, length, offset): from that rank on, pieces fill sequence, sequence + 1 and so on, each with `each` pieces, one behind the other from offset.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs (first sequence, count)
    order: list[int] = []
    runs, opened, rank = [], 0, 0

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, count))

    def fill(gap: int, first: int, count: int, left: int, length: int) -> int:
        """Puts up to left pieces into a run of sequences with this gap; the number placed."""
        nonlocal rank
        each = gap // length
        full, more = divmod(min(left, count * each), each)
        if full:
            runs.append((rank, first, each, length, capacity - gap))
            put(gap - each * length, first, full)
        if more:
            runs.append((rank + full * each, first + full, more, length, capacity - gap))
            put(gap - more * length, first + full, 1)
        put(gap, first + full + bool(more), count - full - bool(more))
        rank += full * each + more
        return full * each + more

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                count = -(-left // (capacity // length))
                first, opened = opened, opened + count
                left -= fill(capacity, first, count, left, length)
                continue
            gap = order[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            left -= fill(gap, first, count, left, length)
    return np.array(runs, np.int64).reshape(-1, 5), opened


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (narrow rows with doc_id, piece and length) with sequence_id and offset."""
    # checkpointed, as a range sort reads its input twice and would tokenise twice
    placed = ranked(checkpointed(cut), [F.col("length").desc(), F.col("doc_id"), F.col("piece")])
    counts = {int(r[0]): int(r[1]) for r in placed.groupBy("length").count().collect()}  # at most capacity rows
    runs, _ = sweeps(counts, capacity)
    shared = cut.sparkSession.sparkContext.broadcast(runs)  # bounded by the capacity, not by the documents
    names = [c for c in placed.columns if c != "rank"]
    schema = placed.select(names).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            first, sequence, each, length, offset = table[np.searchsorted(table[:, 0], rank, side="right") - 1].T if len(rank) else np.zeros((5, 0), np.int64)
            nth = rank - first
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence + nth // np.maximum(each, 1)), pa.array(offset + nth % np.maximum(each, 1) * length)], names=[*names, "sequence_id", "offset"])

    return placed.mapInArrow(run, schema)


def packed(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(pieces(documents, vocabulary, capacity), capacity)
