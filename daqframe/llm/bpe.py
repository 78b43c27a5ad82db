"""Byte-level BPE by segment trees, and decoding.

A text is split by the pattern, each piece is encoded by itself. Over the byte positions of a piece stands a segment tree: a leaf
holds the rank of the pair that starts at its live position, an inner node the smallest rank below it, the leftmost among equals. A merge
takes the root's pair, joins it with the next live neighbour and updates three leaves and their ancestors. Trees of many pieces
are arrays side by side: each step does one merge in each piece that still has one. A very long piece has a tree of its own.

Pieces are encoded once for each stretch of text and kept in a bounded cache.

Defined results: a null or empty text has no ids, whose digests are those of no bytes; repeated rows each get a row; an empty
table gives an empty result; columns other than doc_id and text are not read. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from daqframe.llm.sampling import narrow

NONE = np.uint32(0xFFFFFFFF)
SLOT_BITS = 20
WIDEST = 512
STRETCH = 3 << 20
CACHED = 300_000


class Vocabulary:
    """Ranks of byte strings, and of the pairs of ids that merge to them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        self.pairs = {}
        for whole, i in ranks.items():
            for cut in range(1, len(whole)):
                left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 16 | right] = i
        if max(self.token) >= 1 << 16 or len(self.pairs) > 3 << (SLOT_BITS - 2):
            raise ValueError(f"ranks up to {max(self.token)} with {len(self.pairs)} pairs: pairs are packed in 32 bits and {1 << SLOT_BITS} slots")
        keys, values = np.array(list(self.pairs), np.uint32), np.array(list(self.pairs.values()), np.uint32)
        self.keys, self.values = np.full(1 << SLOT_BITS, NONE), np.full(1 << SLOT_BITS, NONE)
        slot = self.slot(keys)
        while len(keys):
            free = self.keys[slot] == NONE
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            stay = np.ones(len(keys), bool)
            stay[first] = False
            keys, values, slot = keys[stay], values[stay], (slot[stay] + 1) & ((1 << SLOT_BITS) - 1)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where they don't merge."""
        key = (left << np.uint32(16)) | right
        slot, out = self.slot(key), np.full(len(key), NONE)
        todo = np.arange(len(key))
        while len(todo):
            there = self.keys[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != NONE)]
            slot[todo] = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def merge_many(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of 2 to width bytes; width is a power of two."""
        n, size = len(pieces), np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte[raw].ravel()
        place = np.arange(width)
        after = np.where(place + 1 < size[:, None], place + 1, width).ravel()  # next live position; width: none
        before = np.tile(place - 1, n)
        tree = np.full((n, 2 * width), NONE)
        inside = place[:-1] + 1 < size[:, None]
        rank = np.full((n, width - 1), NONE)
        table = ids.reshape(n, width)
        rank[inside] = self.pair_ranks(table[:, :-1][inside], table[:, 1:][inside])
        tree[:, width : 2 * width - 1] = np.where(rank != NONE, rank * np.uint32(width) + place[:-1].astype(np.uint32), NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree, live = tree.ravel(), np.zeros(n * width, bool)
        live.reshape(n, width)[:] = place < size[:, None]
        rows = np.arange(n)

        def update(rows: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> None:
            key = np.full(len(rows), NONE)
            if right is not None:
                got = self.pair_ranks(left, right)
                key = np.where(got != NONE, got * np.uint32(width) + at.astype(np.uint32), NONE)
            base, node = rows * (2 * width), at + width
            tree[base + node] = key
            while len(rows) and node[0] > 1:
                node = node >> 1
                tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])

        while True:
            root = tree[rows * (2 * width) + 1]
            rows, root = rows[root != NONE], root[root != NONE]
            if not len(rows):
                break
            at, base = (root % np.uint32(width)).astype(np.int64), rows * width
            gone = after[base + at]
            beyond = after[base + gone]
            ids[base + at] = root // np.uint32(width)
            live[base + gone] = False
            after[base + at] = beyond
            more = beyond < width
            before[(base + beyond)[more]] = at[more]
            update(rows, gone, gone, None)
            update(rows[~more], at[~more], at[~more], None)
            update(rows[more], at[more], ids[(base + at)[more]], ids[(base + beyond)[more]])
            prior = before[base + at]
            more = prior >= 0
            update(rows[more], prior[more], ids[(base + prior)[more]], ids[(base + at)[more]])
        flat = ids[live].tolist()
        ends = np.cumsum(live.reshape(n, width).sum(axis=1)).tolist()
        return [flat[a:z] for a, z in zip([0, *ends[:-1]], ends)]

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length."""
        n, width = len(piece), 1 << (len(piece) - 1).bit_length()
        none, pairs = 1 << 62, self.pairs
        ids = [int(self.byte[b]) for b in piece]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 16 | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def update(at: int) -> None:
            to = after[at] if ids[at] >= 0 else -1
            rank = pairs.get(ids[at] << 16 | ids[to]) if to >= 0 else None
            node = width + at
            tree[node] = none if rank is None else rank * width + at
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] != none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            ids[at], ids[gone], after[at] = rank, -1, after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            update(gone)
            update(at)
            if before[at] >= 0:
                update(before[at])
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of non-empty pieces; one that is a token as a whole is that token."""
        out: list[list[int] | None] = [None] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            else:
                widths.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in widths.items():
            if width > WIDEST:
                for i in members:
                    out[i] = self.merge_long(pieces[i])
                continue
            step = max(1, (1 << 19) // width)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                for i, ids in zip(part, self.merge_many([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])


class Encoder:
    """Splits texts by the pattern and keeps what pieces were encoded to, up to a number of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.ids: dict[str, str] = {}  # piece -> its ids, comma-joined
        self.decoded: dict[str, bytes] = {}  # piece -> what its ids decode to

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, all of them known afterwards."""
        split = [self.split(t) for t in texts]
        if len(self.ids) > CACHED:
            self.ids.clear()
            self.decoded.clear()
        new = list(set().union(*split).difference(self.ids))
        for piece, ids in zip(new, self.vocabulary.encode_pieces([p.encode() for p in new])):
            self.ids[piece] = ",".join(map(str, ids))
            self.decoded[piece] = self.vocabulary.decode(ids)
        return split

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for split in self.pieces(texts):
            yield [int(i) for p in split for i in self.ids[p].split(",")]


@lru_cache(maxsize=2)
def encoder(ranks_file: str, pattern: str) -> Encoder:
    with open(ranks_file, "rb") as f:
        return Encoder(Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}), pattern)


def stretches(column: pa.Array, most: int = STRETCH) -> Iterator[tuple[int, list[str]]]:
    """Whole texts in lists of about most characters, each with the row of its first."""
    first, texts, size = 0, [], 0
    for row, text in enumerate(column):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield first, texts
            first, texts, size = row + 1, [], 0
    if texts:
        yield first, texts


def round_trip(documents: DataFrame, ranks_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; with_ids: the ids too."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_file, pattern)
        for batch in batches:
            for first, texts in stretches(batch.column("text")):
                count, ids_digest, decoded_digest, lists = [], [], [], []
                for split in own.pieces(texts):
                    joined = ",".join(map(own.ids.__getitem__, split))
                    count.append(joined.count(",") + 1 if joined else 0)
                    ids_digest.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded_digest.append(hashlib.sha256(b"".join(map(own.decoded.__getitem__, split))).hexdigest())
                    if with_ids:
                        lists.append([int(i) for i in joined.split(",")] if joined else [])
                arrays = [batch.column("doc_id").slice(first, len(texts)), pa.array(count, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(decoded_digest, pa.string())]
                if with_ids:
                    arrays.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays)])

    return narrow(documents).mapInArrow(run, schema)
