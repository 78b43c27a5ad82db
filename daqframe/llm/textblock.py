"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A :class:`TextBlock` holds the whole texts of a few rows as one byte array. Words are maximal runs of
bytes outside ``\\x20 \\x09-\\x0D``; they never cross a row. Hashes are taken from eight bytes at a time,
each lane mixed with its place before lanes are added up, so no arithmetic relation between bytes carries over to hashes.
Where equality decides a result, equal hashes are compared byte by byte (``same``, ``same_words``, ``identified``).
A block is closed once it holds ``BLOCK_BYTES``; one longer text makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits each depend on all input bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), ends.astype(np.int64)


def mixed(x: int) -> int:
    return int(mix(np.array([x + 1], U64) * ODD)[0])


KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


class TextBlock:
    """The texts of rows first .. first + rows - 1 of a column, joined."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0, lower: bool = False):
        self.first, self.rows = first, len(offsets) - 1
        self.data = data[offsets[0] : offsets[-1]]
        if lower:
            self.data = LOWER[self.data]
        self.offsets = offsets - offsets[0]
        self._lanes: np.ndarray | None = None

    @classmethod
    def of(cls, texts: list[str | None], lower: bool = False) -> TextBlock:
        return cls(*string_buffers(pa.array(texts, pa.large_string())), lower=lower)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (bytes) of all words, and for each row the number of the first word at or after its start."""
        n = len(self.data)
        inside = ~SEPARATOR[self.data]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edges = self.offsets[:-1][self.offsets[:-1] < n]
            first[edges] = inside[edges]
            edges = self.offsets[1:][self.offsets[1:] > 0] - 1
            last[edges] = inside[edges]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def spaced(self, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each starts and ends there."""
        size = ends - starts
        out = np.full(int(size.sum()) + len(size), 32, np.uint8)
        word = np.repeat(np.arange(len(size)), size)
        out[np.arange(len(word)) + word] = self.data[~SEPARATOR[self.data]]
        after = np.cumsum(size + 1)
        return out.tobytes(), after - size - 1, after - 1

    def lanes(self) -> np.ndarray:
        """The eight bytes from each place on as one number, with zeros beyond the end."""
        if self._lanes is None:
            padded = np.zeros(len(self.data) + 9, np.uint8)
            padded[: len(self.data)] = self.data
            self._lanes = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        return self._lanes

    def _beyond(self, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of spans longer than eight bytes each further lane: its span, its number from 1 on, and its bytes."""
        long = np.flatnonzero(size > 8)
        count = (size[long] - 1) // 8
        span = np.repeat(long, count)
        lane = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count) + 1
        left = np.minimum(size[span] - 8 * lane, 8)
        return span, lane, self.lanes()[starts[span] + 8 * lane] & KEEP[left]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        """64-bit hashes of byte spans: equal bytes, equal hash."""
        size = ends - starts
        h = mix((self.lanes()[starts] & KEEP[np.minimum(size, 8)]) + U64(mixed(salt)))
        span, lane, value = self._beyond(starts, size)
        if len(span):
            first = np.flatnonzero(np.diff(span, prepend=-1))
            h[span[first]] += np.add.reduceat(mix(value + mix(lane.astype(U64) + U64(mixed(salt + 1)))), first)
        return mix(h + size.astype(U64))

    def same(self, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a[i] and b[i] hold the same bytes."""
        size = ends[a] - starts[a]
        equal = size == ends[b] - starts[b]
        equal &= ((self.lanes()[starts[a]] ^ self.lanes()[starts[b]]) & KEEP[np.minimum(size, 8)]) == 0
        some = np.flatnonzero(equal & (size > 8))
        if len(some):
            span, _, left = self._beyond(starts[a[some]], size[some])
            _, _, right = self._beyond(starts[b[some]], size[some])
            equal[some[span[left != right]]] = False
        return equal

    def same_words(self, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, count: np.ndarray | int) -> np.ndarray:
        """Whether the count[i] words from word a[i] on are those from b[i] on."""
        count = np.broadcast_to(count, len(a))
        equal = np.ones(len(a), bool)
        for j in range(int(count.max(initial=0))):
            at = np.flatnonzero(equal & (count > j))
            equal[at] = self.same(starts, ends, a[at] + j, b[at] + j)
        return equal

    def text(self, row: int) -> str:
        return bytes(self.data[self.offsets[row] : self.offsets[row + 1]]).decode("utf-8", "replace")


def characters(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and each row's bounds among them."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=total[1:])
    return points, total[block.offsets]


def gram_hashes(points: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For 1, 2 and so on up to longest the 32-bit hashes of all n-grams of code points, one starting at each that leaves room."""
    gram = np.zeros(len(points), np.uint32)
    for n in range(1, longest + 1):
        size = max(len(points) - n + 1, 0)
        gram = (gram[:size] + points[n - 1 : n - 1 + size]) * np.uint32(2654435761)
        gram ^= gram >> np.uint32(15)
        yield gram * np.uint32(0x85EBCA6B)


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    """The column as blocks of whole rows."""
    data, offsets = string_buffers(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield TextBlock(data, offsets[at : to + 1], at, lower)
        at = to


def spans_text(spaced: tuple[bytes, np.ndarray, np.ndarray], first: np.ndarray, after: np.ndarray) -> Iterator[bytes]:
    """The words from first[i] to after[i] - 1, joined by one space; of no word, nothing."""
    whole, starts, ends = spaced
    filled = after > first
    low, high = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    low[filled], high[filled] = starts[first[filled]], ends[after[filled] - 1]
    return (whole[a:z] for a, z in zip(low.tolist(), high.tolist()))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]] as int64."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """For each element the row that it lies in, given bounds as in row_sums."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of words[i : i + size] for each i that leaves room, from hashes of the words; windows are joined from halves, each join mixed."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, part, span = np.full(n, size, U64), 0, words, 1
    while True:
        if size & span:
            out = mix(out * ODD + part[done : done + n])
            done += span
        if done == size:
            return out
        part = mix(part[:-span] * ODD + part[span:])
        span *= 2


def identified(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of keys, equal where the keys are and same(i, j) holds too, and an order in which they ascend."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    twin = ordered[1:] == ordered[:-1]
    at = np.flatnonzero(twin)
    differs = at[~same(order[at], order[at + 1])] if len(at) else at
    number = np.zeros(len(keys), np.int64)
    number[order[1:]] = np.cumsum(~twin)
    if not len(differs):
        return number, order
    fresh = int(number.max()) + 1
    for n in np.unique(number[order[differs]]):  # unequal things under one key: told apart one after the other
        left = np.flatnonzero(number == n)
        while len(left):
            alike = same(np.full(len(left), left[0]), left)
            number[left[alike]] = fresh
            left, fresh = left[~alike], fresh + 1
    return number, np.argsort(number, kind="stable")
