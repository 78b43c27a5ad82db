"""Removal of repeated passages by recompression.

Each document is a sequence of words. A level of recompression names runs of equal symbols, then splits the symbols into two
sides by their names and names each pair of a left and a right neighbour. A name is a hash of what it stands for, so
every Spark task gives the same name to the same run or pair and no dictionary has to be exchanged. What a level does to a
symbol depends on its direct neighbours only; hence equal substrings get equal interior symbols, wherever they stand.

For a window of words, the symbols that its own words fix, whatever stands around, are tracked through the levels.
Of the highest level that leaves any, the longest symbol (the smallest name among equals) is the window's anchor:
a function of the window's words alone. A window that occurs in two documents has its anchor in both.

1. One pass over the texts gives each document's distinct anchors and a digest of its whole word sequence.
2. Documents with equal sequences: all but the smallest doc_id are repeats as a whole. Only that one goes on.
3. Anchors of one document alone drop out; the others go back to their documents.
4. Neighbouring windows with one anchor make a span of words. Documents with the same span: all but the smallest doc_id lose it
   as a whole, at a row for each span.
5. What the smallest documents' spans still share with others, at their ends, shows in their windows. A window reaches as far to one side of its anchor as to the other or
   farther: the anchor and so many words on either side are looked up first, and only windows at halves that several documents have go on. The smallest doc_id of each is found.
6. Words covered by a window that starts in a smaller doc_id are removed.

Anchors only bring candidates together. Sequences, spans and windows are told by cryptographic digests of their words (SHA-256, BLAKE2b of 128 bits),
so no hash of symbols decides what is removed.

All groupings take minima before the shuffle, so a passage that a third of all documents share costs a row per task.

Defined results: a null or empty text has no words; documents of fewer words than a window lose nothing; equal windows
within one doc_id, repeated rows included, remove nothing; rows without a doc_id neither remove nor lose words; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daqframe.llm.sampling import narrow
from daqframe.llm.session import checkpointed, written
from daqframe.llm.textblock import TextBlock, blocks, mix, row_sums, rows_of, spans_text

WINDOW = 50
LEVELS = 4
U64 = np.uint64


def named_runs(symbol: np.ndarray, row: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the runs of equal symbols, and where each run starts."""
    new = np.ones(len(symbol), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(symbol)))
    name = symbol[first]
    return np.where(length > 1, mix(name * U64(0x9E3779B97F4A7C15) + (length.astype(U64) << U64(8)) + U64(2 * level + 1)), name), first


def named_pairs(symbol: np.ndarray, row: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names after each left symbol has joined a right one behind it, where each stands, and the side of each old symbol."""
    right = (mix(symbol + U64(0xA5A5A5A5 + level)) & U64(1)).astype(bool)
    join = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
    head = np.ones(len(symbol), bool)
    head[1:] = ~join
    first = np.flatnonzero(head)
    joined = np.zeros(len(symbol), bool)
    joined[:-1] = join
    joined = joined[first]
    name = symbol[first]
    at = first[joined]
    name[joined] = mix(symbol[at] * U64(0xC2B2AE3D27D4EB4F) + mix(symbol[at + 1] + U64(2 * level + 2)))
    return name, first, right


def least_in(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(keys[low[i]:high[i]]) for ranges that aren't empty."""
    width = high - low
    power = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(low), keys.dtype)
    table, k = keys, 0
    while True:
        now = np.flatnonzero(power == k)
        out[now] = np.minimum(table[low[now]], table[high[now] - (1 << k)])
        k += 1
        if not (power >= k).any():
            return out
        table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])


def leftmost(keys: np.ndarray, wanted: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The first place at low or behind it that holds the wanted key; there is one."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    number = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])) * len(keys)
    return order[np.searchsorted(number + order, number[np.searchsorted(ordered, wanted)] + low)]


def anchors(words: np.ndarray, bounds: np.ndarray, size: int = WINDOW, levels: int = LEVELS, where: bool = False) -> tuple[np.ndarray, ...]:
    """All windows of size words within a row: the word that each starts at, and its anchor; where: also the first word of the anchor's first place and the one behind it."""
    row = rows_of(bounds)
    if len(words) < size:
        return (np.zeros(0, np.int64), np.zeros(0, U64)) + (np.zeros(0, np.int64),) * 2 * where
    start = np.flatnonzero(row[: len(words) - size + 1] == row[size - 1 :])
    anchor = np.zeros(len(start), U64)
    symbol, place = mix(words + U64(77)), np.arange(len(words))
    begin, behind = start.copy(), start + size
    low, high, alive = start.copy(), start + size, np.ones(len(start), bool)
    for level in range(levels + 1):
        if level:
            symbol, first = named_runs(symbol, row, level)
            run = np.zeros(len(row), np.int64)
            run[first] = 1
            run = np.cumsum(run) - 1
            place, row = place[first], row[first]
            low, high = run[low] + 1, run[high - 1]
            alive, low, high = still(alive, low, high)
            symbol, first, right = named_pairs(symbol, row, level)
            number = np.zeros(len(row), np.int64)
            number[first] = 1
            number = np.cumsum(number) - 1
            place, row = place[first], row[first]
            low, high = low + right[low], high - ~right[high - 1]
            alive, low, high = still(alive, low, high)
            low, high = number[low], number[high - 1] + 1
        last = np.append(place[1:], len(words))
        key = (U64(63) - np.minimum(last - place, 63).astype(U64)) << U64(58) | mix(symbol) >> U64(6)
        now = np.flatnonzero(alive)
        if not len(now):
            break
        turn = np.ones(len(now), bool)  # neighbours mostly have the same range
        turn[1:] = (low[now[1:]] != low[now[:-1]]) | (high[now[1:]] != high[now[:-1]])
        some, each = now[turn], np.cumsum(turn) - 1
        least = least_in(key, low[some], high[some])
        anchor[now] = mix(least + U64(level))[each]
        if where:
            at = leftmost(key, least, low[some])
            begin[now], behind[now] = place[at][each], last[at][each]
    return (start, anchor, begin, behind) if where else (start, anchor)


def still(alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose range went empty are out; their ranges become 0..1 so that later steps stay inside the arrays."""
    alive = alive & (low < high)
    return alive, np.where(alive, low, 0), np.where(alive, high, 1)


def block_words(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, bounds = block.words()
    return starts, ends, bounds, block.hashes(starts, ends)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def short_digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def per_row(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, in order of row."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], row[new]


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and text_key, which tells rows of one doc_id apart."""
    return narrow(documents).withColumn("text_key", F.xxhash64("text"))


def outline(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, n_words, digest of all words and distinct anchors of each row of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                rows = batch.slice(block.first, block.rows)
                starts, ends, bounds, words = block_words(block)
                start, anchor = anchors(words, bounds, window)
                values, row = per_row(anchor, rows_of(bounds)[start])
                lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(block.rows + 1)).astype(np.int32), pa.array(values.view(np.int64)))
                full = pa.array([digest(x) for x in spans_text(block.spaced(starts, ends), bounds[:-1], bounds[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), pa.array(np.diff(bounds)), full, lists], names=["doc_id", "text_key", "n_words", "full_sha256", "anchors"])

    return texts.mapInArrow(run, "doc_id long, text_key long, n_words long, full_sha256 string, anchors array<long>")


def listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), rows_of(np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]))


def within(values: np.ndarray, row: np.ndarray, allowed: np.ndarray, allowed_row: np.ndarray) -> np.ndarray:
    """Which values are among those allowed for their row."""
    salt = mix(np.arange(max(row.max(initial=0), allowed_row.max(initial=0)) + 1, dtype=U64) + U64(9))
    return np.isin(mix(values ^ salt[row]), mix(allowed.view(U64) ^ salt[allowed_row]))


SPANS = "doc_id long, text_key long, first int, count int, span binary"
HALVES = ", left_count int, left_half binary, right_first int, right_count int, right_half binary"


def spans_table(rows: pa.RecordBatch, row: np.ndarray, first: np.ndarray, count: np.ndarray, texts: Iterator[bytes]) -> dict[str, pa.Array]:
    owner = pa.array(row)
    return {"doc_id": rows.column("doc_id").take(owner), "text_key": rows.column("text_key").take(owner), "first": pa.array(first.astype(np.int32)), "count": pa.array(count.astype(np.int32)), "span": pa.array([short_digest(x) for x in texts], pa.binary())}


def shared_spans(texts: DataFrame, window: int) -> DataFrame:
    """Spans at the anchors listed with each row: count windows from the one at word first of the document, and a digest of their words.

    A window reaches half of its other words or more to the left of its anchor, or to the right. Of each span the digest of the anchor with so many words on either side
    goes along, and the windows that hold it: windows that two documents share have one of these halves in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                rows = batch.slice(block.first, block.rows)
                starts, ends, bounds, words = block_words(block)
                start, anchor, begin, behind = anchors(words, bounds, window, where=True)
                row = rows_of(bounds)[start]
                there = within(anchor, row, *listed(rows.column("anchors")))
                start, anchor, row, begin, behind = start[there], anchor[there], row[there], begin[there], behind[there]
                new = np.ones(len(start), bool)
                new[1:] = (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (begin[1:] != begin[:-1])
                head = np.flatnonzero(new)
                count = np.diff(np.append(head, len(start)))
                first, row, begin, behind = start[head], row[head], begin[head], behind[head]
                spaced = block.spaced(starts, ends)
                columns = spans_table(rows, row, first - bounds[row], count, spans_text(spaced, first, first + count + window - 1))
                reach = (window - (behind - begin)) // 2
                left = np.clip(begin - reach - first + 1, 0, count)
                right_first = np.clip(behind + reach - window, first, first + count)
                right = first + count - right_first
                for name, some, a, z in (("left", left, begin - reach, behind), ("right", right, begin, behind + reach)):
                    at = np.flatnonzero(some > 0)
                    half = np.full(len(first), None, object)
                    half[at] = [short_digest(x) for x in spans_text(spaced, a[at], z[at])]
                    columns |= {f"{name}_count": pa.array(some.astype(np.int32)), f"{name}_half": pa.array(half, pa.binary())}
                columns["right_first"] = pa.array((right_first - bounds[row]).astype(np.int32))
                yield pa.RecordBatch.from_pydict({n: columns[n] for n in ("doc_id", "text_key", "first", "count", "span", "left_count", "left_half", "right_first", "right_count", "right_half")})

    return texts.select("doc_id", "text", "text_key", "anchors").mapInArrow(run, SPANS + HALVES)


def with_shared_halves(spans: DataFrame) -> DataFrame:
    """The runs of windows of spans at those halves that several documents have."""
    left = spans.where("left_count > 0").select("doc_id", "text_key", "first", F.col("left_count").alias("count"), F.col("left_half").alias("half"))
    right = spans.where("right_count > 0").select("doc_id", "text_key", F.col("right_first").alias("first"), F.col("right_count").alias("count"), F.col("right_half").alias("half"))
    both = left.unionByName(right)
    shared = checkpointed(both.groupBy("half").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("half"))
    return both.join(shared, "half").drop("half")


def stretches(rows: pa.RecordBatch, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window (a word of the block) and number of windows of all that is listed with the rows."""
    first, row = listed(rows.column("firsts"))
    count, _ = listed(rows.column("counts"))
    return row, bounds[row] + first, count.astype(np.int64)


def windows_of(texts: DataFrame, window: int) -> DataFrame:
    """Each window of the spans listed with a row, as a span of one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                rows = batch.slice(block.first, block.rows)
                starts, ends, bounds = block.words()
                _, first, count = stretches(rows, bounds)
                each = np.unique(np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum()))
                row = np.searchsorted(bounds, each, side="right") - 1
                yield pa.RecordBatch.from_pydict(spans_table(rows, row, each - bounds[row], np.ones(len(each), np.int64), spans_text(block.spaced(starts, ends), each, each + window)))

    return texts.select("doc_id", "text", "text_key", "firsts", "counts").mapInArrow(run, SPANS)


def without_windows(texts: DataFrame, window: int) -> DataFrame:
    """Rows with lists of windows: what is left after their words are removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                rows = batch.slice(block.first, block.rows)
                starts, ends, bounds = block.words()
                _, first, count = stretches(rows, bounds)
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + count + window - 1, -1)
                gone = np.cumsum(cover)[:-1] > 0
                whole, left = block.data.tobytes(), []
                for r in range(block.rows):
                    stay = bounds[r] + np.flatnonzero(~gone[bounds[r] : bounds[r + 1]])
                    left.append(b" ".join([whole[a:z] for a, z in zip(starts[stay].tolist(), ends[stay].tolist())]))
                columns = [rows.column("doc_id"), rows.column("text_key"), pa.array(np.diff(bounds)), pa.array(row_sums(gone, bounds)), pa.array([digest(x) for x in left], pa.string()), pa.array([x.decode() for x in left], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return texts.select("doc_id", "text", "text_key", "firsts", "counts").mapInArrow(run, "doc_id long, text_key long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def at_smallest(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of spans those that a smaller doc_id has too, and the rest."""
    low = checkpointed(spans.groupBy("span").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("span", "low"))
    met = spans.join(low, "span", "left").drop("span")
    return met.where("doc_id > low").drop("low"), met.where("low is null or doc_id = low").drop("low")


def per_document(spans: DataFrame) -> DataFrame:
    """The lists of spans of each row; a document's own at most."""
    both = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("first", "count"))).alias("x"))
    return both.select("doc_id", "text_key", F.col("x.first").alias("firsts"), F.col("x.count").alias("counts"))


EMPTY = digest(b"")


def repeated_passages(documents: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    with_text: also text_key, a hash of the whole text, and kept_text, null where nothing is removed.
    """
    from daqframe.llm.neardup import with_nodes

    row = ["doc_id", "text_key"]
    texts = keyed(documents)
    made = written(outline(texts, window))
    able = made.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    copies = checkpointed(able.groupBy("full_sha256").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"))
    whole = checkpointed(able.select(*row, "full_sha256").join(copies, "full_sha256").where("doc_id > low").select(row).distinct())
    single = able.select(*row, "anchors").join(whole, row, "left_anti")
    places = single.select(*row, F.explode("anchors").alias("anchor"))
    shared = checkpointed(places.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"))
    wanted = written(places.join(shared, "anchor").groupBy(row).agg(F.collect_set("anchor").alias("anchors")))
    some = written(with_nodes(texts, wanted.select(F.col("doc_id").alias("node"))))
    spans = written(shared_spans(some.join(wanted, row), window))
    lost, smallest = at_smallest(spans)
    lost, smallest = written(lost.select(*row, "first", "count")), written(per_document(with_shared_halves(written(smallest))))
    windows = written(windows_of(some.join(smallest, row), window))
    more, _ = at_smallest(windows)
    hits = written(per_document(lost.unionByName(more.select(*row, "first", "count"))))
    cut = without_windows(some.join(hits, row), window)
    rest = made.drop("anchors").join(hits.select(row), row, "left_anti").join(whole.withColumn("copy", F.lit(True)), row, "left")
    copy = F.coalesce("copy", F.lit(False))
    rest = rest.select(*row, "n_words", F.when(copy, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(copy, EMPTY).otherwise(F.col("full_sha256")).alias("kept_sha256"), F.when(copy, "").alias("kept_text"))
    every = rest.unionByName(cut)
    return every if with_text else every.drop("text_key", "kept_text")


def without_repeats(documents: DataFrame) -> DataFrame:
    """documents with repeated passages taken out of text; texts that lose nothing stay as they are, spaces included.

    Only rows that change are joined with their new text. A row whose every word is repeated stays, with an empty text.
    """
    changed = written(repeated_passages(documents, with_text=True).where("n_removed > 0").select("doc_id", "text_key", "kept_text").distinct())
    ids = checkpointed(changed.select("doc_id").distinct())
    ids = F.broadcast(ids) if ids.count() <= 1 << 20 else ids
    same = documents.join(ids, "doc_id", "left_anti")
    touched = documents.join(ids, "doc_id", "left_semi").alias("d")
    fits = (F.col("d.doc_id") == F.col("c.doc_id")) & (F.xxhash64("d.text") == F.col("c.text_key"))
    new = touched.join(changed.alias("c"), fits, "left")
    columns = [F.coalesce("c.kept_text", "d.text").alias("text") if c == "text" else F.col(f"d.{c}").alias(c) for c in documents.columns]
    return same.unionByName(new.select(*columns))
