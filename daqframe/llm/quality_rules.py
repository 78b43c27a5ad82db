"""Rule statistics of documents and an isolation forest over them.

``rule_statistics`` gives the countable facts about each whole text. ``fit`` grows random trees on these statistics
of all rows labelled good, so that a large kind of junk doesn't pass as normal, with
splits over the range of all labelled rows: a document that few random splits isolate has short paths, hence a high anomaly
score. A tree isolates a subsample, as an isolation forest's trees do, but none is drawn: splits don't depend on rows, so all rows are
counted in each node, and from these counts follows a path's mean length over all subsamples.
The threshold comes from all labelled rows: the lowest one that still keeps ``keep_share`` of the rows
labelled good, moved up to the point between good and bad rows that errs least. For this a row is scored by the half of the trees that didn't grow on it.

Defined results: a null or empty text has no words and fails the base rules; repeated rows each get a row; an
empty table gives an empty result; without labelled rows of both kinds only the base rules decide; a doc_id with several labels counts as the smallest, one
with several texts counts with each; a score equal to the threshold keeps a document; very long texts are counted whole. Only
doc_id and text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daqframe.llm.sampling import marks_of, narrow
from daqframe.llm.session import checkpointed, partitions
from daqframe.llm.textblock import SEPARATOR, TextBlock, blocks, identified, mix, row_sums, rows_of, window_hashes

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words", "n_bytes"]
SCHEMA = "doc_id long, " + ", ".join(f"{x} long" for x in STATISTICS)

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
MARK = np.zeros(256, dtype=bool)
MARK[list(b"!\"'(),-./:;?@[]\\^_`{}~+=")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
WINDOW = 8
# thresholds are multiples of 1 / GRID, so counts by multiples tell all that rows say about them
GRID = 1 << 18
# nodes are left out below one that two rows of a subsample meet less often than this
NO_CHANCE = 1e-6


def repeated(number: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number: does an equal one stand elsewhere, and does an equal one stand earlier? order is a stable one."""
    same = number[order[1:]] == number[order[:-1]]
    again = np.zeros(len(number), dtype=bool)
    earlier = np.zeros(len(number), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    earlier[order[1:][same]] = True
    return again, earlier


def block_statistics(block: TextBlock) -> dict[str, np.ndarray]:
    data, rows = block.data, block.rows
    starts, ends, bounds = block.words()
    words = block.hashes(starts, ends)
    row = rows_of(bounds)
    salt = mix(row.astype(np.uint64) + np.uint64(1))
    inside = ~SEPARATOR[data]
    out = {"n_words": np.diff(bounds), "n_bytes": np.diff(block.offsets)}
    out["word_chars"] = row_sums(inside & ((data & 0xC0) != 0x80), block.offsets)
    for name, table in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_digits", DIGIT), ("n_marks", MARK)):
        out[name] = row_sums(table[data], block.offsets)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([block.offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts <= len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    closed = (line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 10) if len(data) else np.zeros(len(line_starts), bool)
    line_ends = line_ends - closed
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    full = total[line_ends] > total[line_starts]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_row = np.searchsorted(block.offsets, line_starts, side="right") - 1
    line_keys = block.hashes(line_starts, line_ends) ^ mix(line_row.astype(np.uint64) + np.uint64(1))
    _, earlier = repeated(*identified(line_keys, lambda i, j: (line_row[i] == line_row[j]) & block.same(line_starts, line_ends, i, j)))
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    out["n_dup_lines"] = np.bincount(line_row[earlier], minlength=rows)

    number, order = identified(words ^ salt, lambda i, j: (row[i] == row[j]) & block.same(starts, ends, i, j))
    _, earlier = repeated(number, order)
    out["n_distinct_words"] = np.bincount(row[~earlier], minlength=rows)
    repeats = np.zeros(rows, np.int64)
    windows = window_hashes(words, WINDOW)
    if len(windows):
        whole = row[: len(windows)] == row[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        again, _ = repeated(*identified(windows[at] ^ salt[at], lambda i, j: np.logical_and.reduce([number[at[i] + k] == number[at[j] + k] for k in range(WINDOW)])))
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, at[again], 1)
        np.add.at(cover, at[again] + WINDOW, -1)
        repeats = row_sums(np.cumsum(cover)[:-1] > 0, bounds)
    out["n_repeat_words"] = repeats
    return out


def statistics_of(column: pa.Array) -> dict[str, np.ndarray]:
    parts = [block_statistics(block) for block in blocks(column)]
    return {k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in STATISTICS}


def rule_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = statistics_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[k]) for k in STATISTICS)], names=["doc_id", *STATISTICS])

    return narrow(documents).mapInArrow(run, SCHEMA)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Sizes as logarithms and counts as shares, one row for each document."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    lines, size = np.maximum(s["n_lines"], 1), np.maximum(s["n_bytes"], 1)
    columns = [
        s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        s["n_upper"] / size, s["n_digits"] / size, s["n_marks"] / size, s["n_distinct_words"] / words * np.log1p(words),
        np.minimum(np.log1p(words), np.log1p(40)),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random binary tree of n keys."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


@dataclass
class Forest:
    """Trees as arrays of [tree, node]; a leaf is its own child. score above threshold: anomalous."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    length: np.ndarray
    depth: int
    sample: int
    threshold: float = math.inf

    def score(self, x: np.ndarray, step: int = 2048) -> np.ndarray:
        """2 to the power of minus the mean path length, as a share of the average one: the higher, the more anomalous."""
        tree = np.arange(len(self.feature))[None, :]
        out = np.zeros(len(x))
        for at in range(0, len(x), step):
            rows = x[at : at + step]
            node = np.zeros((len(rows), len(self.feature)), np.int64)
            for _ in range(self.depth):
                to = self.child[tree, node]
                right = np.take_along_axis(rows, self.feature[tree, node], axis=1) >= self.split[tree, node]
                node = np.where(to == node, node, to + right)
            out[at : at + step] = self.length[tree, node].mean(axis=1)
        return np.exp2(-out / max(float(average_path(self.sample)), 1e-9))

    def part(self, first: int, last: int) -> Forest:
        """The trees from first to last."""
        return Forest(self.feature[first:last], self.split[first:last], self.child[first:last], self.length[first:last], self.depth, self.sample)

    def calibrate(self, step: np.ndarray, good: np.ndarray, bad: np.ndarray, keep_share: float) -> None:
        """Of all thresholds that keep keep_share of the good rows, the one with the fewest errors, each kind by its share.

        good and bad rows are counted by the least multiple of 1 / GRID that keeps them; step rises.
        """
        if not good.sum() or not bad.sum():
            return
        passed = np.cumsum(good)
        able = passed > math.ceil((int(passed[-1]) - 1) * keep_share)
        errors = np.where(able, 1 - passed / good.sum() + np.cumsum(bad) / bad.sum(), math.inf)
        self.threshold = float(step[np.argmin(errors)] / GRID)


@dataclass
class Cuts:
    """Random trees down to their depth, as arrays of [tree, node]; node n has the children 2n + 1 and 2n + 2."""

    feature: np.ndarray
    split: np.ndarray
    depth: int

    @classmethod
    def draw(cls, low: np.ndarray, high: np.ndarray, trees: int, depth: int, seed: int) -> Cuts:
        """Splits are uniform over a node's part of the box low..high, which may reach beyond the rows that trees grow on:
        a place where these have no rows is then cut off after a few splits."""
        rng = np.random.default_rng(seed)
        varied = np.flatnonzero(high > low)
        depth = depth if len(varied) else 0
        feature, split = np.zeros((trees, 2**depth - 1), np.int16), np.zeros((trees, 2**depth - 1))
        for t in range(trees):
            below, above = low[None, :], high[None, :]
            for level in range(depth):
                nodes, here = slice(2**level - 1, 2 ** (level + 1) - 1), np.arange(2**level)
                f = rng.choice(varied, 2**level)
                at = rng.uniform(below[here, f], above[here, f])
                feature[t, nodes], split[t, nodes] = f, at
                below, above = np.repeat(below, 2, axis=0), np.repeat(above, 2, axis=0)
                above[2 * here, f] = below[2 * here + 1, f] = at
        return cls(feature, split, depth)

    def ends(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        """How many rows of x end at each node of the last level, [tree, place], for the trees from first to last."""
        out = np.zeros((last - first) << self.depth, np.int64)
        tree = np.arange(first, last)[None, :]
        for a in range(0, len(x), 2048):
            rows = x[a : a + 2048]
            node = np.zeros((len(rows), last - first), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.take_along_axis(rows, self.feature[tree, node], axis=1) >= self.split[tree, node])
            place = node - (2**self.depth - 1) + ((tree - first) << self.depth)
            out += np.bincount(place.ravel(), minlength=len(out))
        return out.reshape(last - first, 1 << self.depth)

    def forest(self, ends: np.ndarray, sample: int) -> Forest:
        """The trees with the mean of their path lengths over all subsamples, drawn with replacement, of the rows counted.

        A path goes on below a node where two rows of the subsample lie in it, so its mean length is the sum of the chances of that.
        """
        trees, bottom = len(ends), 2**self.depth - 1
        rows = np.zeros((trees, 2 * bottom + 1), np.int64)
        rows[:, bottom:] = ends
        for level in reversed(range(self.depth)):
            a, z = 2**level - 1, 2 ** (level + 1) - 1
            rows[:, a:z] = rows[:, 2 * a + 1 : 2 * z + 1 : 2] + rows[:, 2 * a + 2 : 2 * z + 2 : 2]
        parts = []
        for t in range(trees):
            share = rows[t] / max(int(rows[t, 0]), 1)
            chance = 1 - (1 - share) ** sample - sample * share * (1 - share) ** (sample - 1)
            parted = chance > NO_CHANCE
            parted[bottom:] = False
            path = np.zeros(len(share))
            for k in range(self.depth):
                a, z = 2**k - 1, 2 ** (k + 1) - 1
                path[2 * a + 1 : 2 * z + 1] = np.repeat(path[a:z] + chance[a:z], 2)
            path[bottom:] += average_path(sample * share[bottom:])
            there = np.append(True, np.repeat(parted[:bottom], 2))
            number, nodes = np.cumsum(there) - 1, np.flatnonzero(there)
            inner = nodes[parted[nodes]]
            feature, split, child = np.zeros(len(nodes), np.int32), np.zeros(len(nodes)), np.arange(len(nodes), dtype=np.int32)
            feature[number[inner]], split[number[inner]], child[number[inner]] = self.feature[t, inner], self.split[t, inner], number[2 * inner + 1]
            parts.append((feature, split, child, path[nodes]))
        most = max(len(p[0]) for p in parts)
        joined = (np.stack([np.pad(p[k], (0, most - len(p[k]))) for p in parts]) for k in range(4))  # nobody gets to the nodes that are added
        return Forest(*joined, self.depth, sample)


FEATURES = [f"f{i}" for i in range(9)]


def labelled(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """Features, good and half (0 or 1, by a hash of doc_id) of all labelled rows that the base rules let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({k: batch.column(k).to_numpy() for k in STATISTICS})
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column("good"), batch.column("half")], names=[*FEATURES, "good", "half"])

    passed = statistics.where("not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)")
    marked = passed.join(marks_of(labels, "quality"), "doc_id").select(*STATISTICS, (F.col("label") == 1).alias("good"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))
    return marked.mapInArrow(run, ", ".join(f"{x} double" for x in FEATURES) + ", good boolean, half int")


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(f).to_numpy() for f in FEATURES], axis=1)


def totals(rows: DataFrame, key: str, *names: str) -> list[np.ndarray]:
    """key and the sums of the columns, by key."""
    found = rows.groupBy(key).agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    order = np.argsort(found.column(key).to_numpy())
    return [found.column(n).to_numpy()[order] for n in (key, *names)]


def fit(documents: DataFrame, labels: DataFrame, trees: int = 100, subsample: int = 3072, depth: int = 14, keep_share: float = 0.998, seed: int = 20) -> Forest | None:
    """A forest grown on, and calibrated by, all labelled documents."""
    return fit_statistics(rule_statistics(documents), labels, trees, subsample, depth, keep_share, seed)


def fit_statistics(statistics: DataFrame, labels: DataFrame, trees: int = 100, subsample: int = 3072, depth: int = 14, keep_share: float = 0.998, seed: int = 20) -> Forest | None:
    """A forest by the statistics of documents. Rows that fail the base rules take no part: the forest judges what those rules let through.

    Three passes over the features of labelled rows, each of which gives a table of bounded size: their range, counts by node and counts by score.
    """
    rows = checkpointed(labelled(statistics, labels).coalesce(partitions(statistics.sparkSession)))
    context = statistics.sparkSession.sparkContext
    found = rows.groupBy("good", "half").agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for name, f in (("low", F.min), ("high", F.max)) for c in FEATURES)).collect()  # four rows
    if sum(r["n"] for r in found) < 2:
        return None
    low, high = (np.array([f(r[f"{name}_{c}"] for r in found) for c in FEATURES]) for name, f in (("low", min), ("high", max)))
    only_good = sum(r["n"] for r in found if r["good"]) > 3
    size = [sum(r["n"] for r in found if r["half"] == h and (r["good"] or not only_good)) for h in (0, 1)]
    apart = min(size) > 1  # of a few rows a half may have none: all trees grow on all of them then
    first = max(trees // 2, 1)
    trees = 2 * first
    cuts = Cuts.draw(low, high, trees, depth, seed)
    shared_cuts = context.broadcast(cuts)  # of a size set by trees and depth

    def grown(good: np.ndarray) -> np.ndarray:
        return good if only_good else np.ones(len(good), bool)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_cuts.value
        total = np.zeros((trees, 1 << model.depth), np.int64)
        for batch in batches:
            x, half = matrix(batch), batch.column("half").to_numpy()
            on = grown(batch.column("good").to_numpy(zero_copy_only=False))
            for h, (a, z) in enumerate(((0, first), (first, trees))):
                total[a:z] += model.ends(x[on & (half == h)] if apart else x[on], a, z)
        flat = total.ravel()
        place = np.flatnonzero(flat)
        for a in range(0, len(place), 1 << 16):
            part = place[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(flat[part])], names=["place", "n"])

    ends = np.zeros((trees, 1 << cuts.depth), np.int64)
    place, n = totals(rows.mapInArrow(ended, "place long, n long"), "place", "n")  # at most a row for each node of the last level
    ends.ravel()[place] = n
    forest = cuts.forest(ends, min(subsample, *(size if apart else [sum(size)])))
    shared_forest = context.broadcast(forest)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_forest.value
        halves = [model.part(0, first), model.part(first, trees)]
        for batch in batches:
            x, half, good = matrix(batch), batch.column("half").to_numpy(), batch.column("good").to_numpy(zero_copy_only=False)
            score = np.zeros(len(x))
            on = grown(good) if apart else np.zeros(len(x), bool)
            score[~on] = model.score(x[~on])
            for h in (0, 1):  # rows that trees grew on are judged by those that grew on others
                score[on & (half == h)] = halves[1 - h].score(x[on & (half == h)])
            step, at = np.unique(np.ceil(score * GRID).astype(np.int64), return_inverse=True)
            counts = [np.bincount(at[kind], minlength=len(step)).astype(np.int64) for kind in (good, ~good)]
            yield pa.RecordBatch.from_arrays([pa.array(step), *map(pa.array, counts)], names=["step", "good", "bad"])

    forest.calibrate(*totals(rows.mapInArrow(scored, "step long, good long, bad long"), "step", "good", "bad"), keep_share)  # at most GRID + 1 rows
    return forest


def judge(documents: DataFrame, forest: Forest | None) -> DataFrame:
    """Every document's statistics, base_failed, anomaly score and kept."""
    return judge_statistics(rule_statistics(documents), forest)


def judge_statistics(statistics: DataFrame, forest: Forest | None) -> DataFrame:
    """Statistics with base_failed, anomaly score and kept."""
    shared = statistics.sparkSession.sparkContext.broadcast(forest)  # a few MB at any corpus size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            s = {k: batch.column(k).to_numpy() for k in STATISTICS}
            failed = base_failed(s)
            score = model.score(features(s)) if model is not None else np.zeros(len(failed))
            kept = ~failed & (score <= (model.threshold if model is not None else math.inf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(score), pa.array(kept)], names=["doc_id", *STATISTICS, "base_failed", "anomaly", "kept"])

    return statistics.mapInArrow(run, SCHEMA + ", base_failed boolean, anomaly double, kept boolean")


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every document."""
    statistics = checkpointed(rule_statistics(documents))  # numbers alone, read by the fit and by the verdict
    return judge_statistics(statistics, fit_statistics(statistics, labels)).select("doc_id", *STATISTICS[:5], "base_failed", "kept", "anomaly")
