"""Supervised subword embeddings for document quality.

A document is the average of learned vectors: of its words, its word pairs and its character n-grams (three and
four code points), each hashed to a bucket of its family. A softmax layer reads that average. Vectors and layer are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. Averaging and the layer are
linear, so for scoring each bucket is reduced to the one number it adds to the logit, in fixed point: a
document's sum then doesn't depend on how rows are batched.

Labels are read for training only, from rows whose crc32(doc_id as text) mod 5 is not 0.

Defined results: a null or empty text has no features and gets the score of the bias alone; repeated rows each get
a row; a doc_id with several labels counts as the smallest, one with several texts is learned from one of them; a score at the threshold is label 1; very long texts are
scored whole; a null doc_id is never held out; an empty table gives an empty result; without labelled rows of both kinds
every score is 0.5. Columns other than doc_id and text are not read as features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daqframe.llm.sampling import marks_of, narrow, remainder, sampled
from daqframe.llm.textblock import TextBlock, blocks, characters, gram_hashes, mix

BITS = 16
BUCKETS = 1 << BITS
GRAMS = (3, 4)
FAMILIES = 2 + len(GRAMS)
SCALE = float(1 << 24)
THRESHOLD = 0.3


def families(block: TextBlock) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family the bucket of each position, and each row's first position and the one after its last."""
    starts, ends, bounds = block.words()
    words = block.hashes(starts, ends)
    yield (words >> np.uint64(64 - BITS)).astype(np.int64), bounds[:-1], bounds[1:]
    pairs = mix(words[:-1] + words[1:] * np.uint64(3)) if len(words) else words
    yield (pairs >> np.uint64(64 - BITS)).astype(np.int64) + BUCKETS, bounds[:-1], np.maximum(bounds[1:] - 1, bounds[:-1])
    points, bounds = characters(block)
    for n, gram in enumerate(gram_hashes(points, max(GRAMS)), 1):
        if n in GRAMS:
            first = np.minimum(bounds[:-1], len(gram))
            yield (gram >> np.uint32(32 - BITS)).astype(np.int64) + (2 + GRAMS.index(n)) * BUCKETS, first, np.maximum(np.minimum(bounds[1:] - n + 1, len(gram)), first)


class Bags:
    """For each row its distinct buckets and their counts: 8 bytes a bucket, in one pair of arrays for each block of texts."""

    def __init__(self, column: pa.Array):
        self.rows: list[tuple[int, int, int, int]] = []  # block, first, one after the last, number of features
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        for block in blocks(column, limit=1 << 18):
            parts, ids, counts, first = list(families(block)), [], [], 0
            for row in range(block.rows):
                every = np.concatenate([bucket[a[row] : b[row]] for bucket, a, b in parts])
                found, count = np.unique(every.astype(np.uint32), return_counts=True)
                ids.append(found)
                counts.append(count.astype(np.uint32))
                self.rows.append((len(self.ids), first, first + len(found), max(len(every), 1)))
                first += len(found)
            self.ids.append(np.concatenate(ids))
            self.counts.append(np.concatenate(counts))

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets, and the share that each has of the row's features."""
        block, first, end, total = self.rows[row]
        return self.ids[block][first:end], self.counts[block][first:end].astype(np.float32) / np.float32(total)


@dataclass
class Model:
    """weight: what one feature of a bucket adds to the logit of label 1, times SCALE."""

    weight: np.ndarray
    bias: float

    @classmethod
    def constant(cls) -> Model:
        return cls(np.zeros(FAMILIES * BUCKETS, np.int32), 0.0)

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for block in blocks(column):
            total, count = np.zeros(block.rows, np.int64), np.zeros(block.rows, np.int64)
            for bucket, first, after in families(block):
                sums = np.zeros(len(bucket) + 1, np.int64)
                np.cumsum(self.weight[bucket], out=sums[1:])
                total += sums[after] - sums[first]
                count += after - first
            logit = total / SCALE / np.maximum(count, 1) + self.bias
            out[block.first : block.first + block.rows] = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        return out


def train(column: pa.Array, label: np.ndarray, dim: int = 16, epochs: int = 4, rate: float = 0.4, gain: float = 100.0, seed: int = 3) -> Model:
    """Stochastic gradient descent, one document a step, rates falling to zero.

    gain makes up for averaging: a bucket gets only its share of a document's gradient, so vectors take longer steps than the layer.
    """
    if len(set(label.tolist())) < 2:
        return Model.constant()
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (FAMILIES * BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    bag = Bags(column)
    steps, done = epochs * len(bag), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bag)):
            step = rate * (1 - done / steps)
            done += 1
            ids, share = bag[i]
            found = vectors[ids]
            hidden = share @ found
            logits = layer @ hidden + bias
            slope = np.exp(logits - logits.max())
            slope /= slope.sum()
            slope[int(label[i])] -= 1
            back = layer.T @ slope
            layer -= step * np.outer(slope, hidden)
            bias -= step * 0.1 * slope
            vectors[ids] = found - (step * gain) * share[:, None] * back
    add = (vectors @ (layer[1] - layer[0])).astype(np.float64)
    return Model(np.clip(np.round(add * SCALE), -(2**31) + 1, 2**31 - 1).astype(np.int32), float(bias[1] - bias[0]))


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = 4096, longest: int = 1 << 18, sample_bytes: int = 1 << 26, **options) -> Model:
    """A model from at most sample_rows labelled documents with at most sample_bytes of text, none of them held out; this bounds what the driver gets.

    Texts over longest bytes are learned only where a label has no shorter ones.
    """
    marks = marks_of(labels, "quality", where=remainder(F.col("doc_id"), 5) != 0)
    drawn = sampled(narrow(documents), sample_rows, longest, sample_bytes, marks).toArrow().sort_by([("doc_id", "ascending")])
    return train(drawn.column("text").combine_chunks() if len(drawn) else pa.array([], pa.string()), drawn.column("label").to_numpy(), **options)


def score_rows(documents: DataFrame, model: Model, keep_from: float | None = None) -> DataFrame:
    """documents with a column score in place of any it has; with keep_from instead only rows that score as much, all columns as they were."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # FAMILIES * BUCKETS numbers: 1 MB at any corpus size
    if keep_from is None:
        documents = documents.drop("score")
    names = documents.columns
    out = documents.schema if keep_from is not None else T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column("text"))
            if keep_from is not None:
                yield batch.filter(pa.array(score >= keep_from))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*names, "score"])

    return documents.mapInArrow(run, out)


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score alone: texts don't come back from Python."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")))], names=["doc_id", "score"])

    return narrow(documents).mapInArrow(run, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = scores(documents, fit(documents, labels))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
