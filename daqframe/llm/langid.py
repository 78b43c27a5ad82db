"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

One to three characters, letters of one case, are hashed to buckets of their order. A feature's value is its share
of the document's n-grams of that order times its inverse document frequency. Weights are trained by
follow-the-regularised-leader with both an absolute and a squared penalty, so most are exactly zero, on a bounded sample of rows with a language;
a part of the sample that training doesn't see then sets the temperature by which scores are calibrated.
Scoring adds fixed-point weights, so it doesn't depend on how rows are batched.

Training reads text and lang of documents whose crc32(doc_id as text) mod 4 is not 2, and nothing else. Document frequencies are counted over all of them.

Defined results: null texts and texts without a letter are ``und`` with score 0; repeated rows each get a row; a null
doc_id is not held out and not learned from; rows of one doc_id are each learned as their own lang, rows without one not at all; of languages with equal scores
the first by name is predicted; very long texts are read whole, for learning only where a language has no others; an empty table gives an empty result; where no row can be learned from
all are ``und``. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daqframe.llm.sampling import narrow, remainder, sampled
from daqframe.llm.textblock import TextBlock, blocks, characters, gram_hashes

BITS = 15
BUCKETS = 1 << BITS
ORDERS = 3
SCALE = float(1 << 20)
GAIN = 8.0
UNDETERMINED = "und"

_tables: list[np.ndarray] = []


def character_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case where that is one character, and whether it is a letter."""
    if not _tables:
        points = [chr(i) for i in range(0x110000)]
        lower = np.arange(0x110000, dtype=np.uint32)
        low = [(i, ord(c.lower())) for i, c in enumerate(points) if len(c.lower()) == 1]
        lower[[i for i, _ in low]] = [x for _, x in low]
        _tables.extend([lower, np.fromiter((c.isalpha() for c in points), dtype=bool, count=len(points))])
    return _tables[0], _tables[1]


def orders(block: TextBlock) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the buckets, and each row's first one and the one after its last; and which rows have a letter."""
    lower, letter = character_tables()
    points, bounds = characters(block)
    seen = np.zeros(len(points) + 1, np.int64)
    np.cumsum(letter[points], out=seen[1:])
    points = lower[points]
    out = []
    for n, gram in enumerate(gram_hashes(points, ORDERS), 1):
        first = np.minimum(bounds[:-1], len(gram))
        out.append(((gram >> np.uint32(32 - BITS)).astype(np.int64) + (n - 1) * BUCKETS, first, np.maximum(np.minimum(bounds[1:] - n + 1, len(gram)), first)))
    return out, seen[bounds[1:]] > seen[bounds[:-1]]


def shares(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row its buckets and term frequencies."""
    for block in blocks(column):
        parts, _ = orders(block)
        for row in range(block.rows):
            got = [np.unique(bucket[a[row] : b[row]], return_counts=True) for bucket, a, b in parts]
            yield np.concatenate([g[0] for g in got]), np.concatenate([g[1] / max(g[1].sum(), 1) for g in got])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """weight[bucket, language] holds weight times inverse document frequency times SCALE."""

    languages: list[str]
    weight: np.ndarray
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, score = [], np.zeros(len(column))
        for block in blocks(column):
            parts, has_letter = orders(block)
            logits = np.tile(self.bias, (block.rows, 1))
            for bucket, first, after in parts:
                for k in range(len(self.languages)):
                    sums = np.zeros(len(bucket) + 1, np.int64)
                    np.cumsum(self.weight[k][bucket], out=sums[1:])
                    logits[:, k] += (sums[after] - sums[first]) / SCALE / np.maximum(after - first, 1)
            known = has_letter & bool(self.languages)
            if self.languages:
                p = softmax(logits / self.temperature)
                best = p.argmax(axis=1)
                names += [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
                score[block.first : block.first + block.rows] = np.where(known, p.max(axis=1), 0.0)
            else:
                names += [UNDETERMINED] * block.rows
        return names, score


def train(column: pa.Array, label: list[str], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, absolute: float = 0.02, squared: float = 0.05, seed: int = 7, seen: np.ndarray | None = None, total: int = 0) -> Model:
    """Follow-the-regularised-leader over single documents; every fifth document of a random order is for the temperature.

    seen: in how many of total documents each bucket occurs; without it those of the column are counted.
    """
    languages = sorted(set(label))
    if not languages:
        return Model([], np.zeros((0, ORDERS * BUCKETS), np.int32))
    rng = np.random.default_rng(seed)
    bag = list(shares(column))
    y = np.array([languages.index(x) for x in label])
    order = rng.permutation(len(bag))
    held, learn = (order[::5], np.setdiff1d(order, order[::5])) if len(bag) >= 50 else (order, order)
    if seen is None:
        seen, total = np.bincount(np.concatenate([ids for ids, _ in bag]), minlength=ORDERS * BUCKETS), len(bag)
    idf = np.log((1 + total) / (1 + seen)) + 1
    z, n = np.zeros((ORDERS * BUCKETS, len(languages))), np.zeros((ORDERS * BUCKETS, len(languages)))
    bias = np.zeros(len(languages))

    def weights(ids: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[ids]) <= absolute, 0.0, -(z[ids] - np.sign(z[ids]) * absolute) / ((beta + np.sqrt(n[ids])) / alpha + squared))

    for _ in range(epochs):
        for i in rng.permutation(learn):
            ids, tf = bag[i]
            x = GAIN * tf * idf[ids]
            w = weights(ids)
            slope = softmax(x @ w + bias)
            slope[y[i]] -= 1
            bias -= 0.01 * slope
            g = x[:, None] * slope[None, :]
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    final = weights(np.arange(ORDERS * BUCKETS)) * idf[:, None] * GAIN
    logits = np.array([tf @ final[ids] + bias for ids, tf in (bag[i] for i in held)])
    temperatures = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in temperatures]
    return Model(languages, np.round(final.T * SCALE).astype(np.int32), bias, float(temperatures[int(np.argmin(loss))]))


def document_frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and the number of documents. A task adds up its own, at a fixed width, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(ORDERS * BUCKETS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for block in blocks(batch.column("text")):
                for bucket, first, after in orders(block)[0]:
                    for a, z in zip(first.tolist(), after.tolist()):
                        seen[np.unique(bucket[a:z])] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], names=["bucket", "n"])

    counted = documents.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket
    bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    seen = np.zeros(ORDERS * BUCKETS + 1, np.int64)
    seen[bucket] = n
    return seen[:-1], int(seen[-1])


def fit(documents: DataFrame, sample_rows: int = 3000, longest: int = 1 << 17, sample_bytes: int = 1 << 26, most_languages: int = 256, **options) -> Model:
    """A model of the languages that rows have, of the most frequent ones if over most_languages.

    Document frequencies cover all rows that may be learned from; weights are trained on at most sample_rows of them with at most sample_bytes of text, which is
    all that the driver gets; texts over longest bytes only where a language has no shorter ones. A row is learned as its own lang says,
    whatever other rows of its doc_id have.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    known = [r[0] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_languages).collect()]
    if not known:
        return train(pa.array([], pa.string()), [])
    rows = rows.where(F.col("label").isin(known))
    drawn = sampled(rows, sample_rows, longest, sample_bytes).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    seen, total = document_frequencies(rows)
    return train(drawn.column("text").combine_chunks(), drawn.column("label").to_pylist(), seen=seen, total=total, **options)


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = model or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # ORDERS * BUCKETS numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    found = narrow(documents).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
