"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash rotates a unit vector pseudo-randomly (three rounds of random signs and a fast Hadamard transform) and takes the
nearest of the signed axes. A row lies in one bucket of each table; a query looks into the buckets of its several nearest
axes. Rows met there are ranked exactly, by Euclidean distance of the original vectors in double precision.

A hash joins the axes of as many rotations as it takes to have BUCKET rows to a bucket on average, so a query's work doesn't grow with the table. How many buckets a
query probes is measured, not set: for a bounded sample of queries the true neighbours are found by brute force
over all rows, and the fewest probes are taken that meet RECALL of them. So tables of any size get the same recall, and it is known.

Of rows with the same vector only the k + 1 with the smallest ids can be among anyone's k nearest: the others are left out as candidates, so copies fill no bucket.
Buckets are dealt out in blocks of a bounded number of rows, and a bucket's queries in blocks too, and each block of queries meets each of rows: a bucket that a third of all
vectors fall into is searched by many tasks of bounded size, none of which gives back more than the nearest few per query. Queries that met fewer candidates than they could have are
searched against all rows, block by block.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do null ids; vectors of another
length than the query's are no candidates; rows repeated under one id are one candidate, at its smallest distance; ties go to the smaller id;
an empty table gives an empty result; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daqframe.llm.session import checkpointed, written
from daqframe.llm.textblock import mix

TABLES = 16
BLOCK = 1024
BUCKET = 2048
RECALL = 0.96
SAMPLE = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width, h = len(x), x.shape[1], 1
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
        x = x.reshape(n, width)
    return x / np.sqrt(width)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    rng = np.random.default_rng([table, x.shape[1]])
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    return y


def depth_of(rows: int, dim: int) -> int:
    """Rotations to a hash, so that buckets have BUCKET rows on average or fewer."""
    axes, depth = 2 << max(0, int(dim - 1).bit_length()), 1
    while rows > BUCKET * axes**depth and depth < 4:
        depth += 1
    return depth


def ranked_axes(x: np.ndarray, rotation: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest `most` signed axes of each row, nearest first (i for axis i, width + i for its opposite), and how far along them a row lies."""
    y = rotated(x, rotation)
    both = np.concatenate([-y, y], axis=1)
    order = np.argmin(both, axis=1)[:, None] if most == 1 else np.argsort(both, axis=1, kind="stable")[:, :most]
    return order, np.take_along_axis(both, order, axis=1)


def codes(x: np.ndarray, table: int, probes: int, depth: int) -> np.ndarray:
    """The buckets of each row in a table, best first: combinations of one axis for each rotation, by the sum of their projections."""
    width = 2 << max(0, int(x.shape[1] - 1).bit_length())
    code, cost = ranked_axes(x, table, min(probes, width))
    for level in range(1, depth):
        axis, more = ranked_axes(x, table + level * TABLES, min(probes, width))
        cost = (cost[:, :, None] + more[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * width + axis[:, None, :]).reshape(len(x), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        code, cost = np.take_along_axis(code, order, axis=1), np.take_along_axis(cost, order, axis=1)
    return code


def keys(x: np.ndarray, probes: int, depth: int) -> np.ndarray:
    """Bucket keys of each row, up to probes for each table. A key mixes vector length, table and bucket."""
    if not len(x):
        return np.zeros((0, TABLES), np.int64)
    found = [mix(codes(x, t, probes, depth).astype(np.uint64) + mix(np.array([(x.shape[1] << 8) + t], np.uint64))).view(np.int64) for t in range(TABLES)]
    return np.concatenate(found, axis=1)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their vectors in double precision, for each length that occurs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, values[start[rows][:, None] + np.arange(n)]


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty((len(queries), len(rows)))
    for i, q in enumerate(queries):
        out[i] = np.sqrt(((rows - q) ** 2).sum(axis=1))
    return out


def nearest(ids: np.ndarray, distance: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k nearest distinct ids but own, ties to smaller ids."""
    order = np.lexsort((ids, distance))
    order = order[ids[order] != own]
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


@dataclass
class Meeting:
    """Gathers the nearest few rows of each query over blocks of rows.

    Inner products sort out, with a margin beyond their rounding, which rows can be among the nearest; only these are measured exactly.
    """

    k: int

    def __call__(self, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[int], list[float]]:
        out: tuple[list[int], list[int], list[float]] = ([], [], [])
        if not len(ids):
            return out
        with np.errstate(over="ignore"):
            length = (rows * rows).sum(axis=1)
        last = min(len(ids) - 1, self.k + len(ids) - len(np.unique(ids)))  # own and repeated rows may stand before the nearest
        for at in range(0, len(query_ids), 64):
            part = queries[at : at + 64]
            with np.errstate(over="ignore", invalid="ignore"):
                own = (part * part).sum(axis=1)
                rough = own[:, None] + length - 2 * (part @ rows.T)
            limit = np.partition(rough, last, axis=1)[:, last] + 1e-9 * (own + length.max())
            for i, q in enumerate(part):
                some = np.flatnonzero(rough[i] <= limit[i]) if np.isfinite(rough[i]).all() else np.arange(len(ids))
                d = distances(q[None, :], rows[some])[0]
                best = nearest(ids[some], d, query_ids[at + i], self.k)
                out[0].extend([int(query_ids[at + i])] * len(best))
                out[1].extend(ids[some][best].tolist())
                out[2].extend(d[best].tolist())
        return out


FOUND = "query_id long, vec_id long, score double"


def found_batch(parts: list[tuple[list[int], list[int], list[float]]]) -> pa.Table:
    query, vec, score = ([x for p in parts for x in p[j]] for j in range(3))
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})


def brute_force(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The k nearest rows of a bounded block of queries, from one pass over all rows. A task gives back k rows a query."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)
    meet = Meeting(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array([q[1] for q in shared.value], pa.list_(pa.float64()))
        query_ids, best = np.array([q[0] for q in shared.value]), None
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            parts = [meet(query_ids[q], x, ids[r], y) for q, x in matrices(asked) for r, y in matrices(batch.column("embedding")) if x.shape[1] == y.shape[1]]
            table = pa.concat_tables([found_batch(parts)] + ([best] if best is not None else []))
            table = table.group_by(["query_id", "vec_id"]).aggregate([("score", "min")]).rename_columns(["query_id", "vec_id", "score"])
            q, v, s = (table.column(c).to_numpy() for c in ("query_id", "vec_id", "score"))
            order = np.lexsort((v, s, q))
            rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
            best = table.take(pa.array(order[rank < k]))
        if best is not None:
            yield from best.to_batches()

    return top(vectors.mapInArrow(run, FOUND), k)


def top(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    distinct = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def probes_for(vectors: DataFrame, queries: DataFrame, k: int, depth: int, most: int = 512) -> int:
    """The fewest probes by which SAMPLE queries meet RECALL of their true neighbours; no more than most."""
    sample = [(int(r[0]), [float(x) for x in r[1]]) for r in queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    if not sample:
        return 1
    truth = brute_force(vectors, sample, k)
    pairs = truth.join(vectors, "vec_id").select("query_id", "vec_id", "embedding").dropDuplicates(["query_id", "vec_id"]).collect()  # SAMPLE * k rows
    by_id = dict(sample)
    needed = []
    for dim in {len(v) for v in by_id.values()}:
        rows = [(by_id[int(r[0])], [float(x) for x in r["embedding"]]) for r in pairs if len(by_id[int(r[0])]) == dim == len(r["embedding"])]
        if rows:
            x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            places = []
            for t in range(TABLES):
                met = codes(x, t, most, depth) == codes(y, t, 1, depth)
                places.append(np.where(met.any(axis=1), met.argmax(axis=1), most - 1))
            needed.append(np.min(places, axis=0) + 1)
    return int(np.quantile(np.concatenate(needed), RECALL, method="higher")) if needed else 1


def hashed(vectors: DataFrame, probes: int, depth: int) -> DataFrame:
    """vectors with keys, their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column("embedding")):
                got = keys(x, probes, depth)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * got.shape[1], pa.array(got.ravel()))
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), lists], names=["vec_id", "embedding", "keys"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, vectors.select("vec_id", "embedding").schema.add("keys", T.ArrayType(T.LongType())))


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """Of rows with the same vector the k + 1 smallest ids, each once. Rows are made distinct and ranks cut before each shuffle, so any number of copies costs a few rows a task."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    return vectors.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).select("vec_id", "embedding")


def usable(table: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))


def dealt(rows: DataFrame, id: str, vector: str, block: str, blocks: DataFrame, other: str) -> DataFrame:
    """rows by bucket, each in one of its bucket's own blocks and in all of the other side's."""
    exploded = rows.select(id, vector, F.explode("keys").alias("key")).join(blocks, "key")
    mine = F.pmod(F.xxhash64(id, "key"), F.col(block)).cast("int").alias(f"{block}_at")
    return exploded.select(id, vector, "key", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at"))


def neighbours(table: DataFrame, every: int = 100, k: int = 10, fallback_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each row whose vec_id is divisible by every."""
    everyone = usable(table)
    asking = everyone.where(F.col("vec_id") % every == 0)
    vectors = written(candidates(everyone, k))
    size = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    depth = depth_of(int(size[0]), int(size[1] or 1))
    probes = probes_for(vectors, asking, k, depth)
    index = written(hashed(vectors, 1, depth))
    queries = checkpointed(hashed(asking, probes, depth).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "keys"))

    def blocks_of(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    blocks = checkpointed(blocks_of(index, "rows").join(blocks_of(queries, "queries"), "key"))  # a row for each bucket that is asked for
    blocks = F.broadcast(blocks) if blocks.count() <= 1 << 20 else blocks
    rows = dealt(index, "vec_id", "embedding", "rows", blocks, "queries")
    asked = dealt(queries, "query_id", "query", "queries", blocks, "rows")
    meet = Meeting(k)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, query_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        if not len(ids) or not len(query_ids):
            return found_batch([])
        return found_batch([meet(query_ids[q], x, ids[r], y) for q, x in matrices(right.column("query")) for r, y in matrices(left.column("embedding")) if x.shape[1] == y.shape[1]])

    group = ["key", "rows_at", "queries_at"]
    found = rows.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(run, FOUND)
    best = checkpointed(top(found, k))

    # who met too few: as many as could be met are k, or fewer where the rows of that length are fewer
    ids = everyone.select("vec_id", F.size("embedding").alias("dim")).groupBy("dim").agg(F.least(F.count_distinct("vec_id") - 1, F.lit(k)).alias("most"))
    met = best.groupBy("query_id").count()
    short = queries.select("query_id", "query", F.size("query").alias("dim")).join(ids, "dim").join(met, "query_id", "left")
    short = checkpointed(short.where(F.coalesce("count", F.lit(0)) < F.col("most")).select("query_id", "query"))
    parts = -(-short.count() // fallback_block)
    exact = []
    for part in range(parts):
        block = short.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()
        if block:
            exact.append(checkpointed(brute_force(vectors, [(int(r[0]), [float(x) for x in r[1]]) for r in block], k)))
    if exact:
        every_exact = exact[0]
        for e in exact[1:]:
            every_exact = every_exact.unionByName(e)
        every_exact = checkpointed(every_exact)
        best = best.join(every_exact.select("query_id").distinct(), "query_id", "left_anti").unionByName(every_exact)
    return best.select("query_id", "rank", "vec_id", "score")
