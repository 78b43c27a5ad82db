"""Near-duplicate documents by b-bit MinHash on word shingles.

1. One pass over the texts makes a sketch of each document: a cryptographic digest of its words, and of its set of shingles the size, a
   128-bit key, band keys over groups of minima and the low bits of the minima, packed.
2. Documents of the same words, by digest, and those with equal sets, brought together by key and confirmed on their words, form a class. From there
   on a class is one node with the smallest doc_id. A group of copies of any size costs one row.
3. Each bucket of a band links its classes to its smallest class only: as many candidates as members. The packed low bits
   give a similarity estimate, corrected for equal bits by chance, that drops candidates far below the threshold.
   The rest are confirmed on full sets, whose shingles are compared word by word.
4. Buckets that still hold several components may hide links between members that aren't the smallest. For
   exactly these classes an exact prefix filter follows: shingles rarest first, and two sets can only reach the threshold
   if they share a shingle at places early enough for both sizes. No group is expanded into all its pairs, none is cut.
5. Components of the confirmed links.

With 24 bands of 5 minima a pair at the threshold of 0.85 is in no common bucket with probability 8e-7, at 0.8 with
7e-5. The estimate's margin is over five standard deviations.

   Shingles of very many nodes are dealt out over tasks. The estimate spares the words of pairs that only share rare shingles; of families whose members all lie
   just below the threshold every pair is compared, over many tasks.

Defined results: texts without words (null, empty) have an empty set, are linked with nothing and are kept; repeated
rows of a doc_id count as one document, with all their texts; documents at the threshold are linked; very long texts are taken whole; rows without a doc_id are linked with nothing and kept, with a null
component; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daqframe.llm.components import components
from daqframe.llm.sampling import narrow
from daqframe.llm.session import checkpointed, written
from daqframe.llm.textblock import TextBlock, blocks, identified, mix, rows_of, spans_text, window_hashes

GROUP = 1024


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 5
    bits: int = 4
    margin: float = 0.25
    seed: int = 5

    @property
    def minima(self) -> int:
        return self.bands * self.rows


@dataclass
class ShingleSets:
    """Distinct shingles of all rows of a block, in order of row and key; row i has those from bounds[i] to bounds[i + 1]."""

    block: TextBlock
    keys: np.ndarray
    bounds: np.ndarray
    word: np.ndarray  # the first word of each
    count: np.ndarray  # its number of words
    starts: np.ndarray
    ends: np.ndarray

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether shingles i and j have the same words."""
        return (self.count[i] == self.count[j]) & self.block.same_words(self.starts, self.ends, self.word[i], self.word[j], np.minimum(self.count[i], self.count[j]))

    def distinct(self) -> ShingleSets:
        """One of each shingle that a row has several times; shingles count as equal if their words are."""
        owner = rows_of(self.bounds)
        order = np.lexsort((self.keys, owner))
        keys, owner, word, count = self.keys[order], owner[order], self.word[order], self.count[order]
        sorted_ = ShingleSets(self.block, keys, self.bounds, word, count, self.starts, self.ends)
        twin = np.flatnonzero((keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1]))
        again = np.zeros(len(keys), bool)
        alike = sorted_.same(twin, twin + 1)
        again[twin[alike] + 1] = True
        for at in twin[~alike]:  # one key for different shingles: look at all of the row that have it
            low, high = at, at + 1
            while low > 0 and keys[low - 1] == keys[at] and owner[low - 1] == owner[at]:
                low -= 1
            while high < len(keys) and keys[high] == keys[at] and owner[high] == owner[at]:
                high += 1
            those = np.arange(low, high)
            number, _ = identified(keys[those], lambda i, j, t=those: sorted_.same(t[i], t[j]))
            again[those] = True
            again[those[np.unique(number, return_index=True)[1]]] = False
        keep = np.flatnonzero(~again)
        return ShingleSets(self.block, keys[keep], np.searchsorted(owner[keep], np.arange(len(self.bounds))), word[keep], count[keep], self.starts, self.ends)


def shingle_sets(block: TextBlock, size: int) -> ShingleSets:
    """The distinct shingles of every row; a row with fewer words than a shingle has them all as one."""
    starts, ends, bounds = block.words()
    words = block.hashes(starts, ends)
    count = np.diff(bounds)
    hashes, row = window_hashes(words, size), rows_of(bounds)
    first = np.flatnonzero(row[: len(hashes)] == row[size - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    keys, owner, long = hashes[first], row[first], np.full(len(first), size)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        made = np.array([int(window_hashes(words[bounds[r] : bounds[r + 1]], int(count[r]))[0]) for r in short], np.uint64)
        keys, owner, first, long = np.concatenate([keys, made]), np.concatenate([owner, short]), np.concatenate([first, bounds[short]]), np.concatenate([long, count[short]])
        order = np.argsort(owner, kind="stable")
        keys, owner, first, long = keys[order], owner[order], first[order], long[order]
    return ShingleSets(block, keys, np.searchsorted(owner, np.arange(block.rows + 1)), first, long, starts, ends).distinct()


def sketch(keys: np.ndarray, bounds: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """Of the rows with a set: size, set key (two numbers), band keys and packed bits."""
    bounds = np.append(bounds[:-1][np.diff(bounds) > 0], bounds[-1])
    rows = len(bounds) - 1
    if not rows:
        return {"size": np.zeros(0, np.int64), "key1": np.zeros(0, np.int64), "key2": np.zeros(0, np.int64), "bands": np.zeros((0, s.bands), np.int64), "packed": np.zeros((0, s.minima * s.bits // 8), np.uint8)}
    out = {"size": np.diff(bounds)}
    for name, salt in (("key1", 11), ("key2", 23)):
        out[name] = mix(np.add.reduceat(mix(keys + np.uint64(salt)), bounds[:-1]) + out["size"].astype(np.uint64)).view(np.int64)
    rng = np.random.default_rng(s.seed)
    factors = rng.integers(0, 2**31, s.minima, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 2**32, s.minima, dtype=np.uint32)
    low, high = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint32)
    least = np.empty((s.minima, rows), np.uint32)
    step = 1 << 15  # values stay in cache while all minima are taken
    cuts = [0]
    while cuts[-1] < rows:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + step, side="right")) - 1))
    for a, z in zip(cuts, cuts[1:]):
        lo, hi, at = low[bounds[a] : bounds[z]], high[bounds[a] : bounds[z]], bounds[a:z] - bounds[a]
        work = np.empty_like(lo)
        for i in range(s.minima):
            np.multiply(lo if i % 2 else hi, factors[i], out=work)
            np.add(work, shifts[i], out=work)
            np.bitwise_xor(work, hi if i % 2 else lo, out=work)
            np.multiply(work, np.uint32(0x9E3779B1), out=work)
            least[i, a:z] = np.minimum.reduceat(work, at)
    bands = np.zeros((rows, s.bands), np.uint64)
    for band in range(s.bands):
        key = np.full(rows, band + 1, np.uint64)
        for i in range(band * s.rows, (band + 1) * s.rows):
            key = mix(key + least[i].astype(np.uint64))
        bands[:, band] = key
    out["bands"] = bands.view(np.int64)
    kept = ((mix(least.astype(np.uint64)) >> np.uint64(40)) & np.uint64((1 << s.bits) - 1)).astype(np.uint8)
    planes = [np.packbits((kept >> np.uint8(j)) & np.uint8(1), axis=0, bitorder="little").T for j in range(s.bits)]
    out["packed"] = np.ascontiguousarray(np.concatenate(planes, axis=1))
    return out


def sketches(documents: DataFrame, s: Settings) -> DataFrame:
    """doc_id, size of the set, digest of all words, key of the set, band keys and packed bits; the last four null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                sets = shingle_sets(block, s.shingle)
                keys, bounds = sets.keys, sets.bounds
                got = sketch(keys, bounds, s)
                words = np.searchsorted(sets.starts, block.offsets)
                texts = spans_text(block.spaced(sets.starts, sets.ends), words[:-1], words[1:])
                wording = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in texts], pa.binary())
                full = np.flatnonzero(np.diff(bounds) > 0)
                at = np.full(block.rows, -1)
                at[full] = np.arange(len(full))
                index = pa.array(at, mask=at < 0)
                lists = pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * s.bands, pa.array(got["bands"].ravel()))
                packed = pa.array([x.tobytes() for x in got["packed"]], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, block.rows), pa.array(np.diff(bounds)), wording, *(pa.array(got[k]).take(index) for k in ("key1", "key2")), lists.take(index), packed.take(index)],
                    names=["doc_id", "n_shingles", "wording", "key1", "key2", "bands", "packed"],
                )

    return narrow(documents).mapInArrow(run, "doc_id long, n_shingles long, wording binary, key1 long, key2 long, bands array<long>, packed binary")


def similar_bits(packed_a: pa.Array, packed_b: pa.Array, s: Settings) -> np.ndarray:
    """Similarity from packed low bits: the share of equal ones, less those that are equal by chance."""
    width = (s.minima + 7) // 8
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), s.bits, width) for x in (packed_a, packed_b))
    differs = np.bitwise_or.reduce(a ^ b, axis=1)
    equal = 1 - np.bitwise_count(differs).sum(axis=1) / s.minima
    chance = 0.5**s.bits
    return (equal - chance) / (1 - chance)


def estimated(pairs: DataFrame, bits: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that the estimate leaves; nodes without bits are left to the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.ones(batch.num_rows, bool)
            known = pa.compute.and_(batch.column("packed_a").is_valid(), batch.column("packed_b").is_valid())
            at = np.flatnonzero(known.to_numpy(zero_copy_only=False))
            if len(at):
                some = batch.take(pa.array(at))
                near[at] = similar_bits(some.column("packed_a"), some.column("packed_b"), s) >= s.percent / 100 - s.margin
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    for side in ("b", "a"):
        pairs = pairs.join(bits.select(F.col("node").alias(side), F.col("packed").alias(f"packed_{side}")), side)
    return pairs.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a long, b long")


def common(sets: ShingleSets) -> np.ndarray:
    """Size of the intersection of rows 2i and 2i + 1. Shingles are told by their words, hashes only bring them together."""
    pair = rows_of(sets.bounds) // 2
    number, order = identified(mix(sets.keys) ^ mix(pair.astype(np.uint64) + np.uint64(1)), lambda i, j: (pair[i] == pair[j]) & sets.same(i, j))
    twice = order[1:][number[order[1:]] == number[order[:-1]]]
    return np.bincount(pair[twice], minlength=(len(sets.bounds) - 1) // 2)


def confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold: 100 * intersection >= percent * union."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 64
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                both = pa.chunked_array([rows.column("text_a"), rows.column("text_b")]).combine_chunks()
                order = np.arange(2 * rows.num_rows).reshape(2, -1).T.ravel()
                block = next(blocks(both.cast(pa.large_string()).take(pa.array(order)), lower=True, limit=1 << 62))
                sets = shingle_sets(block, s.shingle)
                shared, size = common(sets), np.diff(sets.bounds)
                union = size[::2] + size[1::2] - shared
                yield rows.select(["a", "b"]).filter(pa.array((100 * shared >= s.percent * union) & (union > 0)))

    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def with_nodes(texts: DataFrame, nodes: DataFrame, most: int = 1 << 20) -> DataFrame:
    """The texts whose doc_id is a node. Up to most ids (8 MB) are broadcast, so texts stay in place; beyond that a shuffled join."""
    nodes = checkpointed(nodes.select(F.col("node").alias("doc_id")))
    return texts.join(F.broadcast(nodes) if nodes.count() <= most else nodes, "doc_id", "left_semi")


def early_shingles(texts: DataFrame, s: Settings) -> DataFrame:
    """(node, shingle, place, size) of each node's first places in the order rarest first, as many as any partner can need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                sets = shingle_sets(block, s.shingle)
                keys, size, row = sets.keys, np.diff(sets.bounds), rows_of(sets.bounds)
                node = batch.column("doc_id").slice(block.first, block.rows).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([node, pa.array(keys.view(np.int64)), pa.array(size[row])], names=["node", "shingle", "size"])

    every = checkpointed(texts.select("doc_id", "text").mapInArrow(run, "node long, shingle long, size long"))
    shared = checkpointed(every.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
    ordered = every.join(shared, "shingle").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("x"))
    # shingles of one document alone come first and can match nothing: they only shift the places of the rest
    before = F.col("size") - F.size("x")
    first = ordered.select("node", "size", before.alias("before"), F.expr(f"slice(x, 1, greatest(cast(floor(size - size * {s.percent} / 100) + 1 - (size - size(x)) as int), 0))").alias("x"))
    return first.select("node", "size", "before", F.posexplode("x").alias("at", "y")).select("node", F.col("y.shingle").alias("shingle"), (F.col("before") + F.col("at")).alias("place"), "size")


def across(early: DataFrame, s: Settings) -> DataFrame:
    """Pairs of nodes of different components that share an early shingle and can still reach the threshold.

    Of a shingle's components the one with most nodes is never paired within itself: only the nodes outside it meet all the others.
    """
    per = early.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("k"), F.sum("n").alias("n"))
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    mixed = checkpointed(early.join(checkpointed(per.where("k > 1").select("shingle", "most", parts.alias("parts"))), "shingle"))
    # a shingle of very many nodes is dealt out: each node of one side to one part, each of the other to all
    x = mixed.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).alias("x")
    y = mixed.where("component <> most").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    need = F.ceil((F.col("x.size") + F.col("y.size")) * s.percent / (100.0 + s.percent) - 1e-6)
    reach = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.component") != F.col("y.component")) & (reach >= need))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def classed(sets: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, node) of every row with a set: the smallest doc_id of those with the same set.

    Rows of the same words are told by a 128-bit cryptographic digest of them. The smallest rows of these classes may still have equal sets, which
    a key over the set brings together and the words confirm.
    """
    # checkpointed, so the join gets two plain exchanges and a class of very many copies can be split
    classes = checkpointed(sets.groupBy("wording", "key1", "key2", "n_shingles").agg(F.min("doc_id").alias("node")))
    heads = classes.groupBy("key1", "key2", "n_shingles").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").drop("last")
    alike = checkpointed(classes.join(checkpointed(heads), ["key1", "key2", "n_shingles"]).where("a < node").select("wording", "a", F.col("node").alias("b")))
    if alike.isEmpty():
        return checkpointed(sets.select("doc_id", "wording").join(classes.select("wording", "node"), "wording").select("doc_id", "node"))
    pairs = alike.select("a", "b").distinct()
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    equal = checkpointed(confirmed(pairs, with_nodes(texts, nodes), replace(s, percent=100)).distinct())
    moved = alike.join(equal, ["a", "b"]).select("wording", F.col("a").alias("first"))
    classes = checkpointed(classes.join(moved, "wording", "left").select("wording", F.coalesce("first", "node").alias("node")))
    return checkpointed(sets.select("doc_id", "wording").join(classes, "wording").select("doc_id", "node"))


def near_duplicates(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    made = checkpointed(sketches(documents, s))
    sets = made.where("key1 is not null and doc_id is not null")
    member = classed(sets, narrow(documents), s)
    nodes = made.join(member.where("doc_id = node").select("doc_id").distinct(), "doc_id", "left_semi").where("key1 is not null").select(F.col("doc_id").alias("node"), "bands", "packed")
    nodes = checkpointed(nodes)
    # a doc_id of several texts has several sketches: its pairs aren't estimated
    bits = nodes.groupBy("node").agg(F.min("packed").alias("packed"), F.max("packed").alias("last")).select("node", F.when(F.col("packed") == F.col("last"), F.col("packed")).alias("packed"))
    bits = checkpointed(bits)
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").drop("last")
    heads = checkpointed(heads)
    inside = checkpointed(buckets.join(heads, "bucket").distinct())
    pairs = inside.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    pairs = checkpointed(estimated(pairs, bits, s))
    texts = written(with_nodes(narrow(documents), inside.select("node").distinct()))
    links = checkpointed(confirmed(pairs, texts, s).distinct())

    # repeated rows of a doc_id may belong to several classes: these are linked too
    same = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    labels = components(links.union(same))
    label = F.coalesce("component", "node").alias("component")
    placed = inside.join(labels, "node", "left").select("bucket", "node", label)
    mixed = checkpointed(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high and n > 2").select("bucket"))
    open_nodes = checkpointed(placed.join(mixed, "bucket", "left_semi").select("node", "component").distinct())
    if open_nodes.limit(1).count():
        left = with_nodes(texts, open_nodes.select("node").distinct())
        more = checkpointed(across(early_shingles(left, s).join(open_nodes, "node"), s))
        more = checkpointed(estimated(more, bits, s))
        found = checkpointed(confirmed(more, texts, s).distinct())
        if found.limit(1).count():
            labels = components(links.union(same).union(found))
    reached = member.join(labels.select("node", "component"), "node", "left").select("doc_id", label).groupBy("doc_id").agg(F.min("component").alias("component_id"))
    result = made.select("doc_id", "n_shingles").join(reached, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))


def representatives(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """documents less those that near_duplicates doesn't keep."""
    gone = checkpointed(near_duplicates(documents, s).where("not kept").select("doc_id").distinct())
    return documents.join(F.broadcast(gone) if gone.count() <= 1 << 20 else gone, "doc_id", "left_anti")
