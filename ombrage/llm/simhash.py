"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints. Words of the lower-cased (A-Z) text, shingles of `width` words, each
hashed by XXH64; a bit is 1 if it is in over half of the hashes.

Candidates. Two fingerprints within an even radius r share a variant: a string
within r/2 of both. For an odd radius the middle falls between two strings, so the
64 bits are also punctured: for each of BLOCKS blocks the fingerprint without that
block's bits emits all variants within floor(r/2). Of two fingerprints at distance up
to r = 3, at least one differing bit (if they differ at all) lies in some block, and
without it at most 2 differ, so they share a variant of radius 1. That is 4 * 49 = 196
rows a fingerprint, instead of the 2 081 that a ball of radius 2 over all bits takes.
Variants are shuffled, and the members of each are verified on all 64 bits.

No bucket is expanded into pairs beyond PAIRS members. Larger buckets, as a crowd of
near copies makes them, are linked exactly in time linear in their size: members
that share a variant and, but for one bit, their own block are within 3 of each
other, so each such class is a star; members with equal kept bits differ within one
block of 16 bits, at most 65 536 values, and are linked by a table over those. A
linked pair of other shape meets in another block's buckets (see link_bucket). Only
edges of a spanning forest leave a bucket. A bucket holds 49 * 65 536 distinct
fingerprints at most, 25 MB, whatever the corpus.

Components. Edges between distinct fingerprints, alternately hooked to the smallest
neighbour (large and small star) until nothing changes (number and sum of hashes of the
edges stay), each round a checkpoint in the shared folder. Equal fingerprints are one node, so crowds of exact copies cost
one.

Defined results: null and blank texts have fingerprint zero and link like any other;
texts with fewer than `width` words have one shingle; rows that repeat a doc_id are
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, written

WIDTH = 3
SEED = 42
RADIUS = 3
BLOCKS = 4
PAIRS = 96
BITS = 64 // BLOCKS


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """SimHash of a text as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [h(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [h(line[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; counted in slices of bounded memory."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, text) to (doc_id, fp long: the 64 bits, signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


REST = 64 - BITS
LOW = np.uint64((1 << REST) - 1)
#: What keeps within radius 1 of the kept bits: no flip, or one of REST.
FLIPS = np.array([0] + [1 << i for i in range(REST)], np.uint64)
#: The strings of one block with one to three ones.
NEAR = [m for m in range(1, 1 << BITS) if m.bit_count() <= RADIUS]


def turned(x: np.ndarray, block: int | np.ndarray, back: bool = False) -> np.ndarray:
    """x rotated so that the block's bits come to the top (back: from there)."""
    k = (np.uint64(BITS) * (np.asarray(block).astype(np.uint64) + np.uint64(1))) % np.uint64(64)
    k = (np.uint64(64) - k) % np.uint64(64) if back else k
    return (x >> k) | (x << ((np.uint64(64) - k) % np.uint64(64)))


def emit_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) to (variant, rest): for each block, the other bits within radius 1 with the
    block's number above them, and which bit was flipped with the block's own bits.
    Together they give the fingerprint back, in little more than its own size."""
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(fps), 4096):
            part = fps[k : k + 4096]
            for b in range(BLOCKS):
                x = turned(part, b)
                keys = ((x & LOW)[:, None] ^ FLIPS[None, :]) | np.uint64(b << REST)
                rest = (x >> np.uint64(REST))[:, None] | (np.arange(len(FLIPS), dtype=np.uint64) << np.uint64(BITS))[None, :]
                order = np.argsort(keys, axis=None)  # neighbours share their first bytes, which packs better
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()[order].view(np.int64)), pa.array(rest.ravel()[order].astype(np.int32))], ["variant", "rest"])


class Forest:
    """Union-find over positions 0 to n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def link_bucket(variant: int, fps: np.ndarray) -> np.ndarray:
    """For the distinct fps of a bucket, turned, the position of a smaller or equal one
    that each is joined to.

    Up to PAIRS members every pair is held against the radius. Beyond, three kinds of
    pairs cover all linked pairs of all buckets together. With p and q the differing
    bits inside and outside a block: p <= 1, q <= 2 is found here, by stars over the
    block with one bit left out; q = 0, p <= 3 is found here, by a table over the
    block; any other linked pair (p = 2, q = 1) has p = 1 or 0 in another block whose
    bucket, small or large, finds it.
    """
    n = len(fps)
    forest = Forest(n)
    if n <= PAIRS:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            forest.join(int(i), int(j))
    else:
        inside = (fps >> np.uint64(REST)).astype(np.int64)
        for bit in range(BITS):
            left_out = inside & ~(1 << bit)
            order = np.argsort(left_out, kind="stable")
            head = order[0]
            for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
                if left_out[a] != left_out[b]:
                    head = b
                else:
                    forest.join(int(head), b)
        same = np.nonzero((fps & LOW) == np.uint64(variant) & LOW)[0]
        at = np.full(1 << BITS, -1, np.int64)
        at[inside[same]] = same
        for m in NEAR:
            other = at[inside[same] ^ m]
            for i, j in zip(same[other >= 0].tolist(), other[other >= 0].tolist(), strict=True):
                if i < j:
                    forest.join(i, j)
    return np.array([forest.root(i) for i in range(n)], np.int64)


def link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (variant, rest) to edges (a < b) of a spanning forest of each
    bucket. What is carried from batch to batch is one bucket."""

    def edges(variants: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
        """Of whole buckets."""
        fps = (((variants & LOW) ^ FLIPS[rest >> BITS]) | (rest.astype(np.uint64) & np.uint64((1 << BITS) - 1)) << np.uint64(REST))
        starts = np.nonzero(np.concatenate(([True], variants[1:] != variants[:-1])))[0]
        sizes = np.diff(np.concatenate((starts, [len(fps)])))
        a, b, of = [], [], []
        # Buckets of two, nearly all, at once.
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= RADIUS]
        a.append(fps[two])
        b.append(fps[two + 1])
        of.append(variants[two])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = fps[s : s + n]
            root = link_bucket(int(variants[s]), own)
            inner = root != np.arange(n)
            a.append(own[root[inner]])
            b.append(own[inner])
            of.append(np.full(int(inner.sum()), variants[s], np.uint64))
        block = np.concatenate(of) >> np.uint64(REST)
        a, b = (turned(np.concatenate(x), block, True).view(np.int64) for x in (a, b))
        pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    kept: tuple | None = None
    for batch in batches:
        cols = (batch.column("variant").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("rest").to_numpy(zero_copy_only=False))
        if kept is not None:
            cols = tuple(np.concatenate(x) for x in zip(kept, cols, strict=True))
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0].view(np.int64), cols[0].view(np.int64)[-1]))
        kept = tuple(x[cut:] for x in cols)
        if cut:
            yield edges(*(x[:cut] for x in cols))
    if kept is not None:
        yield edges(*kept)


def links(nodes: DataFrame) -> DataFrame:
    """Distinct (fp) to edges (a < b) that connect what links at RADIUS or less."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        nodes.mapInArrow(emit_variants, "variant long, rest int")
        .repartition(n, "variant")
        .sortWithinPartitions("variant", "rest")
        .mapInArrow(link_buckets, "a long, b long")
        .distinct()
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (a, b) to (node, root): the smallest node connected to each, of all but the
    smallest nodes themselves. The small side of each join is a checkpoint, so that
    adaptive execution can split the rows of a node with very many neighbours."""
    edges = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct().checkpoint()
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    now = state(edges)
    for _ in range(rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        # Large star: larger neighbours go to the smallest neighbour.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct().checkpoint()
        # Small star: smaller neighbours and the node itself go to the smallest.
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m")).checkpoint()
        small = large.join(small_least, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        after = small.checkpoint()
        edges, before, now = after, now, state(after)
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classes(nodes: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """Nodes (key, first_id) and the (node, root) of those that are linked to (key,
    component_id), the least first_id of each component; a written table, one row a node.

    Least ids are written before they are joined: both sides of that join, and of one
    with the result, are then plain shuffles, whose hot keys adaptive execution splits."""
    labelled = written(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), "labelled").withColumnRenamed("node", "_node")
    placed = written(nodes.select(key, "first_id").join(labelled, F.col(key) == F.col("_node")).select(key, "first_id", "root"), "placed")
    least = written(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    linked = written(placed.join(least, "root").select(F.col(key).alias("_key"), "component_id"), "linked")
    alone = nodes.join(linked, F.col(key) == F.col("_key"), "left")
    return written(alone.select(key, F.coalesce("component_id", "first_id").alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, text) to (doc_id, fp, component_id), one row for each of docs."""
    marked = written(fingerprints(docs, width, seed), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes.select("fp")))
    return marked.join(classes(nodes, "fp", roots), "fp").select("doc_id", "fp", "component_id")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with the row of the smallest doc_id of each component; of rows that
    repeat a doc_id one stays. Columns as given; rows without doc_id stay."""
    names = docs.columns
    keep = near_duplicates(docs.where("doc_id IS NOT NULL")).where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    id_at = F.col("doc_id").cast("long")
    order = W.partitionBy("doc_id").orderBy(F.xxhash64(*names))
    kept = docs.join(keep, id_at == F.col("_kept_id"), "left_semi")
    once = kept.withColumn("_row", F.row_number().over(order)).where("_row = 1").select(*names)
    return once.unionByName(docs.where("doc_id IS NULL"))
