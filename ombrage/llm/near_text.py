"""Near duplicates by text similarity: candidates through SimHash and MinHash, exact check.

op5's fingerprints link what differs in a few words of a long text. This form of the
operator finds texts whose sets of five-word shingles have a similarity (Jaccard) of
ALIKE = 0.8 or more, in three steps.

Keys. BALLS fingerprints of BITS SimHash bits over the distinct shingles emit all variants
within one bit, so what is within 2 bits meets. At 0.8 that is rare, so BANDS keys of
ROWS least hashes each are emitted too: a pair at 0.8 shares one of these with chance
0.9995, one at 0.85 with 0.99999, by the binomial. Keys have 48 and 58 bits, so that
strangers hardly meet in 10 billion texts either.

Groups. Rows that share a key are held against a sketch of 320 SimHash bits. LIMIT is a
filter of candidates and no verdict: at 0.8 a pair differs in 48 bits on average, standard
error 6. Only edges of a forest leave a key. Crowds are grouped without a comparison, which
loses nothing, as groups are judged exactly: a key that over CROWD of SLICE rows of one
task have is shuffled once for these rows, and they follow under a key of their own; a
key of over BUCKET rows is a star that streams through.

Links. Within a group all sketches are compared and all pairs within LIMIT that aren't
connected yet are judged by their shingle sets, at ALIKE or more; nothing else makes a
link. A group of over BLOCK_ROWS rows or BLOCK_BYTES is dealt into blocks. Each block is
linked by itself, then the heads of what is linked; of the classes that result the largest
is known to hang together, so only rows outside it are held against all blocks, in
tasks of two blocks each. So no task holds more than two blocks, however large a crowd,
and a crowd of near copies costs little more than its size.

Before that, a large group is taken apart by rare shingles: two sets at ALIKE share one of the
rarest 1 - ALIKE of either (the prefix filter, exact for any common order), so rows are
grouped anew by these keys. Pages of one template, which share its shingles and little else,
part here, for a fifth of their shingles a row; what meets all rows is only what is alike,
or shares more than ALIKE of itself with very many others.

Defined results: null and blank texts are one group; texts with fewer than `width`
words have one shingle; rows that repeat are one group; an empty table gives no
rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .simhash import SEED, classes, components

WIDTH = 5
ALIKE = 0.8
WORDS64 = 5
BALLS, BITS = 2, 48
BANDS, ROWS, BAND_BITS = 32, 7, 58
LIMIT = 88
PAIRS = 64
SLICE, CROWD, BUCKET, CARRY = 4096, 32, 2048, 50_000
BLOCK_ROWS, BLOCK_BYTES = 8192, 32 << 20
FLIPS = np.array([0] + [1 << i for i in range(BITS)], np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of hashes (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the shingles of the lower-cased words of a text."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([h(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([h(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64))


def sketch_of(hashes: np.ndarray) -> bytes:
    ones = np.zeros(64 * WORDS64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        wide = np.stack([mixed(part, k) for k in range(WORDS64)], 1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").tobytes()


def sketch(text: str | None, width: int = WIDTH) -> bytes:
    return sketch_of(shingle_hashes(text, width))


#: Odd multipliers, each of which orders the hashes anew.
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 0) | np.uint64(1)


def bands_of(hashes: np.ndarray) -> bytes:
    """BANDS keys of BAND_BITS, each of ROWS least hashes; no shingles, no keys."""
    if not len(hashes):
        return b""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 10):
        part = mixed(hashes[at : at + (1 << 10)], WORDS64)
        least = np.minimum(least, (part[:, None] * FACTORS[None, :]).min(0))
    key = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        key = mixed(key ^ least[k::ROWS], k)
    return (key >> np.uint64(64 - BAND_BITS)).astype("<u8").tobytes()


def set_hash(hashes: np.ndarray) -> int:
    """The node of a set of shingles, as a signed long."""
    from xxhash import xxh64_intdigest as h

    return int(np.uint64(h(hashes.tobytes(), SEED)).astype(np.int64))


def table_of(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) to (doc_id, node, size, sketch, bands); size counts shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(set_hash(x), len(x), sketch_of(x), bands_of(x)) for x in (shingle_hashes(t, width) for t in batch.column("text").to_pylist())]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "node", "size", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, node long, size long, sketch binary, bands binary")


def bits_of(column: pa.Array) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, WORDS64)


def prints_of(bits: np.ndarray) -> np.ndarray:
    """Of sketches the BALLS fingerprints."""
    raw = np.ascontiguousarray(bits).view(np.uint8)
    out = np.zeros((len(bits), BALLS, 8), np.uint8)
    out[:, :, : BITS // 8] = raw[:, : BALLS * BITS // 8].reshape(len(bits), BALLS, BITS // 8)
    return out.view("<u8")[:, :, 0]


def ball_keys(bits: np.ndarray) -> np.ndarray:
    """Of each sketch all strings within one bit of its fingerprints, the table's number
    above them."""
    keys = (prints_of(bits)[:, :, None] ^ FLIPS) | (np.arange(BALLS, dtype=np.uint64) << np.uint64(BITS))[:, None]
    return keys.reshape(len(bits), -1).view(np.int64)


def band_keys(bands: list[bytes]) -> np.ndarray:
    """Bands as negative numbers, the band's number above the key."""
    keys = np.frombuffer(b"".join(bands), "<u8").reshape(-1, BANDS)
    return (keys | np.arange(BANDS, dtype=np.uint64) << np.uint64(BAND_BITS) | np.uint64(1 << 63)).view(np.int64)


KEYS = "variant long, node long, crowd boolean"


def keyed(variant: np.ndarray, node: np.ndarray, crowd: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(variant), pa.array(node), pa.array(crowd)], ["variant", "node", "crowd"])


def emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sketch, bands) to (variant, node, crowd). Where over CROWD rows of a slice
    have a key, its least node alone is put out under it, and all of them under a key
    of this slice; both are marked as crowds."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            nodes, bands = part.column("node").to_numpy(zero_copy_only=False), part.column("bands").to_pylist()
            some = nodes[np.array([len(x) > 0 for x in bands], bool)]
            balls = ball_keys(bits_of(part.column("sketch")))
            key = np.concatenate((balls.ravel(), band_keys(bands).ravel()))
            node = np.concatenate((np.repeat(nodes, balls.shape[1]), np.repeat(some, BANDS)))
            order = np.lexsort((node, key))  # neighbours share their first bytes, which packs better
            key, node = key[order], node[order]
            starts = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
            sizes = np.diff(np.concatenate((starts, [len(key)])))
            many = np.repeat(sizes > CROWD, sizes)
            yield keyed(key[~many], node[~many], np.zeros(int((~many).sum()), bool))
            heads = starts[sizes > CROWD]
            if len(heads):
                own = mixed(key[heads].view(np.uint64) ^ mixed(node[heads].view(np.uint64), 1), 2).view(np.int64)
                keys = np.concatenate((key[heads], np.repeat(own, sizes[sizes > CROWD])))
                yield keyed(keys, np.concatenate((node[heads], node[many])), np.ones(len(keys), bool))


def shared_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by variant those whose variant another row has too."""
    kept: tuple | None = None

    def several(keys: np.ndarray, nodes: np.ndarray, crowd: np.ndarray) -> pa.RecordBatch:
        same = keys[1:] == keys[:-1]
        on = np.concatenate((same, [False])) | np.concatenate(([False], same))
        return keyed(keys[on], nodes[on], crowd[on])

    for batch in batches:
        cols = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("variant", "node", "crowd"))
        if kept is not None:
            cols = tuple(np.concatenate(x) for x in zip(kept, cols, strict=True))
        if not len(cols[0]):
            continue
        # The last variant waits for the next batch; of one with very many rows, two do.
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if len(cols[0]) - cut > CARRY:
            yield several(*(x[:-2] for x in cols))
            kept = tuple(x[-2:] for x in cols)
            continue
        kept = tuple(x[cut:] for x in cols)
        if cut:
            yield several(*(x[:cut] for x in cols))
    if kept is not None:
        yield several(*kept)


def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return far(a, b) <= LIMIT


def own_here(variant: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair with fingerprints a and b is this variant's to judge. Equal ones
    share BITS + 1 variants, and the fingerprint itself has them; others share two, of
    which the smaller has them. So a pair of a small bucket is judged once a table."""
    return np.where(a == b, variant == a, variant < (a ^ b ^ variant))


def bucket_edges(bits: np.ndarray) -> list[tuple[int, int]]:
    """Edges (position, position) of a forest that connects a bucket's near rows."""
    label = np.arange(len(bits))
    for i in range(1, len(bits)):
        met = np.unique(label[:i][near(bits[:i], bits[i])])
        if len(met):
            label[: i + 1][np.isin(label[: i + 1], met)] = met[0]
            label[i] = met[0]
    return [(int(k), i) for i, k in enumerate(label) if k != i]


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (variant, node, crowd, sketch) sorted by (variant, node) to edges (a < b)."""

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pair = np.stack((np.minimum(a, b), np.maximum(a, b)), 1)
        pair = np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    def whole(keys: np.ndarray, nodes: np.ndarray, crowd: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        """Of whole buckets."""
        ball = keys >= 0
        table = np.where(ball & (keys >> BITS < BALLS), keys >> BITS, 0)
        prints = prints_of(bits)[np.arange(len(keys)), table]
        variant = keys.view(np.uint64) & np.uint64((1 << BITS) - 1)
        starts = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0]
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        star = np.logical_or.reduceat(crowd, starts) | (sizes > BUCKET)
        a, b = [np.repeat(nodes[starts[star]], sizes[star])], [nodes[np.repeat(star, sizes)]]
        two = starts[(sizes == 2) & ~star]
        two = two[~ball[two] | own_here(variant[two], prints[two], prints[two + 1])]
        two = two[near(bits[two], bits[two + 1])]
        a.append(nodes[two])
        b.append(nodes[two + 1])
        more = (sizes > 2) & ~star
        for s, n in zip(starts[more].tolist(), sizes[more].tolist(), strict=True):
            own, at = bits[s : s + n], slice(s, s + n)
            if n <= PAIRS:
                on = near(own[:, None, :], own[None, :, :])
                if ball[s]:
                    on &= own_here(variant[s], prints[at][:, None], prints[at][None, :])
                i, j = np.nonzero(np.triu(on, 1))
            else:
                i, j = np.array(bucket_edges(own), np.int64).reshape(-1, 2).T
            a.append(nodes[at][i])
            b.append(nodes[at][j])
        return edges(np.concatenate(a), np.concatenate(b))

    kept: tuple | None = None
    for batch in batches:
        cols = (*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("variant", "node", "crowd")), bits_of(batch.column("sketch")))
        if kept is not None:
            cols = tuple(np.concatenate(x) for x in zip(kept, cols, strict=True))
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield whole(*(x[:cut] for x in cols))
        kept = tuple(x[cut:] for x in cols)
        if len(kept[0]) > BUCKET:  # a star: only its first row has to wait
            yield edges(np.repeat(kept[1][:1], len(kept[1])), kept[1])
            kept = (kept[0][:1], kept[1][:1], np.ones(1, bool), kept[3][:1])
    if kept is not None:
        yield whole(*kept)


def links(nodes: DataFrame, emit=emit_keys) -> DataFrame:
    """(node, sketch, ...) to distinct edges that connect nodes whose sketches are near, of
    those that share a key."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = nodes.mapInArrow(emit, KEYS).repartition(n, "variant").sortWithinPartitions("variant", "node").mapInArrow(shared_variants, KEYS)
    full = met.join(nodes.select("node", "sketch"), "node").select("variant", "node", "crowd", "sketch")
    return full.repartition(n, "variant").sortWithinPartitions("variant", "node").mapInArrow(verify, "a long, b long").distinct()


def exact_roots(bits: np.ndarray, sets: list[np.ndarray], known: list[int] | None = None) -> list[int]:
    """For rows of sketches and sets, of which those with equal known values are known to be
    connected, the first position that links of ALIKE or more connect each to."""
    n = len(sets)
    label = np.arange(n)
    if known is not None:
        _, first, of = np.unique(np.array(known, np.int64), return_index=True, return_inverse=True)
        label = first[of]
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(flat) + 1, np.int32)

    def alike(i: int, js: np.ndarray) -> np.ndarray:
        """Which of the sets js, none of them empty, are alike to i's, which is marked."""
        ends = np.cumsum(sizes[js])
        at = np.arange(ends[-1]) + np.repeat(starts[js] - ends + sizes[js], sizes[js])
        both = np.add.reduceat(mark[flat[at]], ends - sizes[js])
        return both >= ALIKE * (sizes[i] + sizes[js] - both) - 1e-9

    for i in range(1, n):
        d = far(bits[:i], bits[i])
        fit = np.minimum(sizes[:i], sizes[i]) >= ALIKE * np.maximum(sizes[:i], sizes[i]) - 1e-9
        js = np.nonzero((d <= LIMIT) & (label[:i] != label[i]) & fit & (sizes[:i] > 0))[0]
        js = js[np.argsort(d[js], kind="stable")]  # the likeliest first
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = 1
        take = 8
        while len(js):
            for j in js[:take][alike(i, js[:take])].tolist():
                lo, hi = sorted((int(label[i]), int(label[j])))
                label[label == hi] = lo
            js = js[take:]
            js, take = js[label[js] != label[i]], 256
        mark[own] = 0
    return label.tolist()


def link_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, node, label, sketch, shingles) sorted by (task, node) to (node, root)."""

    def linked(rows: list[tuple]) -> pa.RecordBatch:
        nodes, known, prints, sets = zip(*rows, strict=True)
        roots = exact_roots(np.frombuffer(b"".join(prints), "<u8").reshape(-1, WORDS64), [np.frombuffer(x, "<u8") for x in sets], known)
        return table_of({"node": (nodes, pa.int64()), "root": ([nodes[i] for i in roots], pa.int64())})

    task, rows = None, []
    for batch in batches:
        for t, *row in zip(*(batch.column(c).to_pylist() for c in ("task", "node", "label", "sketch", "shingles")), strict=True):
            if t != task:
                if rows:
                    yield linked(rows)
                task, rows = t, []
            if not rows or rows[-1][0] != row[0]:
                rows.append(tuple(row))
    if rows:
        yield linked(rows)


def link(rows: DataFrame, *task: Column | str) -> DataFrame:
    """(node, label, sketch, shingles) rows to (node, root), those of a task held against
    each other."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.xxhash64(*task).alias("task"), "node", "label", "sketch", "shingles")
    return dealt.repartition(n, "task").sortWithinPartitions("task", "node").mapInArrow(link_tasks, "node long, root long")


def shingled(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) and (first_id, node, ...) to members with the shingles of their text."""
    names = [c for c in members.columns if c != "first_id"]
    schema = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingle_hashes(t, width) for t in part.column("text").to_pylist()]
                own = pa.array([set_hash(x) == n for x, n in zip(sets, part.column("node").to_pylist(), strict=True)], pa.bool_())
                full = pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([x.tobytes() for x in sets], pa.binary())], [*names, "shingles"])
                yield full.filter(own)  # rows that repeat an id may have other texts

    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), "text")
    return texts.join(members, "first_id").select(*names, "text").mapInArrow(run, schema + ", shingles binary")


def blocks_of(rows: Column, size: Column) -> Column:
    return F.greatest(F.ceil(rows / F.lit(BLOCK_ROWS)), F.ceil(8 * size / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")


def block(k: int, blocks: str) -> Column:
    """A row's block, the k-th dealing."""
    return F.pmod(F.xxhash64("node", F.lit(k)), F.col(blocks)).cast("int")


def link_large(sets: DataFrame) -> DataFrame:
    """(group, blocks, node, sketch, shingles) of groups of several blocks to (node, root)."""
    alone = sets.withColumn("label", F.col("node"))
    first = written(link(alone, "group", block(0, "blocks")), "blocks")
    heads = alone.join(first.where("node = root").select("node"), "node")
    count = written(heads.groupBy("group").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("heads")), "heads")
    second = written(link(heads.join(count, "group"), "group", block(1, "heads")), "seconds")
    edges = lambda *parts: components(reduce_union([p.select(F.col("node").alias("a"), F.col("root").alias("b")) for p in parts]))
    known = written(edges(first, second), "known").withColumnRenamed("node", "_node")
    light = sets.select("group", "blocks", "node")
    labelled = written(light.join(known, light["node"] == F.col("_node"), "left").select("group", "blocks", "node", F.coalesce("root", "node").alias("label")), "labelled")
    by_label = labelled.groupBy("group", "blocks", "label").count()
    top = by_label.groupBy("group", "blocks").agg(F.max(F.struct("count", "label")).alias("t"), F.sum("count").alias("rows"))
    # Blocks of the largest class and of the rest, in proportion to their rows.
    part = lambda c: F.ceil(c / F.col("rows") * F.col("blocks")).cast("int")
    plan = written(top.select("group", F.col("t.label").alias("top"), part(F.col("t.count")).alias("inner"), part(F.col("rows") - F.col("t.count")).alias("outer")).where("outer > 0"), "plan")
    placed = labelled.join(plan, "group").withColumn("_node", F.col("node"))
    inside = F.col("label") == F.col("top")
    u, m = block(2, "outer"), block(3, "inner")
    each = lambda n, one: F.transform(F.sequence(F.lit(0), F.col(n) - 1), one)
    with_rest = each("outer", lambda v: F.struct(F.lit("rest").alias("of"), F.least(u, v).alias("i"), F.greatest(u, v).alias("j")))
    with_top = each("inner", lambda v: F.struct(F.lit("top").alias("of"), u.alias("i"), v.alias("j")))
    from_top = each("outer", lambda v: F.struct(F.lit("top").alias("of"), v.alias("i"), m.alias("j")))
    dealt = placed.select("group", "_node", "label", F.explode(F.when(inside, from_top).otherwise(F.concat(with_rest, with_top))).alias("pair"))
    third = link(sets.select("node", "sketch", "shingles").join(dealt, F.col("node") == F.col("_node")), "group", "pair")
    # A task returns the first position of each class; known classes connect what tasks share.
    return edges(first, second, written(third, "thirds"))


def reduce_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Counters of shingles, by their lowest bits: any order that all rows share will do.
COUNTERS = 1 << 16


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """In how many sets the shingles of each counter stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column("shingles").to_pylist():
                total += np.bincount((np.frombuffer(x, "<u8") & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield table_of({"counter": (used.tolist(), pa.int64()), "n": (total[used].tolist(), pa.int64())})

    out = np.zeros(COUNTERS, np.int64)
    for counter, n in sets.select("shingles").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n")).collect():  # COUNTERS rows at most
        out[counter] = n
    return out


def rarest(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, one of which any set at ALIKE has among its own."""
    n = len(hashes) - int(np.ceil(ALIKE * len(hashes) - 1e-9)) + 1
    return hashes[np.lexsort((hashes, counts[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:n]]


def parted(sets: DataFrame) -> DataFrame:
    """(node, sketch, shingles) rows of large groups to (node, group), grouped by rare
    shingles; rows that share none with a near row have no group and no link."""
    counts = shingle_counts(sets)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = [rarest(np.frombuffer(x, "<u8"), counts) for x in part.column("shingles").to_pylist()]
                nodes = np.repeat(part.column("node").to_numpy(zero_copy_only=False), [len(k) for k in keys])
                key = (mixed(np.concatenate([np.zeros(0, np.uint64), *keys]), 3) | np.uint64(1 << 63)).view(np.int64)
                yield keyed(key, nodes, np.zeros(len(key), bool))

    led = written(components(links(sets.select("node", "sketch", "shingles"), emit)).select("node", F.col("root").alias("group")), "parted")
    return led.union(led.select(F.col("group").alias("node"), "group").distinct())


def link_crowds(sets: DataFrame) -> DataFrame:
    """(node, sketch, size, shingles) rows of large groups to (node, root)."""
    rows = written(sets.join(parted(sets).withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node"), "crowds")
    sizes = written(rows.groupBy("group").agg(blocks_of(F.count("*"), F.sum("size")).alias("blocks")), "sizes")
    rows = written(rows.join(sizes, "group"), "members")
    out = link(rows.where("blocks = 1").withColumn("label", F.col("node")), "group").where("node <> root")
    large = rows.where("blocks > 1")
    return out.unionByName(link_large(large.select("group", "blocks", "node", "sketch", "shingles"))) if large.limit(1).count() else out


def exact(docs: DataFrame, members: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) and (first_id, node, group, size, sketch) to (node, root), linked at
    ALIKE."""
    sizes = written(members.groupBy("group").agg(blocks_of(F.count("*"), F.sum("size")).alias("blocks")), "sizes")
    members = written(members.join(sizes, "group"), "members")
    small = shingled(docs, members.where("blocks = 1").withColumn("label", F.col("node")).drop("blocks", "size"), width)
    out = link(small, "group").where("node <> root")
    large = members.where("blocks > 1")
    if large.limit(1).count():
        out = out.unionByName(link_crowds(written(shingled(docs, large.drop("group", "blocks"), width), "sets")))
    return out


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) to (doc_id, component_id), one row for each of docs."""
    marked = written(sketches(docs, width), "sketches")
    least = [F.min(c).alias(c) for c in ("size", "sketch", "bands")]
    nodes = written(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), *least), "nodes")
    led = written(components(links(nodes.select("node", "sketch", "bands"))).select("node", F.col("root").alias("group")), "groups")
    groups = led.union(led.select(F.col("group").alias("node"), "group").distinct())  # the least node has no row of its own
    roots = written(exact(docs, nodes.drop("bands").join(groups, "node"), width), "roots")
    return marked.select("doc_id", "node").join(classes(nodes, "node", roots), "node").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with the row of the smallest doc_id of each group; of rows that repeat a
    doc_id one stays. Columns as given; rows without doc_id stay."""
    names = docs.columns
    keep = near_duplicates(docs.where("doc_id IS NOT NULL")).where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    kept = docs.join(keep, F.col("doc_id").cast("long") == F.col("_kept_id"), "left_semi")
    order = W.partitionBy("doc_id").orderBy(F.xxhash64(*names))
    once = kept.withColumn("_row", F.row_number().over(order)).where("_row = 1").select(*names)
    return once.unionByName(docs.where("doc_id IS NULL"))
