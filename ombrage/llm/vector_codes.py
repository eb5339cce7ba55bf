"""Vector code compression: product codes learnt by rounds of integer k-means.

A component x becomes the integer floor(4096 x); a vector is cut into PARTS equal parts,
and each part becomes the index of the nearest entry of its position's codebook.

Vectors are laid out once as columnar NumPy blocks, (components, rows) in the smallest
integer type that holds them, and written to the shared folder; a round reads them from
there, so a lost executor costs a reread. A round is one RDD treeAggregate: a block adds up
its distances dimension by dimension, np.add.at puts its parts into int64 sums and counts
of every entry, and these tensors (PARTS * ENTRIES entries, whatever the input) merge
through a reduction tree, so that neither the driver nor one task meets all of them.
Only codebooks go out to the executors.

Numbers that int64 can't be sure to hold (components beyond about 2**27, or sums beyond
2**62) go on as Python integers, so codes and codebooks are exact at every magnitude.

Defined results: a row whose vector is null or holds a null, NaN or infinite component is
left out. The dimension is the most frequent length (of two, the longer one); rows of
another length are left out, and a dimension that PARTS doesn't divide is filled up with
zeros. Null vec_ids come last in the choice of entries; equal vec_ids go by their vectors,
and each row counts. With fewer rows than ENTRIES the codebooks have as many entries as there
are rows. Null labels are one label. Errors beyond a long are the largest long. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows and bytes of a block at most: its distances stay in the cache.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 20
LONGEST = (1 << 63) - 1

Tensors = tuple[np.ndarray, np.ndarray]


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), in the smallest type; Python integers beyond 2**62."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(SCALE))
    top = np.abs(y).max(initial=0.0)
    if top >= 2.0**62:
        whole = [int(v) * SCALE if abs(v) >= 2.0**52 else math.floor(v * SCALE) for v in x.ravel().tolist()]
        return np.array(whole, dtype=object).reshape(x.shape)
    for kind in (np.int16, np.int32):
        if top <= np.iinfo(kind).max:
            return y.astype(kind)
    return y.astype(np.int64)


def packed(part: np.ndarray) -> tuple[str, bytes]:
    """Type and bytes of a block; Python integers as decimal text."""
    if part.dtype == object:
        return "text", ",".join(map(str, part.ravel().tolist())).encode()
    return part.dtype.str, np.ascontiguousarray(part).tobytes()


def unpacked(kind: str, data: bytes, n: int) -> np.ndarray:
    """(components, rows), components filled up to a multiple of PARTS."""
    if kind == "text":
        flat = np.array([int(v) for v in bytes(data).split(b",") if v], dtype=object)
    else:
        flat = np.frombuffer(data, kind)
    part = flat.reshape(len(flat) // n, n)
    short = -part.shape[0] % PARTS
    return np.vstack([part, np.zeros((short, n), part.dtype)]) if short else part


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, embedding) to blocks of rows of one length."""
    for batch in batches:
        vectors, ids, labels = batch.column("embedding"), batch.column("vec_id"), batch.column("label")
        ends = vectors.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = np.diff(ends)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        good = (bad[ends[1:]] == bad[ends[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths[good]).tolist():
            rows = np.flatnonzero(good & (lengths == dim))
            step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dim, 1))))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                block = scaled(flat[ends[some][None, :] + np.arange(dim)[:, None]])
                kind, data = packed(block)
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([len(some)], pa.int32()), pa.array([kind]), pa.array([data], pa.binary()), *[pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), c.take(take)) for c in (ids, labels)]],
                    ["dim", "n", "kind", "data", "ids", "labels"],
                )


def blocks_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) to the written blocks of the most frequent length."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label")
    label = rows.schema["label"].dataType.simpleString()
    blocks = written(rows.mapInArrow(to_blocks, f"dim int, n int, kind string, data binary, ids array<bigint>, labels array<{label}>"), "blocks")
    top = blocks.groupBy("dim").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    return blocks.where(F.col("dim") == (top["dim"] if top else -1))


def first_vectors(blocks: DataFrame, k: int) -> list[tuple]:
    """The k rows of smallest vec_id, as tuples of integers."""

    def smallest(rows):
        best: list[tuple] = []
        for r in rows:
            keys = [(i is None, i or 0) for i in r["ids"]]
            bound = max(heapq.nsmallest(k, keys))
            near = [j for j, key in enumerate(keys) if key <= bound]
            part = unpacked(r["kind"], r["data"], r["n"])[:, near].T.tolist()
            best = heapq.nsmallest(k, [*best, *((keys[j], tuple(v)) for j, v in zip(near, part, strict=True))])
        return best

    return [v for _, v in blocks.select("ids", "n", "kind", "data").rdd.mapPartitions(smallest).takeOrdered(k)]


def codebooks_from(vectors: list[tuple]) -> np.ndarray:
    """(parts, entries, components), of Python integers."""
    whole = np.array(vectors, dtype=object).reshape(len(vectors), PARTS, len(vectors[0]) // PARTS)
    return whole.transpose(1, 0, 2)


def narrow(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 where no squared distance can leave it, else as they are."""
    top = max(abs(int(x)) for a in (block, books) for x in ((a.min(), a.max()) if a.size else (0,)))
    if 4 * top * top * max(1, books.shape[2]) < 1 << 59:  # PARTS of these are added up
        return block.astype(np.int64), books.astype(np.int64)
    return block.astype(object), books


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance to it, both (parts, rows)."""
    x, c = narrow(block, books)
    parts, entries, width = c.shape
    x = x.reshape(parts, width, block.shape[1])
    codes, errors = np.empty((parts, x.shape[2]), np.int64), np.empty((parts, x.shape[2]), x.dtype)
    for p in range(parts):
        away = np.zeros((entries, x.shape[2]), x.dtype)
        for j in range(width):
            step = x[p, j][None, :] - c[p, :, j][:, None]
            away += step * step
        codes[p] = away.argmin(axis=0)
        errors[p] = np.take_along_axis(away, codes[p][None, :], 0)[0]
    return codes, errors


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b, as Python integers where int64 might not hold it."""
    if a.dtype != object and b.dtype != object and a.size and int(np.abs(a).max()) + int(np.abs(b).max()) >= 1 << 62:
        a = a.astype(object)
    return a + b


def gathered(tensors: Tensors, block: np.ndarray, books: np.ndarray) -> Tensors:
    """tensors with the parts of one block added to their entries."""
    codes, _ = nearest(block, books)
    parts, entries, width = books.shape
    x = block.reshape(parts, width, block.shape[1])
    top = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
    sums = np.zeros(books.shape, np.int64 if top * x.shape[2] < 1 << 62 else object)
    counts = np.zeros((parts, entries), np.int64)
    for p in range(parts):
        np.add.at(sums[p], codes[p], x[p].T.astype(sums.dtype))
        np.add.at(counts[p], codes[p], 1)
    return merged(tensors, (sums, counts))


def merged(a: Tensors, b: Tensors) -> Tensors:
    return add(a[0], b[0]), a[1] + b[1]


def refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all blocks."""
    given = blocks.sparkSession.sparkContext.broadcast(books)
    zero = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    seen = lambda tensors, r: gathered(tensors, unpacked(r["kind"], r["data"], r["n"]), given.value)
    sums, counts = blocks.select("n", "kind", "data").rdd.treeAggregate(zero, seen, merged)
    given.unpersist()
    out, used = books.copy(), counts > 0
    out[used] = sums.astype(object)[used] // counts.astype(object)[used][:, None]
    return out


def learn(blocks: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks (parts, entries, components) of Python integers; None without rows."""
    first = first_vectors(blocks, entries)
    if not first:
        return None
    books = codebooks_from(first)
    for _ in range(rounds):
        books = refined(blocks, books)
    return books


def digest_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """Blocks to rows (vec_id, label, code, error)."""
    given = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                kind, data, n = (batch.column(c)[k].as_py() for c in ("kind", "data", "n"))
                codes, errors = nearest(unpacked(kind, data, n), given.value)
                texts = [bytes(row).hex() for row in codes.T.astype(np.uint8)]
                total = [min(int(e), LONGEST) for e in errors.sum(axis=0)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(texts, pa.string()), pa.array(total, pa.int64())], ["vec_id", "label", "code", "error"])

    label = blocks.schema["labels"].dataType.elementType.simpleString()
    return blocks.select("n", "kind", "data", "ids", "labels").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) to vec_id, label, code, error and the codebooks' digest."""
    blocks = blocks_of(vectors)
    books = learn(blocks)
    if books is None:
        return vectors.select(F.col("vec_id").cast("long"), "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256")).where(F.lit(False))
    return encode(blocks, books).withColumn("codebooks_sha256", F.lit(digest_of(books)))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: the error summed over equal labels, added up before it is joined."""
    coded = written(coded, "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = written(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label"), "sums")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = compress(read_table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    rounds, last = [], "c0"
    for r in range(1, ROUNDS + 2):
        rounds.append(
            f"""a{r} AS MATERIALIZED (
  SELECT k, part, entry, aa + least_away AS away, s FROM (
    SELECT k, part, arg_min(entry, struct_pack(d := away, e := entry)) AS entry, min(away) AS least_away, any_value(aa) AS aa, any_value(s) AS s
    FROM (SELECT p.k, p.part, p.s, p.aa, c.entry, list_inner_product(c.s, c.s) - 2 * list_inner_product(p.s, c.s) AS away FROM p JOIN {last} c USING (part)) GROUP BY k, part))"""
        )
        if r <= ROUNDS:
            rounds.append(
                f"""c{r} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(u.s, c.s) AS s FROM {last} c LEFT JOIN (
    SELECT part, entry, list(floor(total / n) ORDER BY pos) AS s
    FROM (SELECT part, entry, pos, sum(x) AS total, count(*) AS n FROM (SELECT part, entry, unnest(s) AS x, unnest(range(len(s))) AS pos FROM a{r}) GROUP BY part, entry, pos)
    GROUP BY part, entry) u USING (part, entry))"""
            )
            last = f"c{r}"
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT k, part, s, list_inner_product(s, s) AS aa
  FROM (SELECT k, part, list_slice(e, part * (len(e) // {PARTS}) + 1, (part + 1) * (len(e) // {PARTS})) AS s FROM v, (SELECT unnest(range({PARTS})) AS part))
), c0 AS MATERIALIZED (SELECT part, k - 1 AS entry, s FROM p WHERE k <= {ENTRIES}), {", ".join(rounds)},
books AS (SELECT sha256(string_agg(t, ',' ORDER BY part, entry)) AS h FROM (SELECT part, entry, array_to_string(list_transform(s, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS t FROM {last})),
o AS (SELECT k, string_agg(printf('%02x', CAST(entry AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM a{ROUNDS + 1} GROUP BY k)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM books) AS codebooks_sha256
FROM v JOIN o USING (k)
"""


SQL = _sql()
