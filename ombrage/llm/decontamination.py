"""Benchmark decontamination: Wu-Manber search of all item windows in whole documents.

The alphabet of the search is words: a window of WINDOW consecutive words of an item (all
words of a shorter one) is a pattern, and a block is two words. For each pattern length
there is a table of shifts by block, which skips the places where no pattern can end;
where the shift is 0, the last block picks a bucket, the first block picks the test
patterns in it, and these are compared word by word. So a document without a passage is
read in steps of WINDOW - 1 words.

The tables are built by the workers from a broadcast of at most SLICE_WORDS item words. A
larger benchmark is dealt into slices by a hash of its pieces, each document is searched
with each slice, and what the slices found is united by document. Long items are cut into
pieces that share WINDOW - 1 words, so no window is lost and no slice depends on one item.

Defined results: null and empty texts have no words; items without words have no window;
items that repeat an id count once, a null id as the empty one; documents that
repeat are judged alike; with an empty benchmark nothing is hit; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

WINDOW = 10
BLOCK = 2
PIECE_WORDS = 20_000
SLICE_WORDS = 400_000
ARROW_ROWS = 256
#: Bytes to bytes: A-Z to lower case, what no word has to a blank. UTF-8 bytes from 0x80 stay.
FOLD = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Patterns:
    """Patterns of one length: shifts by block, and buckets by last and first block."""

    def __init__(self, length: int, base: int):
        self.length, self.base, self.block = length, base, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple[list[int], set[int]]]]] = defaultdict(lambda: defaultdict(list))

    def key(self, ids: list[int], last: int) -> int:
        """Of the block that ends at last."""
        return ids[last] if self.block == 1 else ids[last - 1] * self.base + ids[last]

    def add(self, ids: list[int], item: int) -> None:
        for last in range(self.block - 1, self.length):
            key = self.key(ids, last)
            self.shift[key] = min(self.shift.get(key, self.far), self.length - 1 - last)
        tests = self.buckets[self.key(ids, self.length - 1)][self.key(ids, self.block - 1)]
        for have, items in tests:
            if have == ids:
                items.add(item)
                return
        tests.append((ids, {item}))

    def places(self, ids: list[int]) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of each occurrence, in order."""
        length, far, shift, base, pair = self.length, self.far, self.shift, self.base, self.block == 2
        at, n = length - 1, len(ids)
        while at < n:
            key = ids[at - 1] * base + ids[at] if pair else ids[at]
            step = shift.get(key, far)
            if step:
                at += step
                continue
            start = at - length + 1
            for pattern, items in self.buckets[key].get(self.key(ids, start + self.block - 1), ()):
                if ids[start : at + 1] == pattern:
                    yield start, items
            at += 1


class Search:
    """All windows of some items (id, words joined by blanks)."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        split = [(number[name], text.split()) for name, text in items]
        self.ids: dict[bytes, int] = {}
        for _, words in split:
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)  # 0: a word of no item
        self.of: dict[int, Patterns] = {}
        for item, words in split:
            ids = [self.ids[w] for w in words]
            length = min(WINDOW, len(ids))
            if length:
                patterns = self.of.setdefault(length, Patterns(length, len(self.ids) + 1))
                for k in range(len(ids) - length + 1):
                    patterns.add(ids[k : k + length], item)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Runs of hit words (start, end exclusive), disjoint and in order, and item ids."""
        get = self.ids.get
        ids = [get(w, 0) for w in words]
        places: list[tuple[int, int]] = []
        found: set[int] = set()
        for patterns in self.of.values():
            for start, items in patterns.places(ids):
                places.append((start, start + patterns.length))
                if not items <= found:
                    found |= items
        return united(places), [self.names[k] for k in sorted(found)]


def united(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(places):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


#: The last slice that this worker has built, by the slice's name.
_BUILT: dict[str, Search] = {}


def built(name: str, items: list[tuple[str, bytes]]) -> Search:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Search(items)
    return _BUILT[name]


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to pieces (item, words, n) of at most PIECE_WORDS new words."""
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            for at in range(0, max(1, len(words) - WINDOW + 1), PIECE_WORDS) if words else ():
                some = words[at : at + PIECE_WORDS + WINDOW - 1]
                yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([b" ".join(some)], pa.binary()), pa.array([len(some)], pa.int64())], ["item", "words", "n"])


def slices_of(benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> tuple[DataFrame, int]:
    """Written pieces with the number of their slice, and how many slices there are."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    pieces = written(rows.mapInArrow(pieces_of, "item string, words binary, n long"), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n = 1 if total <= slice_words else -(-2 * total // slice_words)  # half full, as a hash deals unevenly
    return pieces.withColumn("slice", F.pmod(F.xxhash64("item", "words"), F.lit(n)).cast("int")), n


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ARROW_ROWS):
            yield batch.slice(at, ARROW_ROWS)


def _items(pieces: DataFrame, k: int):
    """The pieces of one slice as a broadcast: SLICE_WORDS words or so."""
    rows = pieces.where(F.col("slice") == k).select("item", "words").collect()
    return pieces.sparkSession.sparkContext.broadcast([(r[0], bytes(r[1])) for r in rows]), uuid.uuid4().hex


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _search_once(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """One slice: a map that doesn't shuffle."""
    given, name = _items(pieces, 0)

    def run(batches):
        search = built(name, given.value)
        for batch in _batches(batches):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                runs, items = search.hits(words)
                for column, x in zip(out, (len(words), sum(b - a for a, b in runs), len(items), sha_of(items)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string")


def _search_slice(keyed: DataFrame, pieces: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, runs, items) of the documents that a slice hits."""
    given, name = _items(pieces, k)

    def run(batches):
        search = built(name, given.value)
        for batch in _batches(batches):
            rows = []
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                runs, items = search.hits(words_of(text))
                if runs:
                    rows.append({"doc_id": doc_id, "key": key, "runs": [{"a": a, "b": b} for a, b in runs], "items": items})
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("key", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, key long, runs array<struct<a:bigint,b:bigint>>, items array<string>")


def _length_of(runs: Column) -> Column:
    """Words in a union of runs."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(acc["end"], r["a"]))).alias("n"), F.greatest(acc["end"], r["b"]).alias("end"))
    return F.aggregate(F.array_sort(runs), start, step, lambda acc: acc["n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _batches(batches):
        n = [len(words_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64())], ["doc_id", "key", "n_words"])


def _search_all(docs: DataFrame, pieces: DataFrame, n: int) -> DataFrame:
    """Several slices: what each finds, written and united by document and text."""
    keyed = _texts(docs).withColumn("key", F.xxhash64("text", F.length("text")))
    found = None
    for k in range(n):
        some = written(_search_slice(keyed, pieces, k), f"slice{k}")
        found = some if found is None else found.unionByName(some)
    hit = found.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hit = hit.select("_id", "_key", _length_of(F.col("runs")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = keyed.mapInArrow(_count_words, f"doc_id {kind}, key long, n_words long")
    joined = counted.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.lit(sha_of([]))).alias("items_sha256"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, text) and (item_id, text) to doc_id, n_words, n_hit, n_items,
    items_sha256 and contaminated."""
    pieces, n = slices_of(benchmark, slice_words)
    found = _search_once(docs, pieces) if n == 1 else _search_all(docs, pieces, n)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, ws, least({WINDOW}, len(ws)) AS size FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS MATERIALIZED (SELECT DISTINCT item, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS x FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT size FROM b),
dw AS (SELECT k, i, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS x FROM (SELECT k, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
hit AS MATERIALIZED (SELECT k, i, bw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.x = bw.x),
n AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + size)) AS p FROM hit) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (k) LEFT JOIN it USING (k)
"""
