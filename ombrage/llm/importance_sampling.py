"""Importance resampling towards a target distribution, over hashed runs of words.

Features are all runs of 1 to RUNS consecutive words; a feature's bucket is the CRC-32 of
its text modulo BUCKETS. The gain of a bucket is the logarithm of how much more often the
target (the benchmark) has it than the corpus. A document's weight is the sum of its
features' gains, and adding Gumbel noise that its id decides turns "the highest
scores" into a draw without replacement in proportion to exp(weight).

Runs are kept in tries local to a task: a node stands for a run, and holds how often it was
met and the CRC state of its text, so that a run's CRC continues that of the run before its
last word. Counting merges a trie's nodes into BUCKETS totals, a fixed number of rows a
task; only these are shuffled. Scoring walks the same paths with the gains attached.
A trie that reaches NODES nodes is handed on and begun anew, so memory is bounded.

Ranks come from one range partition of (score, doc_id): rows are numbered within their
partition, and a table of one row a partition gives each its offset. No task or driver meets
all rows.

Defined results: null and empty texts have no features, weight 0 and no rank; a null
doc_id draws as the empty id and comes last among ties; rows that repeat a doc_id are ranked
one by one, those with fewer features first; an empty table gives no rows; without a benchmark T
and t are 0; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_order, read_table, written
from .decontamination import words_of

RUNS = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
SCALE = 1000
NODES = 300_000
ARROW_ROWS = 256


def runs_of(words: list[bytes], runs: int) -> Counter:
    """Runs of `runs` words, and the shorter ones at the end, with how often each begins."""
    out = Counter(zip(*[words[k:] for k in range(runs)], strict=False))
    for at in range(max(0, len(words) - runs + 1), len(words)):
        out[tuple(words[at:])] += 1
    return out


class Trie:
    """Nodes [count, crc, gain of the path, children] by word."""

    def __init__(self, buckets: int = BUCKETS, gains: list[int] | None = None):
        self.buckets, self.gains, self.size = buckets, gains, 0
        self.root: dict[bytes, list] = {}

    def path(self, run: tuple[bytes, ...]) -> Iterator[list]:
        kids, state, gain, mark = self.root, 0, 0, b""
        for w in run:
            node = kids.get(w)
            if node is None:
                crc = crc32(mark + w, state)
                more = self.gains[crc % self.buckets] if self.gains else 0
                node = kids[w] = [0, crc, gain + more, {}]
                self.size += 1
            yield node
            kids, state, gain, mark = node[3], node[1], node[2], b" "

    def count(self, runs: Counter) -> None:
        for run, n in runs.items():
            for node in self.path(run):
                node[0] += n

    def weight(self, runs: Counter) -> int:
        """Gains of all features: a path's last node has the sum along the path."""
        out = 0
        for run, n in runs.items():
            node = None
            for node in self.path(run):  # noqa: B007
                pass
            out += n * node[2]
        return out

    def add_to(self, totals: np.ndarray) -> None:
        """Adds the counts of all nodes to their buckets."""
        kids = [self.root]
        while kids:
            for node in kids.pop().values():
                totals[node[1] % self.buckets] += node[0]
                if node[3]:
                    kids.append(node[3])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ARROW_ROWS):
            some = batch.slice(at, ARROW_ROWS)
            yield some, (words_of(t) for t in some.column("text").to_pylist())


def _body(rows: DataFrame, *ids: str) -> DataFrame:
    return rows.select(*ids, F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))


def bucket_counts(rows: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the texts fall into each bucket."""

    def run(batches):
        totals, trie = np.zeros(buckets, np.int64), Trie(buckets)
        for _, texts in _texts(batches):
            for words in texts:
                trie.count(runs_of(words, runs))
                if trie.size >= NODES:
                    trie.add_to(totals)
                    trie = Trie(buckets)
        trie.add_to(totals)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=object)
    for r in _body(rows).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Of each bucket, in doubles."""
    big_s, big_t, size = float(sum(corpus)), float(sum(target)), float(len(corpus))
    return [math.floor(SCALE * math.log((t + 1.0) * (big_s + size) / ((s + 1.0) * (big_t + size)))) for s, t in zip(map(float, corpus), map(float, target), strict=True)]


def noise_of(doc_id: object, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: list[int], runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """(doc_id, text) to doc_id, n_features, weight, score, and words."""
    given = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        trie = Trie(len(given.value), given.value)
        for batch, texts in _texts(batches):
            n, words_in, weights = [], [], []
            for words in texts:
                words_in.append(len(words))
                n.append(sum(max(0, len(words) - k) for k in range(runs)))
                weights.append(trie.weight(runs_of(words, runs)))
                if trie.size >= NODES:
                    trie = Trie(len(given.value), given.value)
            ids = batch.column("doc_id")
            total = [w + noise_of(i, seed) for w, i in zip(weights, ids.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in (n, weights, total, words_in)]], ["doc_id", "n_features", "weight", "score", "words"])

    return _body(docs, "doc_id").mapInArrow(run, "doc_id long, n_features long, weight long, score long, words long")


def ranked(rows: DataFrame, drawn: int, n: int) -> DataFrame:
    """n rows (doc_id, n_features, weight, score) with rank: 1 to drawn by score, else null."""
    placed = in_order(rows, n, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"))
    return placed.select(*rows.columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, text) and the target's texts to doc_id, n_features, weight, score, rank."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    gains = gains_of(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    scored = written(scores(docs, gains, runs, seed), "scores")
    columns = ["doc_id", "n_features", "weight", "score"]
    n = scored.where(F.col("words") >= min_words).count()
    rest = scored.where(F.col("words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    if not n:
        return rest
    return ranked(scored.where(F.col("words") >= min_words).select(*columns), percent * n // 100, n).unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CRC_STEP = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_TABLE = "SELECT i, i AS x0 FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)"
for _k in range(8):
    _TABLE = f"SELECT i, {_CRC_STEP.replace('x', f'x{_k}').replace(f'x{_k}or', 'xor')} AS x{_k + 1} FROM ({_TABLE})"
SQL = f"""
WITH tab AS MATERIALIZED (SELECT list(x8 ORDER BY i) AS t FROM ({_TABLE})),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS ws FROM documents),
dw AS MATERIALIZED (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(ws) AS w FROM d) GROUP BY k, w),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY w),
crc AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda j: CAST('0x' || substr(h, CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT w, lower(hex(encode(w))) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)), tab
),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
tot AS (SELECT CAST(coalesce((SELECT sum(s) FROM s), 0) AS DOUBLE) AS big_s, CAST(coalesce((SELECT sum(t) FROM t), 0) AS DOUBLE) AS big_t),
gain AS MATERIALIZED (
  SELECT bucket, CAST(floor({SCALE} * ln((coalesce(CAST(t AS DOUBLE), 0) + 1) * (big_s + {BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * (big_t + {BUCKETS})))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket), tot
),
wt AS (SELECT k, sum(n * g) AS weight FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY k),
sc AS (
  SELECT k, doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-{SCALE} * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN wt USING (k)
),
r AS (
  SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS r, count(*) OVER () AS n FROM sc WHERE n_features >= {MIN_WORDS}
)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS BIGINT) AS rank FROM sc LEFT JOIN r USING (k)
"""
