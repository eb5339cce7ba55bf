"""Longest-processing-time sharding of groups that must stay together.

Groups (rows of one key) sorted by size, largest first, go one by one to the
least-loaded shard, kept in a heap. Groups of one size are interchangeable, so the
schedule needs only how many groups there are of each size: the driver meets the
histogram of sizes (there are at most sqrt(2 * all bytes) distinct sizes, 14 million in
100 TB) and schedules a run of equal groups at once, with the picks that the heap
would make one by one. So it is the schedule of one heap over all groups, at every size
of input.

Executors then sort the groups by (size, key) into ranges, number them, and look up
whose turn each number within its size is. A size that very many groups have is spread
over ranges by their keys.

Slots number a shard's rows from 0 without gaps. Rows are dealt by a hash of
their own id, so that a hot group is numbered by many tasks: each numbers its share
from 0, then a table of counts (shards * chunks rows) gives each share its offset.

Defined results: a null text has no bytes and belongs with the empty text; equal
sizes go by key; rows that repeat a doc_id get slots of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_order, read_table, written

SHARDS = 24


def picks(heap: list[tuple[int, int]], size: int, count: int) -> list[int]:
    """How many of count groups of one size each shard gets; heap (load, shard) is brought
    up to date.

    One group goes to the heap's top. Of several, the heap would give shard s its k-th
    when the load reaches load(s) + (k - 1) * size, so together they are the count least of
    these numbers, of equal ones those of the first shards."""
    out = [0] * len(heap)
    if count == 1 or size == 0:
        load, s = heap[0]
        out[s] = count
        heapq.heapreplace(heap, (load + count * size, s))
        return out
    below = lambda bound: sum(max(0, -(-(bound - load) // size)) for load, _ in heap)  # noqa: E731  numbers under bound
    low, high = heap[0][0], heap[0][0] + count * size + 1
    while high - low > 1:  # the largest bound with at most count numbers under it
        middle = (low + high) // 2
        low, high = (middle, high) if below(middle) <= count else (low, middle)
    for load, s in heap:
        out[s] = max(0, -(-(low - load) // size))
    left = count - sum(out)
    for s in sorted(s for load, s in heap if load <= low and (low - load) % size == 0)[:left]:
        out[s] += 1
    heap[:] = [(load + out[s] * size, s) for load, s in heap]
    heapq.heapify(heap)
    return out


def schedule(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, list[int]]]:
    """(size, count) rows to (size, first, ends): the place of a size's first group in the
    order of sizes, and the places within the size before which shard 0, 1... ends."""
    heap, first, out = [(0, s) for s in range(shards)], 0, []
    for size, count in sorted(histogram, reverse=True):
        ends, end = [], 0
        for n in picks(heap, size, count):
            end += n
            ends.append(end)
        out.append((size, first, ends))
        first += count
    return out


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(group_key string, group_size long), one row a group, to (group_key, shard)."""
    spark = groups.sparkSession
    histogram = [tuple(r) for r in groups.groupBy("group_size").count().collect()]
    plan = spark.createDataFrame(schedule(histogram, shards), "group_size long, first long, ends array<long>")
    placed = in_order(groups.select("group_key", "group_size"), sum(n for _, n in histogram), F.desc("group_size"), F.asc("group_key"))
    shard = F.size(F.filter("ends", lambda end: end <= F.col("place") - F.col("first")))
    return placed.join(written(plan, "plan"), "group_size").select("group_key", shard.alias("shard"))


def number_slots(rows: DataFrame, shards: int, chunks: int) -> DataFrame:
    """Adds slot to (doc_id, shard, ...): gapless from 0 within each shard."""
    dealt = written(rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "group_key", F.lit(7)), F.lit(chunks)).cast("int")), "dealt")
    counts = dealt.groupBy("shard", "chunk").count()
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("doc_id", "group_key")) - 1
    return dealt.withColumn("own", own).join(offsets, ["shard", "chunk"]).withColumn("slot", (F.col("offset") + F.col("own")).cast("long")).drop("own", "offset", "chunk")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, text) to doc_id, size, text_crc32, group_key, shard, slot."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = written(docs.select("doc_id", (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("group_key")), "rows")
    groups = written(rows.groupBy("group_key").agg(F.sum("size").alias("group_size")), "groups")
    n = rows.count()
    chunks = max(1, min(100_000, n // (shards * 50_000) + 1)) * 8
    placed = rows.join(assign_groups(groups, shards), "group_key")
    return number_slots(placed, shards, chunks)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return shard_documents(docs, SHARDS).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
