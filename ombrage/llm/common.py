"""Shared folder, written tables and small column helpers of the corpus operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the
    session, or, where it is unset (tests on one machine), one of our own."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", None)
    if given:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(given)
        return given.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(sc, "_ombrage_shared", None)
    if own is None:
        own = sc._ombrage_shared = "file://" + tempfile.mkdtemp(prefix="ombrage-")
        sc.setCheckpointDir(own + "/checkpoints")
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes at exit."""
    path = f"{shared_dir(spark)}/ombrage-{uuid.uuid4().hex}/{name}"
    pid = os.getpid()
    atexit.register(lambda: _remove(spark, os.path.dirname(path)) if os.getpid() == pid else None)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends
    there, so a lost executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once for a row, whatever Catalyst inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Number of words without building their array."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}", "")
    return F.regexp_count(trimmed, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


ROWS_A_PARTITION, MAX_PARTITIONS = 200_000, 10_000


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the row's place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        places = pa.array(np.arange(at, at + batch.num_rows), pa.int64())
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int64()), places], [*batch.schema.names, "_part", "_place"])


def in_order(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """rows, about n of them, with column place: 0, 1, 2... in the given order.

    They are dealt out by ranges of it and numbered within their partition; a table of one
    row a partition gives each its offset. No task meets all rows, and equal leading
    values are split by the ones after them."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, min(MAX_PARTITIONS, -(-n // ROWS_A_PARTITION)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _part long, _place long"
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(dealt.mapInArrow(_numbered, schema), "placed")
    offsets, before = [], 0
    for r in sorted(placed.groupBy("_part").count().collect()):  # one row a partition
        offsets.append((r["_part"], before))
        before += r["count"]
    given = spark.createDataFrame(offsets, "_part long, _before long")
    return placed.join(F.broadcast(given), "_part").select(*rows.columns, (F.col("_before") + F.col("_place")).alias("place"))
