"""Versioned parameter tables: rules, types, block lists and entity tables with undo.

A store is a folder. A commit writes its change rows (key, other columns, whether
the key goes) once as Parquet and then claims the next version by creating that version's
manifest, which no other writer can have created: who comes second takes the version
after, so of two writers neither loses a change. The state at a version is, for each key, its last
change up to there. Nothing is ever rewritten, so a reader at a version sees the same rows
whatever is committed meanwhile.

Manifests are one small file a commit. Commits are made by people who curate, so the
driver lists them; change rows may be as many as the tables have and stay in Spark.

Defined results: of rows that repeat a key in one commit the largest stays, nulls being least; null is a key like any other; a key that goes and comes in one commit is there; a
store without commits is an empty table at version 0; undo of the first commit leaves an
empty table, and undo is a commit too, so it can be undone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    """A table of one row a key, with all its versions."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.columns = self.schema.fieldNames()

    # ── Files ──

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _system(self):
        return self._file("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _claim(self, version: int, manifest: dict) -> bool:
        """Creates the version's manifest, unless it is there."""
        fs, target = self._system(), self._file(f"versions/{version:012d}.json")
        if fs.exists(target):
            return False
        try:
            out = fs.create(target, False)
        except Exception as e:  # noqa: BLE001 - the class of the Java error tells
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return True

    def manifests(self) -> list[dict]:
        """Of all versions, in order."""
        fs, folder = self._system(), self._file("versions")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        rows = self.spark.read.text(names, wholetext=True).collect() if names else []
        return sorted((json.loads(r[0]) for r in rows), key=lambda m: m["version"])

    # ── Commits ──

    @property
    def version(self) -> int:
        return max((m["version"] for m in self.manifests()), default=0)

    def commit(self, put: DataFrame | None = None, gone: DataFrame | None = None, note: str = "") -> int:
        """Rows to put and keys that go; the version that the commit became."""
        empty = self.spark.createDataFrame([], self.schema)
        rows = (empty if put is None else put.select(*self.columns)).withColumn("_gone", F.lit(False))
        if gone is not None:
            lost = gone.select(*self.key).distinct()
            rows = rows.unionByName(lost.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        first = F.row_number().over(W.partitionBy(*self.key).orderBy("_gone", F.desc(F.struct(*self.columns))))
        folder = f"changes/{uuid.uuid4().hex}"
        rows.withColumn("_n", first).where("_n = 1").drop("_n").write.parquet(f"{self.path}/{folder}")
        version = self.version + 1
        while not self._claim(version, {"version": version, "folder": folder, "note": note}):
            version += 1
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, by default the last."""
        wanted = [m for m in self.manifests() if version is None or m["version"] <= version]
        schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in self.schema), T.StructField("_gone", T.BooleanType())])
        changes = self.spark.createDataFrame([], schema).withColumn("_version", F.lit(0))
        for m in wanted:
            changes = changes.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{m['folder']}").withColumn("_version", F.lit(m["version"])))
        last = changes.groupBy(*[F.col(k).alias(f"_{k}") for k in self.key]).agg(F.max_by(F.struct(*self.columns, "_gone"), "_version").alias("r"))
        return last.select("r.*").where("NOT _gone").select(*self.columns)

    def undo(self, to: int | None = None) -> int:
        """Commits what leads back to a version, by default the one before the last."""
        target = max(0, self.version - 1) if to is None else to
        now, then = self.read(), self.read(target)
        same = F.to_json(F.struct(*self.columns))
        back = then.join(now.select(same.alias("_same")), same == F.col("_same"), "left_anti")
        keys = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key]
        gone = now.join(then.select(*[F.col(k).alias(f"_{k}") for k in self.key]), keys, "left_anti")
        return self.commit(back, gone, f"back to {target}")


#: The tables that are kept so, and their keys.
RULES = "rule_no int, id string, `from` string, `to` string, caseSensitive boolean, createdAt bigint"


def rule_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, RULES, ("id",))


def type_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, "id string, label string", ("id",))


def word_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, "word string", ("word",))


def entity_store(spark: SparkSession, path: str, entities: DataFrame) -> Store:
    """An entity table, whose columns vary, by document and id."""
    return Store(spark, path, entities.schema, ("doc_id", "id"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or, where that is
    unset and all run on one machine, a temporary one."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        given = "file://" + tempfile.mkdtemp(prefix="ombrage-store-")
    return f"{given.rstrip('/')}/store-{uuid.uuid4().hex}/{name}"
