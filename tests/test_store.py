import threading

import pytest
from pyspark.sql import functions as F

from ombrage.sources import files, sinks
from ombrage.sources.store import Store, rule_store, word_store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", "doc_id long, id string, value string, tags array<string>", ("doc_id", "id"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_versions_changes_and_undo(spark, store):
    make = lambda *r: spark.createDataFrame([(*x, ["t"], 1) for x in r], "doc_id long, id string, value string, tags array<string>, more int")
    assert store.version == 0 and store.read().count() == 0
    assert store.commit(make((1, "a", "x"), (None, "a", "y"), (None, None, "z"))) == 1
    assert store.commit(make((1, "a", "x2"), (2, "b", "w")), make((None, None, ""))) == 2
    assert rows(store.read()) == sorted([(1, "a", "x2", ["t"]), (2, "b", "w", ["t"]), (None, "a", "y", ["t"])], key=str)
    assert rows(store.read(1)) == sorted([(1, "a", "x", ["t"]), (None, "a", "y", ["t"]), (None, None, "z", ["t"])], key=str)
    assert store.undo() == 3 and rows(store.read()) == rows(store.read(1))
    assert store.undo() == 4 and rows(store.read()) == rows(store.read(2))
    assert store.undo(0) == 5 and store.read().count() == 0
    assert [m["note"] for m in store.manifests()][2:] == ["back to 1", "back to 2", "back to 0"]


def test_repeated_keys_and_keys_that_go_and_come(spark, store):
    make = lambda *r: spark.createDataFrame([(*x, None) for x in r], "doc_id long, id string, value string, tags array<string>")
    store.commit(make((1, "a", "x"), (1, "a", "y"), (1, "a", None)), make((1, "a", "")))
    assert rows(store.read()) == [(1, "a", "y", None)]
    store.commit()
    assert store.version == 2 and store.read().count() == 1


def test_a_version_is_claimed_once(store):
    assert store._claim(1, {"version": 1, "folder": "x", "note": ""})
    assert not store._claim(1, {"version": 1, "folder": "y", "note": ""})
    assert [m["folder"] for m in store.manifests()] == ["x"]


def test_two_writers_lose_nothing(spark, tmp_path):
    words = [word_store(spark, f"file://{tmp_path}/w") for _ in range(2)]
    seen = []
    # Both have looked at the version before either claims one.
    words[1].__class__ = type("Late", (Store,), {"version": property(lambda self: 0)})
    put = lambda s, *w: seen.append(s.commit(spark.createDataFrame([(x,) for x in w], "word string")))
    threads = [threading.Thread(target=put, args=(s, f"own{k}", "both")) for k, s in enumerate(words)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    put(words[1], "late")
    assert sorted(seen) == [1, 2, 3]
    assert rows(words[0].read()) == [("both",), ("late",), ("own0",), ("own1",)]


def test_rules_in_a_store(spark, tmp_path):
    kept = rule_store(spark, f"file://{tmp_path}/r")
    kept.commit(spark.createDataFrame([(0, "1", "l e", "le", False, 5)], kept.schema))
    assert kept.read().select("from", "to").first() == ("l e", "le")


def test_archives_in_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 70_000), (2, ""), (3, None), (None, "a")], "doc_id long, text string")
    made = docs.select("doc_id", sinks.zip_archive([(F.concat(F.lit("été"), F.col("doc_id").cast("string")) if k else F.lit("b.txt"), F.col("text")) for k in range(1)]).alias("content"))
    got = {r["doc_id"]: (r["name"], r["size"], r["sound"]) for r in files.zip_entries(made).collect()}
    assert got == {1: ("b.txt", 140_000, True), 2: ("b.txt", 0, True), 3: ("b.txt", 0, True), None: ("b.txt", 1, True)}
    accented = docs.where("doc_id = 1").select("doc_id", sinks.zip_archive([(F.lit("été.txt"), F.lit("ça")), (F.lit("b"), F.lit("c"))]).alias("content"))
    assert [(r["name"], r["size"]) for r in files.zip_entries(accented).collect()] == [("été.txt", 3), ("b", 1)]
    odd = spark.createDataFrame([(1, b"no archive"), (2, None)], "doc_id long, content binary")
    assert files.zip_entries(odd).count() == 0
