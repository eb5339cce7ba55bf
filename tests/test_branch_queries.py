"""Queries of single branches against their SQL, over whole small tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from ombrage.operators import curation, detection
from ombrage.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = (
    "a8_given k11_given a11_current l5_fix_breaks_from l6_fix_all_breaks r5_initials h1_segments h4_search_coverage h5_fragment_places h10_word_inside s8_decode_mac s8_decode_windows"
    " s9_ingest_txt s14_import_block_list_json c2_set_active c9_add_alias c10_change_type c10_remove_types c12_undo c13_shrink_block_list"
).split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, SF)
    want = tables.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert rows and rows == sorted(want.fetchall(), key=repr)


def test_pre_detection_adds_what_is_not_known(spark):
    """Known entities stay first; what detection finds follows in its order, without values
    that are known in any case."""
    made = [(1, "Madame Catherine DUPONT et Monsieur Jean LAPRÈS, contact@exemple.fr."), (2, None), (3, "Monsieur Jean LAPRÈS.")]
    docs = spark.createDataFrame(made, "doc_id long, rawText string")
    known = detection.detect_entities(spark.createDataFrame([(1, "Madame dupont. Madame Catherine DUPONT.")], "doc_id long, rawText string"), text="rawText")
    known = known.withColumn("value", F.lower("value"))
    have = [r["value"] for r in known.orderBy("ord").collect()]
    found = detection.detect_entities(docs, text="rawText").orderBy("doc_id", "ord").collect()
    got = {}
    for r in curation.pre_detect(docs, known).orderBy("doc_id", "ord").collect():
        got.setdefault(r["doc_id"], []).append(r["value"])
    assert got[1] == have + [r["value"] for r in found if r["doc_id"] == 1 and r["value"].lower() not in have]
    assert len(have) < len(got[1]) < len(have) + sum(r["doc_id"] == 1 for r in found)
    assert got[3] == [r["value"] for r in found if r["doc_id"] == 3] and set(got) == {1, 3}
