"""What failed on larger tables: plans that broadcast what maps make, work that grows with the
square of a document, and rare letters."""

import time

import pytest
from pyspark.sql import functions as F

from ombrage.operators import curation
from ombrage.operators.detection import Found, detect_entities, entity_batch, entity_rows


def table(spark, *found, doc_id=1):
    schema = detect_entities(spark.createDataFrame([], "doc_id long, text string")).schema
    return spark.createDataFrame(entity_batch(entity_rows(doc_id, list(found))).to_pandas(), schema=schema)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Queries that join what a map makes.
JOINED = ["c14_run_analysis", "o4_add_omissions", "a13_pipeline", "a8_anonymise", "o3_omission_panel", "k11_highlight", "o2_omissions", "r1_parties", "s9_pre_detect"]


@pytest.mark.parametrize("name", JOINED)
def test_what_a_map_makes_is_not_broadcast(spark, name):
    """Catalyst gives it the size of the map's input."""
    from ombrage.plans import catalog

    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_new_entities_meet_known_ones_in_windows(spark):
    e = table(spark, Found("Dupont", "NOM"), Found("Li", "NOM"))
    more = table(spark, Found("DUPONT", "NOM"), Found("Zoé", "NOM"), Found("zoé", "NOM"), Found("Abel", "NOM"))
    none = more.withColumn("doc_id", F.lit(None).cast("long"))
    got = curation.append_new(e, more.unionByName(none))
    assert [(r["ord"], r["value"]) for r in got.where("doc_id = 1").orderBy("ord").collect()] == [(0, "Dupont"), (1, "Li"), (2, "Zoé"), (3, "Abel")]
    assert [r["value"] for r in got.where("doc_id IS NULL").orderBy("ord").collect()] == ["DUPONT", "Zoé", "Abel"]
    assert [r["value"] for r in curation.append_new(e, more, repeats=True).orderBy("ord").collect()] == ["Dupont", "Li", "Zoé", "zoé", "Abel"]


def test_an_import_of_many_lines(spark):
    from ombrage.sources import tables

    text = "Valeur;Type;Alias\n" + "\n".join(f'"Dupont {k}";NOM;a | b' for k in range(20000)) + '\n"DUPONT 7";REF;c'
    files = spark.createDataFrame([(1, "a.csv", text), (None, "b.csv", '"X";NOM;')], "doc_id long, filename string, content string")
    began = time.perf_counter()
    got = tables.import_step_entities(files).agg(F.count("*"), F.count_if(F.col("value") == "X"), F.count_if(F.col("type") == "REF")).first()
    assert list(got) == [20001, 1, 0] and time.perf_counter() - began < 30


def test_spellings_join_as_one_pass_over_all_pairs():
    import random

    from ombrage.operators.detection import alike_words, joined_spellings

    rng = random.Random(5)
    pool = ["dupont", "dupond", "dupon", "jean", "jeanne", "jeane", "li", "valois"]
    for _ in range(300):
        words = [tuple(rng.sample(pool, rng.randrange(1, 3))) for _ in range(rng.randrange(2, 25))]
        counts = sorted((rng.choice([1, 2, 3, 4, 9, 12, 30]) for _ in words), reverse=True)
        long = [rng.random() < 0.9 for _ in words]
        n, to = list(counts), [None] * len(words)
        for k, a in enumerate(words):
            fits = [j for j, b in enumerate(words) if j != k and to[j] is None and long[k] and alike_words(a, b) and n[j] > n[k] and (n[j] >= 3 * n[k] or len(a) > 1 or len(b) > 1)]
            if fits:
                to[k] = fits[0]
                n[fits[0]] += n[k]
        assert joined_spellings(words, long, list(counts)) == (n, to)


def test_a_document_of_many_names(spark):
    from ombrage.operators.detection import join_spellings

    rows = [(1, k, ["Jean Dupontel", "Jean Dupontl", "Marie Valois", "Dupontl"][k % 4], k % 40 + 1) for k in range(8000)]
    began = time.perf_counter()
    got = join_spellings(spark.createDataFrame(rows, "doc_id long, ord int, value string, occurrences int")).agg(F.count("*"), F.count("joined")).first()
    assert got[0] == 8000 and got[1] > 0 and time.perf_counter() - began < 30


def test_capitals_are_as_many_letters():
    from ombrage.functions.text import py_title, py_upper, py_value
    from ombrage.operators.detection import Detector

    assert (py_upper("Weßel"), py_upper("ﬁn"), py_upper("été")) == ("WEẞEL", "ﬁN", "ÉTÉ")
    assert (py_title("ßen weßel"), py_value("WEẞEL")) == ("ẞen Weßel", "WEẞEL")
    found = Detector(frozenset()).detect("avec Relywh Erßie, qui signe")
    assert [(e.value, e.aliases) for e in found] == [("Relywh Erßie", [])]


def odd_texts(spark, path):
    rows = [(0, ""), (1, None), (2, "avec Relywh Erßie, qui signe"), (3, 'a\x00b\x1f"\\\u2028😀\r\n\tÿ'), (4, "null"), (5, "{}"), (6, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("name", ["s16_session_round_trip", "d_detect_documents"])
def test_odd_texts_equal_the_sql(spark, tmp_path, name):
    import duckdb

    from ombrage.plans import catalog

    odd_texts(spark, tmp_path)
    got = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
