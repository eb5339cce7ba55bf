from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ombrage.operators import lines as L


def breaks(spark, texts, value):
    return [(r["lineIdx"], r["skipCount"]) for r in L.suspect_breaks(L.split_lines(texts(value))).orderBy("lineIdx").collect()]


def test_suspect_breaks(spark, texts):
    assert breaks(spark, texts, "VALOIS est\nen\ndroit de réclamer") == [(0, 2), (1, 2)]
    assert breaks(spark, texts, "Monsieur\nDupont.") == [(0, 2)]
    assert breaks(spark, texts, "Fin de phrase.\nNouvelle.") == []


def test_chain_over_blank_lines(spark, texts):
    value = "a\n\nb\n\nc\n\nd\ne\n\n\nf"
    assert breaks(spark, texts, value) == sorted(L.breaks_of(value.split("\n")).items())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "a", "b.", "C", "x-"]), max_size=9).map("\n".join), min_size=20, max_size=20))
def test_window_form_equals_loop(spark, texts, values):
    got = {}
    for r in L.suspect_breaks(L.split_lines(texts(*values))).collect():
        got.setdefault(r["doc_id"], {})[r["lineIdx"]] = r["skipCount"]
    assert got == {i: b for i, v in enumerate(values) if (b := L.breaks_of(v.split("\n")))}


def test_fix_breaks():
    assert L.fix_breaks("Aix-en-\nProvence.") == "Aix-en- Provence."
    assert L.fix_breaks("a\n\n\nb\nc.") == "a b c."


def test_blank_lines_all_go(texts):
    assert texts("A\n\n \nb").select(L.drop_blank_lines(F.col("text"))).first()[0] == "A\nb"


def test_spacing():
    merged = lambda t, words=frozenset(): [s[3] for s in L.spacing_suspects(t, words)]
    assert merged("articles 5 - 1 et 22 / 06") == []
    assert merged("2  lits") == ["2 lits"]
    assert merged("la r  etraite") == ["retraite"]
    assert merged("l espace") == []
    assert merged("d e l a", frozenset(["de", "la"])) == ["de la"]
    assert L.apply_spacing("la r  etraite", L.spacing_suspects("la r  etraite")) == "la retraite"


def test_overlap_with_immediate_predecessor(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 7), (1, 8, 9)], "doc_id long, start int, end int")
    assert sorted((r["start"], r["end"]) for r in L.without_overlaps(spans).collect()) == [(0, 10), (8, 9)]


def test_merge_line_in_columns(spark):
    rows = [("a-\nb\nc", 0, 2), ("a \n\n b\nc", 0, 3), ("x\ny", 1, 2), ("x\ny", 5, 2), ("x\ny", None, 2), ("x", 0, 2), (None, 0, 2), ("", 0, 2)]
    df = spark.createDataFrame(rows, "text string, line int, skip int")
    got = [r[0] for r in df.select(L.merge_line("text", "line", "skip")).collect()]
    assert got == ["a- b\nc", "a b\nc", "x\ny ", "x\ny", "x\ny", "x ", None, " "]
