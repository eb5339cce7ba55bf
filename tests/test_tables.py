import io
import zipfile

from pyspark.sql import functions as F

from ombrage.operators import curation, omissions, parties, spans
from ombrage.operators.detection import Found, detect_entities, entity_batch, entity_rows
from ombrage.sources import files, sinks, tables


def table(spark, *found, doc_id=1):
    schema = detect_entities(spark.createDataFrame([], "doc_id long, text string")).schema
    return spark.createDataFrame(entity_batch(entity_rows(doc_id, list(found))).to_pandas(), schema=schema)


def content(spark, name, text):
    return spark.createDataFrame([(1, name, text)], "doc_id long, filename string, content string")


def test_block_list_and_types(spark):
    words = spark.createDataFrame([(" Foo",), ("foo",), ("",), ("bar",)], "word string")
    assert [r["word"] for r in curation.save_block_list(words).collect()] == ["bar", "foo"]
    t = spark.createDataFrame([("Numéro d'écrou",)], "label string")
    assert curation.add_types(spark.createDataFrame([], "id string, label string"), t).first()["id"] == "NUMERO_D_ECROU"


def test_csv_field(spark):
    assert spark.range(1).select(sinks.csv_field(F.lit('a;"b"'))).first()[0] == '"a;""b"""'


def test_imports(spark):
    a = tables.import_entities(content(spark, "x.csv", "h\nDupont;NOM;a, b\n;NOM\ndupont;REF;c\nX;;")).orderBy("seq").collect()
    assert [(r["value"], r["type"], r["aliases"]) for r in a] == [("Dupont", "NOM", ["a", "b"]), ("X", "NOM", [])]
    b = tables.import_step_entities(content(spark, "x.csv", '"Dupont";NOM;"a | b"')).first()
    assert (b["value"], b["aliases"]) == ("Dupont", ["a", "b"])
    c = tables.import_concordance(content(spark, "x.csv", "Placeholder;Valeur;Alias;Formes\n[NOM_1];Dupont;a | b;Dupont")).first()
    assert (c["value"], c["aliases"], c["type"]) == ("Dupont", ["a", "b"], "Dupont")
    j = tables.import_entities(content(spark, "x.json", '[{"value":"A","blocked":true},{"value":"B","aliases":["c"]}]')).collect()
    assert [(r["value"], r["aliases"]) for r in j] == [("B", ["c"])]
    w = tables.import_block_list(spark.createDataFrame([("a.txt", "un;deux,\nx"), ("b.json", '["un"]'), ("c.json", '{"k":1}')], "filename string, content string"))
    assert sorted(r["word"] for r in w.collect()) == ["deux", "k", "un", "un"]


def test_types_and_rules(spark):
    f = lambda s: spark.createDataFrame([("t.json", s)], "filename string, content string")
    assert tables.load_types(f('["Numéro d\'écrou"]')).first()["id"] == "NUMERO_D_ECROU"
    assert tables.load_types(f('[{"id":"A","label":"b"}]')).first()["label"] == "b"
    assert tables.load_rules(f('[{"id":"1","from":"a","to":"b","caseSensitive":true,"createdAt":5}]')).first()["from"] == "a"


def test_session_drops_first_names(spark):
    text = '{"version":"2.9","rawText":"t","entities":[{"id":"1","value":"A","prenom":"B","aliases":["c"]}],"parties":{"demandeurs":[{"entityId":"1","label":"x"}],"defendeurs":[]}}'
    s = tables.load_sessions(content(spark, "s.json", text))
    assert "prenom" not in tables.session_entities(s).columns and tables.session_entities(s).first()["value"] == "A"
    assert [(r["side"], r["ordre"]) for r in tables.session_parties(s).collect()] == [("demandeurs", 1)]
    assert tables.load_sessions(content(spark, "s.json", "{}")).count() == 0


def test_decode_cascade():
    assert files.decode_text("é\r\nb\rc".encode()) == "é\nb\nc"
    assert files.decode_text("été".encode("cp1252")) == "été"
    assert files.decode_text("été – fin".encode("mac_roman")) == "été – fin"


def test_docx_and_router(spark):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Un</w:t></w:r></w:p><w:p><w:r><w:t>Deux</w:t></w:r></w:p></w:body></w:document>'
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("word/document.xml", body)
    rows = [("a.docx", "docx", f.getvalue()), ("b.pdf", "pdf", b"/Page /Page "), ("c.txt", "txt", b"x"), ("d.docx", "docx", b"no")]
    df = spark.createDataFrame(rows, "filename string, extension string, content binary")
    got = {r["filename"]: (r["text"], r["method"]) for r in files.extract(df, native=lambda c: "x" * 99).collect()}
    assert got == {"a.docx": ("Un\n\nDeux", "docx"), "b.pdf": ("x" * 99, "ocr_unavailable"), "c.txt": ("x", "txt"), "d.docx": ("", "docx")}
    for n, method in ((99, "ocr"), (100, "native")):
        r = spark.range(1).select(files.route_pdf(F.lit("x" * n), F.lit("/Page /Page "), F.lit("o"), F.lit(True)).alias("r")).first()["r"]
        assert r["method"] == method


def test_read_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"x")
    (tmp_path / "b.exe").write_bytes(b"x")
    assert [r["filename"] for r in files.read_files(spark, str(tmp_path)).collect()] == ["a.TXT"]
    assert [r["reason"] for r in files.rejected_files(spark, str(tmp_path)).collect()] == ["extension"]


def test_curation(spark):
    e = table(spark, Found("Dupont", "NOM", aliases=["D"]), Found("Durand", "NOM"), Found("X", "ENTITE", active=False))
    ids = {r["value"]: r["id"] for r in e.collect()}
    pick = lambda *v: spark.createDataFrame([(1, ids[x]) for x in v], "doc_id long, id string")
    assert {r["value"] for r in curation.toggle(e, pick("X", "Dupont")).where("active").collect()} == {"X", "Durand"}
    left, block = curation.block(e, spark.createDataFrame([], "word string"), pick("Dupont"))
    assert left.count() == 2 and {r["word"] for r in block.collect()} == {"dupont", "d"}
    groups = spark.createDataFrame([(1, 1, ids["Dupont"], True), (1, 1, ids["Durand"], False)], "doc_id long, group_no int, id string, canonical boolean")
    merged = curation.merge(e, groups)
    assert merged.where("value = 'Dupont'").first()["aliases"] == ["D", "Durand"] and merged.count() == 2
    new = spark.createDataFrame([(1, 0, "dupont", "NOM"), (1, 1, "Neuf", "REF")], "doc_id long, seq int, value string, type string")
    assert [(r["ord"], r["value"]) for r in curation.add_manual(e, new).orderBy("ord").collect()][0] == (-1, "Neuf")
    assert [r["value"] for r in curation.append_new(e, table(spark, Found("DUPONT", "NOM"), Found("Z", "NOM"))).orderBy("ord").collect()][-1] == "Z"
    assert [r["value"] for r in curation.view(e, search="du", ascending=False).collect()] == ["Durand", "Dupont"]


def test_parties(spark, texts):
    docs = texts("Monsieur Dupont, demandeur, et le défendeur : Madame Martin")
    e = table(spark, Found("Dupont", "NOM"), doc_id=0)
    rows = parties.detect_parties(docs, e).orderBy("ord").collect()
    assert ("Dupont", "demandeurs") in {(r["name"].split()[-1], r["side"]) for r in rows}
    assert any(r["side"] == "defendeurs" and "Martin" in r["name"] for r in rows)
    roles = spark.createDataFrame([(0, 0, e.first()["id"], "DEMANDEUR")], "doc_id long, seq int, id string, role string")
    assert parties.assign_roles(e, roles).first()["type"] == "DEMANDEUR_1"


def test_omissions(spark, texts):
    docs = texts("Madame Annaïk MEROYER, 75011 PARIS, Monsieur Dupont")
    e = table(spark, Found("Dupont", "NOM"), doc_id=0)
    rows = omissions.find_omissions(docs, e).collect()
    values = {r["value"] for r in rows}
    assert "Madame Annaïk MEROYER" in values and "75011 PARIS" in values and not any("Dupont" in v for v in values)
    cut = spark.createDataFrame([(0, "Meroyer")], "doc_id long, word string")
    assert not any("MEROYER" in r["value"] for r in omissions.find_omissions(docs, e, cut).collect())


def test_segments_partition_the_text(spark, texts):
    docs = texts("le Dupont et dup", None)
    terms = spark.createDataFrame([(0, 1, 0, "Dupont", True, False), (0, 3, 0, "dup", False, False)], "doc_id long, pass int, seq int, term string, flexible boolean, case_sensitive boolean")
    rows = spans.segment_documents(docs, terms).where("doc_id = 0").orderBy("start").collect()
    assert "".join(r["text"] for r in rows) == "le Dupont et dup"
    assert [r["type"] for r in rows] == ["normal", "hl-search-in-rule", "normal", "hl-search"]
    assert spans.search_coverage(spans.segment_documents(docs, terms)).first()["covered"] == 1


def test_page_rectangles_split_at_lines(spark):
    rows = [(1, 0, 0, "Monsieur", 0.1, 0.1, 0.1, 0.02), (1, 0, 1, "DUPONT,", 0.1, 0.12, 0.1, 0.02)]
    words = spark.createDataFrame(rows, "doc_id long, page int, word_no int, text string, left double, top double, width double, height double")
    e = table(spark, Found("Monsieur Dupont", "NOM"))
    assert spans.page_rectangles(words, e).count() == 2
    near = words.withColumn("top", F.lit(0.1))
    assert spans.page_rectangles(near, e).count() == 1


def test_highlight_html(spark):
    got = spark.range(1).select(sinks.highlight_html(F.lit("<M. [NOM_1] & [DÉFENDEUR_1]"), F.array(F.lit("M.")))).first()[0]
    assert got == '&lt;M. <mark class="ph ph-nom">[NOM_1]</mark> &amp; <mark class="ph ph-defendeur">[DÉFENDEUR_1]</mark>'
    got = spark.range(1).select(sinks.highlight_html(F.lit("a M. b"), F.array(F.lit("M.")))).first()[0]
    assert got == 'a <mark class="ph ph-initiale">M.</mark> b'


def test_stream(spark, tmp_path, texts):
    from ombrage.streaming import anonymise_stream, read_documents

    texts("Monsieur Dupont écrit").write.parquet(str(tmp_path / "in"))
    query = anonymise_stream(read_documents(spark, str(tmp_path / "in")), lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out{n}")), str(tmp_path / "cp"), frozenset(["monsieur"]))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out0")).first()["anonymized"] == "Monsieur [NOM_1] écrit"


def test_smaller_operators(spark):
    from ombrage.operators import anonymise

    one = spark.createDataFrame([("Isabelle MERVOYER", "La Poste", "DUPONT Jean")], "a string, b string, c string")
    assert list(one.select(*[anonymise.first_name(F.col(c)) for c in "abc"]).first()) == ["Isabelle", None, None]
    assert list(one.select(*[anonymise.graphic_variants(F.col(c)) for c in "abc"]).first()) == [["ISABELLE MERVOYER"], ["LA POSTE"], ["DUPONT JEAN"]]
    assert one.select(spans.replace_at(F.col("a"), F.lit(0), F.lit(8), F.lit("I."))).first()[0] == "I. MERVOYER"
    assert one.select(spans.replace_all(F.col("a"), "ER", "$1")).first()[0] == "Isabelle M$1VOY$1"
    assert one.select(spans.word_at(F.col("a"), F.lit(3))).first()[0] == "Isabelle"
    schema = "rule_no int, id string, from string, to string, caseSensitive boolean, createdAt long"
    rules = spark.createDataFrame([(0, "a", "x", "y", True, 5)], schema)
    more = spark.createDataFrame([(None, "c", "z", "", True, 7), (None, "b", "w", "", True, 6), (None, "d", "", "", True, 6)], schema)
    both = tables.add_rules(rules, more)
    assert [(r["rule_no"], r["id"]) for r in both.orderBy("rule_no").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert tables.remove_rules(both, spark.createDataFrame([("a",)], "id string")).count() == 2


def test_types_removed_fall_back(spark):
    e = table(spark, Found("X", "ECROU"), Found("Y", "NOM"))
    types = spark.createDataFrame([("ECROU", "Écrou"), ("B", "b")], "id string, label string")
    left, back = curation.remove_types(types, e, spark.createDataFrame([("ECROU",)], "id string"))
    assert [r["id"] for r in left.collect()] == ["B"] and {r["type"] for r in back.collect()} == {"NOM"}


def test_parties_added_and_removed(spark):
    p = spark.createDataFrame([(1, "demandeurs", 1, "a")], "doc_id long, side string, ordre int, entity_id string")
    more = parties.accept_parties(p, spark.createDataFrame([(1, "demandeurs", "b"), (1, "demandeurs", "a")], "doc_id long, side string, entity_id string"))
    assert sorted((r["ordre"], r["entity_id"]) for r in more.collect()) == [(1, "a"), (2, "b")]
    less = parties.remove_parties(more, spark.createDataFrame([(1, "demandeurs", "a")], "doc_id long, side string, entity_id string"))
    assert [(r["ordre"], r["entity_id"]) for r in less.collect()] == [(1, "b")]


def test_omissions_become_aliases_or_entities(spark):
    e = table(spark, Found("Dupont", "NOM"))
    chosen = spark.createDataFrame([(1, 0, "Monsieur Dupont", "NOM"), (1, 1, "75011 PARIS", "ADRESSE")], "doc_id long, seq int, value string, type string")
    got = omissions.add_omissions(e, chosen).orderBy("ord").collect()
    assert [(r["value"], r["aliases"]) for r in got] == [("Dupont", ["Monsieur Dupont"]), ("75011 PARIS", [])]


def test_concordance_merge_and_exports(spark):
    e = table(spark, Found("Dupont", "NOM", aliases=["D"]))
    rows = spark.createDataFrame([(1, 0, "dupont ", "NOM", None, ["d", "E"]), (1, 1, "Neuf", None, None, [])], "doc_id long, seq int, value string, type string, label string, aliases array<string>")
    got = {r["value"]: (r["type"], r["aliases"]) for r in curation.merge_concordance(e, rows).collect()}
    assert got == {"Dupont": ("NOM", ["D", "E"]), "Neuf": ("NOM", [])}
    csv = sinks.entities_csv(e).first()["csv"]
    assert csv == "﻿Valeur;Type;Alias;Actif;Bloqué\nDupont;NOM;D;oui;non"
    back = tables.import_step_entities(content(spark, "x.csv", csv)).first()
    assert (back["value"], back["aliases"]) == ("Dupont", ["D"])


def test_export_all(spark, tmp_path):
    c = spark.createDataFrame([(1, 0, "[NOM_1]", "A", ["B"], "NOM", "NOM", None, ["A"])], "doc_id long, ord int, placeholder string, value string, aliases array<string>, type string, label string, initialPrefix string, replacedForms array<string>")
    r = spark.createDataFrame([(1, "x", "raw")], "doc_id long, anonymized string, text string")
    sinks.export_all(r, c, r, r.select("doc_id", F.col("text").alias("rawText")), F.lit("2024-01-31 12:05:00").cast("timestamp"), str(tmp_path / "e"))
    assert next((tmp_path / "e/anonymised/doc_id=1").glob("*.txt")).read_text() == "x\n"
    assert "[NOM_1];A;B;A;NOM;;" in next((tmp_path / "e/concordance/doc_id=1").glob("*.txt")).read_text()
    archives = sinks.export_archives(r, c, r, r.select("doc_id", F.col("text").alias("rawText")), F.lit("2024-01-31 12:05:00").cast("timestamp")).collect()
    assert [a["filename"] for a in archives] == ["1_export_2024-01-31_12h05.zip"]
    with zipfile.ZipFile(io.BytesIO(archives[0]["content"])) as z:
        assert z.testzip() is None and [i.split("_")[0] for i in z.namelist()] == ["anonymise", "concordance", "original", "session"]
        assert z.read(z.namelist()[0]).decode() == "x" and "[NOM_1];A;B;A;NOM;;" in z.read(z.namelist()[1]).decode()


def test_word_lists(spark, tmp_path):
    from ombrage.operators import curation, detection

    (tmp_path / "words.txt").write_text("# remark\n'Été', \"le\"\nLA;du  du\n// none\n")
    words = tables.load_words(spark, str(tmp_path / "words.txt"))
    assert {r["word"] for r in words.collect()} == {"Été", "le", "LA", "du"}
    none = words.limit(0)
    start = curation.start_block_list(words, spark.createDataFrame([("Zoé",), ("ETE",), (" ",), (None,)], "word string"), none)
    assert detection.word_set(start) == {"ete", "le", "la", "du", "zoe"}
    assert detection.word_set(none) == frozenset()


def test_long_word_lists_are_refused(spark, monkeypatch):
    import pytest

    from ombrage.operators import detection

    monkeypatch.setattr(detection, "MAX_WORDS", 2)
    with pytest.raises(ValueError, match="too long"):
        detection.detect_entities(spark.createDataFrame([(1, "x")], "doc_id long, text string"), frozenset("abc"))
    with pytest.raises(ValueError, match="too long"):
        detection.word_set(spark.createDataFrame([("a",), ("b",), ("c",)], "word string"))
