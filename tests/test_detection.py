from ombrage.operators import detection as D
from ombrage.operators.detection import Detector, Found

BLOCK = frozenset("madame monsieur maitre mme me les epoux couple".split())


def detect(text, words=BLOCK):
    return {(e.value, e.type): e for e in Detector(words).detect(text)}


def test_titles():
    for text in ("Monsieur Mahidine BOUCHAABA", "Monsieur BOUCHAABA Mahidine"):
        assert detect(text)["BOUCHAABA", "NOM"].prenom == "Mahidine"
    assert detect("Monsieur Jean-Pierre Dupont")["Dupont", "NOM"].prenom == "Jean-Pierre"
    assert detect("Maître HENNEQUIN") == {}
    out: list[Found] = []
    Detector(BLOCK).titled("Maitre HENNEQUIN", out)
    assert out == []


def test_ascii_boundary_cuts_the_name():
    assert Detector(BLOCK).words("avec André") == {"Andr": 1}


def test_typed(texts):
    rows = D.typed_matches(texts("née le 3 mars 1980 ; +33 6 12 34 56 78", "06 12 34 56 78, jean.dupont@exemple.fr", None)).collect()
    assert {(r["doc_id"], r["type"], r["label"], r["value"]) for r in rows} == {(0, "REF", "Date naissance", "Née Le 3 Mars 1980"), (1, "PHONE", "PHONE", "06 12 34 56 78"), (1, "EMAIL", "EMAIL", "Jean.dupont@exemple.fr")}


def test_crossed_names():
    got = detect("Madame Suhua Laprès épouse Mervoyer est venue")
    assert ("Suhua Laprès", "NOM") in got or ("Laprès", "NOM") in got


def test_levenshtein1():
    assert D.levenshtein1("ouchaaba", "bouchaaba") and D.levenshtein1("a", "a") and D.levenshtein1("abc", "abd")
    assert not D.levenshtein1("ab", "ba") and not D.levenshtein1("abc", "abcde")


def test_near_names_equal_all_pairs(spark):
    names = ["dupont", "dupond", "dupon", "upont", "durand", "durant", "a", "", "b"]
    df = spark.createDataFrame([(1, n) for n in names], "k int, name string")
    got = {(r["a"], r["b"]) for r in D.near_names(df, "name", "k").collect()}
    assert got == {(a, b) for a in names for b in names if a < b and D.levenshtein1(a, b)}


def test_word_counts_equal_the_loop(texts):
    values = ["Il a vu Paris. Lyon aussi, et Lyon : Nice « Brest", "BÉÉ. ABCÉtage Étage", ""]
    got = {(r["doc_id"], r["word"]): r["n"] for r in D.word_counts(texts(*values)).collect()}
    assert got == {(i, w): n for i, v in enumerate(values) for w, n in Detector(frozenset()).words(v).items()}


def test_detect_entities_rows(spark, texts):
    df = D.detect_entities(texts("Monsieur Dupont habite 12 rue de la Paix, Paris", None), BLOCK)
    rows = df.where("doc_id = 0").orderBy("ord").collect()
    assert ("ADRESSE", "12 Rue De La Paix") in {(r["type"], r["value"]) for r in rows}
    assert [r["ord"] for r in rows] == list(range(len(rows)))
    again = D.detect_entities(texts("Monsieur Dupont habite 12 rue de la Paix, Paris").repartition(3), BLOCK).orderBy("ord").collect()
    assert [r["id"] for r in rows] == [r["id"] for r in again]


def test_block_list_anti_join(spark):
    words = spark.createDataFrame([(1, "Écrou"), (1, "Jean Ecrou"), (1, "Jean")], "doc_id long, word string")
    block = spark.createDataFrame([("ecrou",)], "word string")
    assert [r["word"] for r in D.not_blocked(words, "word", block).collect()] == ["Jean"]


def plain_merge(detector, people):
    """All pairs, in order."""
    ordered = sorted(people, key=lambda e: -e.occurrences)
    gone = set()
    for cand in ordered:
        if id(cand) in gone or len(cand.value) < 5:
            continue
        for pivot in ordered:
            if pivot is not cand and id(pivot) not in gone and pivot.occurrences > cand.occurrences and detector.alike(cand, pivot):
                detector.absorb(pivot, cand, int.__add__)
                gone.add(id(cand))
                break
    return [e for e in people if id(e) not in gone]


def plain_consolidate(detector, people):
    gone = set()
    for e in people:
        if id(e) in gone:
            continue
        for o in people:
            if o is e or id(o) in gone or o.key not in {D.low(a) for a in e.aliases}:
                continue
            pivot, lost = (e, o) if len(e.value) >= len(o.value) else (o, e)
            detector.absorb(pivot, lost, max)
            gone.add(id(lost))
    return [e for e in people if id(e) not in gone]


def test_merges_equal_all_pairs():
    import copy
    import random

    rng, detector = random.Random(3), Detector(frozenset())
    parts = ["dupont", "dupond", "duponts", "durand", "jean", "jeanne", "marie", "mariee", "li", "bouchaaba", "ouchaaba"]
    for _ in range(200):
        values = dict.fromkeys(" ".join(rng.sample(parts, rng.randrange(1, 4))).title() for _ in range(14))
        people = [Found(v, "NOM", occurrences=rng.randrange(1, 9), aliases=[a.title() for a in rng.sample(parts, rng.randrange(3)) if a != v.lower()]) for v in values]
        show = lambda es: [(e.value, e.occurrences, e.aliases) for e in es]
        a, b = copy.deepcopy(people), copy.deepcopy(people)
        assert show(detector.merge_fuzzy(a)) == show(plain_merge(detector, b))
        a, b = copy.deepcopy(people), copy.deepcopy(people)
        assert show(detector.consolidate(a)) == show(plain_consolidate(detector, b))


def test_spellings_join_as_in_a_document(spark):
    """The relation against the pass over one document's entities."""
    import random

    from ombrage.operators.detection import Detector, Found, join_spellings

    rng = random.Random(3)
    base = ["Dupontel", "Bouchaaba", "Jean Dupontel", "Marchandeau", "Li", "Anne Marie Kermadec", "Éric Valois"]

    def damaged(name):
        k = rng.randrange(len(name))
        return rng.choice([name, name[:k] + name[k + 1 :], name[:k] + "x" + name[k:], name[:k] + "z" + name[k + 1 :]])

    rows, want = [(7, 0, None, 1), (None, 0, "Dupontel", 9), (None, 1, "Dupontl", 1)], {(None, "Dupontel"): 10}
    for doc in range(40):
        names = list(dict.fromkeys(damaged(rng.choice(base)) for _ in range(14)))
        found = [Found(n, "NOM", occurrences=rng.randrange(1, 12)) for n in names]
        rows += [(doc + 10, k, e.value, e.occurrences) for k, e in enumerate(found)]
        for e in Detector(frozenset()).merge_fuzzy(found):
            want[doc + 10, e.value] = e.occurrences
    got = join_spellings(spark.createDataFrame(rows, "doc_id long, ord int, value string, occurrences int")).where("joined IS NULL AND value IS NOT NULL").collect()
    assert {(r["doc_id"], r["value"]): r["occurrences"] for r in got} == want
