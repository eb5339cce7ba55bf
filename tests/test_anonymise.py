import pytest
from pyspark.sql import functions as F

from ombrage.operators import anonymise as A
from ombrage.operators.detection import Found, detect_entities, entity_batch, entity_rows


def run(text, *entities):
    return A.substitute(text, list(entities))


BOUCHAABA = dict(value="BOUCHAABA", type="NOM", prenom="Mahidine", variants=["Mahidine", "MAHIDINE"])


@pytest.mark.parametrize(
    ("text", "entity", "wanted"),
    [
        ("Monsieur Dupont", {"value": "Dupont"}, "Monsieur [NOM_1]"),
        ("Mahidine BOUCHAABA", BOUCHAABA, "M. [NOM_1]"),
        ("Mahidine", BOUCHAABA, "M."),
        ("[de M. BOUCHAABA]", {"value": "BOUCHAABA"}, "[de M. [NOM_1]]"),
        ("[NOM_1]", {"value": "NOM"}, "[NOM_1]"),
        ("Jean-Pierre", {"value": "Jean Pierre"}, "[NOM_1]"),
        ("Jean Pierre", {"value": "Jean-Pierre"}, "Jean Pierre"),
        ("OUCHAABA", {"value": "BOUCHAABA"}, "[NOM_1]"),
        ("X", {"value": "X1", "type": "DEMANDEUR_1"}, "X"),
        ("Dupont", {"value": "Dupont", "type": "DEMANDEUR_1"}, "[DEMANDEUR_1_1]"),
        ("Dupontel", {"value": "Dupont"}, "Dupontel"),
    ],
)
def test_goldens(text, entity, wanted):
    assert run(text, Found(**({"type": "NOM"} | entity)))[0] == wanted


def test_numbers_are_used_up():
    done, rows, _ = run("Martin", Found("Absent", "NOM"), Found("Martin", "NOM"))
    assert done == "[NOM_2]" and [r["placeholder"] for r in rows] == ["[NOM_2]"]


def test_initials_have_no_concordance():
    done, rows, initials = run("Mahidine", Found(**BOUCHAABA))
    assert (rows, initials) == ([], ["M."])


def test_no_active_entity():
    assert run("texte", Found("texte", "NOM", active=False)) == ("texte", [], [])


def test_idempotent_on_placeholders():
    e = Found("NOM", "NOM"), Found("Dupont", "NOM")
    once = run("NOM Dupont", *e)[0]
    assert run(once, *e)[0] == once == "[NOM_1] [NOM_2]"


def test_redactions():
    rows = [{"word": "b c", "replacement": "$1", "scope": "all", "position": None}, {"word": "a", "replacement": "X", "scope": "current", "position": 3}]
    assert A.redact_text("a b-c a", rows) == "a $1 X"
    assert A.redact_text("a b", [{"word": "a", "replacement": "X", "scope": "current", "position": 2}]) == "X b"


def test_initial_choice():
    assert A.choose_initial("Jean", {"j."}) == ("JE.", False, [])
    assert A.choose_initial("Jo", {"j.", "jo."}) == ("J.", True, ["J.", "JO."])


def test_tables(spark, texts):
    docs = texts("Monsieur Dupont écrit. Dupont signe.", "", None)
    found = detect_entities(docs, frozenset(["monsieur"]))
    r = {x["doc_id"]: x for x in A.anonymise(docs, found).collect()}
    assert r[0]["anonymized"] == "Monsieur [NOM_1] écrit. [NOM_1] signe."
    assert r[1]["anonymized"] == r[2]["anonymized"] == ""
    c = A.concordance(A.anonymise(docs, found)).collect()
    assert [(x["placeholder"], x["replacedForms"]) for x in c] == [("[NOM_1]", ["Monsieur Dupont", "Dupont"])]


def test_rules_and_redaction_register(spark):
    batch = entity_batch(entity_rows(1, [Found("Madame Jean Dupont", "NOM", aliases=["Dupont", "M."])]))
    e = spark.createDataFrame(batch.to_pandas(), schema=detect_entities(spark.createDataFrame([], "doc_id long, text string")).schema)
    rules = A.plain_rules(A.number_placeholders(e)).orderBy("rule_no").collect()
    assert [(r["val"], r["with_title"]) for r in rules] == [("Jean Dupont", True), ("Jean Dupont", False), ("Dupont", True), ("Dupont", False)]
    schema = "doc_id long, ord int, word string, replacement string, scope string, position int"
    known = spark.createDataFrame([(1, 0, "Ab", "x", "all", None), (1, 1, "c", "y", "all", None)], schema)
    new = spark.createDataFrame([(1, 1, "AB", "z", "all", None), (1, 2, "d", "w", "all", None)], schema)
    got = sorted((r["ord"], r["word"], r["replacement"]) for r in A.register_redactions(known, new).collect())
    assert got[0] == (0, "AB", "z") and got[1] == (1, "c", "y") and got[2][1:] == ("d", "w")


def test_apply_initial(spark):
    e = spark.createDataFrame(entity_batch(entity_rows(1, [Found("Dupont", "NOM")])).to_pandas(), schema=detect_entities(spark.createDataFrame([], "doc_id long, text string")).schema)
    choice = spark.createDataFrame([(1, "Jean", "J.")], "doc_id long, prenom string, initiale string")
    once = A.apply_initial(e, choice)
    twice = A.apply_initial(once, choice.withColumn("initiale", F.lit("JE.")))
    assert [(r["value"], r["type"], r["initialeValue"]) for r in twice.orderBy("ord").collect()] == [("Dupont", "NOM", None), ("Jean", "PRENOM", "JE.")]


def test_one_map_equals_two_steps(spark, texts):
    docs = texts("Monsieur Mahidine BOUCHAABA et Madame Dupont. OUCHAABA, Mabhidine BOUCHAABBA, Bouchaaba.", "", None, "Dupont-Durand Dupont")
    words = frozenset(["monsieur", "madame"])
    two = A.anonymise(docs, detect_entities(docs, words))
    assert sorted(map(str, A.pseudonymise(docs, words).collect())) == sorted(map(str, two.collect()))


def near_pattern(word):
    """A word or what one edit makes of it, as one alternation."""
    letter, cut = "[A-Za-zÀ-ÿ]", [(word[:k], word[k:]) for k in range(len(word) + 1)]
    less = [A.escaped(x + y[1:]) for x, y in cut if y]
    more = [A.escaped(x) + letter + A.escaped(y) for x, y in cut]
    other = [A.escaped(x) + letter + A.escaped(y[1:]) for x, y in cut if y]
    return "(?:" + "|".join([A.escaped(word), *less, *more, *other]) + ")"


def pattern_of(rule):
    step = {"is": A.escaped, "comma?": lambda _: ",?", "gap": lambda _: f"[{A.WS},\\-]+", "near": near_pattern}
    return "".join(step[kind](text) for kind, text in rule.steps)


def test_near_words_equal_the_full_pattern():
    import random
    import re

    rng = random.Random(4)
    for word in ("bouchaaba", "o'connor-smith"):
        full = re.compile(f"{A.E.LEFT_BOUND}(?:{near_pattern(word)}){A.E.RIGHT_BOUND}", re.I)
        rule = A.Rule(word, (A.near_step(word),), "[NOM_1]", False)
        for _ in range(400):
            t = list(word)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(t))
                t[k : k + rng.randrange(2)] = rng.choice(["", "é", "z", "-", "b"])
            text = "x " + "".join(t) + rng.choice([" y", ".", "z", ""])
            assert [m.span() for m in full.finditer(text)] == [(a, b) for a, _, b, _ in A.Matcher([rule], text).matches(text)], text


def test_repeated_ids_leak_nothing_and_null_ids_are_refused(spark):
    """Rows of one id share their entities; rows without one can't be told apart."""
    from ombrage.operators import identity, omissions, parties

    name = "Monsieur Jean DUPONT est venu."
    docs = spark.createDataFrame([(None, name, 1), (3, name, 1), (3, "Monsieur MARTIN et DUPONT.", 1), (4, None, 1)], "doc_id long, text string, ord int")
    found = detect_entities(docs)
    known = docs.where("doc_id IS NOT NULL")
    done = A.anonymise(known, found).collect()
    assert len(done) == 3 and not any("DUPONT" in r["anonymized"] or "MARTIN" in r["anonymized"] for r in done)
    assert not any("DUPONT" in r["value"] for r in omissions.find_omissions(known, found).collect())
    assert parties.detect_parties(known, found).count() >= 0
    cuts = spark.createDataFrame([(None, 0, "venu", "x", "all", None), (3, 0, "venu", "parti", "all", None)], "doc_id long, ord int, word string, replacement string, scope string, position int")
    assert sum("parti" in r["anonymized"] for r in A.anonymise(known, found, cuts).collect()) == 1
    for operator in (A.anonymise, omissions.find_omissions, parties.detect_parties):
        with pytest.raises(Exception, match="without doc_id"):
            operator(docs, found).collect()
    assert {r["doc_id"] for r in identity.resolve(docs, found).collect()} == {None, 3}
    assert not any("DUPONT" in r["anonymized"] for r in A.pseudonymise(docs.where("doc_id IS NULL")).collect())


def plain_substitute(text, entities):
    """One alternation of all rules in order."""
    import re

    rules, _ = A.rules_of(entities)
    title = A.render(A.E.TITLE_BEFORE, "python") + f"[{A.WS}]+"
    whole = "|".join(f"({title if r.with_title else ''})({pattern_of(r)})" for r in rules)
    rx = re.compile(f"{A.E.LEFT_BOUND}(?:{whole}){A.E.RIGHT_BOUND}", re.I)

    def new(m):
        k = m.lastindex // 2 - 1
        r = rules[k]
        return m[2 * k + 1] + (f"{r.initial} {r.placeholder}" if r.combined else r.initial or r.placeholder)

    return rx.sub(new, text)


def test_matcher_equals_one_alternation():
    import random

    rng = random.Random(6)
    names = ["Dupont", "DUPONT", "Dupond", "Jean Dupont", "O'Connor-Smith", "Li", "Bouchaaba", "BOUCHAABA", "Maître Corbeau", "12 Rue Verte", "Émile", "a@b.fr", "Jean", "Marie"]
    glue = [" ", ", ", " Monsieur ", " Mme ", " M. ", "-", "\n", " madame  ", " [", "] ", "x", "_1] ", " et Me. "]
    for _ in range(400):
        entities = [Found(n, rng.choice(["NOM", "ENTITE", "DEMANDEUR_1", "PRENOM"]), aliases=rng.sample(names, rng.randrange(2)), prenom=rng.choice([None, "Jean", "Marie"])) for n in rng.sample(names, rng.randrange(1, 6))]
        text = "".join(rng.choice([n, n.upper(), n.lower(), n[1:], n + "s"]) + rng.choice(glue) for n in rng.choices(names, k=8))
        assert A.substitute(text, entities)[0] == plain_substitute(text, entities), (text, entities)
