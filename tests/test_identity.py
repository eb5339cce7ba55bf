import pytest

from ombrage.functions.text import py_fold
from ombrage.operators import identity as I

ENTITIES = "doc_id long, ord int, value string, type string, label string, occurrences int, aliases array<string>, active boolean, blocked boolean, members string"


@pytest.fixture
def resolve(spark):
    """Names, or (name, type, occurrences, aliases), and a text to resolved rows in order."""

    def run(names, text="", doc_id=1):
        rows = [(doc_id, k, n, "NOM", "", 1, [], True, False, "x") if isinstance(n, str) else (doc_id, k, n[0], n[1], "", n[2], n[3], True, False, "x") for k, n in enumerate(names)]
        docs = spark.createDataFrame([(doc_id, text, "x"), (7, "les époux Nul Part", "x")], "doc_id long, text string, _g string")
        return sorted(I.resolve(docs, spark.createDataFrame(rows, ENTITIES)).collect(), key=lambda r: r["ord"])

    return run


def test_unique_surname_attaches(resolve):
    out = resolve(["Jean Dupont", "Dupont"])
    assert [e["value"] for e in out] == ["Jean Dupont"]
    assert "Dupont" in out[0]["aliases"]


def test_shared_surname_stays_apart(resolve):
    out = resolve(["Jean Dupont", "Marie Dupont", "Dupont"])
    assert [e["value"] for e in out] == ["Jean Dupont", "Marie Dupont", "Dupont"]
    assert all(py_fold(a).split()[-1] != "dupont" or len(py_fold(a).split()) > 2 or py_fold(a).split()[0] in ("jean", "marie") for e in out for a in e["aliases"])


def test_longest_name_leads_and_order_decides_aliases(resolve):
    out = resolve([("Jean Dupont", "NOM", 2, ["J. Dupont"]), ("SARL Dupont", "ENTITE", 1, []), ("Jean Marie Dupont", "NOM", 5, ["Jeannot"]), ("monsieur Jean Dupont", "NOM", 1, ["J. DUPONT", "Jo"]), ("jean dupont", "NOM", 9, ["Ji"])])
    assert [(e["value"], e["type"], e["occurrences"]) for e in out] == [("Sarl Dupont", "ENTITE", 1), ("Jean Marie Dupont", "NOM", 9)]
    assert out[1]["aliases"][:6] == ["J. Dupont", "Ji", "Monsieur Jean Dupont", "Jo", "Jeannot", "Jean"]


def test_couples(resolve):
    out = resolve(["Jean Dupont"], "Monsieur et Madame Dupont ; les époux Martin")
    couple = next(e for e in out if e["value"] == "Monsieur Et Madame Dupont")
    assert couple["type"] == "COUPLE" and couple["members"] == [out[0]["id"]]
    assert couple["aliases"] == ["M. Et Mme Dupont", "Les Époux Dupont", "Le Couple Dupont", "Les Conjoints Dupont", "Jean Dupont"]
    assert any(e["value"] == "Les Époux Martin" for e in out)


def test_couples_of_two_known_members_and_known_couples(resolve):
    out = resolve(["Jean Dupont", "Marie Dupont", ("Les Époux Martin", "COUPLE", 1, [])], "Marie et Jean Dupont, Marie et Jean Dupont ; les époux Martin ; Monsieur et Madame Dupont")
    assert [e["value"] for e in out] == ["Jean Dupont", "Marie Dupont", "Les Époux Martin", "Marie Et Jean Dupont", "Monsieur Et Madame Dupont"]
    assert out[3]["members"] == [out[1]["id"], out[0]["id"]] and out[4]["members"] == [out[0]["id"], out[1]["id"]]


def test_no_name_no_document(resolve):
    assert [e["value"] for e in resolve(["Monsieur", "12", "Jean", ("", "NOM", 1, [])])] == ["Monsieur", "12", "Jean"]
    assert [e["doc_id"] for e in resolve(["Jean Dupont"], "les époux Dupont", None)] == [None, None]
    assert [e["value"] for e in resolve([])] == []


def test_set_based_forms(spark):
    people = spark.createDataFrame([(1, 0, "Jean Dupont"), (1, 1, "Dupont"), (1, 2, "Marie de la Tour"), (1, 3, "Monsieur Tour")], "doc_id long, ord int, value string")
    got = {r["ord"]: r["owner"] for r in I.attach_singles(people).collect()}
    assert got == {0: None, 1: "jean dupont", 2: None, 3: "marie de la tour"}
    groups = {r["surname"]: r["members"] for r in I.surname_groups(people).collect()}
    assert groups == {"dupont": ["Jean Dupont", "Dupont"], "tour": ["Marie de la Tour", "Monsieur Tour"]}


def test_exact_duplicates(spark):
    e = spark.createDataFrame([(1, 0, "NOM", "Lapres", 1, ["X"]), (1, 1, "NOM", "LAPRÈS", 4, ["x", "Y"])], "doc_id long, ord int, type string, value string, occurrences int, aliases array<string>")
    r = I.exact_duplicates(e).first()
    assert (r["value"], r["occurrences"], r["aliases"]) == ("Lapres", 4, ["X", "Y"])
