"""Resolution of variant spellings to one identity, per document.

Everything is said on relations: an entity has a key of identity, rows of one key are
one person, and a person's aliases are the distinct forms of an ordered list of what these
rows bring. Nothing is decided in a loop, and no document's entities meet in one row: after
one shuffle by document all steps are windows and groups within it.

* Equal type and folded value: one entity, in the first one's spelling.
* A full name's key is its first word and its surname. A single name takes the key of the
  full name that alone in the document has it as surname, else its own.
* A person's value is the first of its longest full names, in words.
* A form becomes an alias where its folded form is new and isn't the value that the person
  has by then.
* Couples are matches in the text, joined with the persons that they name.

Null is a document like any other. Entities of documents that aren't among docs are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import entity_rules as E
from ..functions.text import fold, py_fold, render, title_case
from .cleaning import once
from .detection import ENTITY

# ── Names ────────────────────────────────────────────────────────────────────

_TITLES_RX = "^(?:(?:" + "|".join(sorted((t.replace(".", "\\.") for t in E.TITLES), key=lambda t: (-len(t), t))) + ") )+"


def bare_key(value: Column) -> Column:
    """Folded value without leading titles; a value of titles only is empty."""
    return untitled(fold(value))


def untitled(key: Column) -> Column:
    """A folded value without leading titles."""
    return F.trim(F.regexp_replace(F.concat(key, F.lit(" ")), _TITLES_RX, ""))


def surname_key(value: Column) -> Column:
    parts = F.filter(F.split(bare_key(value), " "), lambda p: ~p.isin(*sorted(E.PARTICLES)) & (p != ""))
    return F.coalesce(F.element_at(F.when(F.size(parts) > 0, parts), -1), F.lit(""))


def words_of(key: Column) -> Column:
    """Words of a folded name; an empty one has none."""
    return F.filter(F.split(key, " "), lambda w: w != "")


def person_like() -> Column:
    """An active name of one to four words (_said, folded _keys) that all look like parts of
    a name."""
    token = F.lit(f"\\A(?:{render(E.NAME_TOKEN)})\\z")
    fine = F.forall("_said", lambda p: F.rlike(p, token)) & ~F.exists("_keys", lambda k: k.isin(*sorted(E.TITLES | E.COUPLE_WORDS)))
    return F.col("active") & ~F.col("blocked") & (F.col("type") == "NOM") & F.size("_keys").between(1, 4) & fine


def document() -> Column:
    """What rows of one document share; null is an id too."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))


def id_column(kind: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.col("_d"), kind, fold(value)), 256)


NAMES = "array<string>"


# ── Identities ───────────────────────────────────────────────────────────────


def displayed(entities: DataFrame) -> DataFrame:
    """Entities in display spelling, one row by type and folded value: own holds the
    first one's aliases, more what the others have."""
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("NOM"))
    aliases = F.filter(F.transform(F.coalesce("aliases", F.array().cast(NAMES)), title_case), lambda a: a != "")
    rows = entities.select(
        "doc_id", document().alias("_d"), "ord", title_case(F.coalesce("value", F.lit(""))).alias("value"), kind.alias("type"), F.coalesce(F.nullif("label", F.lit("")), kind).alias("label"),
        F.coalesce(F.nullif("occurrences", F.lit(0)), F.lit(1)).alias("occurrences"), aliases.alias("aliases"), F.coalesce("active", F.lit(True)).alias("active"), F.coalesce("blocked", F.lit(False)).alias("blocked"),
    ).where("value <> ''")
    first = lambda c: F.min_by(c, "ord").alias(c)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("ord", "aliases"))), lambda x: x["aliases"])
    one = rows.repartition("_d").groupBy("_d", "type", fold(F.col("value")).alias("_key")).agg(first("doc_id"), F.min("ord").alias("ord"), first("value"), first("label"), F.max("occurrences").alias("occurrences"), first("active"), first("blocked"), lists.alias("_lists"))
    return one.select("*", F.element_at("_lists", 1).alias("own"), F.flatten(F.slice("_lists", 2, F.size("_lists"))).alias("more")).drop("_lists")


def identified(one: DataFrame) -> DataFrame:
    """Adds person, the identity _g, and the place (_lead) of the full name, or of the
    first row, that a row comes with."""
    rows = one.withColumn("_bare", untitled(F.col("_key"))).withColumn("_keys", words_of(F.col("_bare")))
    said = F.split("value", " ")  # display spelling has single spaces, so words stand as the folded ones do
    named = F.filter("_keys", lambda k: ~k.isin(*sorted(E.PARTICLES)))
    rows = rows.withColumns({"_said": F.slice(said, F.size(said) - F.size("_keys") + 1, F.size("_keys")), "_surname": F.coalesce(F.element_at(F.when(F.size(named) > 0, named), -1), F.lit(""))})
    rows = rows.withColumn("person", person_like()).withColumn("_words", F.when(F.col("person"), F.size("_keys")).otherwise(0))
    full, single = F.col("_words") >= 2, F.col("_words") == 1
    named = F.when(full, F.concat_ws("\x01", F.lit("full"), F.element_at(words_of(F.col("_bare")), 1), F.col("_surname")))
    rows = rows.withColumns({"_named": named, "_name": F.when(full, F.col("_surname")).when(single, F.col("_bare"))})
    # A single name is held against the full names of that surname: alone is what all agree on.
    near = W.partitionBy("_d", "_name")
    told = lambda c: F.when(full, F.col(c))
    alone = F.min(told("_bare")).over(near) == F.max(told("_bare")).over(near)
    owner, owner_lead = F.min(told("_named")).over(near), F.min(told("ord")).over(near)
    of = F.when(full, F.col("_named")).when(single & alone, owner).when(single, F.concat_ws("\x01", F.lit("single"), F.col("_bare"))).otherwise(F.concat_ws("\x01", F.lit("other"), "type", "_key"))
    rows = rows.withColumns({"_g": of, "_owner_lead": F.when(single & alone, owner_lead)})
    lead = F.when(full, F.min("ord").over(W.partitionBy("_d", "_g", "_bare"))).otherwise(F.coalesce("_owner_lead", F.min("ord").over(W.partitionBy("_d", "_g"))))
    return rows.withColumn("_lead", lead).drop("_named", "_name", "_owner_lead")


def forms_of(said: Column, keys: Column) -> Column:
    """The further forms of a person, given the words of its name and these folded: structs of
    the form and its folded key, in order. First name and surname, titled, inverted."""
    low = lambda form: py_fold(form.replace("{}", "")) + " "

    def forms(p: Column) -> Column:
        said, keys = p["said"], p["keys"]
        plain = F.filter(F.zip_with(said, keys, lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda x: ~x["k"].isin(*sorted(E.PARTICLES)))
        last, first = F.element_at(F.when(F.size(plain) > 0, plain), -1), F.struct(F.element_at(said, 1).alias("w"), F.element_at(keys, 1).alias("k"))
        whole = F.struct(F.array_join(said, " ").alias("w"), F.array_join(keys, " ").alias("k"))
        form = lambda text, key: F.struct(text.alias("alias"), key.alias("key"), F.lit(False).alias("own"))
        titled = lambda f, x: form(F.concat(F.lit(f.replace("{}", "")), x["w"]), F.concat(F.lit(low(f)), x["k"]))
        some = [form(first["w"], first["k"]), *(F.when(F.size(plain) > 0, y) for y in (form(last["w"], last["k"]), *(titled(f, last) for f in E.SURNAME_ALIASES)))]
        inverted = form(F.concat_ws(" ", last["w"], first["w"]), F.concat_ws(" ", last["k"], first["k"]))
        several = F.array(form(whole["w"], whole["k"]), inverted, *(titled(f, whole) for f in E.FULL_NAME_ALIASES))
        none = F.filter(F.array(form(first["w"], first["k"])), lambda _: F.lit(False))
        return F.when(F.size(said) == 0, none).otherwise(F.concat(F.filter(F.array(*some), lambda x: x.isNotNull()), F.when(F.size(said) >= 2, several).otherwise(none)))

    return once(F.struct(said.alias("said"), keys.alias("keys")), forms)


def merged(rows: DataFrame) -> DataFrame:
    """One row an identity: its value, its aliases, and those that stand for it alone."""
    of = W.partitionBy("_d", "_g")
    leads = F.when(F.col("ord") == F.col("_lead"), F.struct("_words", (-F.col("_lead")).alias("at"), "value", "_key", "_said", "_keys", "_surname"))
    until = F.max(leads).over(of.orderBy("_lead").rangeBetween(W.unboundedPreceding, W.currentRow))
    first = (F.col("ord") == F.col("_lead")) & (F.col("_lead") == F.min("_lead").over(of))
    rows = rows.withColumns({"_then": until["_key"], "_now": F.max(leads).over(of), "_first": first})
    # What a row brings: its value and its aliases, those of the first row without condition.
    said = F.transform(F.concat(F.array("value"), "own", "more"), lambda a, i: F.struct(a.alias("alias"), F.when(i == 0, F.col("_key")).otherwise(fold(a)).alias("key"), (F.col("_first") & i.between(1, F.size("own"))).alias("own")))
    fine = F.filter(said, lambda e: e["own"] | (e["key"] != F.col("_then")))
    place = F.struct("_lead", (F.col("_words") == 1).alias("single"), "ord")
    lead = lambda c: F.min_by(c, place).alias(c)
    brought = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), fine.alias("fine")))), lambda x: x["fine"]))
    whole = rows.groupBy("_d", "_g").agg(*map(lead, ("doc_id", "type", "label", "active", "blocked", "person")), F.first("_now").alias("_now"), F.max("occurrences").alias("occurrences"), F.struct(F.startswith("_g", F.lit("single")).cast("int").alias("a"), F.min("_lead").alias("b")).alias("_place"), brought.alias("_brought"))
    more = F.filter(forms_of(F.col("_now._said"), F.col("_now._keys")), lambda e: e["key"] != F.col("_now._key"))
    told = F.when(F.col("person"), F.concat("_brought", more)).otherwise(F.col("_brought"))
    # The first row's own come first, so that a form's first place decides.
    distinct = lambda all_: once(F.transform(all_, lambda x: x["key"]), lambda keys: F.filter(all_, lambda e, i: e["own"] | (F.array_position(keys, e["key"]) == i + 1)))
    whole = whole.withColumn("_once", once(told, distinct)).withColumns({"value": F.col("_now.value"), "_key": F.col("_now._key"), "_surname": F.when(F.col("person"), F.col("_now._surname"))})
    whole = whole.withColumns({"aliases": F.transform("_once", lambda e: e["alias"]), "_akeys": F.transform("_once", lambda e: e["key"])})
    shared = (F.count("*").over(W.partitionBy("_d", "_surname")) > 1) & (F.col("_surname") != "")
    alone = F.transform(F.filter("_once", lambda e: untitled(e["key"]) != F.col("_surname")), lambda e: e["alias"])
    return whole.withColumn("kept", F.when(shared, alone).otherwise(F.col("aliases"))).drop("_brought", "_once", "_now")


# ── Couples ──────────────────────────────────────────────────────────────────

#: A row of what is looked up within a document: an entity, a key that persons have, or
#: what a couple in the text needs. Rows meet by (by, key).
WHO = "struct<place:struct<a:int,b:int>,id:string,form:string>"
COUPLE = "struct<at:struct<rule:int,i:int>,value:string,name:string>"
ROW = f"array<struct<role:string,by:string,key:string,side:int,who:{WHO},couple:{COUPLE}>>"


def _row(role: str, by: str, key: Column, side: int = 0, who: Column | None = None, couple: Column | None = None) -> Column:
    nothing = F.lit(None)
    return F.struct(F.lit(role).alias("role"), F.lit(by).alias("by"), key.alias("key"), F.lit(side).alias("side"), (nothing if who is None else who).cast(WHO).alias("who"), (nothing if couple is None else couple).cast(COUPLE).alias("couple"))


def _couples_by(rule: int, pattern: str, ignore: bool, text: Column) -> Column:
    """What the couples that one pattern finds in a text need."""
    rx = render(pattern, "java", ignore)
    untitled = lambda m: ~F.exists(F.array(F.regexp_extract(m, rx, 1), F.regexp_extract(m, rx, 2)), lambda w: fold(w).isin(*sorted(E.TITLES)))

    def needs(m: Column, i: Column) -> Column:
        def rows(names: Column) -> Column:
            name = F.element_at(names, -1)
            if rule == 0:
                first = [F.element_at(names, k) for k in (1, 2)]
                value = F.concat(first[0], F.lit(" et "), first[1], F.lit(" "), name)
                wanted = [("form", bare_key(F.concat_ws(" ", x, name)), k) for k, x in enumerate(first)]
            else:
                value = F.concat(F.lit("Monsieur et Madame " if rule == 1 else "Les époux "), name)
                wanted = [("surname", fold(name), 0)]
            couple = F.struct(F.struct(F.lit(rule).alias("rule"), i.alias("i")).alias("at"), value.alias("value"), name.alias("name"))
            return F.array(_row("need", "known", fold(value), -1, None, couple), *[_row("need", by, key, side, None, couple) for by, key, side in wanted])

        return once(F.transform(F.array(*[F.regexp_extract(m, rx, k) for k in ((1, 2, 3) if rule == 0 else (1,))]), title_case), rows)

    found = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    return F.flatten(F.transform(F.filter(found, untitled) if rule == 0 else found, needs)).cast(ROW)


def _needs(docs: DataFrame, text: str) -> DataFrame:
    """A row a document, and those that its couples need: the members by a folded name or
    by a surname, and whether the couple is known."""
    body = F.coalesce(F.col(text), F.lit(""))
    parts = [_couples_by(rule, pattern, ignore, body) for rule, (pattern, ignore) in enumerate(E.RESOLVED_COUPLES)]
    return docs.select("doc_id", document().alias("_d"), F.explode(F.concat(F.array(_row("document", "", F.lit(""))).cast(ROW), *parts)).alias("r"))


def _keys(whole: DataFrame) -> DataFrame:
    """A row an entity, and those by which persons and known couples are found."""
    who = F.struct(F.col("_place").alias("place"), F.sha2(F.concat_ws("|", "_d", "type", "_key"), 256).alias("id"), F.col("value").alias("form"))
    forms = F.array_distinct(F.transform(F.concat(F.array("_key"), "_akeys"), untitled))
    person = F.concat(F.transform(forms, lambda k: _row("key", "form", k, 0, who)), F.array(_row("key", "surname", F.col("_surname"), 0, who)))
    known = F.array(_row("key", "known", untitled(F.col("_key"))))
    keys = F.when(F.col("person"), person.cast(ROW)).when(F.col("type") == "COUPLE", known.cast(ROW)).otherwise(F.array().cast(ROW))
    return whole.withColumn("r", F.explode(F.concat(F.array(_row("entity", "entity", F.col("_g"), 0, who)).cast(ROW), keys)))


def resolve(docs: DataFrame, entities: DataFrame, prefix: str = "COUPLE", text: str = "text") -> DataFrame:
    """Resolved entities of every document that has some, in order: others, people,
    known couples, new couples. First names do not come through, by specification."""
    whole = merged(identified(displayed(entities)))
    rows = _keys(whole).unionByName(_needs(docs, text), allowMissingColumns=True).select("*", "r.*").drop("r", "_akeys", "_surname", "aliases").repartition("_d")
    met, here = W.partitionBy("_d", "by", "key"), W.partitionBy("_d")
    key, is_role = F.when(F.col("role") == "key", F.col("who")), lambda x: F.max(F.col("role") == x)
    one = F.when(F.col("by") == "form", F.array(F.min(key).over(met))).when(F.col("by") == "surname", F.array_sort(F.collect_list(key).over(met)))
    found = rows.withColumns({"_who": F.filter(one, lambda w: w.isNotNull()), "_known": is_role("key").over(met) & (F.col("by") == "known"), "_whole": is_role("document").over(here) & is_role("entity").over(here)})
    found = found.where("_whole AND role IN ('entity', 'need')").withColumn("_key", F.when(F.col("role") == "entity", F.concat(F.lit("entity "), "_g")).otherwise(F.concat(F.lit("couple "), fold(F.col("couple.value")))))
    # Of a couple met several times the first counts; each side's members in order.
    only = F.col("couple.at") == F.min("couple.at").over(W.partitionBy("_d", "_key"))
    own = lambda c: F.first(c, ignorenulls=True).alias(c)
    members = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") >= 0, F.struct("side", "_who")))), lambda x: x["_who"]))
    found = found.withColumn("_id", F.when(F.col("role") == "entity", F.col("who.id")))
    carried = ("_id", "type", "label", "active", "blocked", "value", "occurrences", "kept", "person", "couple", "_place")
    done = found.withColumn("_only", F.coalesce(only, F.lit(True))).where("_only").groupBy("_d", "_key").agg(*map(own, ("doc_id", *carried)), F.max("_known").alias("_known"), members.alias("who"))
    new = F.col("couple").isNotNull()
    templates = [F.array(*[F.replace(F.lit(t), F.lit("{}"), F.col("couple.name")) for t in some]) for some in E.RESOLVED_COUPLE_ALIASES]
    value = title_case(F.col("couple.value"))
    given = F.when(F.col("couple.at.rule") == 0, templates[0]).when(F.col("couple.at.rule") == 1, templates[1]).otherwise(templates[2])
    told = F.filter(F.transform(F.concat(given, F.transform("who", lambda w: w["form"])), title_case), lambda a: (a != "") & (fold(a) != fold(value)))
    distinct = F.filter(told, lambda a, i: F.array_position(F.transform(told, fold), fold(a)) == i + 1)
    section = F.when(new, 3).when(F.col("person"), 1).when(F.col("type") == "COUPLE", 2).otherwise(0)
    place = F.when(new, F.struct(F.col("couple.at.rule").alias("a"), F.col("couple.at.i").alias("b"))).otherwise(F.col("_place"))
    made = {"value": value, "type": F.lit(prefix), "label": F.lit(prefix), "occurrences": F.lit(1), "aliases": distinct, "active": F.lit(True), "blocked": F.lit(False)}
    shown = done.where("couple IS NULL OR NOT _known").withColumns({c: F.when(new, x).otherwise(F.col("kept" if c == "aliases" else c)) for c, x in made.items()} | {"_section": section, "_order": place, "members": F.when(new, F.transform(F.slice("who", 1, 2), lambda w: w["id"])).otherwise(F.array().cast(NAMES))})
    ranked = shown.withColumn("ord", F.row_number().over(W.partitionBy("_d").orderBy("_section", "_order")) - 1)
    nothing = F.lit(None).cast("string")
    out = {"id": F.coalesce("_id", id_column(F.col("type"), F.col("value"))), "prenom": nothing, "prenomVariants": F.array().cast(NAMES), "isInitiale": F.lit(False), "initialeValue": nothing}
    names = [(c.split()[0], c.split()[1]) for c in ENTITY.split(", ")]
    return ranked.select(*[out.get(c, F.col(c)).cast(t).alias(c) for c, t in names])


# ── Parts of resolution by themselves ────────────────────────────────────────

def exact_duplicates(entities: DataFrame) -> DataFrame:
    """One row by (doc_id, type, folded value): the first one's value, the highest
    count, all aliases once by folded form in order."""
    key = [F.col("doc_id"), F.col("type"), fold(F.col("value")).alias("key")]
    grouped = entities.groupBy(*key).agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord"), F.max("occurrences").alias("occurrences"), F.array_sort(F.collect_list(F.struct("ord", "aliases"))).alias("all"))
    flat = F.flatten(F.transform("all", lambda x: x["aliases"]))
    once = F.aggregate(flat, F.array().cast("array<string>"), lambda acc, a: F.when((fold(a) == F.col("key")) | F.exists(acc, lambda x: fold(x) == fold(a)), acc).otherwise(F.array_append(acc, a)))
    return grouped.select("doc_id", "type", "value", "ord", "occurrences", once.alias("aliases"))


def attach_singles(people: DataFrame) -> DataFrame:
    """(doc_id, ord, value) to the same with owner: for a single name the full name that
    alone in the document has it as its surname, else null."""
    keyed = people.select("doc_id", "ord", "value", bare_key(F.col("value")).alias("key"), surname_key(F.col("value")).alias("surname")).withColumn("words", F.size(F.split("key", " ")))
    full = keyed.where("words >= 2").dropDuplicates(["doc_id", "key"])
    n = F.count("*").over(W.partitionBy("doc_id", "surname"))
    alone = full.withColumn("n", n).where("n = 1").select("doc_id", F.col("surname").alias("single"), F.col("key").alias("owner"))
    single = keyed.withColumn("single", F.when(F.col("words") == 1, F.col("key")))
    return single.join(alone, ["doc_id", "single"], "left").select("doc_id", "ord", "value", "owner")


def surname_groups(people: DataFrame) -> DataFrame:
    """Suggestions: surnames of two letters and more that several share, with members
    in order."""
    keyed = people.withColumn("surname", surname_key(F.col("value"))).where(F.length("surname") >= 2)
    grouped = keyed.groupBy("doc_id", "surname").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("members"))
    return grouped.where("n >= 2").select("doc_id", "surname", "n", F.transform("members", lambda m: m["value"]).alias("members"))


def ambiguous_aliases(people: DataFrame) -> DataFrame:
    """(doc_id, ord, value, aliases) with aliases that stand for a shared surname gone."""
    s = surname_key(F.col("value"))
    keyed = people.withColumn("_s", s).withColumn("_n", F.count("*").over(W.partitionBy("doc_id", "_s")))
    kept = F.when((F.col("_s") != "") & (F.col("_n") > 1), F.filter("aliases", lambda a: bare_key(a) != F.col("_s"))).otherwise(F.col("aliases"))
    return keyed.withColumn("aliases", kept).drop("_s", "_n")


def apply_parties(entities: DataFrame, parties: DataFrame) -> DataFrame:
    """Entities with type and label of the side that parties(doc_id, side, ordre,
    entity_id) gives them; of two declarations that for the defence, then the later."""
    names = F.create_map(*[F.lit(x) for kv in E.SIDES.items() for x in kv])
    role = F.concat(F.element_at(names, F.col("side")), F.lit("_"), F.col("ordre").cast("string"))
    last = parties.groupBy("doc_id", F.col("entity_id").alias("id")).agg(F.max_by(role, F.struct(F.col("side") == "defendeurs", "ordre")).alias("_role"))
    return entities.join(last, ["doc_id", "id"], "left").withColumns({"type": F.coalesce("_role", "type"), "label": F.coalesce("_role", "label")}).drop("_role").select(*entities.columns)
