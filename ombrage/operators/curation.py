"""Curation of the entity table: every manual step as an operator over parameter
tables. All are joins, filters and windows by document; only pre_detect, which begins
with detection, leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import deaccent, fold, js_trim
from .detection import detect_entities

EMPTY = "array<string>"


def view(entities: DataFrame, kind: str | None = None, search: str = "", ascending: bool | None = None, hide_initials: bool = True) -> DataFrame:
    """The table as shown: type filter, search in value or aliases, French order."""
    out = entities
    if hide_initials and "isInitiale" in entities.columns:
        out = out.where(~F.coalesce("isInitiale", F.lit(False)))
    if kind:
        out = out.where(F.col("type") == kind)
    if search:
        s = search.lower()
        out = out.where(F.contains(F.lower("value"), F.lit(s)) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(s))))
    if ascending is not None:
        key = F.collate("value", "fr_CI_AI")
        out = out.orderBy("doc_id", key.asc() if ascending else key.desc(), "value", "ord")
    return out


def counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("doc_id").agg(F.count_if("active").alias("active"), F.count("*").alias("total"))


def toggle(entities: DataFrame, chosen: DataFrame) -> DataFrame:
    """Entities of chosen(doc_id, id) switch between active and not."""
    return entities.join(chosen.select("doc_id", "id", F.lit(True).alias("_hit")).distinct(), ["doc_id", "id"], "left").withColumn("active", F.when(F.col("_hit"), ~F.col("active")).otherwise(F.col("active"))).select(*entities.columns)


def set_active(entities: DataFrame, active: bool, kind: str | None = None, search: str = "") -> DataFrame:
    """All that the filter shows, switched on or off."""
    shown = F.lit(True) if kind is None else F.col("type") == kind
    if search:
        s = search.lower()
        shown = shown & (F.contains(F.lower("value"), F.lit(s)) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(s))))
    return entities.withColumn("active", F.when(shown, F.lit(active)).otherwise(F.col("active")))


def forms(entities: DataFrame) -> DataFrame:
    """Values and aliases as block-list words."""
    return entities.select(F.explode(F.concat(F.array("value"), F.coalesce("aliases", F.array().cast(EMPTY)))).alias("word"))


def save_block_list(words: DataFrame) -> DataFrame:
    """Trimmed, lower case, no empty word, each once, in order."""
    low = js_trim(F.lower("word"))
    return words.select(low.alias("word")).where("word <> ''").distinct().orderBy("word")


def block(entities: DataFrame, block_list: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen entities go; their forms join the block list."""
    key = chosen.select("doc_id", "id").distinct()
    gone = entities.join(key, ["doc_id", "id"], "left_semi")
    return entities.join(key, ["doc_id", "id"], "left_anti").select(*entities.columns), extend_block_list(block_list, forms(gone))


def extend_block_list(block_list: DataFrame, words: DataFrame) -> DataFrame:
    folded = lambda d: d.select(deaccent(js_trim(F.lower("word"))).alias("word")).where("word <> ''")
    return folded(block_list).union(folded(words)).distinct()


def start_block_list(internal: DataFrame, dictionary: DataFrame, saved: DataFrame) -> DataFrame:
    """(word) lists that detection begins with: the words that name nobody, all words of the
    dictionary, and the saved list, folded, each once."""
    return extend_block_list(extend_block_list(internal, dictionary), saved)


def shrink_block_list(block_list: DataFrame, words: DataFrame) -> DataFrame:
    return block_list.join(words.select(deaccent(js_trim(F.lower("word"))).alias("word")).distinct(), "word", "left_anti")


def delete(entities: DataFrame, chosen: DataFrame) -> DataFrame:
    return entities.join(chosen.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti").select(*entities.columns)


def delete_word(entities: DataFrame, words: DataFrame) -> DataFrame:
    """Without entities whose value or an alias is a word of words(doc_id, word)."""
    hit = entities.select("doc_id", "id", F.explode(F.concat(F.array("value"), "aliases")).alias("f")).select("doc_id", "id", F.lower("f").alias("w")).join(words.select("doc_id", F.lower("word").alias("w")), ["doc_id", "w"], "left_semi")
    return delete(entities, hit)


def bulk_to_block_list(entities: DataFrame, block_list: DataFrame, which: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """which: unchecked, checked or type. Those go and join the block list."""
    hit = {"unchecked": ~F.col("active"), "checked": F.col("active"), "type": F.col("type") == F.lit(kind)}[which]
    return entities.where(~hit), extend_block_list(block_list, forms(entities.where(hit)))


def bulk_remove(entities: DataFrame, which: str, kind: str | None = None) -> DataFrame:
    hit = {"unchecked": ~F.col("active"), "checked": F.col("active"), "type": F.col("type") == F.lit(kind)}[which]
    return entities.where(~hit)


def _once(items: Column, but: Column) -> Column:
    """Items by first lower-cased form, without `but`."""
    step = lambda acc, a: F.when((F.lower(a) == F.lower(but)) | F.exists(acc, lambda x: F.lower(x) == F.lower(a)), acc).otherwise(F.array_append(acc, a))
    return F.aggregate(items, F.array().cast(EMPTY), step)


def merge(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """groups(doc_id, group_no, id, canonical): members become aliases of the canonical
    entity, whose count stays; aliases are united."""
    tagged = entities.join(groups.select("doc_id", "id", "group_no", "canonical"), ["doc_id", "id"], "left")
    inside = tagged.where("group_no IS NOT NULL")
    united = inside.groupBy("doc_id", "group_no").agg(F.array_sort(F.collect_list(F.struct(~F.col("canonical"), "ord", "value", "aliases"))).alias("m"))
    flat = united.select("doc_id", "group_no", F.flatten(F.transform("m", lambda x: F.concat(F.array(x["value"]), x["aliases"]))).alias("_all"), F.col("m")[0]["value"].alias("_own"))
    pivot = inside.where("canonical").join(flat, ["doc_id", "group_no"]).withColumn("aliases", _once(F.col("_all"), F.col("_own"))).select(*entities.columns)
    return tagged.where("group_no IS NULL").select(*entities.columns).unionByName(pivot)


def add_alias(entities: DataFrame, added: DataFrame) -> DataFrame:
    """added(doc_id, id, alias), unless the entity has it."""
    more = added.groupBy("doc_id", "id").agg(F.array_sort(F.collect_list("alias")).alias("_more"))
    return entities.join(more, ["doc_id", "id"], "left").withColumn("aliases", F.when(F.col("_more").isNull(), F.col("aliases")).otherwise(_once(F.concat("aliases", "_more"), F.col("value")))).select(*entities.columns)


def remove_alias(entities: DataFrame, removed: DataFrame) -> DataFrame:
    gone = removed.groupBy("doc_id", "id").agg(F.collect_set("alias").alias("_gone"))
    return entities.join(gone, ["doc_id", "id"], "left").withColumn("aliases", F.when(F.col("_gone").isNull(), F.col("aliases")).otherwise(F.array_except("aliases", "_gone"))).select(*entities.columns)


def change_type(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(doc_id, id, type)."""
    new = changes.select("doc_id", "id", F.col("type").alias("_type"))
    return entities.join(new, ["doc_id", "id"], "left").withColumns({"type": F.coalesce("_type", "type"), "label": F.coalesce("_type", "label")}).select(*entities.columns)


def type_id(label: Column) -> Column:
    """Identifier of a type from its label: Numéro d'écrou gives NUMERO_D_ECROU."""
    plain = F.upper(deaccent(js_trim(label)))
    out = F.regexp_replace(F.regexp_replace(plain, "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "CUSTOM").otherwise(out)


def add_types(types: DataFrame, labels: DataFrame) -> DataFrame:
    new = labels.select(type_id(F.col("label")).alias("id"), js_trim(F.col("label")).alias("label")).where("id <> ''").dropDuplicates(["id"])
    return types.select("id", "label").unionByName(new.join(types.select("id"), "id", "left_anti"))


def remove_types(types: DataFrame, entities: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removed types go, and their entities become names."""
    key = removed.select("id").distinct()
    hit = entities.join(key.select(F.col("id").alias("type"), F.lit(True).alias("_hit")), "type", "left")
    back = hit.withColumns({"type": F.when(F.col("_hit"), "NOM").otherwise(F.col("type")), "label": F.when(F.col("_hit"), "NOM").otherwise(F.col("label"))})
    return types.join(key, "id", "left_anti"), back.select(*entities.columns)


def add_manual(entities: DataFrame, manual: DataFrame) -> DataFrame:
    """manual(doc_id, seq, value, type) go before the first entity, the latest first;
    values that exist already (in any case) are left out."""
    have = entities.select("doc_id", F.lower("value").alias("_low"))
    new = manual.withColumn("_low", F.lower(js_trim(F.col("value")))).where("_low <> ''").join(have, ["doc_id", "_low"], "left_anti")
    once = new.withColumn("_k", F.row_number().over(W.partitionBy("doc_id", "_low").orderBy("seq"))).where("_k = 1")
    first = entities.groupBy("doc_id").agg(F.min("ord").alias("_first"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))
    placed = once.join(first, "doc_id", "left").withColumn("ord", (F.coalesce("_first", F.lit(0)) - n).cast("int"))
    given = {"doc_id": F.col("doc_id"), "ord": F.col("ord"), "id": F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "type", fold(F.col("value"))), 256), "value": js_trim(F.col("value")), "type": F.col("type"), "label": F.col("type"), "occurrences": F.lit(0), "aliases": F.array().cast(EMPTY), "active": F.lit(True), "blocked": F.lit(False)}
    return entities.unionByName(placed.select(*[given.get(c, F.lit(None)).cast(entities.schema[c].dataType).alias(c) for c in entities.columns]))


def append_new(entities: DataFrame, found: DataFrame, repeats: bool = False) -> DataFrame:
    """Found entities whose value the document doesn't have yet, in any case, after
    those it has; of found ones with one value the first, or all (repeats).

    Both tables meet in windows after one shuffle by document, and not in joins: what
    comes out of a map looks small to Catalyst, which would broadcast it."""
    both = entities.withColumn("_new", F.lit(False)).unionByName(found.select(*entities.columns).withColumn("_new", F.lit(True))).withColumn("_low", F.lower("value"))
    rows = both.repartition("doc_id")
    known = F.col("doc_id").isNotNull()  # rows without an id, or without a value, have nothing in common
    same, here = W.partitionBy("doc_id", "_low"), W.partitionBy("doc_id")
    have = F.coalesce(F.bool_or(~F.col("_new")).over(same) & known & F.col("_low").isNotNull(), F.lit(False))
    rows = rows.withColumns({"_have": have, "_k": F.row_number().over(W.partitionBy("doc_id", "_low", "_new").orderBy("ord"))})
    left = rows.where("NOT _new OR NOT _have" if repeats else "NOT _new OR NOT _have AND _k = 1")
    last = F.when(known, F.max(F.when(~F.col("_new"), F.col("ord"))).over(here))
    n = F.row_number().over(W.partitionBy("doc_id", "_new").orderBy("ord"))
    placed = left.withColumns({"_last": last, "_n": n}).withColumn("ord", F.when(F.col("_new"), (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast("int")).otherwise(F.col("ord")))
    return placed.select(*entities.columns)


def pre_detect(ingested: DataFrame, entities: DataFrame, block_list: frozenset[str] = frozenset()) -> DataFrame:
    """What detection finds in the working text (rawText) of ingested documents, after the
    entities that are there; what has one of their values, in any case, is left out."""
    return append_new(entities, detect_entities(ingested, block_list, "rawText"), repeats=True)


def merge_concordance(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(doc_id, seq, value, type, label, aliases): an existing value unites its
    aliases, another is appended as a manual entity."""
    key = lambda d: d.withColumn("_low", F.lower(js_trim(F.col("value"))))
    mine, theirs = key(entities), key(rows).where("_low <> ''")
    more = theirs.groupBy("doc_id", "_low").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "aliases"))), lambda x: x["aliases"])).alias("_more"))
    united = mine.join(more, ["doc_id", "_low"], "left").withColumn("aliases", F.when(F.col("_more").isNull(), F.col("aliases")).otherwise(_once(F.concat("aliases", "_more"), F.lit("")))).select(*entities.columns)
    new = theirs.join(mine.select("doc_id", "_low"), ["doc_id", "_low"], "left_anti").withColumn("_k", F.row_number().over(W.partitionBy("doc_id", "_low").orderBy("seq"))).where("_k = 1").drop("aliases").join(more, ["doc_id", "_low"])
    last = entities.groupBy("doc_id").agg(F.max("ord").alias("_last"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))
    placed = new.join(last, "doc_id", "left").withColumn("ord", (F.coalesce("_last", F.lit(-1)) + n).cast("int"))
    kind = F.coalesce("type", F.lit("NOM"))
    given = {"doc_id": F.col("doc_id"), "ord": F.col("ord"), "id": F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), kind, "_low"), 256), "value": js_trim(F.col("value")), "type": kind, "label": F.coalesce("label", kind), "occurrences": F.lit(0), "aliases": _once(F.col("_more"), F.lit("")), "active": F.lit(True), "blocked": F.lit(False)}
    return united.unionByName(placed.select(*[given.get(c, F.lit(None)).cast(entities.schema[c].dataType).alias(c) for c in entities.columns]))
