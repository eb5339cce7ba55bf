"""Importing entities, block lists, concordances, types, rules and sessions.

Files are read whole as text, one row a file, and taken apart with columns, so a
folder of a million small imports is one scan. Imports of entities are
(doc_id, seq, value, type, label, aliases, active, blocked); which rows join a table
is a join in operators.curation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import js_trim
from ..operators.curation import type_id

ENTITY_JSON = "array<struct<placeholder:string,value:string,type:string,label:string,aliases:array<string>,active:boolean,blocked:boolean,occurrences:int>>"
RULE_JSON = "array<struct<id:string,from:string,to:string,caseSensitive:boolean,createdAt:bigint>>"


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of the text files at path, without a byte order mark."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("filename"), F.regexp_replace("value", "\\A\ufeff", "").alias("content"))
    return raw


def _lines(content: Column, skip: Column) -> Column:
    """Fields of the lines after the first `skip`, which is found once and not by line."""
    lines = F.split(content, "\n")
    return F.transform(F.slice(lines, skip + 1, F.size(lines)), lambda x: F.split(x, ";"))


def _text(field: Column) -> Column:
    return js_trim(F.coalesce(field, F.lit("")))


def _unquoted(field: Column) -> Column:
    return F.regexp_replace(_text(field), '^"|"$', "")


def _entity(value: Column, kind: Column, aliases: Column) -> Column:
    kind = F.when(kind != "", kind).otherwise("NOM")
    return F.struct(value.alias("value"), kind.alias("type"), kind.alias("label"), aliases.alias("aliases"), F.lit(True).alias("active"), F.lit(False).alias("blocked"))


def _parts(text: Column, separator: str) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(text, separator), js_trim), lambda a: a != ""))


def _json(content: Column) -> Column:
    return F.transform(
        F.coalesce(F.from_json(content, ENTITY_JSON), F.array().cast(ENTITY_JSON)),
        lambda e: F.struct(e["value"].alias("value"), F.coalesce(e["type"], F.lit("NOM")).alias("type"), F.coalesce(e["label"], e["type"], F.lit("NOM")).alias("label"), F.coalesce(e["aliases"], F.array().cast("array<string>")).alias("aliases"), F.coalesce(e["active"], F.lit(True)).alias("active"), F.coalesce(e["blocked"], F.lit(False)).alias("blocked")),
    )


def _rows(files: DataFrame, entities: Column, keep_blocked: bool) -> DataFrame:
    """One row an entity with a value; of equal values, in any case, the first."""
    out = files.select("doc_id", F.posexplode(entities).alias("seq", "e")).select("doc_id", "seq", "e.*").where(js_trim(F.coalesce("value", F.lit(""))) != "")
    out = out if keep_blocked else out.where("NOT blocked")
    place = F.row_number().over(W.partitionBy("doc_id", F.lower("value")).orderBy("seq"))
    return out.withColumn("_place", place).where("_place = 1").drop("_place")


def is_json(name: str = "filename") -> Column:
    return F.endswith(F.lower(F.col(name)), F.lit(".json"))


def import_entities(files: DataFrame) -> DataFrame:
    """(doc_id, filename, content): JSON, or CSV with a header and aliases divided by
    commas. Blocked entities stay out."""
    csv = F.transform(_lines(F.col("content"), F.lit(1)), lambda p: _entity(_text(F.get(p, 0)), _text(F.get(p, 1)), _parts(_text(F.get(p, 2)), ",")))
    return _rows(files, F.when(is_json(), _json(F.col("content"))).otherwise(csv), False)


def import_step_entities(files: DataFrame) -> DataFrame:
    """The other profile: the header is optional, values may be quoted, aliases are
    divided by ' | ', and blocked says nothing."""
    head = F.when(F.contains(F.lower(F.substring_index("content", "\n", 1)), F.lit("valeur")), 1).otherwise(0)
    csv = F.transform(_lines(F.col("content"), head), lambda p: _entity(_unquoted(F.get(p, 0)), _text(F.get(p, 1)), _parts(F.regexp_replace(F.coalesce(F.get(p, 2), F.lit("")), '^"|"$', ""), " \\| ")))
    whole = F.transform(_json(F.col("content")), lambda e: _entity(e["value"], e["type"], e["aliases"]))
    return _rows(files, F.when(is_json(), whole).otherwise(csv), True)


def import_concordance(files: DataFrame) -> DataFrame:
    """A concordance or an entity list. With a header that names placeholders a row is
    placeholder; value; aliases; type, taken by place: in an exported concordance the
    fourth field is the replaced forms, and it is read as the type all the same."""
    full = F.filter(F.split("content", "\n"), lambda x: js_trim(x) != "")
    marked = F.contains(F.lower(F.element_at(full, 1)), F.lit("placeholder"))
    parts = F.transform(F.filter(full, lambda x, i: i >= 1), lambda x: F.transform(F.split(x, ";"), _unquoted))
    field = lambda p, k: F.coalesce(F.get(p, k), F.lit(""))
    of = lambda value, kind: F.transform(parts, lambda p: _entity(field(p, value), field(p, kind), _parts(field(p, 2), "\\|")))
    csv = F.when(marked, of(1, 3)).otherwise(of(0, 1))
    out = files.select("doc_id", F.posexplode(F.when(is_json(), _json(F.col("content"))).otherwise(csv)).alias("seq", "e")).select("doc_id", "seq", "e.*")
    return out.where(js_trim(F.coalesce("value", F.lit(""))) != "")


def import_block_list(files: DataFrame) -> DataFrame:
    """(filename, content) to words: a JSON array, the keys of a JSON object, or CSV and
    text divided at line ends, commas and semicolons, words of two characters up."""
    array = F.from_json("content", "array<string>")
    keys = F.json_object_keys("content")
    text = F.filter(F.transform(F.split("content", "[\n,;]+"), js_trim), lambda w: F.length(w) > 1)
    array_like = F.startswith(js_trim(F.col("content")), F.lit("["))
    words = F.when(is_json() & array_like, array).when(is_json(), keys).otherwise(text)
    return files.select(F.explode(words).alias("word")).where("word IS NOT NULL")


def load_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list in text files, words divided by line ends, commas, semicolons and blanks,
    quotes around them dropped; lines that begin with # or // are remarks."""
    lines = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*(#|//)")))
    words = lines.select(F.explode(F.split("value", "[\\s,;]+")).alias("word"))
    return words.select(F.regexp_replace("word", "^['\"]+|['\"]+$", "").alias("word")).where("word <> ''").distinct()


def load_block_list(files: DataFrame) -> DataFrame:
    """A saved list; anything that is no JSON array is an empty one."""
    return files.select(F.explode(F.from_json("content", "array<string>")).alias("word")).where("word IS NOT NULL")


def load_types(files: DataFrame) -> DataFrame:
    """Types as (id, label), or bare labels of which the id is made."""
    pairs = F.from_json("content", "array<struct<id:string,label:string>>")
    labels = F.transform(F.from_json("content", "array<string>"), lambda x: F.struct(type_id(x).alias("id"), x.alias("label")))
    bare = F.rlike("content", F.lit('^\\s*\\[\\s*"'))
    return files.select(F.explode(F.when(bare, labels).otherwise(pairs)).alias("t")).select("t.*")


def load_rules(files: DataFrame) -> DataFrame:
    """User rules in order: rule_no, id, from, to, caseSensitive, createdAt."""
    return files.select(F.posexplode(F.from_json("content", RULE_JSON)).alias("rule_no", "r")).select("rule_no", "r.*")


#: The keys of a session, and what an import keeps of an entity.
SESSION_VERSION = "2.9"
SESSION_ENTITY = "id string, value string, type string, label string, occurrences int, aliases array<string>, active boolean, blocked boolean, manual boolean"
SESSION = (
    "version string, savedAt string, originalText string, rawText string, processedText string,"
    f" entities array<struct<{', '.join(f'{a.split()[0]}:{a.split()[1]}' for a in SESSION_ENTITY.split(', '))}>>,"
    " blacklist array<string>, ocrRules array<struct<id:string,from:string,to:string,caseSensitive:boolean,createdAt:bigint>>, customTypes array<struct<id:string,label:string>>,"
    " parties struct<demandeurs:array<struct<entityId:string,label:string,civilite:string>>,defendeurs:array<struct<entityId:string,label:string,civilite:string>>>,"
    " partiesKeywords struct<demandeurs:array<string>,defendeurs:array<string>>, initialesMap map<string,string>, currentStep int, sourceFileName string,"
    " concordance array<struct<placeholder:string,value:string,aliases:array<string>,type:string,label:string,initialPrefix:string,replacedForms:array<string>>>, anonymized string,"
    " caviardages array<struct<word:string,replacement:string,scope:string,position:int>>, scanIgnored array<string>"
)


def load_sessions(files: DataFrame, without_text: bool = False) -> DataFrame:
    """(doc_id, filename, content) to one row a session with its fields; those without
    text are left out, unless asked for. Entity fields beyond the schema (first names,
    initials) drop."""
    s = files.select("doc_id", F.from_json("content", SESSION).alias("s")).select("doc_id", "s.*")
    return s if without_text else s.where((F.coalesce("rawText", F.lit("")) != "") | (F.coalesce("processedText", F.lit("")) != ""))


def session_entities(sessions: DataFrame) -> DataFrame:
    return sessions.select("doc_id", F.posexplode("entities").alias("ord", "e")).select("doc_id", "ord", "e.*")


def session_parties(sessions: DataFrame) -> DataFrame:
    side = lambda name: sessions.select("doc_id", F.lit(name).alias("side"), F.posexplode(f"parties.{name}").alias("k", "p"))
    return side("demandeurs").unionByName(side("defendeurs")).select("doc_id", "side", (F.col("k") + 1).alias("ordre"), F.col("p.entityId").alias("entity_id"), F.col("p.label").alias("label"), F.col("p.civilite").alias("civilite"))


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """Of several saved states of a document the one saved last."""
    best = sessions.groupBy("doc_id").agg(F.max_by(F.struct(*sessions.columns), F.col("savedAt")).alias("s"))
    return best.select("s.*")


def add_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """User rules (rule_no, id, from, to, caseSensitive, createdAt) with new ones after
    them; a rule without `from` is none."""
    from pyspark.sql import Window as W

    both = rules.withColumn("_new", F.lit(0)).unionByName(new.where(F.coalesce("from", F.lit("")) != "").withColumn("_new", F.lit(1)), allowMissingColumns=True)
    n = F.row_number().over(W.orderBy("_new", "rule_no", "createdAt", "id")) - 1  # a handful of rules, typed by hand
    return both.withColumn("rule_no", n.cast("int")).select(*rules.columns)


def remove_rules(rules: DataFrame, gone: DataFrame) -> DataFrame:
    return rules.join(gone.select("id").distinct(), "id", "left_anti").select(*rules.columns)
