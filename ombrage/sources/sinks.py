"""Writing results: texts, concordances, entity lists, sessions, highlighted pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entity_rules as E
from ..functions.text import deaccent
from ..operators.cleaning import quoted
from .tables import SESSION_VERSION

BOM = "\ufeff"


def csv_field(field: Column) -> Column:
    """Quoted only where it holds a semicolon, a quote or a line end."""
    s = F.coalesce(field, F.lit(""))
    return F.when(F.rlike(s, F.lit('[;"\n]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def joined(items: Column) -> Column:
    return F.array_join(F.coalesce(items, F.array().cast("array<string>")), " | ")


def _document(rows: DataFrame, header: str, line: Column) -> DataFrame:
    """One CSV text a document, rows in order."""
    lines = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return lines.select("doc_id", F.concat(F.lit(BOM + header + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("csv"))


def concordance_csv(concordance: DataFrame) -> DataFrame:
    """Forced civility is always empty: concordance rows don't carry it."""
    fields = [F.coalesce("placeholder", F.lit("")), csv_field(F.col("value")), csv_field(joined(F.col("aliases"))), csv_field(joined(F.col("replacedForms"))), csv_field(F.coalesce("label", "type")), F.lit(""), csv_field(F.col("initialPrefix"))]
    return _document(concordance, E.CONCORDANCE_HEADER, F.concat_ws(";", *fields))


def concordance_json(concordance: DataFrame) -> DataFrame:
    row = F.struct("ord", F.struct("placeholder", "value", "aliases", "type", "label", "initialPrefix", "replacedForms").alias("r"))
    return concordance.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])).alias("json"))


def entities_csv(entities: DataFrame) -> DataFrame:
    yes = lambda c: F.when(F.col(c), "oui").otherwise("non")
    fields = [csv_field(F.col("value")), csv_field(F.col("type")), csv_field(joined(F.col("aliases"))), yes("active"), yes("blocked")]
    return _document(entities, E.ENTITIES_HEADER, F.concat_ws(";", *fields))


def entities_json(entities: DataFrame) -> DataFrame:
    row = F.struct("ord", F.struct("value", "type", "label", "aliases", "active", "blocked").alias("r"))
    return entities.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])).alias("json"))


def file_name(prefix: Column, suffix: str, extension: str, at: Column) -> Column:
    """[prefix_]suffix_2024-01-31_12h05.ext"""
    stamp = F.date_format(at, "yyyy-MM-dd_HH'h'mm")
    head = F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("_"))).otherwise("")
    return F.concat(head, F.lit(f"{suffix}_"), stamp, F.lit(f".{extension}"))


def sessions(states: DataFrame, saved_at: Column) -> DataFrame:
    """states: one row a document, with any of the session's columns; to its JSON."""
    from .tables import SESSION

    names = [f.split()[0] for f in SESSION.split(", ") if f.split()[0] in states.columns]
    fields = [F.lit(SESSION_VERSION).alias("version"), F.date_format(saved_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("savedAt"), *(F.col(n) for n in names if n not in ("version", "savedAt"))]
    return states.select("doc_id", F.to_json(F.struct(*fields)).alias("json"))


def block_list_json(saved: DataFrame) -> DataFrame:
    """A saved block list as one JSON array. It is one row by nature of the file."""
    return saved.agg(F.to_json(F.array_sort(F.collect_list("word"))).alias("json"))


def types_json(types: DataFrame) -> DataFrame:
    return types.agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "label")))).alias("json"))


def write_texts(rows: DataFrame, column: str, path: str) -> None:
    """One text file a document: partitioned by doc_id, a line end between rows only."""
    rows.select("doc_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path, lineSep="\n")


def export_all(result: DataFrame, concordance: DataFrame, originals: DataFrame, states: DataFrame, saved_at: Column, path: str) -> None:
    """The parts of an export as four folders: anonymised, concordance, original, session."""
    write_texts(result, "anonymized", f"{path}/anonymised")
    write_texts(concordance_csv(concordance), "csv", f"{path}/concordance")
    write_texts(originals, "text", f"{path}/original")
    write_texts(sessions(states, saved_at), "json", f"{path}/session")


#: What begins a ZIP file's entry, its line in the directory, and the end, each
#: with version 2.0, UTF-8 names, no compression, 1 January 1980.
_ENTRY, _LINE, _END = "504B03041400000800000000" "2100", "504B010214001400000800000000" "2100", "504B050600000000"


def _little(n: Column, size: int) -> Column:
    """A number as bytes, the lowest first."""
    h = F.lpad(F.hex(n.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))]))


def zip_archive(parts: list[tuple[Column, Column]]) -> Column:
    """(file name, text) pairs as the bytes of one ZIP file, stored as they are."""
    raw, nothing = lambda h: F.unhex(F.lit(h)), F.lit(b"")
    files = F.array(*[F.struct(F.encode(name, "UTF-8").alias("title"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("data")) for name, text in parts])

    def with_facts(p: Column) -> Column:
        size = F.length(p["data"])
        facts = F.concat(_little(F.crc32(p["data"]), 4), _little(size, 4), _little(size, 4), _little(F.length(p["title"]), 2), raw("0000"))
        return F.struct(p["title"].alias("title"), p["data"].alias("data"), facts.alias("facts"))

    def put(done: Column, p: Column) -> Column:
        line = F.concat(raw(_LINE), p["facts"], raw("0000" * 3 + "00000000"), _little(F.length(done["body"]), 4), p["title"])
        return F.struct(F.concat(done["body"], raw(_ENTRY), p["facts"], p["title"], p["data"]).alias("body"), F.concat(done["lines"], line).alias("lines"))

    def whole(done: Column) -> Column:
        n = _little(F.lit(len(parts)), 2)
        return F.concat(done["body"], done["lines"], raw(_END), n, n, _little(F.length(done["lines"]), 4), _little(F.length(done["body"]), 4), raw("0000"))

    return F.aggregate(F.transform(files, with_facts), F.struct(nothing.alias("body"), nothing.alias("lines")), put, whole)


def export_archives(result: DataFrame, concordance: DataFrame, originals: DataFrame, states: DataFrame, saved_at: Column) -> DataFrame:
    """(doc_id, filename, content): one ZIP file a document with the four parts of an
    export, made where the rows are; a part that a document lacks is an empty file."""
    tables = (result.select("doc_id", F.col("anonymized").alias("_a")), concordance_csv(concordance).select("doc_id", F.col("csv").alias("_c")), originals.select("doc_id", F.col("text").alias("_o")), sessions(states, saved_at).select("doc_id", F.col("json").alias("_s")))
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.join(t, "doc_id", "left")
    named = [("anonymise", "txt", "_a"), ("concordance", "csv", "_c"), ("original", "txt", "_o"), ("session", "json", "_s")]
    nothing = F.lit("")
    content = zip_archive([(file_name(nothing, suffix, ext, saved_at), F.col(c)) for suffix, ext, c in named])
    return rows.select("doc_id", file_name(F.col("doc_id").cast("string"), "export", "zip", saved_at).alias("filename"), content.alias("content"))


def highlight_html(text: Column, initials: Column) -> Column:
    """HTML with initials and placeholders marked by type. initials: array of strings,
    each marked where blanks, tags or the ends of the text are on both sides."""
    safe = F.coalesce(text, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(sign), F.lit(entity))
    ordered = F.transform(F.sort_array(F.transform(F.coalesce(initials, F.array().cast("array<string>")), lambda i: F.struct((-F.length(i)).alias("n"), i.alias("i")))), lambda x: x["i"])
    step = lambda acc, i: F.regexp_replace(acc, F.concat(F.lit("(?<=[\\s>]|^)("), quoted(i), F.lit(")(?=[\\s<]|$)")), F.lit('<mark class="ph ph-initiale">$1</mark>'))
    out = F.aggregate(ordered, safe, step)
    holder = "\\[([A-ZÉÈÀÙÂÊÎÔÛÄËÏÖÜ0-9_]+)\\]"
    pieces = F.split(F.regexp_replace(out, holder, "\u0001[$1]\u0001"), "\u0001")

    def mark(p: Column) -> Column:
        first = F.lower(deaccent(F.element_at(F.split(F.regexp_extract(p, holder, 1), "_"), 1)))
        return F.when(F.rlike(p, F.lit(f"^{holder}$")), F.concat(F.lit('<mark class="ph ph-'), F.regexp_replace(first, "[^a-z]", ""), F.lit('">'), p, F.lit("</mark>"))).otherwise(p)

    return F.array_join(F.transform(pieces, mark), "")
