"""Scan for mentions that no entity covers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import entity_rules as E
from ..functions.text import WS, Containing, py_squeeze, py_trim, python_pattern
from .anonymise import escaped
from .detection import by_document, slices

SCAN_CONTEXT, PANEL_CONTEXT = 65, 50
EXACT_ONLY = ("adresse", "codepostal")


class Captured:
    """What is known already: values and aliases, redacted words, ignored values."""

    def __init__(self, entities: list[dict], redacted: list[str], ignored: list[str]):
        self.known = {py_trim(v.lower()) for e in entities for v in (e["value"], *(e["aliases"] or []))}
        self.cut: set[str] = set()
        for word in filter(None, redacted):
            w = py_squeeze(word.lower())
            self.known.add(w)
            self.cut |= {w, *(t for t in w.split(" ") if len(t) >= 4)}
        self.known |= {py_trim(v.lower()) for v in ignored}
        self.long = Containing([v for v in self.known if len(v) >= 8])

    def covers(self, category: str, key: str) -> bool:
        if key in self.known:
            return True
        if any(w in key for w in self.cut):
            return True
        if category in EXACT_ONLY:
            return False
        words = [w for w in re.split(f"[{WS}]+", key) if len(w) >= 3]
        return any(w in self.known for w in words) or self.long.first(key) is not None


def marked(text: str, start: int, end: int, value: str, tag: str) -> str:
    context = py_squeeze(text[max(0, start) : end])
    return re.sub(escaped(value), lambda _: f"{tag}{value}</mark>", context, count=1, flags=re.I)


def scan(text: str, captured: Captured, panel: bool = False) -> list[dict]:
    """Suspects in pattern order, each value once. The panel's keys have single spaces
    and it lists every occurrence; the scan gives the first one's context."""
    out, seen = [], set()
    for category, kind, pattern, ignore, group in E.OMISSIONS:
        for m in python_pattern(pattern, ignore).finditer(text):
            value = py_trim(m[group])
            key = py_squeeze(value.lower()) if panel else value.lower()
            if len(value) < 3 or key in seen or captured.covers(category, key):
                continue
            seen.add(key)
            if panel:
                places = [(x.start(), marked(text, x.start() - PANEL_CONTEXT, x.start() + len(value) + PANEL_CONTEXT, value, '<mark class="oubli-mark">')) for x in re.finditer(escaped(value), text, re.I)]
            else:
                places = [(m.start(), marked(text, m.start() - SCAN_CONTEXT, m.start() + len(value) + SCAN_CONTEXT, value, "<mark>"))]
            if places:
                out.append({"cat": category, "type": kind, "value": value, "occurrences": [{"index": i, "ctx": c} for i, c in places]})
    return out


SUSPECT = "doc_id long, ord int, cat string, type string, value string, occurrences array<struct<index:int,ctx:string>>, parentEntity string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ord", pa.int32()), ("cat", pa.string()), ("type", pa.string()), ("value", pa.string()), ("occurrences", pa.list_(pa.struct([("index", pa.int32()), ("ctx", pa.string())]))), ("parentEntity", pa.string())])


def find_omissions(docs: DataFrame, entities: DataFrame, redactions: DataFrame | None = None, ignored: DataFrame | None = None, panel: bool = False, text: str = "text") -> DataFrame:
    """Suspects of each document. parentEntity (panel) is the active entity whose value
    is a word of the suspect."""
    listed = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "value", "aliases", "active", "blocked"))).alias("entities"))
    others = {name: table.groupBy("doc_id").agg(F.collect_set(column).alias(name)) for name, column, table in (("cuts", "word", redactions), ("skip", "value", ignored)) if table is not None}
    joined = by_document(docs, text, listed, *others.values()).withColumns({name: F.lit(None).cast("array<string>") for name in ("cuts", "skip") if name not in others})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, t, ents, cut, ign in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "entities", "cuts", "skip")), strict=True):
                ents = ents or []
                first = {}
                for e in ents:
                    if e["active"] and not e["blocked"]:
                        first.setdefault(e["value"].lower(), e["value"])
                for k, s in enumerate(scan(t or "", Captured(ents, cut or [], ign or []), panel)):
                    words = {w for w in re.split(f"[{WS}]+", s["value"].lower()) if len(w) >= 3}
                    parent = next((v for low, v in first.items() if low in words), None) if panel else None
                    rows.append({"doc_id": doc_id, "ord": k, **s, "parentEntity": parent})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return joined.mapInArrow(run, SUSPECT)


def add_omissions(entities: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen(doc_id, seq, value, type): an alias of the first active entity whose value
    is one of its words, else a new entity at the end.

    Both tables meet in windows after one shuffle by document. A row is an entity, or one
    word of a chosen value (_no: the first of them is the value's own row)."""
    from pyspark.sql import Window as W

    known = F.col("doc_id").isNotNull()  # rows without an id have nothing in common
    picked = chosen.select("doc_id", "seq", F.col("value").alias("_value"), F.col("type").alias("_type"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.filter(F.split(F.lower("value"), f"[{WS}]+"), lambda w: F.length(w) >= 3), F.array().cast("array<string>")))).alias("_no", "_w"))
    live = F.when(F.col("active") & ~F.col("blocked"), F.lower("value"))
    rows = entities.withColumn("_w", live).unionByName(picked, allowMissingColumns=True).withColumn("_own", F.col("_no").isNull()).repartition("doc_id")
    owner = F.when(F.col("_w").isNotNull() & known, F.min(F.when(F.col("_own"), F.struct("ord", "id"))).over(W.partitionBy("doc_id", "_w")))
    rows = rows.withColumn("_owner", F.when(~F.col("_own"), owner))
    rows = rows.withColumn("_to", F.when(F.col("_own"), F.when(known, F.col("id"))).otherwise(F.min("_owner").over(W.partitionBy("doc_id", "_own", "seq", "_value"))["id"])).where("_own OR _no = 0")
    low = lambda xs: F.transform(xs, lambda x: F.lower(x))
    told = F.collect_set(F.when(~F.col("_own"), F.struct("seq", "_value"))).over(W.partitionBy("doc_id", "_to"))
    last = F.when(known, F.max(F.when(F.col("_own"), F.col("ord"))).over(W.partitionBy("doc_id")))
    rows = rows.withColumns({"_more": F.when(F.col("_to").isNotNull(), F.transform(F.array_sort(told), lambda x: x["_value"])), "_last": last}).where("_own OR _to IS NULL")
    union = F.when(F.col("_more").isNull() | (F.size("_more") == 0), F.col("aliases")).otherwise(F.concat("aliases", F.filter("_more", lambda v: ~F.array_contains(low(F.col("aliases")), F.lower(v)) & (F.lower(v) != F.lower("value")))))
    n = F.row_number().over(W.partitionBy("doc_id", "_own").orderBy("seq"))
    kind, value = F.col("_type"), F.col("_value")
    given = {"doc_id": F.col("doc_id"), "ord": (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast("int"), "id": F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), kind, F.lower(value)), 256), "value": value, "type": kind, "label": kind, "occurrences": F.lit(1), "aliases": F.array().cast("array<string>"), "active": F.lit(True), "blocked": F.lit(False)}
    own = lambda c: union if c == "aliases" else F.col(c)
    return rows.withColumn("_n", n).select(*[F.when(F.col("_own"), own(c)).otherwise(given.get(c, F.lit(None)).cast(entities.schema[c].dataType)).alias(c) for c in entities.columns])


def ignore_omissions(ignored: DataFrame, values: DataFrame) -> DataFrame:
    return ignored.select("doc_id", "value").union(values.select("doc_id", "value")).distinct()
