"""Parties of a case: who claims, who defends, found next to the words that say so."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import entity_rules as E
from ..functions.text import Containing, py_deaccent, render
from .anonymise import escaped
from .detection import by_document, slices

FOUND = "doc_id long, ord int, name string, side string, entity_id string, context string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ord", pa.int32()), ("name", pa.string()), ("side", pa.string()), ("entity_id", pa.string()), ("context", pa.string())])


def folded(s: str) -> str:
    return py_deaccent(s).lower()


def find_parties(text: str, entities: list[dict], keywords: dict[str, list[str]]) -> list[dict]:
    """Names before ", keyword" or "(keyword", and after "keyword :"."""
    index: dict[str, str] = {}
    for e in entities:
        for form in (e["value"], *(e["aliases"] or [])):
            index[folded(form)] = e["id"]
    names, near = list(index), Containing(list(index))
    out, seen = [], set()
    title, name = render(E.PARTY_TITLE, "python"), render(E.PARTY_NAME, "python")
    for side, words in keywords.items():
        if not words:
            continue
        either = "|".join(sorted(map(escaped, words), key=len, reverse=True))
        before = re.compile(f"{title}(?P<n>{name}){render('{s}*[,\\(]{s}*', 'python')}(?:{either})", re.I)
        after = re.compile(f"(?:{either}){render('{s}*[:\\-,]?{s}+', 'python')}{title}(?P<n>{name})", re.I)
        for rx in (before, after):
            for m in rx.finditer(text):
                key = folded(m["n"].strip())
                if len(key) < 3 or (side, key) in seen:
                    continue
                seen.add((side, key))
                who = index.get(key) or (index[names[k]] if (k := near.first(key)) is not None else None)
                a, b = max(0, m.start() - 30), min(len(text), m.end() + 30)
                context = ("…" if a else "") + text[a:b].replace("\n", " ") + ("…" if b < len(text) else "")
                out.append({"name": m["n"].strip(), "side": side, "entity_id": who, "context": context})
    return out


def detect_parties(docs: DataFrame, entities: DataFrame, keywords: dict[str, list[str]] | None = None, text: str = "text") -> DataFrame:
    """Parties of each document with the entity they name, if any."""
    words = E.SIDE_KEYWORDS if keywords is None else keywords
    listed = entities.where("active AND NOT blocked").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "value", "aliases"))).alias("entities"))
    joined = by_document(docs, text, listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, t, ents in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "entities")), strict=True):
                rows += [{"doc_id": doc_id, "ord": k, **p} for k, p in enumerate(find_parties(t or "", ents or [], words))]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return joined.mapInArrow(run, FOUND)


def accept_parties(parties: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted (doc_id, side, entity_id, label) join parties(..., ordre) at the end of
    their side; who is on that side already stays as is."""
    new = accepted.join(parties.select("doc_id", "side", "entity_id"), ["doc_id", "side", "entity_id"], "left_anti").dropDuplicates(["doc_id", "side", "entity_id"])
    last = parties.groupBy("doc_id", "side").agg(F.max("ordre").alias("_last"))
    n = F.row_number().over(W.partitionBy("doc_id", "side").orderBy("entity_id"))
    placed = new.join(last, ["doc_id", "side"], "left").withColumn("ordre", (F.coalesce("_last", F.lit(0)) + n).cast("int"))
    return parties.unionByName(placed.select(*[F.col(c) if c in placed.columns else F.lit(None).alias(c) for c in parties.columns]))


def remove_parties(parties: DataFrame, removed: DataFrame) -> DataFrame:
    """Without (doc_id, side, entity_id), the rest numbered anew."""
    left = parties.join(removed.select("doc_id", "side", "entity_id"), ["doc_id", "side", "entity_id"], "left_anti")
    return left.withColumn("ordre", F.row_number().over(W.partitionBy("doc_id", "side").orderBy("ordre", "entity_id"))).select(*parties.columns)


def assign_roles(entities: DataFrame, roles: DataFrame) -> DataFrame:
    """roles(doc_id, seq, id, role): the entity's type becomes the role; ordered roles
    get the next number among types that begin with them."""
    base = F.upper("role").isin(*E.ORDERED_ROLES)
    now = entities.join(roles.select("doc_id", F.upper("role").alias("_role")).distinct(), "doc_id").where(F.startswith(F.upper("type"), F.col("_role"))).groupBy("doc_id", "_role").agg(F.count("*").alias("_n"))
    counted = roles.withColumn("_role", F.upper("role")).join(now, ["doc_id", "_role"], "left")
    n = F.row_number().over(W.partitionBy("doc_id", "_role").orderBy("seq"))
    final = counted.select("doc_id", "id", F.when(base, F.concat("_role", F.lit("_"), (F.coalesce("_n", F.lit(0)) + n).cast("string"))).otherwise(F.col("role")).alias("_type"))
    return entities.join(final, ["doc_id", "id"], "left").withColumns({"type": F.coalesce("_type", "type"), "label": F.coalesce("_type", "label")}).select(*entities.columns)
