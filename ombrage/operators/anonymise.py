"""Replacement of active entities by numbered placeholders, and its concordance.

Numbers and rules are relations (windows over doc_id). The substitution itself must
take, at the leftmost place, the first rule that fits, and never look at its own
output; that is one pass over a document, in a map over Arrow batches. Rules are steps
over the lower-cased text and not patterns, since compiling these for each document
costs more than its matches. Documents without an active entity pass through that map
as they are: a branch of their own would detect everything twice.

Rows of one doc_id share one list of entities and redactions: what is detected in one of
them is replaced in all. Rows without doc_id are refused where entities are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import entity_rules as E
from ..functions.text import WS, fold, py_squeeze, python_pattern, render, squeeze
from .cleaning import SPECIAL
from .detection import Detector, Found, by_document, from_row, levenshtein1, shared_words, slices


def is_active(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("active") & ~F.col("blocked") & (squeeze(F.coalesce("value", F.lit(""))) != ""))


def prefix_of(kind: Column) -> Column:
    """Placeholder prefix of a type; null for first names, which have none."""
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(F.trim(kind)), "[^A-Z0-9]", "_"), "_+", "_"), "^_|_$", "")
    known = F.when(kind.isin(*E.PREFIXES), kind)
    return F.when(F.upper(kind) == "PRENOM", F.lit(None)).otherwise(F.coalesce(known, F.when(own != "", own), F.lit("VAL")))


def number_placeholders(entities: DataFrame) -> DataFrame:
    """Active entities with prefix, number and placeholder. The counter runs by prefix
    in entity order, whether or not an entity is ever met in the text."""
    initial = F.coalesce("isInitiale", F.lit(False)) if "isInitiale" in entities.columns else F.lit(False)
    p = is_active(entities).withColumn("prefix", F.when(~initial, prefix_of(F.col("type"))))
    n = F.when(F.col("prefix").isNotNull(), F.row_number().over(W.partitionBy("doc_id", "prefix").orderBy("ord")))
    return p.withColumn("number", n).withColumn("placeholder", F.when(F.col("number").isNotNull(), F.concat(F.lit("["), "prefix", F.lit("_"), F.col("number").cast("string"), F.lit("]"))))


def plain_rules(numbered: DataFrame) -> DataFrame:
    """Value and alias rules in the order of substitution: (doc_id, rule_no, val,
    placeholder, with_title). Longer values first, with a title before without."""
    head = "(?iu)" + render(E.TITLE_HEAD)
    values = F.concat(F.array("value"), F.coalesce("aliases", F.array().cast("array<string>")))
    clean = F.transform(values, lambda v: squeeze(F.regexp_replace(squeeze(v), head, "")))
    usable = F.filter(clean, lambda v: (F.length(v) > 1) & ~F.lower(v).isin(*sorted(E.TITLE_WORDS)))
    each = numbered.where("placeholder IS NOT NULL").select("doc_id", "ord", "placeholder", F.posexplode(usable).alias("at", "val"))
    both = each.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("with_title"))
    first = both.groupBy("doc_id", "placeholder", "with_title", F.lower("val").alias("low")).agg(F.min(F.struct("ord", "at", "val")).alias("f"))
    rows = first.select("doc_id", "placeholder", "with_title", "f.ord", "f.at", "f.val")
    order = W.partitionBy("doc_id").orderBy(F.desc(F.length("val")), F.desc("with_title"), "ord", "at")
    return rows.withColumn("rule_no", F.row_number().over(order)).select("doc_id", "rule_no", "val", "placeholder", "with_title")


def flex_column(value: Column) -> Column:
    """A value as a pattern: spaces match spaces, commas and dashes; a comma after a
    digit may be missing."""
    p = F.regexp_replace(squeeze(value), SPECIAL, r"\\$1")
    return F.regexp_replace(F.regexp_replace(p, " ", F.lit(f"[{WS},\\\\-]+")), "([0-9]),", "$1,?")


# ── One document ─────────────────────────────────────────────────────────────


def escaped(s: str) -> str:
    return re.sub(SPECIAL, r"\\\1", s)


def flex(value: str) -> str:
    p = escaped(py_squeeze(value)).replace(" ", f"[{WS},\\-]+")
    return re.sub("([0-9]),", r"\1,?", p)


LETTERS = re.compile("[A-Za-zÀ-ÿ]")
RUNS = re.compile(f"[A-Za-zÀ-ÿ]+|[{E.L}]+")
GAP = frozenset(chr(c) for c in range(0x10000) if re.match(f"[{WS},\\-]", chr(c)))
RIGHT = re.compile(E.RIGHT_BOUND)
STARTS = re.compile(E.LEFT_BOUND + ".", re.S)
TITLE = re.compile(f"{render(E.TITLE_BEFORE, 'python')}[{WS}]+", re.I)

#: A step of a rule: ("is", text), ("comma?", ""), ("gap", "") or ("near", word).
Step = tuple[str, str]


def lowered(s: str) -> str:
    """Lower case, character by character, so that places stay."""
    out = s.lower()
    return out if len(out) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


@lru_cache(maxsize=1 << 15)
def steps_of(value: str) -> tuple[Step, ...]:
    """A value's words, with a gap between them; a comma after a digit may be missing."""
    out: list[Step] = []
    for k, word in enumerate(lowered(py_squeeze(value)).split(" ")):
        if k:
            out.append(("gap", ""))
        for piece in re.split("(?<=[0-9])(,)", word):
            if piece:
                out.append(("comma?", "") if piece == "," and out and out[-1][1][-1:].isdigit() else ("is", piece))
    return tuple(out)


@lru_cache(maxsize=1 << 15)
def near_of(run: str, word: str) -> bool:
    return levenshtein1(run, word)


class Runs:
    """The distinct runs of letters of a text, by their ends.

    Between the boundaries of a rule a word of letters can only match a whole run, so
    the forms of it that a text has are all that its rule must name. One edit in
    six letters leaves the first or the last three as they are."""

    def __init__(self, low: str):
        self.head: dict[str, list[str]] = {}
        self.tail: dict[str, list[str]] = {}
        for t in {m[0] for m in RUNS.finditer(low)}:
            if len(t) >= 5:
                self.head.setdefault(t[:3], []).append(t)
                self.tail.setdefault(t[-3:], []).append(t)

    def found(self, word: str) -> list[str]:
        """The runs within one edit of a word, itself if it is short, longest first."""
        low = lowered(word.strip())
        if len(low) < 6:
            return [low]
        near = {t for t in (*self.head.get(low[:3], ()), *self.tail.get(low[-3:], ())) if near_of(t, low)}
        return sorted(near, key=lambda t: (-len(t), t))


def near_ends(low: str, at: int, word: str) -> Iterator[int]:
    """Where a form of a word of six characters and more, not all letters, ends that
    begins here: as it is, with one character less, one letter more, or one changed."""
    n = len(word)
    if low.startswith(word, at):
        yield at + n
    for size in (n - 1, n + 1, n):
        part = low[at : at + size]
        if len(part) == size and part != word and levenshtein1(part, word):
            k = next((k for k in range(min(size, n)) if part[k] != word[k]), min(size, n))
            if size < n or LETTERS.match(part[k]):
                yield at + size


def ends_of(low: str, at: int, steps: tuple[Step, ...], forms: dict[str, list[str] | None]) -> Iterator[int]:
    """Where the steps can end that begin here, the longest gap first."""
    if not steps:
        yield at
        return
    (kind, text), rest = steps[0], steps[1:]
    if kind == "is":
        if low.startswith(text, at):
            yield from ends_of(low, at + len(text), rest, forms)
    elif kind == "comma?":
        if low.startswith(",", at):
            yield from ends_of(low, at + 1, rest, forms)
        yield from ends_of(low, at, rest, forms)
    elif kind == "gap":
        end = at
        while end < len(low) and low[end] in GAP:
            end += 1
        for k in range(end, at, -1):
            yield from ends_of(low, k, rest, forms)
    else:
        known = forms[text]
        if known is None:
            for end in near_ends(low, at, text):
                yield from ends_of(low, end, rest, forms)
        for form in known or ():
            if low.startswith(form, at):
                yield from ends_of(low, at + len(form), rest, forms)


@lru_cache(maxsize=1 << 15)
def strip_title(value: str) -> str:
    return py_squeeze(python_pattern(E.TITLE_HEAD, True).sub("", value))


@dataclass(slots=True)
class Rule:
    val: str
    steps: tuple[Step, ...]
    placeholder: str | None
    with_title: bool
    initial: str | None = None
    combined: bool = False

    @property
    def rank(self) -> tuple:
        return (-(2 if self.combined else 1 if self.initial else 0), -len(self.val), not self.with_title)


def near_step(word: str) -> Step:
    w = lowered(word.strip())
    return ("near", w) if len(w) >= 6 else ("is", w)


def placeholder_prefix(kind: str) -> str | None:
    if kind.upper() == "PRENOM":
        return None
    return E.PREFIXES.get(kind) or re.sub("_+", "_", re.sub("[^A-Z0-9]", "_", kind.strip().upper())).strip("_") or "VAL"


def rules_of(active: list[Found]) -> tuple[list[Rule], list[dict]]:
    """Ordered rules and, in entity order, the rows of the concordance."""
    rules: dict[tuple, list[Rule]] = {}
    rows: list[dict] = []
    number: dict[str, int] = {}
    for e in active:
        flat = [py_squeeze(v) for v in (e.value, *e.aliases)]
        if e.is_initial or e.type.upper() == "PRENOM":
            sign = e.initial or e.value[0].upper() + "."
            for v in dict.fromkeys(v for v in flat if v and v.lower() not in E.TITLE_WORDS):
                for titled in (True, False):
                    rules.setdefault(("initial", titled, v.lower()), [Rule(v, steps_of(v), None, titled, sign)])
            rows.append({"placeholder": sign, "entity": e, "label": "Initiale", "initialPrefix": sign, "forms": []})
            continue
        prefix = placeholder_prefix(e.type)
        number[prefix] = number.get(prefix, 0) + 1
        ph = f"[{prefix}_{number[prefix]}]"
        person = e.type.upper().startswith(("DEMANDEUR", "DEFENDEUR", "DÉFENDEUR")) or e.type.upper() == "NOM"
        for v in dict.fromkeys(strip_title(v) for v in flat):
            if len(v) < 2 or v.lower() in E.TITLE_WORDS:
                continue
            for titled in (True, False):
                rules.setdefault((ph, titled, v.lower()), [Rule(v, steps_of(v), ph, titled)])
            if person and " " not in v and len(v) >= 6:
                rules.setdefault((ph, "fuzzy", v.lower()), [Rule(v, (near_step(v),), ph, False)])
        if person:
            for f in dict.fromkeys(f for f in (e.prenom, *e.variants) if f and len(f) >= 2):
                sign, exact = f[0].upper() + ".", ("is", lowered(f))
                for titled in (False, True):
                    rules.setdefault(("first", titled, f.lower()), [Rule(f, (exact,), None, titled, sign)])
                if len(e.value) >= 3:
                    rules.setdefault(("both", f.lower(), e.value.lower()), [Rule(f, (exact, ("gap", ""), near_step(e.value)), ph, titled, sign, True) for titled in (True, False)])
        rows.append({"placeholder": ph, "entity": e, "label": e.label or e.type, "initialPrefix": None, "forms": []})
    return sorted((r for group in rules.values() for r in group), key=lambda r: r.rank), rows


class Matcher:
    """The rule that fits at a place of a text: the first in order, with its title.

    Trying every rule at every place would cost their product. Rules are kept by the
    first character that they can have, those after a title apart from the others, so
    that a place only tries what can begin there."""

    def __init__(self, rules: list[Rule], text: str):
        self.rules, self.low = rules, lowered(text)
        runs = Runs(self.low)
        self.forms = {t: runs.found(t) if t.isalpha() else None for r in rules for kind, t in r.steps if kind == "near"}
        self.by_head: dict[tuple[bool, str], list[int]] = {}
        for k, r in enumerate(rules):
            kind, first = r.steps[0] if r.steps else ("is", "")
            if kind == "near":
                known = self.forms[first]
                heads = {f[0] for f in known} if known is not None else {""}  # "": any character
            else:
                heads = {first[:1]}
            for c in heads:
                self.by_head.setdefault((r.with_title, c), []).append(k)

    def fit(self, text: str, at: int, titled: bool) -> tuple[int, int] | None:
        """(number of the rule, end) at a place."""
        if at >= len(text):
            return None
        own, anywhere = self.by_head.get((titled, self.low[at]), []), self.by_head.get((titled, ""), [])
        for k in sorted({*own, *anywhere}) if anywhere else own:
            for end in ends_of(self.low, at, self.rules[k].steps, self.forms):
                if RIGHT.match(text, end):
                    return k, end
        return None

    def matches(self, text: str) -> Iterator[tuple[int, int, int, Rule]]:
        """(start, start of the name, end, rule) from left to right, none overlapping."""
        heads = {c for _, c in self.by_head}
        titled, some = any(t for t, _ in self.by_head), "" in heads
        done = 0
        for s in STARTS.finditer(text) if heads else ():
            begin = s.start()
            c = self.low[begin]
            if begin < done or not (some or c in heads or titled and c in "mdp"):
                continue
            best = [(*f, begin) for f in [self.fit(text, begin, False)] if f]
            if titled and c in "mdp" and (t := TITLE.match(text, begin)):
                best += [(*f, t.end()) for f in [self.fit(text, t.end(), True)] if f]
            if best:
                k, end, name = min(best)
                yield begin, name, end, self.rules[k]
                done = end


def substitute(text: str, entities: list[Found]) -> tuple[str, list[dict], list[str]]:
    """The text with every mention replaced, the concordance rows that were met, and
    the initials written."""
    rules, rows = rules_of([e for e in entities if e.active and not e.blocked and py_squeeze(e.value)])
    by_placeholder = {r["placeholder"]: r for r in rows}
    initials: dict[str, None] = {}
    out, done = [], 0
    for start, name, end, rule in Matcher(rules, text).matches(text):
        row = by_placeholder.get(rule.placeholder) if rule.placeholder else None
        form = text[start:end].strip()
        if row is not None and form not in row["forms"]:
            row["forms"].append(form)
        if rule.initial:
            initials[rule.initial] = None
        out += [text[done:name], f"{rule.initial} {rule.placeholder}" if rule.combined else rule.initial or rule.placeholder or ""]
        done = end
    return "".join([*out, text[done:]]), [r for r in rows if r["forms"]], list(initials)


# ── Redactions ───────────────────────────────────────────────────────────────


def redact_text(text: str, redactions: list[dict]) -> str:
    """Words removed one after another; scope 'current' only the first at or after a
    position, else the first. The replacement is literal."""
    import unicodedata

    for r in redactions:
        rx, new = re.compile(flex(unicodedata.normalize("NFC", r["word"])), re.I), r["replacement"] or ""
        if r["scope"] == "current" and r["position"] is not None:
            m = rx.search(text, int(r["position"])) or rx.search(text)
            text = text[: m.start()] + new + text[m.end() :] if m else text
        else:
            text = rx.sub(lambda _, n=new: n, text)
    return text


def redact_all(text: Column, redactions: Column) -> Column:
    """Redactions of scope 'all', an ordered array of (word, replacement), as columns."""
    step = lambda acc, r: F.regexp_replace(acc, F.concat(F.lit("(?iu)"), flex_column(r["word"])), F.regexp_replace(r["replacement"], r"([$\\])", r"\\$1"))
    return F.aggregate(F.filter(redactions, lambda r: squeeze(r["word"]) != ""), text, step)


def register_redactions(known: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert on (doc_id, lower word, scope): a new entry takes the old one's place."""
    key = ["doc_id", F.lower("word").alias("_key"), "scope"]
    a, b = known.select("*", *key[1:2]), new.select("*", *key[1:2])
    at = a.select("doc_id", "_key", "scope", F.col("ord").alias("_at"))
    kept = a.join(b.select("doc_id", "_key", "scope"), ["doc_id", "_key", "scope"], "left_anti").drop("_key").select(*known.columns)
    top = known.groupBy("doc_id").agg(F.max("ord").alias("_top"))
    put = b.join(at, ["doc_id", "_key", "scope"], "left").join(top, "doc_id", "left").withColumn("ord", F.coalesce("_at", F.coalesce("_top", F.lit(0)) + F.col("ord")))
    return kept.unionByName(put.select(*known.columns))


def redaction_counts(docs: DataFrame, redactions: DataFrame, text: str = "text") -> DataFrame:
    """How often each redacted word stands in its document."""
    n = F.regexp_count(F.col("_text"), F.concat(F.lit("(?iu)"), flex_column(F.col("word"))))
    return redactions.join(docs.select("doc_id", F.col(text).alias("_text")), "doc_id").select("doc_id", "word", "scope", n.alias("n"))


# ── Whole tables ─────────────────────────────────────────────────────────────

RESULT = (
    "doc_id long, anonymized string, initiales array<string>,"
    " concordance array<struct<placeholder:string,value:string,aliases:array<string>,type:string,label:string,initialPrefix:string,replacedForms:array<string>>>"
)
_ROW = pa.struct([("placeholder", pa.string()), ("value", pa.string()), ("aliases", pa.list_(pa.string())), ("type", pa.string()), ("label", pa.string()), ("initialPrefix", pa.string()), ("replacedForms", pa.list_(pa.string()))])
_ARROW = pa.schema([("doc_id", pa.int64()), ("anonymized", pa.string()), ("initiales", pa.list_(pa.string())), ("concordance", pa.list_(_ROW))])

FIELDS = ("ord", "value", "type", "label", "occurrences", "aliases", "active", "blocked", "prenom", "prenomVariants", "members", "isInitiale", "initialeValue")


def anonymise(docs: DataFrame, entities: DataFrame, redactions: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Every document with its text anonymised, its concordance and its initials.
    Redactions (doc_id, ord, word, replacement, scope, position) come first."""
    listed = is_active(entities).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("entities"))
    none = F.lit(None).cast("array<struct<ord:int,word:string,replacement:string,scope:string,position:int>>")
    if redactions is None:
        joined = by_document(docs, text, listed).withColumn("cuts", none)
    else:
        joined = by_document(docs, text, listed, redactions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "word", "replacement", "scope", "position"))).alias("cuts")))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, t, ents, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "entities", "cuts")), strict=True):
                text = redact_text(t or "", cuts or [])
                done, conc, initials = substitute(text, [from_row(e) for e in ents]) if ents else (text, [], [])
                rows.append({"doc_id": doc_id, "anonymized": done, "initiales": initials, "concordance": [table_row(r) for r in conc]})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return joined.mapInArrow(run, RESULT)


def pseudonymise(docs: DataFrame, block_list: frozenset[str] = frozenset(), text: str = "text") -> DataFrame:
    """Detection and substitution of each document in one map, nothing shuffled: the
    form for large tables where no one curates the entities in between."""
    shared = shared_words(docs.sparkSession, block_list)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(shared.value)
        for batch in slices(batches):
            rows = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                done, conc, initials = substitute(t or "", detector.detect(t or ""))
                rows.append({"doc_id": doc_id, "anonymized": done, "initiales": initials, "concordance": [table_row(r) for r in conc]})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, RESULT)


def table_row(r: dict) -> dict:
    e = r["entity"]
    return {"placeholder": r["placeholder"], "value": e.value, "aliases": e.aliases, "type": e.type, "label": r["label"], "initialPrefix": r["initialPrefix"], "replacedForms": r["forms"]}


def concordance(result: DataFrame) -> DataFrame:
    """One row a placeholder met, in order within its document."""
    return result.select("doc_id", F.posexplode("concordance").alias("ord", "c")).select("doc_id", "ord", "c.*")


def choose_initial(first_name: str, used: set[str]) -> tuple[str, bool, list[str]]:
    """(initial, conflict, alternatives): J., JE., JEA., JEAN., the first not used."""
    forms = [first_name.upper()[:k] + "." for k in range(1, min(len(first_name), 4) + 1)]
    free = next((f for f in forms if f.lower() not in used), None)
    return (free, False, []) if free else (forms[0], True, forms)


@F.pandas_udf(ArrayType(StringType()))
def assign_initials(names: pd.Series) -> pd.Series:
    """For a document's first names in order, the initial of each."""
    out = []
    for many in names:
        used: dict[str, str] = {}
        signs = []
        for n in many if many is not None else []:
            sign = choose_initial(n, {v for k, v in used.items() if k != n.lower()})[0]
            used[n.lower()] = sign.lower()
            signs.append(sign)
        out.append(signs)
    return pd.Series(out)


def apply_initial(entities: DataFrame, choices: DataFrame) -> DataFrame:
    """Upsert of initials (doc_id, prenom, initiale): an initial of the same first name
    changes, others are appended as entities of type PRENOM."""
    pick = choices.select("doc_id", F.lower("prenom").alias("_key"), F.col("initiale").alias("_sign"), "prenom").withColumnRenamed("prenom", "_name")
    mine = F.coalesce("isInitiale", F.lit(False))
    joined = entities.withColumn("_key", F.when(mine, F.lower("value"))).join(pick, ["doc_id", "_key"], "left")
    changed = joined.withColumn("initialeValue", F.coalesce("_sign", "initialeValue")).select(*entities.columns)
    have = entities.where(mine).select("doc_id", F.lower("value").alias("_key")).distinct()
    last = entities.groupBy("doc_id").agg(F.max("ord").alias("_last"))
    new = pick.join(have, ["doc_id", "_key"], "left_anti").join(last, "doc_id", "left")
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("_key"))
    values = {
        "ord": (F.coalesce("_last", F.lit(-1)) + n).cast("int"), "id": F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("PRENOM"), fold(F.col("_name"))), 256), "value": F.col("_name"), "type": F.lit("PRENOM"), "label": F.lit("Initiale"),
        "occurrences": F.lit(1), "aliases": F.array().cast("array<string>"), "active": F.lit(True), "blocked": F.lit(False), "isInitiale": F.lit(True), "initialeValue": F.col("_sign"),
    }
    rows = new.select(*[(values[c] if c in values else F.col("doc_id") if c == "doc_id" else F.lit(None)).cast(entities.schema[c].dataType).alias(c) for c in entities.columns])
    return changed.unionByName(rows)


# ── Forms of a name ──────────────────────────────────────────────────────────

#: Words that open a name but are no first name.
ARTICLES = ("la", "le", "les", "du", "de", "des", "un", "une", "au", "aux", "l", "d", "sur", "en")


def first_name(value: Column) -> Column:
    """First word of a name of several, if it looks like a first name: a capital, 2 to
    12 characters, not all capitals, no article; else null."""
    parts = F.split(squeeze(value), " ")
    first = F.element_at(parts, 1)
    fine = F.rlike(first, F.lit("^[A-ZÀ-Ö]")) & F.length(first).between(2, 12) & (first != F.upper(first)) & F.rlike(first, F.lit("[a-zà-öø-ÿ]")) & ~F.lower(first).isin(*ARTICLES)
    return F.when((F.size(parts) >= 2) & fine, first)


def graphic_variants(value: Column) -> Column:
    """All capitals of a mixed value; of one in capitals the form with small letters."""
    v = F.trim(value)
    mixed = F.array_join(F.transform(F.split(squeeze(v), " "), lambda w: F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")
    forms = F.array(F.when(F.upper(v) != v, F.upper(v)), F.when((F.upper(v) == v) & (mixed != v), mixed))
    return F.when(F.length(v) < 2, F.array().cast("array<string>")).otherwise(F.filter(forms, lambda x: x.isNotNull()))
