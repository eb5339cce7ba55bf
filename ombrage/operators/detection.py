"""Rule-based detection of entities.

Passes that only look at matches are Column expressions (typed patterns, typographic
words). The whole detection, whose passes build on one another in order, runs
within one document and so is a map over Arrow batches: no shuffle, no state between
documents. Block lists are parameters; a word list is broadcast once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import entity_rules as E
from ..functions.text import WS, deaccent, fold, normal_value, py_deaccent, py_squeeze, py_trim, py_upper, py_value, python_pattern, render, squeeze

ENTITY = (
    "doc_id long, ord int, id string, value string, type string, label string, occurrences int, aliases array<string>, active boolean, blocked boolean,"
    " prenom string, prenomVariants array<string>, members array<string>, isInitiale boolean, initialeValue string"
)


# ── Columns ──────────────────────────────────────────────────────────────────


def matches(text: Column, pattern: str, ignore_case: bool = False, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(render(pattern, "java", ignore_case)), F.lit(group))


def typed_matches(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, type, label, place, value, key): every typed value of a document once,
    with the first type in pattern order. A birth date counts as REF."""
    wanted = [(k, *p) for k, p in enumerate(E.PATTERNS) if kinds is None or p[0] in kinds]

    def placed(rank: int, kind: str, pattern: str, ignore: bool) -> Column:
        return F.transform(matches(F.coalesce(F.col(text), F.lit("")), pattern, ignore), lambda m, n: F.struct(F.lit(rank).alias("rank"), n.alias("place"), F.lit(kind).alias("kind"), m.alias("raw")))

    found = F.concat(*[placed(*w) for w in wanted])
    rows = docs.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.rank", "m.place", "m.kind", normal_value(F.col("m.raw")).alias("value"))
    first = rows.where("value <> ''").withColumn("key", F.lower("value")).groupBy("doc_id", "key").agg(F.min(F.struct("rank", "place", "kind", "value")).alias("f"))
    birth = F.col("f.kind") == "NAISSANCE"
    return first.select("doc_id", F.when(birth, "REF").otherwise(F.col("f.kind")).alias("type"), F.when(birth, E.BIRTH_LABEL).otherwise(F.col("f.kind")).alias("label"), (F.col("f.rank") * 1_000_000 + F.col("f.place")).alias("place"), F.col("f.value").alias("value"), "key")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, word, n): capitalised words that don't open a sentence.

    A word opens one if, of the three characters before it, the last that isn't white
    space ends a sentence. Such words are first replaced by a small letter, which leaves
    the boundaries around them as they are; what then matches is counted."""
    word = render(E.TYPOGRAPHIC)
    ends = f"[{E.SENTENCE_ENDS}]"
    opening = f"(?:(?<={ends})|(?<={ends}[{WS}])|(?<={ends}[{WS}]{{2}})){word}"
    rest = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), opening, "x")
    found = F.regexp_extract_all(rest, F.lit(word), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def not_blocked(words: DataFrame, column: str, block_list: DataFrame) -> DataFrame:
    """Rows of which no folded token is in block_list(word). An anti join on exploded
    tokens, whose strategy Catalyst takes by the list's size."""
    tokens = words.select("*", F.explode(F.split(F.lower(deaccent(F.col(column))), f"[{WS}]+")).alias("_token"))
    listed = block_list.select(fold(F.col("word")).alias("_token")).where("_token <> ''").distinct()
    hit = tokens.join(listed, "_token", "left_semi").select(*words.columns).distinct()
    return words.join(hit, words.columns, "left_anti")


# ── One document ─────────────────────────────────────────────────────────────


@dataclass
class Found:
    """An entity in the making."""

    value: str
    type: str
    label: str = ""
    occurrences: int = 1
    aliases: list[str] = field(default_factory=list)
    active: bool = True
    blocked: bool = False
    prenom: str | None = None
    variants: list[str] = field(default_factory=list)
    members: list[str] = field(default_factory=list)
    initial: str | None = None
    is_initial: bool = False

    @property
    def key(self) -> str:
        return low(self.value)


@lru_cache(maxsize=1 << 16)
def low(s: str) -> str:
    return py_deaccent(s.lower())


def blanks(s: str) -> list[str]:
    return py_squeeze(s).split(" ") if py_squeeze(s) else []


def levenshtein1(a: str, b: str) -> bool:
    """At most one edit apart: strip the common ends and look at what is left."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return len(a) <= 1 and len(b) <= 1


@lru_cache(maxsize=1 << 14)
def cut_forms(word: str) -> tuple[str, ...]:
    """A word and, from five letters, its forms with one letter left out."""
    return (word, *(word[:k] + word[k + 1 :] for k in range(len(word)))) if len(word) >= 5 else (word,)


#: A match of these types has one of these parts, in any case.
NEEDED = {
    "REF": ("rg", "n°"), "ADRESSE": ("rue", "avenue", "boulevard", "place", "allée", "quai", "route", "chemin", "impasse", "square", "cours"),
    "IBAN": ("fr",), "EMAIL": ("@",), "NAISSANCE": ("19", "20"),
}


class Detector:
    """Detection on one text, given the folded words that name nobody."""

    def __init__(self, block_list: frozenset[str]):
        self.listed = block_list

    def is_listed(self, value: str) -> bool:
        return any(p in self.listed for p in low(value).split())

    def alias(self, ent: Found, alias: str | None) -> None:
        a = py_value(alias)
        if len(a) > 1 and not self.is_listed(a) and a.lower() != ent.value.lower() and a.lower() not in (x.lower() for x in ent.aliases):
            ent.aliases.append(a)

    def titled(self, text: str, out: list[Found]) -> None:
        """Names after a title: a family name, and the first name with it."""
        for m in python_pattern(E.TITLED).finditer(text):
            whole = py_trim(m[2])
            if not whole or self.is_listed(whole):
                continue
            parts = blanks(whole)
            capital = next((k for k, p in enumerate(parts) if p == py_upper(p) and python_pattern("[A-ZÀ-Ö]{2,}").search(p)), None)
            at = len(parts) - 1 if capital is None else capital
            family, first = parts[at], " ".join(parts[:at] + parts[at + 1 :]) or None
            if first and low(first) in E.CIVIL_TITLES:
                first = None
            value = py_value(family)
            if not value or self.is_listed(value):
                continue
            known_first = any(e.type == "NOM" and e.prenom and low(value) in low(e.prenom).split() for e in out)
            if known_first and first:
                first = family  # the value stays: both fields then hold the same name
            ent = next((e for e in out if e.type == "NOM" and e.key == low(value)), None)
            if ent is None:
                out.append(ent := Found(value, "NOM"))
            if low(m[1].strip().removesuffix(".")) in E.COUNSEL_TITLES:
                ent.blocked = True
            if first and not ent.prenom:
                ent.prenom = first.strip()

    def typed(self, text: str, out: list[Found]) -> None:
        have = {e.value.lower() for e in out}
        lower = text.lower()
        odd = "\u017f" in text or "\u212a" in text  # letters that match s and k in any case, and aren't lowered to these
        for kind, pattern, ignore in E.PATTERNS:
            if kind in NEEDED and not odd and not any(x in lower for x in NEEDED[kind]):
                continue
            for m in python_pattern(pattern, ignore).finditer(text):
                value = py_value(m[0])
                if value and value.lower() not in have:
                    have.add(value.lower())
                    birth = kind == "NAISSANCE"
                    out.append(Found(value, "REF" if birth else kind, E.BIRTH_LABEL if birth else ""))

    def words(self, text: str) -> dict[str, int]:
        count: dict[str, int] = {}
        for m in python_pattern(E.TYPOGRAPHIC).finditer(text):
            before = py_trim(text[max(0, m.start() - 3) : m.start()])
            if (not before or before[-1] not in E.SENTENCE_ENDS) and not self.is_listed(m[0]):
                count[m[0]] = count.get(m[0], 0) + 1
        return count

    def promote(self, counts: dict[str, int], out: list[Found]) -> None:
        """Counted words become names, unless known, blocked or short and single."""
        blocked = {e.key for e in out if e.blocked}
        by_key: dict[str, Found] = {}
        for e in out:
            by_key.setdefault(e.key, e)
        for word, n in counts.items():
            value = py_value(word)
            if not value:
                continue
            ent = by_key.get(low(value))
            if ent is not None:
                ent.occurrences = max(ent.occurrences or 1, n)
            elif low(value) not in blocked and not (len(value) <= 6 and n < 2):
                out.append(ent := Found(value, "NOM", occurrences=n))
                by_key[ent.key] = ent

    def officers(self, text: str, out: list[Found]) -> None:
        names: set[str] = set()
        for pattern, ignore in E.OFFICERS:
            for m in python_pattern(pattern, ignore).finditer(text):
                names.add(low(py_trim(m[1])))
                names.update(low(p) for p in blanks(m[1]))
        for e in out:
            if e.type == "NOM":
                parts = [p for p in e.key.split() if len(p) >= 3]
                if e.key in names or parts and all(p in names for p in parts):
                    e.blocked = True

    def several(self, text: str, out: list[Found]) -> None:
        """Names of three, then of two words."""
        people = [e for e in out if e.type == "NOM"]
        names = {e.key for e in people}
        firsts = {low(p) for e in people if e.prenom for p in blanks(e.prenom)}
        shut = {e.key for e in people if e.blocked} | {low(p) for e in people if e.blocked for p in blanks(e.value) if len(p) >= 3}
        have = {e.value.lower() for e in out}
        new: dict[str, None] = {}
        for pattern in (E.THREE_WORDS, E.TWO_WORDS):
            for m in python_pattern(pattern).finditer(text):
                value = py_value(m[1])
                parts = value.split(" ")
                keys = [low(p) for p in parts]
                if any(k in E.CIVIL_TITLES or k in shut for k in keys) or any(self.is_listed(p) for p in parts) or all(len(p) <= 2 for p in parts):
                    continue
                if any(k in firsts for k in keys) and any(k in names for k in keys):
                    continue
                new[value] = None
        for value in new:
            if value.lower() not in have:
                have.add(value.lower())
                out.append(Found(value, "NOM"))

    def first_names(self, out: list[Found]) -> None:
        """Spellings of each first name, unless it is itself a name as frequent."""
        for e in out:
            if e.type != "NOM":
                continue
            for v in ([] if e.value == py_upper(e.value) else [py_upper(e.value)]) + ([e.value[0] + e.value[1:].lower()] if e.value == py_upper(e.value) and len(e.value) > 1 else []):
                self.alias(e, v)
            if e.prenom and not any(o is not e and o.type == "NOM" and o.key == low(e.prenom) and (o.occurrences or 1) >= (e.occurrences or 1) for o in out):
                p = e.prenom
                forms = [p, py_upper(p)] + ([p[0] + p[1:].lower()] if p == py_upper(p) else [])
                e.variants = list(dict.fromkeys([*e.variants, *forms]))

    def couples(self, text: str, out: list[Found]) -> None:
        new: list[Found] = []
        seen: set[str] = set()

        def couple(value: str, aliases: list[str]) -> None:
            if low(value) not in seen:
                seen.add(low(value))
                new.append(ent := Found(value, "COUPLE"))
                for a in aliases:
                    self.alias(ent, a)

        first, second, third, crossed = (python_pattern(p, i) for p, i in E.COUPLES)
        for m in first.finditer(text):
            if m[1].lower() not in E.CIVIL_TITLES and m[2].lower() not in E.CIVIL_TITLES:
                couple(py_value(f"{m[1]} et {m[2]} {m[3]}"), [*(a.format(m[3]) for a in E.COUPLE_ALIASES[0]), f"{m[1]} {m[3]}", f"{m[2]} {m[3]}"])
        for rx, k, group, form in ((second, 1, 3, "Monsieur et Madame {}"), (third, 2, 1, "Les époux {}")):
            for m in rx.finditer(text):
                name = py_value(m[group])
                couple(py_value(form.format(name)), [a.format(name) for a in E.COUPLE_ALIASES[k]])
        for m in crossed.finditer(text):
            pair = []
            for name in (py_value(m[1]), py_value(m[2])):
                ent = next((e for e in out if e.type == "NOM" and e.key == low(name)), None)
                if ent is None:
                    out.append(ent := Found(name, "NOM"))
                pair.append((ent, name))
            for (ent, own), (_, other) in (pair, pair[::-1]):
                self.alias(ent, other)
                self.alias(ent, f"Madame {own}")
        have = {e.value.lower() for e in out}
        out.extend(c for c in new if c.value.lower() not in have)

    def consolidate(self, out: list[Found]) -> list[Found]:
        """Equal values of a type become one; a name that is another's alias joins it,
        the longer value staying."""
        by_key: dict[tuple[str, str], Found] = {}
        for e in out:
            have = by_key.setdefault((e.type, e.key), e)
            if have is not e:
                have.occurrences = max(have.occurrences or 1, e.occurrences or 1)
                have.aliases += [a for a in e.aliases if low(a) not in {low(x) for x in have.aliases}]
        result = list(by_key.values())
        people, gone = [e for e in result if e.type == "NOM"], set()
        place = {e.key: k for k, e in enumerate(people)}
        for k, e in enumerate(people):
            at = -1
            while k not in gone or at >= 0:
                # The next name that an alias stands for; joining one may add aliases.
                later = [p for p in (place.get(low(a)) for a in e.aliases) if p is not None and p > at and p != k and p not in gone]
                if not later:
                    break
                at = min(later)
                o = people[at]
                pivot, lost = (e, o) if len(e.value) >= len(o.value) else (o, e)
                self.absorb(pivot, lost, max)
                gone.add(at if lost is o else k)
        kept = {id(e) for k, e in enumerate(people) if k not in gone}
        return [e for e in result if e.type != "NOM" or id(e) in kept]

    def absorb(self, pivot: Found, lost: Found, combine) -> None:
        self.alias(pivot, lost.value)
        for a in list(lost.aliases):
            self.alias(pivot, a)
        pivot.occurrences = combine(pivot.occurrences or 1, lost.occurrences or 1)

    @staticmethod
    def alike(cand: Found, pivot: Found) -> bool:
        """The candidate's spelling is a damaged form of the more frequent pivot's."""
        a, b = [low(p) for p in blanks(cand.value)], [low(p) for p in blanks(pivot.value)]
        near = lambda x, y: len(x) >= 5 and len(y) >= 5 and levenshtein1(x, y)
        if len(a) == 1:
            if len(b) > 1:
                return any(near(p, a[0]) for p in b)
            return len(b) == 1 and pivot.occurrences >= 3 * cand.occurrences and near(a[0], b[0])
        if len(a) != len(b):
            return False
        free = list(b)
        for x in a:
            hit = next((y for y in free if x == y or near(x, y)), None)
            if hit is None:
                return False
            free.remove(hit)
        return True

    def merge_fuzzy(self, out: list[Found]) -> list[Found]:
        """Less frequent near spellings join the most frequent; occurrences add up."""
        people = sorted((e for e in out if e.type == "NOM"), key=lambda e: -(e.occurrences or 1))
        gone: set[int] = set()
        # Words within one edit share the word or a form of it with a letter left out.
        index: dict[str, list[int]] = {}
        for k, e in enumerate(people):
            for form in {f for p in blanks(e.value) for f in cut_forms(low(p))}:
                index.setdefault(form, []).append(k)
        for k, cand in enumerate(people):
            if k in gone or len(cand.value) < 5:
                continue
            first = low(blanks(cand.value)[0])
            for j in sorted({j for f in cut_forms(first) for j in index.get(f, ())}):
                pivot = people[j]
                if j == k or j in gone or (pivot.occurrences or 1) <= (cand.occurrences or 1):
                    continue
                if self.alike(cand, pivot):
                    self.absorb(pivot, cand, int.__add__)
                    gone.add(k)
                    break
        gone = {id(people[k]) for k in gone}
        return [e for e in out if e.type == "NOM" and id(e) not in gone] + [e for e in out if e.type != "NOM"]

    @staticmethod
    def drop_covered(out: list[Found]) -> list[Found]:
        """Single-word names go that are an alias, or a first name that isn't frequent."""
        people = [e for e in out if e.type == "NOM"]
        frequent = {e.key for e in people if (e.occurrences or 1) >= 3}
        covered = {low(a) for e in people for a in e.aliases}
        firsts = {low(p) for e in people for p in (*(blanks(e.prenom) if e.prenom else ()), *e.variants) if len(p) >= 2} - frequent
        keep = [e for e in people if len(blanks(e.value)) > 1 or e.key not in covered and e.key not in firsts]
        return keep + [e for e in out if e.type != "NOM"]

    def detect(self, text: str) -> list[Found]:
        out: list[Found] = []
        self.titled(text, out)
        self.typed(text, out)
        self.promote(self.words(text), out)
        self.officers(text, out)
        self.several(text, out)
        self.first_names(out)
        self.couples(text, out)
        done = self.drop_covered(self.merge_fuzzy(self.consolidate(out)))
        return [e for e in done if not e.blocked]


def id_of(doc_id: object, e: Found) -> str:
    return hashlib.sha256(f"{doc_id}|{e.type}|{low(py_squeeze(e.value))}".encode()).hexdigest()


def entity_rows(doc_id: object, found: list[Found], first: int = 0) -> list[dict]:
    return [
        {
            "doc_id": doc_id, "ord": first + k, "id": id_of(doc_id, e), "value": e.value, "type": e.type, "label": e.label or e.type, "occurrences": e.occurrences, "aliases": e.aliases,
            "active": e.active, "blocked": e.blocked, "prenom": e.prenom, "prenomVariants": e.variants, "members": e.members, "isInitiale": e.is_initial, "initialeValue": e.initial,
        }
        for k, e in enumerate(found)
    ]


def from_row(r: dict) -> Found:
    listed = lambda k: list(r.get(k) if r.get(k) is not None else [])
    return Found(r["value"], r["type"] or "NOM", r.get("label") or r["type"] or "NOM", int(r.get("occurrences") or 1), listed("aliases"), r.get("active") is not False, bool(r.get("blocked")), r.get("prenom"), listed("prenomVariants"), listed("members"), r.get("initialeValue"), bool(r.get("isInitiale")))


ARROW_ENTITY = pa.schema(
    [
        ("doc_id", pa.int64()), ("ord", pa.int32()), ("id", pa.string()), ("value", pa.string()), ("type", pa.string()), ("label", pa.string()), ("occurrences", pa.int32()), ("aliases", pa.list_(pa.string())),
        ("active", pa.bool_()), ("blocked", pa.bool_()), ("prenom", pa.string()), ("prenomVariants", pa.list_(pa.string())), ("members", pa.list_(pa.string())), ("isInitiale", pa.bool_()), ("initialeValue", pa.string()),
    ]
)


def entity_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW_ENTITY)


#: Rows of texts that a map turns into Python objects at once.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that what a map holds beside a batch is bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def key_of_document() -> Column:
    """doc_id as a key; a null one fails, as its rows would share one unbounded list of
    entities. pseudonymise() and detect_entities() need no ids."""
    refused = F.raise_error(F.lit("rows without doc_id can't be joined with what was found in them: give each an id"))
    return F.when(F.col("doc_id").isNull(), refused.cast("string")).otherwise(F.col("doc_id").cast("string")).alias("_key")


def by_document(docs: DataFrame, text: str, *given: DataFrame, how: str = "left") -> DataFrame:
    """(doc_id, text) with the columns of given tables (one row a doc_id), dealt out for a
    heavy map: the texts are shuffled once, to a number of partitions that adaptive
    execution doesn't join by bytes. Joins are by sorting: what a map gives has its input's
    size to Catalyst, which would broadcast it whatever it grows to."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = docs.select(key_of_document(), F.col("doc_id").cast("long"), F.col(text).alias("text")).repartition(n, "_key")
    for table in given:
        out = out.join(table.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("_key"), *[c for c in table.columns if c != "doc_id"]).hint("merge"), "_key", how)
    return out.drop("_key")


#: Words of a list that is broadcast, at most; longer lists are joined (not_blocked).
MAX_WORDS = 500_000


def shared_words(spark: SparkSession, words: frozenset[str]):
    """A word list as a broadcast, its size checked."""
    if len(words) > MAX_WORDS:
        raise ValueError(f"a list of {len(words)} words is too long to broadcast; join it (not_blocked)")
    return spark.sparkContext.broadcast(words)


def word_set(words: DataFrame) -> frozenset[str]:
    """(word) rows, a table of bounded size, as the folded set that detection takes."""
    rows = words.select(fold(F.col("word")).alias("word")).where("word <> ''").distinct().limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"a list of over {MAX_WORDS} words is too long to broadcast; join it (not_blocked)")
    return frozenset(r[0] for r in rows)


def detect_entities(docs: DataFrame, block_list: frozenset[str] = frozenset(), text: str = "text") -> DataFrame:
    """(doc_id, text) to entities in order. block_list: folded words, a bounded table."""
    shared = shared_words(docs.sparkSession, block_list)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(shared.value)
        for batch in slices(batches):
            rows: list[dict] = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += entity_rows(doc_id, detector.detect(t or ""))
            yield entity_batch(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, ENTITY)


def near_names(names: DataFrame, column: str, key: str) -> DataFrame:
    """Pairs within a key at most one edit apart, the candidates of a fuzzy merge.

    An equi-join on (key, deletion variant): two strings within one edit share
    the string itself or a string with one character left out. No pairs but these
    meet."""
    emitted = names.select(key, F.col(column).alias("a")).distinct().select(key, "a", F.explode(F.when(F.length("a") > 0, variants_of(F.col("a"))).otherwise(F.array("a"))).alias("_v"))
    other = emitted.select(key, F.col("a").alias("b"), "_v")
    return emitted.join(other, [key, "_v"]).where("a < b").select(key, "a", "b").distinct().where(F.levenshtein("a", "b", 1) >= 0)


def variants_of(s: Column) -> Column:
    """A string and all strings with one of its characters left out."""
    cut = F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.concat(F.substring(s, F.lit(1), k - 1), F.substring(s, k + 1, F.length(s))))
    return F.array_distinct(F.concat(F.array(s), cut))


# ── Near spellings ───────────────────────────────────────────────────────────


def alike_words(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether words a are a damaged form of words b: one word near one of several or near the
    only one; of as many words, each equal or near one of its own."""
    near = lambda x, y: len(x) >= 5 and len(y) >= 5 and levenshtein1(x, y)
    if len(a) == 1:
        return any(near(y, a[0]) for y in b)
    if len(a) != len(b):
        return False
    free = list(b)
    for x in a:
        at = next((k for k, y in enumerate(free) if x == y or near(x, y)), None)
        if at is None:
            return False
        del free[at]
    return True


def joined_spellings(words: list[tuple[str, ...]], long: list[bool], counts: list[int | None]) -> tuple[list[int | None], list[int | None]]:
    """Counts in the end, and the place of the name that each joins, of a document's names in
    order of frequency.

    Names of equal words are one class, and classes that are alike are found once. In order,
    counts within a class only fall, and only the first that is left of it can rise: where any
    of a class is frequent enough the first is. So a name is held against one of each class."""
    classes: dict[tuple[str, ...], int] = {}
    of = [classes.setdefault(w, len(classes)) for w in words]
    members: list[list[int]] = [[] for _ in classes]
    for k, c in enumerate(of):
        if counts[k] is not None:  # a name without a count joins nothing, nor does anything join it
            members[c].append(k)
    index: dict[str, list[int]] = {}
    for w, c in classes.items():
        for form in {f for x in w for f in cut_forms(x)}:
            index.setdefault(form, []).append(c)
    names, front, to = list(classes), [0] * len(classes), [None] * len(words)
    alike: dict[int, list[tuple[int, int]]] = {}
    for k, c in enumerate(of):
        if not long[k] or not words[k] or counts[k] is None:
            continue
        if c not in alike:
            met = {o for f in cut_forms(words[k][0]) for o in index.get(f, ())}
            alike[c] = [(o, 3 if len(words[k]) == 1 == len(names[o]) else 1) for o in met if alike_words(words[k], names[o])]
        own, best = counts[k], None
        for o, times in alike[c]:
            rows = members[o]
            while front[o] < len(rows) and to[rows[front[o]]] is not None:
                front[o] += 1
            if front[o] < len(rows):
                j = rows[front[o]]
                if counts[j] > own and counts[j] >= times * own and (best is None or j < best):
                    best = j
        if best is not None:
            to[k] = best
            counts[best] += own
    return counts, to


def join_spellings(names: DataFrame) -> DataFrame:
    """(doc_id, ord, value, occurrences) to the same with joined, the ord of the name that a
    spelling joins (null: it stays), and occurrences as they are in the end.

    In order of frequency, then ord, each spelling of five characters and more joins
    the first name that it is alike to and that is more frequent by then, three times as
    frequent where both are one word; what joins adds its occurrences. Each step builds on those
    before it, so a document's names are one list, which a map goes through once."""
    words = F.transform(F.filter(F.split(squeeze(F.col("value")), " "), lambda w: w != ""), lambda w: F.lower(deaccent(w)))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d")
    row = F.struct(F.col("occurrences").isNull().alias("none"), (-F.col("occurrences").cast("long")).alias("less"), "ord", "doc_id", "value", (F.length("value") >= 5).alias("long"), words.alias("words"))
    listed = names.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("all")).select("all")
    schema = T.StructType([*listed.schema.fields, T.StructField("n", T.ArrayType(T.LongType())), T.StructField("to", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, to = [], []
            for rows in batch.column("all"):
                less, long, said = (rows.values.field(c).to_pylist() for c in ("less", "long", "words"))
                done = joined_spellings([tuple(w or ()) for w in said], [bool(x) for x in long], [None if x is None else -x for x in less])
                n.append(done[0])
                to.append(done[1])
            yield pa.RecordBatch.from_arrays([batch.column("all"), pa.array(n, pa.list_(pa.int64())), pa.array(to, pa.list_(pa.int32()))], names=["all", "n", "to"])

    each = F.transform("all", lambda e, i: F.struct(e["doc_id"].alias("doc_id"), e["ord"].alias("ord"), e["value"].alias("value"), F.get("n", i).alias("occurrences"), F.get("all", F.get("to", i))["ord"].alias("joined")))
    return listed.mapInArrow(run, schema).select(F.explode(each).alias("e")).select("e.*")
