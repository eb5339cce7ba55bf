"""Repair of broken lines and stray spaces.

Tests of adjacent lines are windows over (doc_id, index). What repeats until nothing
changes, and what needs offsets, works on one document in a Pandas UDF: both only look
at their own document, so neither shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import BOUNDARY, WS, js_trim, py_trim
from .detection import shared_words

#: Fixed values.
ENDS_WORD = f"[a-zA-Z0-9À-ÖØ-öø-ÿ][{WS}]*\\z"
STARTS_LOWER = "^[a-zàâäéèêëîïôùûüçœæ]"
ENDS_HYPHEN = f"[a-zA-ZÀ-ÖØ-öø-ÿ]-[{WS}]*\\z"
ENDS_TITLE = f"(?iu){BOUNDARY}(?:Monsieur|Madame|Mademoiselle|Maître|Maitre|Docteur|Professeur|M\\.|Mme\\.?|Me\\.?|Dr\\.?|Pr\\.?)[{WS}]*\\z"
ENDS_CLAUSE = f"[.?!:;)»\"…—\\]][{WS}]*\\z"
MAX_PASSES, MAX_PASSES_FROM = 20, 30


def suspect_break(line: Column, following: Column) -> Column:
    """The line break between two lines looks like a break within a sentence."""
    a, b = F.coalesce(line, F.lit("")), F.coalesce(following, F.lit(""))
    open_end = ~F.rlike(a, F.lit(ENDS_CLAUSE)) & (F.rlike(js_trim(b), F.lit(STARTS_LOWER)) | F.rlike(js_trim(a), F.lit(ENDS_WORD)))
    return (js_trim(a) != "") & (js_trim(b) != "") & (F.rlike(a, F.lit(ENDS_HYPHEN)) | F.rlike(a, F.lit(ENDS_TITLE)) | open_end)


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("index", "line"))


def suspect_breaks(lines: DataFrame) -> DataFrame:
    """(doc_id, index, line) to (doc_id, lineIdx, skipCount).

    Each non-blank line is held against the next non-blank one. Where blank lines
    stand between and the break is suspect, that next line is not tested itself; in a
    chain of such breaks every other one counts, which the parity of a line's place in
    its chain decides."""
    order = W.partitionBy("doc_id").orderBy("index")
    full = lines.where(js_trim(F.col("line")) != "")
    tested = full.select("doc_id", "index", F.lead("index").over(order).alias("next"), suspect_break(F.col("line"), F.lead("line").over(order)).alias("suspect"))
    jump = F.coalesce(F.col("suspect") & (F.col("next") - F.col("index") > 1), F.lit(False))
    placed = tested.withColumns({"jump": jump, "row": F.row_number().over(order)})
    chain = placed.withColumn("last_other", F.max(F.when(~F.col("jump"), F.col("row"))).over(order.rowsBetween(W.unboundedPreceding, -1)))
    before = F.col("row") - 1 - F.coalesce("last_other", F.lit(0))
    return chain.where(F.col("suspect") & (before % 2 == 0)).select("doc_id", F.col("index").alias("lineIdx"), (F.col("next") - F.col("index") + 1).alias("skipCount"))


def suspects_with_noise(breaks: DataFrame, scored: DataFrame, from_line: int = 0) -> DataFrame:
    """Breaks from a line on, and unreadable lines as suspects of their own."""
    found = breaks.where(F.col("lineIdx") >= from_line) if from_line > 0 else breaks
    noisy = scored.where("isGibberish").select("doc_id", F.col("index").alias("lineIdx"), F.lit(1).alias("skipCount"))
    return found.unionByName(noisy.join(found, ["doc_id", "lineIdx"], "left_anti"))


def drop_blank_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: js_trim(x) != ""), "\n")


_HYPHEN, _TITLE, _CLAUSE, _WORD, _LOWER = (re.compile(p.replace("(?iu)", "").replace("\\z", "\\Z"), re.I if p.startswith("(?iu)") else 0) for p in (ENDS_HYPHEN, ENDS_TITLE, ENDS_CLAUSE, ENDS_WORD, STARTS_LOWER))


def is_suspect(a: str, b: str) -> bool:
    if not py_trim(a) or not py_trim(b):
        return False
    if _HYPHEN.search(a) or _TITLE.search(a):
        return True
    return not _CLAUSE.search(a) and bool(_LOWER.search(py_trim(b)) or _WORD.search(py_trim(a)))


def breaks_of(lines: list[str]) -> dict[int, int]:
    """Line index to the number of lines that the merged line replaces."""
    full = [i for i, x in enumerate(lines) if py_trim(x)]
    out, skip = {}, False
    for a, b in zip(full, full[1:], strict=False):
        if skip:
            skip = False
            continue
        if is_suspect(lines[a], lines[b]):
            out[a] = b - a + 1
            skip = b - a > 1
    return out


def merge_pass(lines: list[str], breaks: dict[int, int]) -> tuple[list[str], int]:
    out, i, n = [], 0, 0
    while i < len(lines):
        k = breaks.get(i)
        if k is None:
            out.append(lines[i])
            i += 1
        else:
            tail = lines[i + k - 1] if i + k - 1 < len(lines) else ""
            out.append(re.sub(f"[{WS}]+\\Z", "", lines[i]) + " " + re.sub(f"\\A[{WS}]+", "", tail))
            i, n = i + k, n + 1
    return out, n


def fix_breaks(text: str, from_line: int = 0, passes: int = MAX_PASSES) -> str:
    """Merge suspect breaks until none is left, or `passes` passes."""
    lines = text.split("\n")
    for _ in range(passes):
        found = {i: k for i, k in breaks_of(lines).items() if i >= from_line}
        lines, n = merge_pass(lines, found)
        if not n:
            break
    return "\n".join(lines)


@F.pandas_udf(StringType())
def fix_all_breaks(text: pd.Series) -> pd.Series:
    return text.map(fix_breaks, na_action="ignore")


@F.pandas_udf(StringType())
def fix_breaks_from(text: pd.Series, from_line: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else fix_breaks(t, int(k), MAX_PASSES_FROM) for t, k in zip(text, from_line, strict=True)])


def merge_line(text: Column | str, line: Column | str, skip: Column | str) -> Column:
    """One chosen break merged: the line and the last of the skip lines from it become one,
    a space between. Without a line, or with one beyond the text, the text stays."""
    text, line, skip = (F.col(c) if isinstance(c, str) else c for c in (text, line, skip))
    lines = F.split(text, "\n")
    n = F.size(lines)
    head = F.regexp_replace(F.get(lines, line), f"[{WS}]+\\z", "")
    tail = F.regexp_replace(F.coalesce(F.get(lines, line + skip - 1), F.lit("")), f"\\A[{WS}]+", "")
    rest = F.slice(lines, line + skip + 1, F.greatest(n - line - skip, F.lit(0)))
    merged = F.array_join(F.concat(F.slice(lines, 1, line), F.array(F.concat(head, F.lit(" "), tail)), rest), "\n")
    return F.when(line.isNull() | skip.isNull() | (line < 0) | (line >= n), text).otherwise(merged)


# ── Stray spaces ─────────────────────────────────────────────────────────────

#: Fixed values.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
TOKEN = re.compile(f"[{LETTER}'’()\\[\\]0-9°.,]+")
WIDE_GAP = re.compile(f"([{LETTER}0-9][{LETTER}0-9]+|[0-9]+)( {{2,}})([{LETTER}0-9][{LETTER}0-9]+|[0-9]+)")
LETTERS = re.compile(f"[{LETTER}]+")
NEVER_ALONE = frozenset("aàyeoiu")
TWO_SPACES = frozenset("ldsnmcjt")
LONGEST_ENTRY = 5

Suspect = tuple[int, int, str, str]


def split_run(run: list[str], words: Iterable[str]) -> list[str]:
    """Single characters into words: from the end, the longest entry that fits,
    else one letter."""
    if not words or len(run) <= 2:
        return ["".join(run)]
    low, out, end = "".join(run).lower(), [], len(run)
    while end:
        size = next((k for k in range(min(LONGEST_ENTRY, end), 1, -1) if low[end - k : end] in words), 1)
        out.append("".join(run[end - size : end]))
        end -= size
    return out[::-1]


def merge_tokens(tokens: list[str], words: Iterable[str] = frozenset()) -> str:
    """Proposal for a run of short tokens: single letters and single digits join among
    themselves (signs with either), longer tokens stand alone."""
    out: list[str] = []
    run: list[str] = []
    kind: str | None = None

    def close() -> None:
        nonlocal run, kind
        if run:
            out.extend(split_run(run, words) if kind == "letter" and len(run) > 2 else ["".join(run)])
        run, kind = [], None

    for t in tokens:
        if len(t) > 1:
            close()
            out.append(t)
            continue
        own = "digit" if t in "0123456789" else "letter" if LETTERS.fullmatch(t) else None
        if own and kind and own != kind:
            close()
        run.append(t)
        kind = own or kind
    close()
    return " ".join(out)


def _lines_at(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def _short_runs(text: str, words: Iterable[str]) -> Iterator[Suspect]:
    for at, line in _lines_at(text):
        least, run = (2 if "  " in line else 3), []
        for m in [*TOKEN.finditer(line), None]:
            if m is not None and len(m[0]) <= 2:
                run.append(m)
                continue
            gaps = (line[a.end() : b.start()] for a, b in zip(run, run[1:], strict=False))
            if len(run) >= least and not any(re.search("[-/]", g) for g in gaps):
                start, end = run[0].start(), run[-1].end()
                plain, merged = " ".join(x[0] for x in run), merge_tokens([x[0] for x in run], words)
                if merged != plain or line[start:end] != plain:
                    yield at + start, at + end, line[start:end], merged
            run = []


def _wide_gaps(text: str) -> Iterator[Suspect]:
    for m in WIDE_GAP.finditer(text):
        if not re.search("[-/]", text[max(0, m.start() - 2) : m.end() + 2]):
            yield m.start(), m.end(), m[0], f"{m[1]} {m[3]}"


def _lone_letters(text: str) -> Iterator[Suspect]:
    for at, line in _lines_at(text):
        found = list(LETTERS.finditer(line))
        for a, b in zip(found, found[1:], strict=False):
            gap, letter = line[a.end() : b.start()], a[0].lower()
            if not re.fullmatch(" {1,3}", gap) or len(a[0]) != 1 or len(b[0]) < 3:
                continue
            if letter in NEVER_ALONE or letter in TWO_SPACES and len(gap) < 2:
                continue
            yield at + a.start(), at + b.end(), line[a.start() : b.end()], a[0] + b[0]


def spacing_suspects(text: str, words: Iterable[str] = frozenset(), from_line: int = 0) -> list[Suspect]:
    """(start, end, original, merged) of stray spaces, sorted; a suspect that overlaps
    the one before it in the sorted list is left out."""
    found = list(_short_runs(text, words))
    for rule in (_wide_gaps, _lone_letters):
        for s in rule(text):
            if not any(o[0] <= s[0] and o[1] >= s[1] for o in found):
                found.append(s)
    found.sort(key=lambda s: s[0])
    kept = [s for k, s in enumerate(found) if k == 0 or s[0] >= found[k - 1][1]]
    if from_line > 0:
        first = sum(len(x) + 1 for x in text.split("\n")[:from_line])
        kept = [s for s in kept if s[0] >= first]
    return kept


def apply_spacing(text: str, suspects: list[Suspect]) -> str:
    for start, end, _, merged in sorted(suspects, reverse=True):
        text = text[:start] + merged + text[end:]
    return text


SUSPECT = "array<struct<start:int,end:int,original:string,merged:string>>"


def find_spacing(docs: DataFrame, words: frozenset[str] = frozenset(), from_line: int = 0, text: str = "text") -> DataFrame:
    """One row a suspect. words: the dictionary, a bounded table of short words that
    each executor gets once."""
    shared = shared_words(docs.sparkSession, words)

    @F.pandas_udf(SUSPECT)
    def scan(column: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end", "original", "merged"), s, strict=True)) for s in spacing_suspects(t or "", shared.value, from_line)] for t in column])

    return docs.select("doc_id", F.explode(scan(F.col(text))).alias("s")).select("doc_id", "s.*")


def fix_spacing(docs: DataFrame, words: frozenset[str] = frozenset(), text: str = "text") -> DataFrame:
    shared = shared_words(docs.sparkSession, words)

    @F.pandas_udf("string")
    def fix(column: pd.Series) -> pd.Series:
        return column.map(lambda t: apply_spacing(t, spacing_suspects(t, shared.value)), na_action="ignore")

    return docs.select("doc_id", fix(F.col(text)).alias("text"))


def without_overlaps(spans: DataFrame) -> DataFrame:
    """(doc_id, start, end, ...) without spans that begin before the end of their
    immediate predecessor in the sorted list."""
    order = W.partitionBy("doc_id").orderBy("start", "end")
    return spans.withColumn("_before", F.lag("end").over(order)).where(F.col("_before").isNull() | (F.col("start") >= F.col("_before"))).drop("_before")
