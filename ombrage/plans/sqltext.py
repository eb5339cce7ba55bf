"""The text operators written out as DuckDB SQL, for the oracles."""

from __future__ import annotations

import re

from ..functions.text import render

#: Rules whose look-around RE2 lacks, as steps it has: (pattern, replacement) in order.
WITHOUT_LOOKAROUND = {
    "€(?!{s}*[0-9])": [("€({s}*[0-9])", "\x01$1"), ("€", "e"), ("\x01", "€")],
    "{B}1°{s}*(?=[a-zA-ZÀ-ÿ])": [("{B}1°{s}*([a-zA-ZÀ-ÿ])", "1er $1")],
    "{B}([0-9]+){s}+E{B}(?![A-Za-z0-9_])": [("{B}([0-9]+){s}+E{B}", "$1 €")],
    "(?<![a-zA-ZÀ-ÿ])ta{s}+(société|somme|saisie|décision|charge|saisies){B}": [("(^|[^a-zA-ZÀ-ÿ])ta{s}+(société|somme|saisie|décision|charge|saisies){B}", "$1la $2")],
}


def quote(s: str) -> str:
    """A string literal; control characters through chr()."""
    parts = re.split("([\x00-\x1f])", s)
    out = [f"chr({ord(p)})" if re.fullmatch("[\x00-\x1f]", p) else "'" + p.replace("'", "''") + "'" for p in parts if p]
    return "(" + " || ".join(out or ["''"]) + ")"


def pattern(p: str) -> str:
    return quote(render(p, "re2").replace("\\Z", "\\z"))


def chain(expr: str, rules: list[tuple[str, str, str]]) -> str:
    """Ordered replacement rules as nested regexp_replace."""
    for pat, rep, flags in rules:
        for p, r in WITHOUT_LOOKAROUND.get(pat, [(pat, rep)]):
            new = re.sub(r"\$(\d)", r"\\\1", r.replace("\\", "\\\\"))
            opts = ("" if "1" in flags else "g") + ("i" if "i" in flags else "")
            prefix = "(?m)" if "m" in flags else ""
            expr = f"regexp_replace({expr}, {quote(prefix + render(p, 're2'))}, {quote(new)}, '{opts}')"
    return expr


def trim(expr: str) -> str:
    ws = render("{s}", "re2")
    return f"regexp_replace({expr}, {quote(f'^{ws}+|{ws}+' + chr(92) + 'z')}, '', 'g')"


def squeeze(expr: str) -> str:
    return trim(f"regexp_replace({expr}, {quote(render('{s}+', 're2'))}, ' ', 'g')")


def fold(expr: str) -> str:
    return f"lower(strip_accents({squeeze(expr)}))"


def title(expr: str) -> str:
    piece = "CASE WHEN regexp_matches(p, '^[A-Za-zÀ-ÖØ-öø-ÿ]') THEN upper(p[1]) || lower(p[2:]) ELSE p END"
    return f"array_to_string(list_transform(regexp_extract_all({squeeze(expr)}, '[-'' ]|[^-'' ]+'), lambda p: {piece}), '')"


def value(expr: str) -> str:
    flat = squeeze(expr)
    return f"CASE WHEN {flat} = upper({flat}) AND length({flat}) > 3 THEN {flat} ELSE {title(expr)} END"


def count(expr: str, p: str) -> str:
    return f"len(regexp_extract_all({expr}, {pattern(p)}))"


def crc32(blob: str) -> str:
    """CRC-32 of bytes, by the table of remainders (crc_table, a CTE of one row t)."""
    h = f"lower(hex({blob}))"
    bytes_ = f"list_transform(range(0, length({h}) // 2), lambda j: CAST('0x' || substr({h}, CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295)"


def crc_table() -> str:
    step = "SELECT i, i AS x0 FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)"
    for k in range(8):
        step = f"SELECT i, CASE WHEN x{k} & 1 = 1 THEN xor(x{k} >> 1, 3988292384) ELSE x{k} >> 1 END AS x{k + 1} FROM ({step})"
    return f"crc_table AS MATERIALIZED (SELECT list(x8 ORDER BY i) AS t FROM ({step}))"
