"""Detection, resolution and substitution of whole documents as DuckDB SQL.

These oracles say each pass as a relation of its own (src: doc_id, text; the last one of
detection is found). Steps that build on one another within a document are recursive: the first
names that are known before a title, names that are another's alias, near spellings that
join, and places in a text from left to right.
"""

from __future__ import annotations

from ..functions import entity_rules as E
from ..functions import text as T
from . import sqltext as Q


def strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values)) + "]"


def low(x: str) -> str:
    return f"lower(strip_accents({x}))"


def words(x: str) -> str:
    """Words of a text; none of an empty one."""
    return f"list_filter(string_split({Q.squeeze(x)}, ' '), lambda w: w <> '')"


def found_all(text: str, pattern: str, group: int = 0, ignore: bool = False) -> str:
    return f"regexp_extract_all({text}, {Q.quote(('(?i)' if ignore else '') + T.render(pattern, 're2'))}, {group})"


def once(items: str, key: str) -> str:
    """A list without the elements whose key an earlier one has; key has {} for the element."""
    keys = f"list_transform({items}, lambda y: {key.replace('{}', 'y')})"
    return f"list_filter({items}, lambda x, i: list_position({keys}, {key.replace('{}', 'x')}) = i)"


def ends_sql(text: str, ends: str, word: str) -> str:
    ws = T.render("{s}", "re2")
    return f"regexp_replace({text}, {Q.quote(f'([{ends}]{ws}{{0,2}}){word}')}, '\\1x', 'g')"


def detection(block_list: frozenset[str]) -> str:
    """CTEs from src to found."""
    blocked = strings(block_list)
    listed = lambda x: f"list_has_any({words(low(x))}, {blocked})"
    value = Q.value
    civil, counsel = strings(E.CIVIL_TITLES), strings(E.COUNSEL_TITLES)
    typo = T.render(E.TYPOGRAPHIC, "re2")
    typed = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS rank, unnest(range(len(m))) AS place, '{t}' AS kind, unnest(m) AS raw FROM (SELECT doc_id, {found_all('text', p, 0, i)} AS m FROM src)" for k, (t, p, i) in enumerate(E.PATTERNS)
    )
    officers = " UNION ALL ".join(f"SELECT doc_id, unnest({found_all('text', p, 1, i)}) AS name FROM src" for p, i in E.OFFICERS)
    several = " UNION ALL ".join(f"SELECT doc_id, {k} AS p, unnest(range(len(m))) AS i, unnest(m) AS raw FROM (SELECT doc_id, {found_all('text', p, 1)} AS m FROM src)" for k, p in enumerate((E.THREE_WORDS, E.TWO_WORDS)))
    (c1, i1), (c2, i2), (c3, i3), (c4, i4) = E.COUPLES
    def filled(forms: list[str], name: str) -> str:
        return "[" + ", ".join(f"replace('{f}', '{{}}', {name})" for f in forms) + "]"

    near = lambda a, b: f"(length({a}) >= 5 AND length({b}) >= 5 AND levenshtein({a}, {b}) <= 1)"
    # Aliases that an entity takes: spelt as values, of two letters, not listed, not the value.
    taken = lambda items, own: once(f"list_filter(list_transform({items}, lambda z: {value('z')}), lambda z: length(z) > 1 AND NOT {listed('z')} AND lower(z) <> lower({own}))", "lower({})")
    first = f"array_to_string(list_concat(parts[:pos - 1], parts[pos + 1:]), ' ')"
    return f"""
t0 AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS title, unnest(b) AS raw FROM (SELECT doc_id, {found_all('text', E.TITLED, 1)} AS a, {found_all('text', E.TITLED, 2)} AS b FROM src)),
t1 AS (SELECT doc_id, i, title, {words('raw')} AS parts, raw FROM t0 WHERE {Q.trim('raw')} <> '' AND NOT {listed('raw')}),
t2 AS (SELECT *, coalesce(list_filter(range(1, len(parts) + 1), lambda k: parts[k] = upper(parts[k]) AND regexp_matches(parts[k], '[A-ZÀ-Ö]{{2,}}'))[1], len(parts)) AS pos FROM t1),
t3 AS (SELECT doc_id, i, title, parts[pos] AS family, CASE WHEN {first} = '' OR list_contains({civil}, {low(first)}) THEN NULL ELSE {first} END AS first FROM t2),
t4 AS (SELECT *, {value('family')} AS value FROM t3),
t5 AS MATERIALIZED (SELECT *, {low('value')} AS key, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM t4 WHERE value <> '' AND NOT {listed('value')}),
t6 AS MATERIALIZED (SELECT *, first IS NOT NULL AND n = min(CASE WHEN first IS NOT NULL THEN n END) OVER (PARTITION BY doc_id, key) AS gives FROM t5),
known AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS have FROM (SELECT DISTINCT doc_id FROM t6)
  UNION ALL SELECT t6.doc_id, t6.n, CASE WHEN gives AND NOT list_contains(have, key) THEN list_concat(have, {words(low('first'))}) ELSE have END FROM known JOIN t6 ON t6.doc_id = known.doc_id AND t6.n = known.n + 1
),
t7 AS (SELECT t6.*, CASE WHEN list_contains(have, key) THEN family ELSE first END AS prenom FROM t6 JOIN known ON known.doc_id = t6.doc_id AND known.n = t6.n - 1),
e1 AS (SELECT doc_id, 1 AS stage, min(n) AS o, arg_min(value, n) AS value, 'NOM' AS type, '' AS label, 1 AS occ, bool_or(list_contains({counsel}, {low("regexp_replace(trim(title), '[.]$', '')")})) AS shut, max(CASE WHEN gives THEN prenom END) AS prenom FROM t7 GROUP BY doc_id, key),
y0 AS ({typed}),
y1 AS (SELECT doc_id, rank * 1000000 + place AS o, kind, {value('raw')} AS value FROM y0),
y2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(value) ORDER BY o) AS n FROM y1 WHERE value <> ''),
e2 AS (SELECT doc_id, 2, o, value, CASE WHEN kind = 'NAISSANCE' THEN 'REF' ELSE kind END, CASE WHEN kind = 'NAISSANCE' THEN '{E.BIRTH_LABEL}' ELSE '' END, 1, false, NULL FROM y2 WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM e1 WHERE e1.doc_id = y2.doc_id AND lower(e1.value) = lower(y2.value))),
b1 AS MATERIALIZED (SELECT * FROM e1 UNION ALL SELECT * FROM e2),
w0 AS (SELECT doc_id, unnest(range(len(m))) AS i, unnest(m) AS word FROM (SELECT doc_id, regexp_extract_all({ends_sql('text', E.SENTENCE_ENDS, typo)}, {Q.quote(typo)}) AS m FROM src)),
w1 AS (SELECT doc_id, word, min(i) AS o, count(*) AS n, {value('word')} AS value FROM w0 WHERE NOT {listed('word')} GROUP BY doc_id, word),
w2 AS MATERIALIZED (SELECT *, {low('value')} AS key, EXISTS (SELECT 1 FROM b1 WHERE b1.doc_id = w1.doc_id AND {low('b1.value')} = {low('w1.value')}) AS had FROM w1 WHERE value <> ''),
w3 AS (SELECT *, min(CASE WHEN length(value) > 6 OR n >= 2 THEN o END) OVER (PARTITION BY doc_id, key) AS maker FROM w2),
e4 AS (SELECT doc_id, 4, min(o), arg_min(value, o), 'NOM', '', max(n), false, NULL FROM w3 WHERE NOT had AND o >= maker GROUP BY doc_id, key),
b2 AS MATERIALIZED (
  SELECT b.doc_id, stage, o, value, type, label, CASE WHEN lead THEN greatest(occ, coalesce(m, 1)) ELSE occ END AS occ, shut, prenom
  FROM (SELECT *, {low('value')} AS key, row_number() OVER (PARTITION BY doc_id, {low('value')} ORDER BY stage, o) = 1 AS lead FROM b1) b
  LEFT JOIN (SELECT doc_id, key, max(n) AS m FROM w2 WHERE had GROUP BY doc_id, key) w ON w.doc_id = b.doc_id AND w.key = b.key
  UNION ALL SELECT * FROM e4
),
o0 AS ({officers}),
o1 AS (SELECT doc_id, list_distinct(flatten(list(list_append({words(low('name'))}, {low(Q.trim('name'))})))) AS names FROM o0 GROUP BY doc_id),
b3 AS MATERIALIZED (
  SELECT b2.* EXCLUDE (long) REPLACE (shut OR coalesce(type = 'NOM' AND (list_contains(coalesce(names, []), {low('value')}) OR (len(long) > 0 AND len(list_filter(long, lambda p: NOT list_contains(coalesce(names, []), p))) = 0)), false) AS shut)
  FROM (SELECT *, list_filter({words(low('value'))}, lambda p: length(p) >= 3) AS long FROM b2) b2 LEFT JOIN o1 ON o1.doc_id = b2.doc_id
),
p0 AS (SELECT doc_id, list({low('value')}) FILTER (type = 'NOM') AS names, flatten(list({words(low("coalesce(prenom, '')"))}) FILTER (type = 'NOM')) AS firsts,
  flatten(list(list_append(list_filter({words(low('value'))}, lambda p: length(p) >= 3), {low('value')})) FILTER (type = 'NOM' AND shut)) AS shuts, list(lower(value)) AS have FROM b3 GROUP BY doc_id),
s0 AS ({several}),
s1 AS (SELECT doc_id, p * 1000000 + i AS o, value, list_transform(parts, lambda w: {low('w')}) AS keys, parts FROM (SELECT *, {value('raw')} AS value, string_split({value('raw')}, ' ') AS parts FROM s0)),
s2 AS (SELECT s1.doc_id, o, value FROM s1 LEFT JOIN p0 ON p0.doc_id = s1.doc_id
  WHERE NOT list_has_any(keys, list_concat({civil}, coalesce(shuts, []))) AND len(list_filter(parts, lambda w: {listed('w')})) = 0 AND len(list_filter(parts, lambda w: length(w) > 2)) > 0
    AND NOT (list_has_any(keys, coalesce(firsts, [])) AND list_has_any(keys, coalesce(names, []))) AND NOT list_contains(coalesce(have, []), lower(value))),
e6 AS (SELECT doc_id, 6, min(o), arg_min(value, o), 'NOM', '', 1, false, NULL FROM s2 GROUP BY doc_id, lower(value)),
b4 AS MATERIALIZED (SELECT *, {low('value')} AS key FROM (SELECT * FROM b3 UNION ALL SELECT * FROM e6)),
x0 AS (SELECT doc_id, unnest(range(len(a))) AS i, {value('unnest(a)')} AS one, {value('unnest(b)')} AS two FROM (SELECT doc_id, {found_all('text', c4, 1, i4)} AS a, {found_all('text', c4, 2, i4)} AS b FROM src)),
x1 AS (SELECT doc_id, 2 * i AS o, one AS own, two AS other FROM x0 UNION ALL SELECT doc_id, 2 * i + 1, two, one FROM x0),
x2 AS (SELECT doc_id, {low('own')} AS key, min(o) AS o, arg_min(own, o) AS value, flatten(list([other, 'Madame ' || own] ORDER BY o)) AS said FROM x1 GROUP BY doc_id, {low('own')}),
b5 AS MATERIALIZED (SELECT * FROM b4 UNION ALL SELECT doc_id, 8, o, value, 'NOM', '', 1, false, NULL, key FROM x2 WHERE NOT EXISTS (SELECT 1 FROM b4 WHERE b4.doc_id = x2.doc_id AND type = 'NOM' AND b4.key = x2.key)),
up AS (SELECT *, replace(upper(value), 'ß', 'SS') AS upper_value FROM b5),
v0 AS MATERIALIZED (
  SELECT up.doc_id, up.stage, up.o, up.value, up.type, up.label, up.occ, up.shut, up.prenom, up.key,
    CASE WHEN type = 'NOM' THEN {taken("list_concat(CASE WHEN stage < 8 THEN [upper_value] ELSE [] END, CASE WHEN row_number() OVER (PARTITION BY up.doc_id, up.key, type ORDER BY up.stage, up.o) = 1 THEN coalesce(said, []) ELSE [] END)", 'up.value')} ELSE [] END AS aliases
  FROM up LEFT JOIN x2 ON x2.doc_id = up.doc_id AND x2.key = up.key
),
v1 AS MATERIALIZED (
  SELECT v.* EXCLUDE (list_distinct_in_order), CASE WHEN prenom IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b4 o WHERE o.doc_id = v.doc_id AND o.type = 'NOM' AND o.key = {low('v.prenom')} AND o.occ >= v.occ AND (o.stage <> v.stage OR o.o <> v.o))
    THEN list_distinct_in_order ELSE [] END AS variants
  FROM (SELECT *, CASE WHEN prenom IS NULL THEN [] ELSE {once("list_concat([prenom, upper(prenom)], CASE WHEN prenom = upper(prenom) THEN [prenom[1] || lower(prenom[2:])] ELSE [] END)", '{}')} END AS list_distinct_in_order FROM v0) v
),
q0 AS (
  SELECT doc_id, 0 AS rule, unnest(range(len(a))) AS i, unnest(a) AS a, unnest(b) AS b, unnest(c) AS c FROM (SELECT doc_id, {found_all('text', c1, 1)} AS a, {found_all('text', c1, 2)} AS b, {found_all('text', c1, 3)} AS c FROM src)
  UNION ALL SELECT doc_id, 1, unnest(range(len(c))), '', '', unnest(c) FROM (SELECT doc_id, {found_all('text', c2, 3, i2)} AS c FROM src)
  UNION ALL SELECT doc_id, 2, unnest(range(len(c))), '', '', unnest(c) FROM (SELECT doc_id, {found_all('text', c3, 1, i3)} AS c FROM src)
),
q1 AS (SELECT *, CASE rule WHEN 0 THEN {value("a || ' et ' || b || ' ' || c")} WHEN 1 THEN {value("'Monsieur et Madame ' || " + value('c'))} ELSE {value("'Les époux ' || " + value('c'))} END AS value,
  CASE rule WHEN 0 THEN list_concat({filled(E.COUPLE_ALIASES[0], 'c')}, [a || ' ' || c, b || ' ' || c]) WHEN 1 THEN {filled(E.COUPLE_ALIASES[1], value('c'))} ELSE {filled(E.COUPLE_ALIASES[2], value('c'))} END AS said
  FROM q0 WHERE rule > 0 OR NOT list_has_any([lower(a), lower(b)], {civil})),
q2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {low('value')} ORDER BY rule, i) AS n FROM q1),
q3 AS (SELECT doc_id, 9 AS stage, rule * 1000000 + i AS o, value, 'COUPLE' AS type, '' AS label, 1 AS occ, false AS shut, NULL AS prenom, {low('value')} AS key, {taken('said', 'value')} AS aliases, [] AS variants
  FROM q2 WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM b5 WHERE b5.doc_id = q2.doc_id AND lower(b5.value) = lower(q2.value))),
g0 AS (SELECT * FROM v1 UNION ALL SELECT * FROM q3),
g1 AS (SELECT doc_id, type, key, min(stage * 100000000 + o) AS o, arg_min(value, stage * 100000000 + o) AS value, arg_min(label, stage * 100000000 + o) AS label, max(occ) AS occ, arg_min(shut, stage * 100000000 + o) AS shut,
  arg_min(coalesce(prenom, ''), stage * 100000000 + o) AS prenom, arg_min(variants, stage * 100000000 + o) AS variants, flatten(list(aliases ORDER BY stage, o)) AS aliases FROM g0 GROUP BY doc_id, type, key),
g2 AS MATERIALIZED (SELECT * REPLACE ({once('aliases', low('{}'))} AS aliases) FROM g1),
-- Names that are an alias of another: one step joins two of them or goes on to the next.
n0 AS (SELECT doc_id, list(struct_pack(k := key, v := value, a := aliases, n := CAST(occ AS BIGINT), gone := false) ORDER BY o) AS p FROM g2 WHERE type = 'NOM' GROUP BY doc_id),
n1 AS (SELECT * FROM n0 WHERE list_has_any(list_transform(p, lambda e: e.k), flatten(list_transform(p, lambda e: list_transform(e.a, lambda z: {low('z')}))))),
join1 AS (
  SELECT doc_id, p, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos FROM n1
  UNION ALL
  SELECT doc_id, CASE WHEN nxt IS NULL THEN p ELSE list_transform(p, lambda e, i: CASE
      WHEN i = lost THEN struct_pack(k := e.k, v := e.v, a := e.a, n := e.n, gone := true)
      WHEN i = main THEN struct_pack(k := e.k, v := e.v, a := {once(f"list_concat(e.a, list_filter(list_concat([p[lost].v], p[lost].a), lambda z: length(z) > 1 AND NOT {listed('z')} AND lower(z) <> lower(e.v)))", 'lower({})')}, n := greatest(e.n, p[lost].n), gone := e.gone) ELSE e END) END,
    CASE WHEN nxt IS NULL THEN k + 1 ELSE k END, coalesce(nxt, 0)
  FROM (SELECT *, CASE WHEN length(p[k].v) >= length(p[nxt].v) THEN k ELSE nxt END AS main, CASE WHEN length(p[k].v) >= length(p[nxt].v) THEN nxt ELSE k END AS lost
    FROM (SELECT *, CASE WHEN p[k].gone AND pos = 0 THEN NULL ELSE list_min(list_filter(list_transform(p[k].a, lambda z: CAST(list_position(list_transform(p, lambda e: e.k), {low('z')}) AS BIGINT)), lambda j: j > pos AND j <> k AND NOT p[j].gone)) END AS nxt FROM join1 WHERE k <= len(p)))
),
n2 AS (SELECT doc_id, unnest(p) AS e FROM join1 WHERE k > len(p)),
g3 AS MATERIALIZED (
  SELECT g2.doc_id, type, key, o, value, label, coalesce(e.n, occ) AS occ, shut, prenom, variants, coalesce(e.a, aliases) AS aliases FROM g2 LEFT JOIN n2 ON n2.doc_id = g2.doc_id AND e.k = g2.key AND type = 'NOM' WHERE NOT coalesce(e.gone, false)
),
-- Near spellings: the less frequent joins the first more frequent one that it is alike to.
m0 AS MATERIALIZED (SELECT *, {words(low('value'))} AS ws, row_number() OVER (PARTITION BY doc_id ORDER BY occ DESC, o) AS k FROM g3 WHERE type = 'NOM'),
mf AS (SELECT DISTINCT doc_id, k, unnest(flatten(list_transform(ws, lambda w: CASE WHEN length(w) < 5 THEN [w] ELSE list_append(list_transform(range(1, length(w) + 1), lambda i: w[:i - 1] || w[i + 1:]), w) END))) AS form FROM m0),
mp AS (SELECT DISTINCT a.doc_id, a.k AS c, b.k AS j FROM mf a JOIN mf b ON a.doc_id = b.doc_id AND a.form = b.form AND a.k <> b.k),
ml AS (SELECT mp.doc_id, c, j, len(a.ws) = 1 AND len(b.ws) = 1 AS single FROM mp JOIN m0 a ON a.doc_id = mp.doc_id AND a.k = c JOIN m0 b ON b.doc_id = mp.doc_id AND b.k = j
  WHERE length(a.value) >= 5 AND CASE WHEN len(a.ws) = 1 THEN len(list_filter(b.ws, lambda w: {near('w', 'a.ws[1]')})) > 0
    WHEN len(a.ws) <> len(b.ws) THEN false
    ELSE list_reduce(list_prepend(b.ws, list_transform(a.ws, lambda w: [w])), lambda free, w: CASE WHEN free IS NULL THEN NULL ELSE
      (CASE WHEN len(list_filter(free, lambda y: y = w[1] OR {near('y', 'w[1]')})) = 0 THEN NULL ELSE
        list_concat(free[:list_position(free, list_filter(free, lambda y: y = w[1] OR {near('y', 'w[1]')})[1]) - 1], free[list_position(free, list_filter(free, lambda y: y = w[1] OR {near('y', 'w[1]')})[1]) + 1:]) END) END) IS NOT NULL END),
mt AS MATERIALIZED (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY c) AS step, list(struct_pack(j := j, single := single) ORDER BY j) AS js FROM ml GROUP BY doc_id, c),
ms AS (SELECT m0.doc_id, list(struct_pack(v := value, a := aliases, n := CAST(occ AS BIGINT), gone := false) ORDER BY k) AS p FROM m0 WHERE doc_id IN (SELECT doc_id FROM mt) GROUP BY m0.doc_id),
join2 AS (
  SELECT doc_id, p, CAST(0 AS BIGINT) AS step FROM ms
  UNION ALL
  SELECT doc_id, CASE WHEN j IS NULL THEN p ELSE list_transform(p, lambda e, i: CASE
      WHEN i = c THEN struct_pack(v := e.v, a := e.a, n := e.n, gone := true)
      WHEN i = j THEN struct_pack(v := e.v, a := {once(f"list_concat(e.a, list_filter(list_concat([p[c].v], p[c].a), lambda z: length(z) > 1 AND NOT {listed('z')} AND lower(z) <> lower(e.v)))", 'lower({})')}, n := e.n + p[c].n, gone := e.gone) ELSE e END) END, step
  FROM (SELECT join2.doc_id, p, mt.step, c, list_filter(js, lambda x: NOT p[c].gone AND NOT p[x.j].gone AND p[x.j].n > p[c].n AND (NOT x.single OR p[x.j].n >= 3 * p[c].n))[1].j AS j FROM join2 JOIN mt ON mt.doc_id = join2.doc_id AND mt.step = join2.step + 1)
),
m1 AS (SELECT doc_id, unnest(p) AS e, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, arg_max(p, step) AS p FROM join2 GROUP BY doc_id)),
g4 AS MATERIALIZED (
  SELECT m0.doc_id, type, key, o, value, label, coalesce(e.n, occ) AS occ, shut, prenom, variants, coalesce(e.a, aliases) AS aliases FROM m0 LEFT JOIN m1 ON m1.doc_id = m0.doc_id AND m1.k = m0.k WHERE NOT coalesce(e.gone, false)
  UNION ALL SELECT doc_id, type, key, o, value, label, occ, shut, prenom, variants, aliases FROM g3 WHERE type <> 'NOM'
),
d0 AS (SELECT doc_id, list(key) FILTER (occ >= 3) AS often, list_transform(flatten(list(aliases)), lambda z: {low('z')}) AS covered,
  list_filter(list_transform(flatten(list(list_concat({words('prenom')}, variants))), lambda z: {low('z')}), lambda z: length(z) >= 2) AS firsts FROM g4 WHERE type = 'NOM' GROUP BY doc_id),
g5 AS (SELECT g4.* FROM g4 LEFT JOIN d0 ON d0.doc_id = g4.doc_id
  WHERE NOT shut AND (type <> 'NOM' OR len({words('value')}) > 1 OR (NOT list_contains(covered, key) AND NOT (list_contains(firsts, key) AND NOT list_contains(coalesce(often, []), key))))),
found AS MATERIALIZED (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY type <> 'NOM', o) - 1 AS INTEGER) AS ord, sha256(doc_id || '|' || type || '|' || {low(Q.squeeze('value'))}) AS id, value, type, CASE WHEN label = '' THEN type ELSE label END AS label,
    CAST(occ AS INTEGER) AS occurrences, aliases, nullif(prenom, '') AS prenom, variants FROM g5
)"""


SHOWN = (
    "SELECT doc_id, ord, id, value, type, label, occurrences, array_to_string(aliases, '|') AS aliases, true AS active, false AS blocked, prenom, array_to_string(variants, '|') AS \"prenomVariants\", '' AS members, false AS \"isInitiale\", CAST(NULL AS VARCHAR) AS \"initialeValue\" FROM found"
)


def detected(source: str, block_list: frozenset[str]) -> str:
    """Detection on a source of (doc_id, text): a whole query."""
    return f"WITH RECURSIVE src AS ({source}), {detection(block_list)} {SHOWN}"


# ── Resolution ───────────────────────────────────────────────────────────────


def resolution(titles_rx: str, prefix: str = "COUPLE") -> str:
    """CTEs from src and found to resolved."""
    fold, title = Q.fold, Q.title
    bare_key = lambda x: f"trim(regexp_replace({fold(x)} || ' ', {Q.quote(titles_rx)}, ''))"
    key_words = lambda x: f"list_filter(string_split({bare_key(x)}, ' '), lambda w: w <> '')"
    particles, odd, titles = strings(E.PARTICLES), strings(E.TITLES | E.COUPLE_WORDS), strings(E.TITLES)
    surname = lambda x: f"coalesce(list_filter({key_words(x)}, lambda w: NOT list_contains({particles}, w))[-1], '')"
    bare_parts = lambda x: f"(CASE WHEN len({key_words(x)}) = 0 THEN [] ELSE string_split({Q.squeeze(x)}, ' ')[-len({key_words(x)}):] END)"
    token = Q.quote(f"^(?:{T.render(E.NAME_TOKEN, 're2')})$")
    filled = lambda forms, name: "[" + ", ".join(f"replace('{f}', '{{}}', {name})" for f in forms) + "]"
    (p0, i0), (p1, i1), (p2, i2) = E.RESOLVED_COUPLES
    return f"""
r0 AS (SELECT doc_id, ord, {title('value')} AS value, type, label, occurrences AS occ, list_filter(list_transform(aliases, lambda z: {title('z')}), lambda z: z <> '') AS aliases FROM found),
r1 AS (SELECT doc_id, type, {fold('value')} AS key, min(ord) AS o, arg_min(value, ord) AS value, arg_min(label, ord) AS label, max(occ) AS occ, list(aliases ORDER BY ord) AS lists FROM r0 WHERE value <> '' GROUP BY doc_id, type, {fold('value')}),
r2 AS (SELECT *, {bare_parts('value')} AS parts, {bare_key('value')} AS bare, {surname('value')} AS surname, len({key_words('value')}) AS n FROM r1),
r3 AS MATERIALIZED (SELECT *, type = 'NOM' AND len(parts) BETWEEN 1 AND 4 AND len(list_filter(parts, lambda w: list_contains({odd}, {fold('w')}) OR NOT regexp_matches(w, {token}))) = 0 AS person FROM r2),
own AS (SELECT doc_id, surname, count(DISTINCT bare) AS owners, min(string_split(bare, ' ')[1]) AS first, min(o) AS lead FROM r3 WHERE person AND n >= 2 AND surname <> '' GROUP BY doc_id, surname),
r4 AS (
  SELECT r3.*, CASE WHEN NOT person THEN 'other ' || type || ' ' || key WHEN n >= 2 THEN 'full ' || string_split(bare, ' ')[1] || ' ' || r3.surname WHEN owners = 1 THEN 'full ' || own.first || ' ' || own.surname ELSE 'single ' || bare END AS g,
    CASE WHEN person AND n = 1 AND owners = 1 THEN own.lead WHEN person AND n >= 2 THEN min(o) OVER (PARTITION BY r3.doc_id, person AND n >= 2, bare) END AS lead0
  FROM r3 LEFT JOIN own ON own.doc_id = r3.doc_id AND own.surname = bare AND person AND n = 1
),
r5 AS (SELECT *, coalesce(lead0, min(o) OVER (PARTITION BY doc_id, g)) AS lead FROM r4),
r6 AS MATERIALIZED (SELECT *, min(lead) OVER (PARTITION BY doc_id, g) AS lead1, CASE WHEN o = lead THEN struct_pack(n := CASE WHEN person THEN n ELSE 0 END, pos := -lead, v := value) END AS cand FROM r5),
r7 AS (SELECT *, max(cand) OVER (PARTITION BY doc_id, g ORDER BY lead RANGE UNBOUNDED PRECEDING) AS thus, max(cand) OVER (PARTITION BY doc_id, g) AS now, o = lead AND lead = lead1 AS lead_row FROM r6),
who AS MATERIALIZED (SELECT doc_id, g, any_value(now).v AS value, arg_min(type, (lead, o)) AS type, arg_min(label, (lead, o)) AS label, bool_or(person) AS person, max(occ) AS occ, min(lead) AS pos, g LIKE 'single %' AS single FROM r7 GROUP BY doc_id, g),
who1 AS (SELECT *, {bare_parts('value')} AS parts, {surname('value')} AS surname FROM who),
who2 AS (SELECT *, array_to_string(parts, ' ') AS clean, parts[1] AS first, list_filter(parts, lambda w: NOT list_contains({particles}, {fold('w')}))[-1] AS last FROM who1),
ev AS (
  SELECT doc_id, g, (0, lead, n = 1, o, 0, 0) AS seq, value AS a, thus.v AS v, false AS keep FROM r7
  UNION ALL SELECT doc_id, g, (0, lead, n = 1, o, 1, i), a, thus.v, lead_row FROM (SELECT *, unnest(lists[1]) AS a, unnest(range(len(lists[1]))) AS i FROM r7)
  UNION ALL SELECT doc_id, g, (0, lead, n = 1, o, 2, i), a, thus.v, false FROM (SELECT *, unnest(flatten(lists[2:])) AS a, unnest(range(len(flatten(lists[2:])))) AS i FROM r7)
  UNION ALL SELECT doc_id, g, (1, 0, false, 0, 0, i), {title('a')}, value, false FROM (
    SELECT *, unnest(f) AS a, unnest(range(len(f))) AS i FROM (SELECT *, list_concat([first, last], {filled(E.SURNAME_ALIASES, 'last')}, CASE WHEN len(parts) >= 2 THEN list_concat([clean, last || ' ' || first], {filled(E.FULL_NAME_ALIASES, 'clean')}) ELSE [] END) AS f FROM who2 WHERE person)) WHERE a IS NOT NULL
),
ev1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g, {fold('a')} ORDER BY NOT keep, seq) AS k FROM ev WHERE keep OR {fold('a')} <> {fold('v')}),
al AS (SELECT doc_id, g, list(a ORDER BY NOT keep, seq) AS aliases FROM ev1 WHERE (k = 1 OR keep) AND a <> '' GROUP BY doc_id, g),
res AS MATERIALIZED (SELECT who2.*, coalesce(aliases, []) AS aliases, sha256(who2.doc_id || '|' || type || '|' || {fold('value')}) AS id, count(*) OVER (PARTITION BY who2.doc_id, person, surname) AS sharing FROM who2 LEFT JOIN al ON al.doc_id = who2.doc_id AND al.g = who2.g),
c0 AS (
  SELECT doc_id, 0 AS rule, unnest(range(len(a))) AS i, unnest(a) AS a, unnest(b) AS b, unnest(c) AS c FROM (SELECT doc_id, {found_all('text', p0, 1, i0)} AS a, {found_all('text', p0, 2, i0)} AS b, {found_all('text', p0, 3, i0)} AS c FROM src)
  UNION ALL SELECT doc_id, 1, unnest(range(len(c))), '', '', unnest(c) FROM (SELECT doc_id, {found_all('text', p1, 1, i1)} AS c FROM src)
  UNION ALL SELECT doc_id, 2, unnest(range(len(c))), '', '', unnest(c) FROM (SELECT doc_id, {found_all('text', p2, 1, i2)} AS c FROM src)
),
c1 AS (SELECT doc_id, rule, i, {title('a')} AS a, {title('b')} AS b, {title('c')} AS name FROM c0 WHERE rule > 0 OR NOT list_has_any([{fold('a')}, {fold('b')}], {titles})),
c2 AS (SELECT *, CASE rule WHEN 0 THEN a || ' et ' || b || ' ' || name WHEN 1 THEN 'Monsieur et Madame ' || name ELSE 'Les époux ' || name END AS value FROM c1),
c3 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {fold('value')} ORDER BY rule, i) AS k FROM c2) x WHERE k = 1
  AND EXISTS (SELECT 1 FROM res WHERE res.doc_id = x.doc_id) AND NOT EXISTS (SELECT 1 FROM res WHERE res.doc_id = x.doc_id AND res.type = 'COUPLE' AND NOT person AND {bare_key('res.value')} = {fold('x.value')})),
form AS (SELECT doc_id, single, pos, id, value, surname, unnest(list_distinct(list_transform(list_prepend(value, aliases), lambda z: {bare_key('z')}))) AS f FROM res WHERE person),
mem AS (
  SELECT c3.doc_id, c3.value AS couple, side, arg_min(struct_pack(single := single, pos := pos, id := form.id, v := form.value), (single, pos)) AS m
  FROM (SELECT *, unnest([0, 1]) AS side, unnest([a, b]) AS given FROM c3 WHERE rule = 0) c3 JOIN form ON form.doc_id = c3.doc_id AND f = {bare_key("given || ' ' || name")} AND f <> '' GROUP BY c3.doc_id, c3.value, side
  UNION ALL SELECT c3.doc_id, c3.value, 0, struct_pack(single := single, pos := pos, id := id, v := res.value) FROM c3 JOIN res ON rule > 0 AND res.doc_id = c3.doc_id AND person AND res.surname = {fold('name')} AND res.surname <> ''
),
mem1 AS (SELECT doc_id, couple, list(m ORDER BY side, m.single, m.pos) AS ms FROM mem GROUP BY doc_id, couple),
new AS (
  SELECT c3.doc_id, rule, i, {title('c3.value')} AS value, coalesce(ms, []) AS ms,
    list_concat(CASE rule WHEN 0 THEN {filled(E.RESOLVED_COUPLE_ALIASES[0], 'name')} WHEN 1 THEN {filled(E.RESOLVED_COUPLE_ALIASES[1], 'name')} ELSE {filled(E.RESOLVED_COUPLE_ALIASES[2], 'name')} END, list_transform(coalesce(ms, []), lambda x: x.v)) AS said
  FROM c3 LEFT JOIN mem1 ON mem1.doc_id = c3.doc_id AND couple = c3.value
),
allr AS (
  SELECT doc_id, CASE WHEN person THEN 1 WHEN type = 'COUPLE' THEN 2 ELSE 0 END AS section, CAST(single AS INTEGER) AS p, CAST(pos AS BIGINT) AS q, value, type, label, occ,
    CASE WHEN person AND sharing > 1 AND surname <> '' THEN list_filter(aliases, lambda z: {bare_key('z')} <> surname) ELSE aliases END AS aliases, CAST([] AS VARCHAR[]) AS members FROM res
  UNION ALL SELECT doc_id, 3, rule, i, value, '{prefix}', '{prefix}', 1, {once(f"list_filter(list_transform(said, lambda z: {title('z')}), lambda z: z <> '' AND {fold('z')} <> {fold('value')})", fold('{}'))}, list_transform(ms[:2], lambda x: x.id) FROM new
),
resolved AS MATERIALIZED (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, p, q) - 1 AS INTEGER) AS ord, sha256(doc_id || '|' || type || '|' || {fold('value')}) AS id, value, type, label, CAST(occ AS INTEGER) AS occurrences, aliases, members FROM allr)"""


def resolved(source: str, block_list: frozenset[str], titles_rx: str) -> str:
    return (
        f"WITH RECURSIVE src AS ({source}), {detection(block_list)}, {resolution(titles_rx)} SELECT doc_id, ord, id, value, type, label, occurrences, array_to_string(aliases, '|') AS aliases, true AS active, false AS blocked,"
        " CAST(NULL AS VARCHAR) AS prenom, '' AS \"prenomVariants\", array_to_string(members, '|') AS members, false AS \"isInitiale\", CAST(NULL AS VARCHAR) AS \"initialeValue\" FROM resolved"
    )


# ── Substitution ─────────────────────────────────────────────────────────────

#: RE2 has no look-around, so that boundaries are put into the text: NOT after what is no
#: letter, where a name may begin, and END before it, where one may end. A placeholder's "_n]" has no END.
BEGIN, END, SIGN, COMMA, ANY = "\x02", "\x03", "\x04", "\x06", "\x07"


def marked(text: str) -> str:
    other = Q.quote(f"([^{E.L}{SIGN}])")
    signed = f"regexp_replace({text}, '_([0-9]+\\])', {Q.quote(SIGN)} || '\\1', 'g')"
    return f"({Q.quote(BEGIN)} || replace(regexp_replace({signed}, {other}, {Q.quote(END)} || '\\1' || {Q.quote(BEGIN)}, 'g'), {Q.quote(SIGN)}, '_' || {Q.quote(BEGIN)}) || {Q.quote(END)})"


def unmarked(text: str) -> str:
    return f"replace(replace({text}, {Q.quote(BEGIN)}, ''), {Q.quote(END)}, '')"


def _literal(x: str) -> str:
    """A text as a pattern over marked text."""
    other = Q.quote(f"([^{E.L}{COMMA}{ANY}])")
    return f"regexp_replace({x}, {other}, {Q.quote(END)} || '\\\\Q\\1\\\\E' || {Q.quote(BEGIN)}, 'g')"


def _gap(chars: str) -> str:
    return f"(?:{END}[{T.render('{ws}', 're2')}{chars}]{BEGIN})+"


def substitution() -> str:
    """CTEs from src (text) and found to done: doc_id, anonymized, initiales, n_rows."""
    head = Q.quote("(?i)" + T.render(E.TITLE_HEAD, "re2"))
    title = E.TITLE_BEFORE.replace("\\.", f"(?:{END}\\.{BEGIN})").replace("(?:(?:", "(?:(?:")
    title = f"{title}{_gap('')}"
    any_letter = "[A-Za-zÀ-ÿ]"
    flex = f"replace(array_to_string(list_transform(string_split(regexp_replace({Q.squeeze('val')}, '([0-9]),', '\\1' || {Q.quote(COMMA)}, 'g'), ' '), lambda w: {_literal('w')}), {Q.quote(_gap(',\\-'))}), {Q.quote(COMMA)}, {Q.quote(f'(?:{END},{BEGIN})?')})"

    def lev1(a: str, b: str) -> str:
        return (
            f"({a} = {b} OR (length({a}) = length({b}) AND len(list_filter(range(1, length({a}) + 1), lambda i: {a}[:i - 1] = {b}[:i - 1] AND {a}[i + 1:] = {b}[i + 1:])) > 0)"
            f" OR (length({a}) = length({b}) + 1 AND len(list_filter(range(1, length({a}) + 1), lambda i: {a}[:i - 1] || {a}[i + 1:] = {b})) > 0) OR (length({b}) = length({a}) + 1 AND len(list_filter(range(1, length({b}) + 1), lambda i: {b}[:i - 1] || {b}[i + 1:] = {a})) > 0))"
        )

    def near(w: str) -> str:
        """A word of six characters and more within one edit, a shorter one as it is."""
        runs = f"list_filter(runs, lambda r: abs(length(r) - length({w})) <= 1 AND {lev1('r', w)})"
        kinds = [f"list_transform(range(1, length({w}) + 1), lambda i: {w}[:i - 1] || {w}[i + 1:])", f"list_transform(range(0, length({w}) + 1), lambda i: {w}[:i] || {Q.quote(ANY)} || {w}[i + 1:])", f"list_transform(range(1, length({w}) + 1), lambda i: {w}[:i - 1] || {Q.quote(ANY)} || {w}[i + 1:])"]
        forms = f"list_concat([{w}], {', '.join(kinds)})"
        return (
            f"(CASE WHEN length({w}) < 6 THEN {_literal(w)} WHEN regexp_full_match({w}, '[{E.L}]+') THEN '(?:' || array_to_string(list_prepend({w}, {runs}), '|') || ')'"
            f" ELSE '(?:' || array_to_string(list_transform({forms}, lambda f: replace({_literal('f')}, {Q.quote(ANY)}, '{any_letter}')), '|') || ')' END)"
        )

    known = " ".join(f"WHEN type = '{k}' THEN '{v}'" for k, v in E.PREFIXES.items())
    person = "(upper(type) = 'NOM' OR upper(type) LIKE 'DEMANDEUR%' OR upper(type) LIKE 'DEFENDEUR%' OR upper(type) LIKE 'DÉFENDEUR%')"
    own = "regexp_replace(regexp_replace(regexp_replace(upper(trim(type)), '[^A-Z0-9]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
    clean = f"list_filter(list_distinct_ordered, lambda z: length(z) >= 2 AND NOT list_contains({strings(E.TITLE_WORDS)}, lower(z)))"
    return f"""
u0 AS (SELECT *, CASE {known} ELSE coalesce(nullif({own}, ''), 'VAL') END AS prefix FROM found WHERE upper(type) <> 'PRENOM'),
u1 AS (SELECT *, '[' || prefix || '_' || row_number() OVER (PARTITION BY doc_id, prefix ORDER BY ord) || ']' AS ph, {person} AS person FROM u0),
u2 AS (SELECT *, {clean} AS vals FROM (SELECT *, {once(f"list_transform(list_prepend(value, aliases), lambda z: {Q.squeeze(f'regexp_replace({Q.squeeze(chr(122))}, {head}, {chr(39) * 2})')})", '{}')} AS list_distinct_ordered FROM u1)),
u3 AS MATERIALIZED (SELECT *, CASE WHEN person THEN list_filter({once('list_concat([prenom], variants)', '{}')}, lambda z: z IS NOT NULL AND length(z) >= 2) ELSE [] END AS firsts FROM u2),
lets AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[{E.L}]+'), lambda z: lower(z))) AS runs FROM src),
k0 AS (
  SELECT doc_id, ord, i, 0 AS kind, titled, val, ph, NULL AS sign, value, 'p' || ph || titled || lower(val) AS once FROM (SELECT *, unnest(vals) AS val, unnest(range(len(vals))) AS i FROM u3), (SELECT unnest([true, false]) AS titled)
  UNION ALL SELECT doc_id, ord, i, 1, false, val, ph, NULL, value, 'f' || ph || lower(val) FROM (SELECT *, unnest(vals) AS val, unnest(range(len(vals))) AS i FROM u3 WHERE person) WHERE NOT contains(val, ' ') AND length(val) >= 6
  UNION ALL SELECT doc_id, ord, 1000 + i, 2, titled, val, NULL, upper(val[1]) || '.', value, 'i' || titled || lower(val) FROM (SELECT *, unnest(firsts) AS val, unnest(range(len(firsts))) AS i FROM u3), (SELECT unnest([true, false]) AS titled)
  UNION ALL SELECT doc_id, ord, 1000 + i, 3, titled, val, ph, upper(val[1]) || '.', value, 'b' || titled || lower(val) || chr(1) || lower(value) FROM (SELECT *, unnest(firsts) AS val, unnest(range(len(firsts))) AS i FROM u3 WHERE length(value) >= 3), (SELECT unnest([true, false]) AS titled)
),
k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, once ORDER BY ord, i) AS n FROM k0) WHERE n = 1),
k2 AS (
  SELECT k1.doc_id, kind, titled, val, ph, sign, value, row_number() OVER (PARTITION BY k1.doc_id ORDER BY CASE kind WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END DESC, length(val) DESC, titled DESC, ord, i, kind) AS rank,
    CASE WHEN titled THEN {Q.quote(title)} ELSE '' END || CASE kind WHEN 0 THEN {flex} WHEN 1 THEN {near('lower(val)')} WHEN 2 THEN {_literal('val')} ELSE {_literal('val')} || {Q.quote(_gap(',\\-'))} || {near('lower(trim(value))')} END AS rx
  FROM k1 JOIN lets ON lets.doc_id = k1.doc_id
),
k3 AS MATERIALIZED (SELECT *, '(?i)' || {Q.quote(BEGIN)} || '(?:' || rx || ')' || {Q.quote(END)} AS whole FROM k2),
big AS (SELECT doc_id, '(?i)' || {Q.quote(BEGIN)} || '(?:' || string_agg('(?:' || rx || ')', '|' ORDER BY rank) || ')' || {Q.quote(END)} AS rx FROM k3 GROUP BY doc_id),
z0 AS MATERIALIZED (SELECT src.doc_id, regexp_extract_all(m, rx) AS hits, string_split_regex(m, rx) AS rest FROM (SELECT doc_id, {marked("coalesce(text, '')")} AS m FROM src) src JOIN big ON big.doc_id = src.doc_id),
z1 AS (SELECT DISTINCT doc_id, unnest(hits) AS s FROM z0),
z2 AS (SELECT z1.doc_id, s, lower({unmarked('s')}) AS flat FROM z1),
z3 AS (SELECT z2.doc_id, s, arg_min(struct_pack(titled := titled, ph := ph, sign := sign, kind := kind), rank) AS r FROM z2 JOIN k3 ON k3.doc_id = z2.doc_id
  WHERE CASE kind WHEN 1 THEN abs(length(flat) - length(val)) <= 1 WHEN 3 THEN length(flat) >= length(val) + length(value) AND contains(flat, lower(val)) ELSE ends_with(flat, lower(val[-1:])) AND length(flat) >= length(val) - 2 END AND regexp_full_match(s, whole) GROUP BY z2.doc_id, s),
z4 AS (SELECT *, CASE WHEN r.titled THEN {unmarked(f"regexp_extract(s, {Q.quote('(?i)^' + BEGIN + '(' + title + ')')}, 1)")} ELSE '' END || CASE r.kind WHEN 3 THEN r.sign || ' ' || r.ph WHEN 2 THEN r.sign ELSE r.ph END AS new FROM z3),
z5 AS (SELECT doc_id, unnest(hits) AS s, unnest(range(len(hits))) AS i FROM z0),
z6 AS (SELECT z5.doc_id, list(new ORDER BY i) AS news, list(r.sign ORDER BY i) FILTER (r.sign IS NOT NULL) AS signs, count(DISTINCT r.ph) AS n FROM z5 JOIN z4 ON z4.doc_id = z5.doc_id AND z4.s = z5.s GROUP BY z5.doc_id),
done AS MATERIALIZED (
  SELECT src.doc_id, CASE WHEN news IS NULL THEN coalesce(src.text, '') ELSE {unmarked("array_to_string(list_transform(rest, lambda x, i: x || coalesce(news[i], '')), '')")} END AS anonymized,
    {once("coalesce(signs, [])", '{}')} AS initiales, CAST(coalesce(n, 0) AS INTEGER) AS n_rows
  FROM src LEFT JOIN z0 ON z0.doc_id = src.doc_id LEFT JOIN z6 ON z6.doc_id = src.doc_id
)"""


def anonymised(source: str, block_list: frozenset[str], shown: str = "doc_id, anonymized, array_to_string(initiales, '|') AS initiales, n_rows") -> str:
    return f"WITH RECURSIVE src AS ({source}), {detection(block_list)}, {substitution()} SELECT {shown} FROM done"


# ── Omissions and parties ────────────────────────────────────────────────────


def places(text: str, pattern: str, group: int = 0, ignore: bool = False) -> str:
    """Columns hits (the group), wholes and rest (the text between) of all matches."""
    rx = Q.quote(("(?i)" if ignore else "") + T.render(pattern, "re2"))
    return f"regexp_extract_all({text}, {rx}, {group}) AS hits, regexp_extract_all({text}, {rx}) AS wholes, string_split_regex({text}, {rx}) AS rest"


#: Where the k-th match (from 0) begins, in code points.
START = "(length(array_to_string(rest[:k + 1], '')) + length(array_to_string(wholes[:k], '')))"


def omissions(redacted: tuple[str, ...] = (), panel: bool = False) -> str:
    """CTEs from src and found to suspects."""
    parts = []
    for n, (cat, kind, pattern, ignore, group) in enumerate(E.OMISSIONS):
        if "(?=" in pattern:  # what follows is consumed in place of looked at
            head, tail = pattern.split("(?=")
            pattern, group = f"({head})(?:{tail}", 1
        parts.append(f"SELECT doc_id, text, {n} AS p, k, '{cat}' AS cat, '{kind}' AS type, hits[k + 1] AS raw, {START} AS start FROM (SELECT *, unnest(range(len(hits))) AS k FROM (SELECT doc_id, text, {places('text', pattern.replace(chr(92) + 'Z', chr(92) + 'z'), group, ignore)} FROM src))")
    cut = sorted({w for word in redacted for w in (word.lower(), *(t for t in word.lower().split(" ") if len(t) >= 4))})
    low = "lower(value)"
    key = Q.squeeze(low) if panel else low
    split = f"list_filter(regexp_split_to_array(key, {Q.quote(T.render('{s}+', 're2'))}), lambda w: length(w) >= 3)"
    return f"""
h0 AS ({" UNION ALL ".join(parts)}),
h1 AS (SELECT doc_id, text, p, k, cat, type, start, {Q.trim('raw')} AS value FROM h0),
h2 AS (SELECT *, {key} AS key FROM h1 WHERE length(value) >= 3),
cap AS (SELECT doc_id, list_concat(list_distinct(flatten(list(list_transform(list_prepend(value, aliases), lambda z: {Q.trim('lower(z)')})))), {strings(w.lower() for w in redacted)}) AS known FROM found GROUP BY doc_id),
h3 AS (SELECT h2.*, coalesce(known, {strings(w.lower() for w in redacted)}) AS known FROM h2 LEFT JOIN cap ON cap.doc_id = h2.doc_id),
h4 AS (SELECT *, {split} AS ws FROM h3 WHERE NOT list_contains(known, key) AND len(list_filter({strings(cut)}, lambda w: contains(key, w))) = 0),
h5 AS (SELECT * FROM h4 WHERE cat IN ('adresse', 'codepostal') OR NOT (list_has_any(ws, known) OR len(list_filter(known, lambda v: length(v) >= 8 AND (contains(v, key) OR contains(key, v)))) > 0)),
h6 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY p, k) AS n FROM h5),
suspects AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1 AS INTEGER) AS ord FROM h6 WHERE n = 1)"""


CONTEXT = f"regexp_replace({Q.squeeze('text[greatest(start - 65, 0) + 1 : start + length(value) + 65]')}, '(?i)\\Q' || value || '\\E', '<mark>' || value || '</mark>')"


def omitted(source: str, block_list: frozenset[str], shown: str, panel: bool = False) -> str:
    return f"WITH RECURSIVE src AS ({source}), {detection(block_list)}, {omissions((), panel)} {shown}"


def parties(source: str, block_list: frozenset[str]) -> str:
    parts = []
    for s, (side, words_) in enumerate(E.SIDE_KEYWORDS.items()):
        either = "|".join(sorted(words_, key=len, reverse=True))
        before = f"{E.PARTY_TITLE}({E.PARTY_NAME}){{s}}*[,\\(]{{s}}*(?:{either})"
        after = f"(?:{either}){{s}}*[:\\-,]?{{s}}+{E.PARTY_TITLE}({E.PARTY_NAME})"
        for r, pattern in enumerate((before, after)):
            parts.append(f"SELECT doc_id, text, {2 * s + r} AS p, k, '{side}' AS side, hits[k + 1] AS raw, wholes[k + 1] AS whole, {START} AS start FROM (SELECT *, unnest(range(len(hits))) AS k FROM (SELECT doc_id, text, {places('text', pattern, 1, True)} FROM src))")
    fold = lambda x: f"lower(strip_accents({x}))"
    return f"""WITH RECURSIVE src AS ({source}), {detection(block_list)},
h0 AS ({" UNION ALL ".join(parts)}),
h1 AS (SELECT *, trim(raw) AS name, {fold('trim(raw)')} AS key, start + length(whole) AS stop FROM h0),
h2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, side, key ORDER BY p, k) AS n FROM h1 WHERE length(key) >= 3),
f0 AS (SELECT doc_id, id, ord * 1000 + unnest(range(len(aliases) + 1)) AS seq, {fold('unnest(list_prepend(value, aliases))')} AS key FROM found),
f1 AS (SELECT doc_id, key, min(seq) AS pos, arg_max(id, seq) AS id FROM f0 GROUP BY doc_id, key),
h3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1 AS ord FROM h2 WHERE n = 1),
h4 AS (SELECT h3.doc_id, h3.ord, arg_min(f1.id, (f1.key <> h3.key, pos)) AS id FROM h3 JOIN f1 ON f1.doc_id = h3.doc_id AND (contains(f1.key, h3.key) OR contains(h3.key, f1.key)) GROUP BY h3.doc_id, h3.ord)
SELECT h3.doc_id, CAST(h3.ord AS INTEGER) AS ord, name, side, h4.id AS entity_id, CASE WHEN start > 30 THEN '…' ELSE '' END || replace(text[greatest(start - 30, 0) + 1 : stop + 30], chr(10), ' ') || CASE WHEN stop + 30 < length(text) THEN '…' ELSE '' END AS context
FROM h3 LEFT JOIN h4 ON h4.doc_id = h3.doc_id AND h4.ord = h3.ord"""


def highlighted(source: str, block_list: frozenset[str]) -> str:
    """The result with initials and placeholders marked."""
    safe = "replace(replace(replace(anonymized, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    one = "regexp_replace({}, '(^|[\\s>' || chr(2) || '])(' || replace(i, '.', '\\.') || ')($|[\\s<' || chr(1) || '])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')".format
    out = f"list_reduce(list_prepend({safe}, list_sort(initiales)), lambda acc, i: {one(one('acc'))})"
    out = f"replace(replace({out}, chr(1), '<mark class=\"ph ph-initiale\">'), chr(2), '</mark>')"
    for name in ("NOM", "ADRESSE", "ENTITE", "REF", "AUTRE", "COUPLE", "SIREN", "IBAN", "EMAIL", "PHONE"):
        out = f"regexp_replace({out}, '\\[({name}_[0-9]+)\\]', '<mark class=\"ph ph-{name.lower()}\">[\\1]</mark>', 'g')"
    return anonymised(source, block_list, f"doc_id, {out} AS html")


def redacted_then_anonymised(source: str, block_list: frozenset[str], word: str, new: str, position: int) -> str:
    """The first of a word at or after a position, else the first, replaced; then the
    substitution, with the entities of the whole text, and how many omissions that has."""
    low = word.lower()
    at = f"CASE WHEN strpos(lower(text[{position + 1}:]), '{low}') > 0 THEN {position} + strpos(lower(text[{position + 1}:]), '{low}') ELSE strpos(lower(text), '{low}') END"
    cut = f"cut AS MATERIALIZED (SELECT doc_id, CASE WHEN p > 0 THEN text[:p - 1] || '{new}' || text[p + {len(word)}:] ELSE text END AS text FROM (SELECT *, {at} AS p FROM src))"
    put = substitution().replace("FROM src)", "FROM cut)").replace("FROM src LEFT", "FROM cut src LEFT")
    return f"WITH RECURSIVE src AS ({source}), {detection(block_list)}, {omissions((word,))}, {cut}, {put} SELECT done.doc_id, anonymized, coalesce(n_left, 0) AS omissions FROM done LEFT JOIN (SELECT doc_id, count(*) AS n_left FROM suspects GROUP BY doc_id) s ON s.doc_id = done.doc_id"


_ROW = "doc_id, ord, id, value, type, label, occurrences, array_to_string(aliases, '|') AS aliases, active, blocked, prenom, array_to_string(variants, '|') AS \"prenomVariants\", array_to_string(members, '|') AS members, CASE WHEN variants IS NOT NULL THEN false END AS \"isInitiale\", CAST(NULL AS VARCHAR) AS \"initialeValue\""
_OWN = "SELECT doc_id, ord, id, value, type, label, occurrences, aliases, true AS active, false AS blocked, prenom, variants, CAST([] AS VARCHAR[]) AS members FROM found"


def analysed(source: str, block_list: frozenset[str], titles_rx: str) -> str:
    """What detection finds, and after it what resolution has of new values."""
    return f"""WITH RECURSIVE src AS ({source}), {detection(block_list)}, {resolution(titles_rx)},
fresh AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(value) ORDER BY ord) AS k FROM resolved r WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = r.doc_id AND lower(f.value) = lower(r.value))),
total AS (SELECT doc_id, max(ord) AS top FROM found GROUP BY doc_id),
rows_ AS ({_OWN} UNION ALL SELECT fresh.doc_id, CAST(coalesce(top, -1) + row_number() OVER (PARTITION BY fresh.doc_id ORDER BY ord) AS INTEGER), id, value, type, label, occurrences, aliases, true, false, NULL, [], members FROM fresh LEFT JOIN total ON total.doc_id = fresh.doc_id WHERE k = 1)
SELECT {_ROW} FROM rows_"""


def with_omissions(source: str, block_list: frozenset[str]) -> str:
    """Entities with every suspect added: an alias of the first entity whose value is one of
    its words, else an entity of its own."""
    split = f"list_filter(regexp_split_to_array(lower(s.value), {Q.quote(T.render('{s}+', 're2'))}), lambda w: length(w) >= 3)"
    return f"""WITH RECURSIVE src AS ({source}), {detection(block_list)}, {omissions()},
hit AS (SELECT s.doc_id, s.ord, any_value(s.value) AS value, arg_min(f.id, f.ord) AS id FROM suspects s JOIN found f ON f.doc_id = s.doc_id AND list_contains({split}, lower(f.value)) GROUP BY s.doc_id, s.ord),
more AS (SELECT doc_id, id, list(value ORDER BY ord) AS more FROM hit GROUP BY doc_id, id),
own AS (SELECT f.* REPLACE (list_concat(aliases, list_filter(coalesce(more, []), lambda v: NOT list_contains(list_transform(aliases, lambda y: lower(y)), lower(v)) AND lower(v) <> lower(f.value))) AS aliases) FROM ({_OWN}) f LEFT JOIN more ON more.doc_id = f.doc_id AND more.id = f.id),
total AS (SELECT doc_id, max(ord) AS top FROM found GROUP BY doc_id),
fresh AS (SELECT * FROM suspects s WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = s.doc_id AND hit.ord = s.ord)),
rows_ AS (SELECT * FROM own UNION ALL SELECT fresh.doc_id, CAST(coalesce(top, -1) + row_number() OVER (PARTITION BY fresh.doc_id ORDER BY ord) AS INTEGER), sha256(fresh.doc_id || '|' || type || '|' || lower(value)), value, type, type, 1, [], true, false, NULL, NULL, NULL FROM fresh LEFT JOIN total ON total.doc_id = fresh.doc_id)
SELECT {_ROW} FROM rows_"""


def pre_detected(source: str, clean: str, known: str, block_list: frozenset[str]) -> str:
    """Entities known from one text, and after them what the cleaned text has of others."""
    first = f"WITH RECURSIVE src AS (SELECT doc_id, '{known}' AS text FROM ({source})), {detection(block_list)} {_OWN}"
    second = f"WITH RECURSIVE src AS (SELECT doc_id, {clean} AS text FROM ({source})), {detection(block_list)} {_OWN}"
    return f"""WITH a AS ({first}), b AS ({second}),
fresh AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND lower(a.value) = lower(b.value))),
total AS (SELECT doc_id, max(ord) AS top FROM a GROUP BY doc_id),
rows_ AS (SELECT * FROM a UNION ALL SELECT fresh.* REPLACE (CAST(coalesce(top, -1) + row_number() OVER (PARTITION BY fresh.doc_id ORDER BY ord) AS INTEGER) AS ord) FROM fresh LEFT JOIN total ON total.doc_id = fresh.doc_id)
SELECT {_ROW} FROM rows_"""


# ── Stray spaces ─────────────────────────────────────────────────────────────


def spacing(source: str, dictionary: str) -> str:
    """CTEs from a source of (doc_id, text) and a dictionary of (word) to kept: the suspects."""
    letters = "A-Za-zÀ-ÖØ-öø-ÿ"
    token, wide = f"[{letters}'’()\\[\\]0-9°.,]+", f"([{letters}0-9][{letters}0-9]+|[0-9]+)( {{2,}})([{letters}0-9][{letters}0-9]+|[0-9]+)"
    each = lambda pattern: f"SELECT doc_id, j, base, line, k, hits[k + 1] AS w, {START} AS a, hits, rest FROM (SELECT *, unnest(range(len(hits))) AS k FROM (SELECT doc_id, j, base, line, {places('line', pattern)} FROM sl))"
    return f"""
src AS MATERIALIZED ({source}), dict AS MATERIALIZED (SELECT list(DISTINCT word) AS ws FROM ({dictionary})),
sl AS MATERIALIZED (SELECT doc_id, j, line, coalesce(CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS base FROM (SELECT doc_id, unnest(range(len(ls))) AS j, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM src))),
tk AS MATERIALIZED ({each(token)}),
sh AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, j ORDER BY k) AS island FROM tk WHERE length(w) <= 2),
ru AS MATERIALIZED (
  SELECT doc_id, j, island, any_value(base) AS base, any_value(line) AS line, min(a) AS a, max(a + length(w)) AS b, string_agg(w, ' ' ORDER BY k) AS plain, list(w ORDER BY k) AS ws FROM sh GROUP BY doc_id, j, island
  HAVING count(*) >= CASE WHEN contains(any_value(line), '  ') THEN 2 ELSE 3 END
),
gp AS (SELECT sh.doc_id, sh.j, sh.island, bool_or(regexp_matches(rest[k + 1], '[-/]')) AS cut FROM sh JOIN ru ON ru.doc_id = sh.doc_id AND ru.j = sh.j AND ru.island = sh.island WHERE sh.a > ru.a GROUP BY sh.doc_id, sh.j, sh.island),
r1 AS (SELECT ru.* FROM ru LEFT JOIN gp ON gp.doc_id = ru.doc_id AND gp.j = ru.j AND gp.island = ru.island WHERE NOT coalesce(cut, false)),
-- Runs of single letters or digits; longer tokens stand alone, signs go with either.
m0 AS (SELECT doc_id, j, island, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM r1),
m1 AS (SELECT *, CASE WHEN length(w) > 1 THEN NULL WHEN w IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9') THEN 'digit' WHEN regexp_full_match(w, '[{letters}]') THEN 'letter' END AS own, sum(CASE WHEN length(w) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, j, island ORDER BY i) * 2 + CASE WHEN length(w) > 1 THEN 0 ELSE 1 END AS stretch FROM m0),
m2 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id, j, island, stretch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m1),
m3 AS (SELECT *, sum(CASE WHEN own <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, j, island, stretch ORDER BY i) AS part FROM m2),
m4 AS MATERIALIZED (SELECT doc_id, j, island, min(i) AS i, string_agg(w, '' ORDER BY i) AS s, max(own) = 'letter' AND count(*) > 2 AS split FROM m3 GROUP BY doc_id, j, island, stretch, part),
sg AS (
  SELECT DISTINCT s, s AS rest, CAST([] AS VARCHAR[]) AS words FROM m4 WHERE split
  UNION ALL SELECT s, rest[:length(rest) - n], list_prepend(rest[length(rest) - n + 1:], words) FROM (
    SELECT *, coalesce(list_filter([5, 4, 3, 2], lambda k: k <= length(rest) AND list_contains(ws, lower(rest[length(rest) - k + 1:])))[1], 1) AS n FROM sg, dict WHERE rest <> '')
),
m5 AS (SELECT doc_id, j, island, string_agg(coalesce(array_to_string(words, ' '), m4.s), ' ' ORDER BY i) AS merged FROM m4 LEFT JOIN (SELECT s, words FROM sg WHERE rest = '') w ON split AND w.s = m4.s GROUP BY doc_id, j, island),
f1 AS (SELECT r1.doc_id, 1 AS rule, base + a AS start, base + b AS stop, line[a + 1:b] AS original, merged FROM r1 JOIN m5 ON m5.doc_id = r1.doc_id AND m5.j = r1.j AND m5.island = r1.island WHERE merged <> plain OR line[a + 1:b] <> plain),
w0 AS (SELECT doc_id, text, hits[k + 1] AS w, {START} AS start FROM (SELECT *, unnest(range(len(hits))) AS k FROM (SELECT doc_id, text, {places('text', wide)} FROM src))),
f2 AS (SELECT doc_id, 2 AS rule, start, start + length(w) AS stop, w AS original, regexp_extract(w, {Q.quote(wide)}, 1) || ' ' || regexp_extract(w, {Q.quote(wide)}, 3) AS merged FROM w0
  WHERE NOT regexp_matches(text[greatest(start - 2, 0) + 1 : start + length(w) + 2], '[-/]') AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.doc_id = w0.doc_id AND f1.start <= w0.start AND f1.stop >= w0.start + length(w0.w))),
l0 AS ({each(f'[{letters}]+')}),
l1 AS (SELECT *, lead(w) OVER (PARTITION BY doc_id, j ORDER BY k) AS w2, lead(a) OVER (PARTITION BY doc_id, j ORDER BY k) AS a2 FROM l0),
l2 AS (SELECT doc_id, 3 AS rule, base + a AS start, base + a2 + length(w2) AS stop, line[a + 1:a2 + length(w2)] AS original, w || w2 AS merged, a2 - a - 1 AS gap, lower(w) AS x FROM l1 WHERE length(w) = 1 AND length(w2) >= 3 AND regexp_full_match(line[a + 2:a2], ' {{1,3}}')),
f3 AS (SELECT doc_id, rule, start, stop, original, merged FROM l2 WHERE NOT contains('aàyeoiu', x) AND NOT (contains('ldsnmcjt', x) AND gap < 2)
  AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) o WHERE o.doc_id = l2.doc_id AND o.start <= l2.start AND o.stop >= l2.stop)),
al AS (SELECT *, lag(stop) OVER (PARTITION BY doc_id ORDER BY start, rule, stop) AS before FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3)),
kept AS (SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", original, merged FROM al WHERE before IS NULL OR start >= before)"""


def spaced(source: str, dictionary: str) -> str:
    return f"WITH RECURSIVE {spacing(source, dictionary)} SELECT * FROM kept"


def respaced(source: str, dictionary: str) -> str:
    """The text with all suspects mended, from the last to the first."""
    step = "list_reduce(list_prepend({'a': CAST(-1 AS INTEGER), 'b': CAST(-1 AS INTEGER), 'm': text}, list_sort(found, 'DESC')), lambda acc, x: {'a': CAST(-1 AS INTEGER), 'b': CAST(-1 AS INTEGER), 'm': acc.m[:x.a] || x.m || acc.m[x.b + 1:]}).m"
    return f"WITH RECURSIVE {spacing(source, dictionary)} SELECT src.doc_id, CASE WHEN found IS NULL THEN text ELSE {step} END AS text FROM src LEFT JOIN (SELECT doc_id, list({{'a': start, 'b': \"end\", 'm': merged}}) AS found FROM kept GROUP BY doc_id) f ON f.doc_id = src.doc_id"


def spellings(source: str) -> str:
    """(doc_id, ord, value, occurrences): which near spelling joins which, step by step."""
    low = "lower(strip_accents({}))".format
    near = lambda a, b: f"(length({a}) >= 5 AND length({b}) >= 5 AND levenshtein({a}, {b}) <= 1)"
    fits = f"list_filter(range(1, len(free) + 1), lambda i: free[i] = w[1] OR {near('free[i]', 'w[1]')})[1]"
    return f"""WITH RECURSIVE n0 AS MATERIALIZED (SELECT *, {words(low('value'))} AS ws, row_number() OVER (PARTITION BY doc_id ORDER BY occurrences DESC, ord) AS k FROM ({source})),
nf AS (SELECT DISTINCT doc_id, k, unnest(flatten(list_transform(ws, lambda w: CASE WHEN length(w) < 5 THEN [w] ELSE list_append(list_transform(range(1, length(w) + 1), lambda i: w[:i - 1] || w[i + 1:]), w) END))) AS form FROM n0),
np AS (SELECT DISTINCT a.doc_id, a.k AS c, b.k AS j FROM nf a JOIN nf b ON a.doc_id = b.doc_id AND a.form = b.form AND a.k <> b.k),
nl AS (SELECT np.doc_id, c, j, len(a.ws) = 1 AND len(b.ws) = 1 AS single FROM np JOIN n0 a ON a.doc_id = np.doc_id AND a.k = c JOIN n0 b ON b.doc_id = np.doc_id AND b.k = j
  WHERE length(a.value) >= 5 AND CASE WHEN len(a.ws) = 1 THEN len(list_filter(b.ws, lambda w: {near('w', 'a.ws[1]')})) > 0 WHEN len(a.ws) <> len(b.ws) THEN false
    ELSE list_reduce(list_prepend(b.ws, list_transform(a.ws, lambda w: [w])), lambda free, w: CASE WHEN free IS NULL OR {fits} IS NULL THEN NULL ELSE list_concat(free[:{fits} - 1], free[{fits} + 1:]) END) IS NOT NULL END),
nt AS MATERIALIZED (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY c) AS step, list(struct_pack(j := j, single := single) ORDER BY j) AS js FROM nl GROUP BY doc_id, c),
ns AS (SELECT doc_id, list(struct_pack(n := CAST(occurrences AS BIGINT), o := ord, t := CAST(NULL AS INTEGER)) ORDER BY k) AS p FROM n0 WHERE doc_id IN (SELECT doc_id FROM nt) GROUP BY doc_id),
go AS (
  SELECT doc_id, p, CAST(0 AS BIGINT) AS step FROM ns
  UNION ALL SELECT doc_id, CASE WHEN j IS NULL THEN p ELSE list_transform(p, lambda e, i: struct_pack(n := e.n + CASE WHEN i = j THEN p[c].n ELSE 0 END, o := e.o, t := CASE WHEN i = c THEN p[j].o ELSE e.t END)) END, step
  FROM (SELECT go.doc_id, p, nt.step, c, list_filter(js, lambda x: p[c].t IS NULL AND p[x.j].t IS NULL AND p[x.j].n > p[c].n AND (NOT x.single OR p[x.j].n >= 3 * p[c].n))[1].j AS j FROM go JOIN nt ON nt.doc_id = go.doc_id AND nt.step = go.step + 1)
),
en AS (SELECT doc_id, unnest(p) AS e, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, arg_max(p, step) AS p FROM go GROUP BY doc_id))
SELECT n0.doc_id, ord, value, coalesce(e.n, occurrences) AS occurrences, e.t AS joined FROM n0 LEFT JOIN en ON en.doc_id = n0.doc_id AND en.k = n0.k"""
