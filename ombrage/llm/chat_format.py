"""Chat formatting by grammar round trip (native: columns only).

A conversation is rendered with one pair of marks a turn

    [SYS]text[/SYS]   [INST]text[/INST]   <s>text</s>
    [ROLE]role[/ROLE][TURN]text[/TURN]            (any other role)

and read back by a deterministic parser. A text that doesn't survive its own
rendering is escaped, a backslash after the first character of each mark in it
(and of each mark already escaped), and rendered again until the parser returns
the source. One step is enough: an escaped text holds no mark, every escape is
undone by dropping one backslash, and no mark can straddle a text and the mark
that follows, since a mark has "[" or "<" in first place only. A conversation
that still differs fails the query instead of passing altered.

Defined results: null text or role counts as empty; rows of a conversation go by
(turn, role, text), nulls first, so ties and repeated rows have one order; a null
conv_id is a conversation of its own; an empty table gives no rows; other columns
of the input are ignored. A conversation is one string by nature of the format,
so its rows meet in one task: memory follows the longest conversation, not the
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, read_table

MARKS = r"(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|/?TURN\])"
TURN = (
    r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|\[SYS\].*?\[/SYS\]"
    r"|\[ROLE\].*?\[/ROLE\]\[TURN\].*?\[/TURN\]"
)
PAIRS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
COLLISION = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)" + MARKS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + MARKS, r"$1$2$3")


def render_turn(role: Column, text: Column, role_text: Column) -> Column:
    """One turn in marks; role decides the marks, role_text is what is written."""
    out = F.concat(F.lit("[ROLE]"), role_text, F.lit("[/ROLE][TURN]"), text, F.lit("[/TURN]"))
    for name, (left, right) in PAIRS.items():
        out = F.when(role == name, F.concat(F.lit(left), text, F.lit(right))).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """Array of struct(role, text, raw) in order; raw is the turn as it stands."""
    turns = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))

    def one(raw: Column) -> Column:
        head = F.regexp_extract(raw, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)
        start = F.length(head) + F.lit(len("[ROLE][/ROLE][TURN]") + 1)
        body = F.substring(raw, start, F.length(raw) - start + 1 - len("[/TURN]"))
        role = unescape(head)
        for name, (left, right) in PAIRS.items():
            here = F.startswith(raw, F.lit(left))
            inner = F.substring(raw, F.lit(len(left) + 1), F.length(raw) - len(left) - len(right))
            body, role = F.when(here, inner).otherwise(body), F.when(here, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(body).alias("text"), raw.alias("raw"))

    return F.transform(turns, one)


def _same(parsed: Column, source: Column) -> Column:
    """The parser accounts for every character and returns the source turns."""
    got = F.transform(parsed, lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    return got == source


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to conv_id, formatted, turns: the text to
    train on and the turns read back from it as array of (role, text, raw).
    Assistant texts are what the loss mask covers."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(role.alias("role"), text.alias("text"))
    plain = render_turn(role, text, role)
    # Round trip of the turn alone; where it fails, what conflicts is escaped.
    whole = F.array_join(F.transform(parse(plain), lambda p: p["raw"]), "") == plain
    fine = whole & _same(parse(plain), F.array(turn))
    shown = F.when(fine, plain).otherwise(render_turn(role, escape(text), escape(role)))
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), shown.alias("shown"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "shown"))).alias("src"))
        .select("conv_id", F.array_join(F.transform("src", lambda t: t["shown"]), "").alias("formatted"), F.transform("src", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("src"))
        .select("conv_id", "formatted", bind(parse(F.col("formatted")), lambda p: F.when((F.array_join(F.transform(p, lambda t: t["raw"]), "") == F.col("formatted")) & _same(p, F.col("src")), p).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))).alias("turns"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(COLLISION).alias("text"))
    done = format_conversations(rows.unionByName(extra))
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        bind(learned, lambda x: F.length(x)).cast("long").alias("loss_chars"),
        bind(learned, lambda x: F.sha2(x, 256)).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_MARK_SQL = r"(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|/?TURN\])"
SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{COLLISION}' UNION ALL SELECT -1, 1, 'assistant', '{COLLISION}'
), e AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*){_MARK_SQL}', '\1\\\2\3', 'g')) AS n,
    length(regexp_replace(role, '([\[<])(\\*){_MARK_SQL}', '\1\\\2\3', 'g')) AS r FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(n + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11 ELSE r + 26 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
