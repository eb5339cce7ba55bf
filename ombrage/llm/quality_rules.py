"""Quality rules: within-text counts and cross-document line frequency (native).

Within a text: words, their characters, symbols, repeated lines, and words covered by
8-word windows found twice or more. A document fails with fewer than MIN_WORDS words or
over MAX_REPEAT percent of its words in repeated windows.

Across documents: normalised lines (lower case, digits as 0, blanks collapsed) are
hashed, and the distinct documents with each line are counted for each host (the
source). Exact copies of a text count as one document, so a group of copies doesn't
make its own lines common. A document that loses over MAX_LOST percent of its words to
common lines, or is left with fewer than MIN_WORDS, is depleted and goes.

A line in over MIN_DOCS documents of a host is common, however large the host is.

Scale: hashes are reduced to distinct (host, line, text) rows before they are counted,
so a hot host or line is spread over its texts. (host, line) rows of the texts are
joined with those of the common lines, and a document meets only its own text's, by a
sort-merge join with skew splitting. Everything within a text is done in that text's row,
in n log n steps.

Defined results: null and empty texts have no words and fail; a null source is a host
of its own; rows that repeat count once across documents and are judged alike; an
empty table gives no rows; other columns are kept by apply_rules().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, read_table, words_of, written

MIN_WORDS = 20
MAX_REPEAT = 30
WINDOW = 8
MIN_DOCS = 20
MAX_LOST = 70
SYMBOLS = r"[#*$%&|<>]"


def normal_line(line: Column) -> Column:
    """A line as it is compared across documents; blank lines become empty."""
    low = F.regexp_replace(F.lower(line), "[0-9]", "0")
    return F.regexp_replace(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "), "^ | $", "")


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def host_of() -> Column:
    return F.coalesce("source", F.lit(""))


def copy_of() -> Column:
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text, F.length(text))


def line_hashes() -> Column:
    return F.array_distinct(F.transform(F.filter(text_lines(F.col("text")), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), line_hash))


def common_of_texts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(source, text) to (host, copy, common): of each text that has some, the hashes of its
    lines that over min_docs distinct texts of the host have."""
    rows = written(docs.select(host_of().alias("host"), copy_of().alias("copy"), F.explode(line_hashes()).alias("line")), "rows")
    often = written(rows.groupBy("host", "line").agg(F.count_distinct("copy").alias("n")).where(F.col("n") > min_docs).select("host", "line"), "often")
    return written(rows.join(often, ["host", "line"]).groupBy("host", "copy").agg(F.collect_set("line").alias("common")), "common")


def repeated_words(words: Column, n: Column) -> Column:
    """Words in WINDOW-word windows found twice or more in the text, first included."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = bind(hashes, lambda h: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(h, (i + k).cast("int")) for k in range(WINDOW)])))

    def covered(win: Column) -> Column:
        placed = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda e, k: F.when(k > 0, F.get(s, k - 1)["x"] == e["x"]).otherwise(False) | F.when(k < last, F.get(s, k + 1)["x"] == e["x"]).otherwise(False)
            return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

        # Windows in order of place: each covers what the one before it doesn't reach.
        start = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("at"))
        step = lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("sum"), i.alias("at"))
        return F.aggregate(bind(placed, twice), start, step, lambda acc: acc["sum"])

    some = bind(windows, lambda win: F.when(F.size(F.array_distinct(win)) < F.size(win), covered(win)).otherwise(0))
    return F.when(n > WINDOW, some).otherwise(0).cast("long")


def measure(docs: DataFrame, common: DataFrame) -> DataFrame:
    """docs with column _m: a struct of the counts and verdicts, and _clean, the text
    without common lines. docs must have source and text; common is that of their texts."""
    words = words_of(F.col("text"))
    lines = F.filter(text_lines(F.col("text")), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    given = common.select(F.col("host").alias("_of_host"), F.col("copy").alias("_of_copy"), F.col("common").alias("_common"))
    same = [F.col("_host") == F.col("_of_host"), F.col("_copy") == F.col("_of_copy")]
    joined = docs.withColumns({"_host": host_of(), "_copy": copy_of()}).join(given.hint("merge"), same, "left")  # grows with the texts: one plan at every size
    drop = lambda x: F.array_contains(F.col("_common"), line_hash(x))
    clean = F.when(F.col("_common").isNull(), F.col("text")).otherwise(
        bind(text_lines(F.col("text")), lambda ls: F.when(F.exists(ls, drop), F.array_join(F.filter(ls, lambda x: ~drop(x)), "\n")).otherwise(F.col("text")))
    )
    one = joined.withColumns({"_words": words, "_lines": lines, "_clean": clean})
    left = F.when(F.col("_clean") == F.coalesce("text", F.lit("")), F.size("_words")).otherwise(F.size(words_of(F.col("_clean"))))
    two = one.withColumns({"_n": F.size("_words"), "_left": F.when(F.col("_clean").isNull(), 0).otherwise(left)})
    n = F.col("_n")
    three = two.withColumn("_r", repeated_words(F.col("_words"), n))
    failed = (n < MIN_WORDS) | (100 * F.col("_r") > MAX_REPEAT * n)
    depleted = (F.col("_left") < n) & ((F.col("_left") < MIN_WORDS) | (100 * (n - F.col("_left")) > MAX_LOST * n))
    m = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_r").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        (n - F.col("_left")).cast("long").alias("n_common_words"),
    )
    return three.withColumn("_m", m)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "source", "text")
    return measure(docs, common_of_texts(docs)).select("doc_id", "_m.*")


def apply_rules(docs: DataFrame) -> DataFrame:
    """docs that the rules keep, text without the common lines and n_chars to fit;
    columns as given."""
    out = {"text": F.col("_clean")} | ({"n_chars": F.when(F.col("_clean") != F.col("text"), F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    done = measure(docs, common_of_texts(docs)).where("_m.kept")
    return done.select(*[out.get(c, F.col(c)).alias(c) for c in docs.columns])


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
ln AS (
  SELECT k, host, t, l, pos, regexp_replace(regexp_replace(regexp_replace(lower(l), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS nl
  FROM (SELECT k, host, t, unnest(ls) AS l, unnest(range(len(ls))) AS pos FROM w)
),
often AS (SELECT host, nl FROM ln WHERE nl <> '' GROUP BY host, nl HAVING count(DISTINCT t) > {MIN_DOCS}),
lost AS (
  SELECT k, sum(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) AS lost FROM ln SEMI JOIN often ON ln.host = often.host AND ln.nl = often.nl GROUP BY k
),
dup AS (SELECT k, count(*) - count(DISTINCT l) AS n FROM ln WHERE nl <> '' GROUP BY k),
win AS (
  SELECT k, i, list_aggregate(list_slice(ws, i, i + {WINDOW - 1}), 'string_agg', ' ') AS x
  FROM (SELECT k, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW})
),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, sum(least({WINDOW}, i - p)) AS n FROM (SELECT k, i, coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), i - {WINDOW}) AS p FROM rep) GROUP BY k),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_common_words
  FROM w LEFT JOIN dup USING (k) LEFT JOIN cov USING (k) LEFT JOIN lost USING (k)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words)
  AND NOT (n_common_words > 0 AND (n_words - n_common_words < {MIN_WORDS} OR 100 * n_common_words > {MAX_LOST} * n_words)) AS kept
FROM m
"""
