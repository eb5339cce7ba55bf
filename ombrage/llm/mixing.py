"""Mixing sources to target weights by iterative proportional fitting (native).

Cells are (source, lang, topic); a cell's weight is its words. Raking multiplies the
weights, margin after margin, by target share / present share, until every margin is
within TOLERANCE of its target, relatively. The ratio of a cell's calibrated to its own weight
calibrates its documents: rate * ratio copies of each are expected. A document is put
out once for each whole copy and once more with the probability of the rest, decided by a
uniform number made from the MD5 of its id. So no probability is clipped, and the
words of the output meet the targets in expectation. Where no document may come twice
(repeat=False) the rate is lowered until probabilities over 1 would hold a hundredth of
the words at most, so that a small cell with a high ratio doesn't thin out all others.

Targets: shares by category for the margins that are given; any other margin is
tempered, share ** ALPHA over the sum of these. Categories without a given share
split what the given ones leave, in proportion to their words; categories that the table
doesn't have leave their share to the others. Given targets that can't be met together
fail; tempered ones, which may not fit each other where a source has one language, end
after ROUNDS rounds with the last margin met.

Topics are a parameter: any column, or the first of a list of patterns that the text
has.

All steps are aggregates and windows over the cells; documents meet their cell in
one equi-join, whose strategy Catalyst picks by the cells' size. A hot source is split
by the other two margins and by adaptive execution.

Defined results: null source, lang, topic or text are the empty category or text; texts
without a word weigh 0 and their cell's ratio is its margin's (1 for cells without a
word); null doc_id has one uniform number; rows that repeat a doc_id are kept or left
together; an empty table gives no rows; other columns are kept by mix() and clash with
nothing (its own are dropped again).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, word_count, written

MARGINS = ("source", "lang", "topic")
ALPHA = 0.7
TOLERANCE = 1e-10
ROUNDS = 60
RATE = 1.0
#: Where no document comes twice: rates that are tried, each 2 ** (-1/4) of the one before,
#: and the share of the expected words that may be lost to probabilities over 1.
STEPS, CLIPPED = 48, 0.01
#: Topics by the first pattern found in the lower-cased text; none: prose. What follows
#: a pattern are strings of which each of its matches has one.
TOPICS = (
    ("legal", "license|copyright|warrant|licen[cz]", ("licen", "copyright", "warrant")),
    ("contact", "[a-z0-9._-]+@[a-z0-9-]+[.][a-z]", ("@",)),
    ("code", "[{}][^\\n]*[{};]|def [a-z]|#include|=>", ("{", "}", "def ", "#include", "=>")),
    ("table", "\\|[^\\n]*\\|", ("|",)),
)


def topic_of(text: Column, topics: Sequence[tuple[str, str, Sequence[str]]] = TOPICS) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("prose")
    for name, pattern, needles in reversed(topics):
        some = reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in needles])
        out = F.when(some & F.rlike(low, F.lit(pattern)), name).otherwise(out)
    return out


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) that the id decides, the first 52 bits of its MD5."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cells_of(weighed: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) rows to cells with their words."""
    return weighed.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("own"))


def aims_of(cells: DataFrame, margin: str, given: dict[str, float] | None) -> DataFrame:
    """(margin, aim): the target share of each category of a margin, 1 in all."""
    sums = cells.groupBy(margin).agg(F.sum("own").alias("words"))
    if given is None:
        aim = F.col("words") ** F.lit(ALPHA)
    else:
        rest = sums.where(~F.col(margin).isin(*given)).agg(F.sum("words")).first()[0] or 1.0
        aim = F.lit(max(0.0, 1.0 - sum(given.values()))) * F.col("words") / F.lit(rest)
        for k, v in given.items():
            aim = F.when(F.col(margin) == k, F.lit(float(v))).otherwise(aim)
    aims = sums.select(margin, aim.alias("aim"))
    total = aims.agg(F.sum("aim")).first()[0] or 1.0
    return aims.select(margin, (F.col("aim") / F.lit(total)).alias(f"aim_{margin}"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, own) with their calibrated share as column fitted.

    Margins are tables of one row a category, so each step is one small aggregate
    and join; the lineage is cut by a checkpoint after every other round."""
    targets = targets or {}
    cells = cells.where("own > 0").checkpoint()
    total = cells.agg(F.sum("own")).first()[0] or 1.0
    fitted = cells.withColumn("fitted", F.col("own") / F.lit(total))
    for m in MARGINS:
        fitted = fitted.join(aims_of(cells, m, targets.get(m)), m)
    fitted = fitted.checkpoint()
    share = lambda m: F.sum("fitted").over(W.partitionBy(m))
    missed = 0.0
    for _ in range(0, rounds, 2):
        for m in MARGINS * 2:
            part = share(m)
            fitted = fitted.withColumn("fitted", F.when(part > 0, F.col("fitted") * F.col(f"aim_{m}") / part).otherwise(0.0))
        fitted = fitted.checkpoint()
        off = fitted.select(*[F.when(F.col(f"aim_{m}") > 0, F.abs(share(m) / F.col(f"aim_{m}") - 1)).otherwise(share(m)).alias(m) for m in MARGINS])
        missed = off.agg(F.max(F.greatest(*MARGINS))).first()[0] or 0.0
        if missed <= tolerance:
            break
    if targets and missed > tolerance:
        raise ValueError(f"the targets can't be met together: a share is off by {missed:.3g} of itself after {rounds} rounds")
    return fitted.select(*MARGINS, "own", "fitted", (F.col("fitted") * F.lit(total) / F.col("own")).alias("ratio"))


def weigh(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """Null-free margins and words of each document."""
    return docs.select(F.col("doc_id").cast("long"), *[c.alias(m) for m, c in margins_of(topic).items()], word_count(F.col("text")).alias("tokens"))


def margins_of(topic: Column | None = None) -> dict[str, Column]:
    own = topic_of(F.col("text")) if topic is None else topic
    return {"source": F.coalesce("source", F.lit("")), "lang": F.coalesce("lang", F.lit("")), "topic": F.coalesce(own, F.lit(""))}


def copies_of(doc_id: Column, expected: Column) -> Column:
    """Whole copies, and one more with the probability of the rest."""
    whole = F.floor(expected)
    return (whole + (uniform(doc_id) < expected - whole).cast("long")).cast("long")


def scaled(ratios: DataFrame, rate: float, repeat: bool) -> float:
    """The rate; where no document may come twice, the largest of STEPS at which
    probabilities over 1 would have had CLIPPED of the expected words at most."""
    if repeat:
        return rate
    steps = [rate * 2.0 ** (-k / 4) for k in range(STEPS)]
    words = lambda r: F.sum(F.lit(r) * F.col("ratio") * F.col("own"))
    over = lambda r: F.sum(F.greatest(F.lit(0.0), F.lit(r) * F.col("ratio") - 1) * F.col("own"))
    lost = ratios.agg(*[F.coalesce(over(r) / words(r), F.lit(0.0)).alias(str(k)) for k, r in enumerate(steps)]).first()
    return next((r for k, r in enumerate(steps) if lost[k] <= CLIPPED), steps[-1])


def sample_plan(weighed: DataFrame, rate: float = RATE, targets: dict | None = None) -> DataFrame:
    """Weighed documents with ratio, the probability of a further copy, and copies."""
    ratios = written(rake(cells_of(weighed), targets), "ratios")
    placed = weighed.join(ratios.select(*MARGINS, "ratio"), list(MARGINS), "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    expected = F.lit(rate) * F.col("ratio")
    return placed.withColumns({"probability": expected - F.floor(expected), "copies": copies_of(F.col("doc_id"), expected)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sample_plan(written(weigh(read_table(spark, sf_dir, "documents")), "weighed"))
    return plan.select("doc_id", *MARGINS, "tokens", F.round("ratio", 4).alias("ratio"), F.round("probability", 4).alias("probability"), "copies")


def mix(docs: DataFrame, rate: float = RATE, targets: dict | None = None, topic: Column | None = None, repeat: bool = True) -> DataFrame:
    """docs with the copies of each row that the calibrated probabilities give; columns
    as given."""
    names = docs.columns
    keys = {f"_mix_{m}": c for m, c in margins_of(topic).items()}
    # Written, so that its size is known when the join is planned.
    ratios = written(rake(cells_of(written(weigh(docs, topic), "weighed")), targets), "ratios")
    rate = scaled(ratios, rate, repeat)
    ratios = ratios.select(*[F.col(m).alias(f"_of_{m}") for m in MARGINS], F.col("ratio").alias("_mix_ratio"))
    same = [F.col(f"_mix_{m}") == F.col(f"_of_{m}") for m in MARGINS]
    joined = docs.withColumns(keys).join(ratios, same, "left")
    expected = F.lit(rate) * F.coalesce("_mix_ratio", F.lit(1.0))
    copies = copies_of(F.col("doc_id").cast("long"), expected if repeat else F.least(expected, F.lit(1.0)))
    return joined.select(*names, copies.alias("_copies")).where("_copies > 0").select(*names, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).select(*names)


#: Rounds of the SQL text, past the tolerance on the tables at hand.
SQL_ROUNDS = 40


def _sql() -> str:
    """The same fitting, written out for another engine."""
    kinds = " ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{n}'" for n, p, _ in TOPICS)
    steps, last = [], "f0"
    for k in range(1, SQL_ROUNDS * len(MARGINS) + 1):
        m = MARGINS[(k - 1) % len(MARGINS)]
        steps.append(f"f{k} AS MATERIALIZED (SELECT * EXCLUDE fitted, fitted * aim_{m} / sum(fitted) OVER (PARTITION BY {m}) AS fitted FROM {last})")
        last = f"f{k}"
    aims = ", ".join(f"a_{m} AS (SELECT {m}, s / sum(s) OVER () AS aim_{m} FROM (SELECT {m}, pow(sum(own), {ALPHA}) AS s FROM cells WHERE own > 0 GROUP BY {m}))" for m in MARGINS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {kinds} ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS tokens FROM documents
), cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS own FROM d GROUP BY ALL), {aims},
f0 AS MATERIALIZED (
  SELECT cells.*, aim_source, aim_lang, aim_topic, own / (SELECT sum(own) FROM cells) AS fitted
  FROM cells JOIN a_source USING (source) JOIN a_lang USING (lang) JOIN a_topic USING (topic) WHERE own > 0
), {", ".join(steps)},
r AS (SELECT source, lang, topic, fitted * (SELECT sum(own) FROM cells) / own AS r FROM {last}),
p AS (
  SELECT d.*, coalesce(r, 1.0) AS r, {RATE} * coalesce(r, 1.0) AS e,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM d LEFT JOIN r USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, tokens, round(r, 4) AS ratio, round(e - floor(e), 4) AS probability,
  CAST(floor(e) + CASE WHEN u < e - floor(e) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM p
"""


SQL = _sql()
