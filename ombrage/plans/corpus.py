"""French case files and entity tables made from the star schema's keys.

The driver's documents hold few of the forms that detection looks for, so these
are built from customers by SQL that Spark and DuckDB read alike; each function gives
the SQL, and the same text serves both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ["Mahidine", "Catherine", "Jean-Pierre", "Suhua", "Daniel", "Isabelle", "Annaïk", "Émile"]
LAST = ["BOUCHAABA", "Dupont", "Mervoyer", "Laprès", "SCHNEIDER", "Valois", "Lefèvre", "Marchandeau", "OUVRARD", "Dupont", "Kermadec"]
TITLES = ["Monsieur", "Madame", "M.", "Mme", "Maître", "Docteur"]
STREETS = ["rue de Vaugirard", "avenue des Ternes", "boulevard Voltaire", "place de la République"]
NOISE = ["te juge a vu la pièce n* 3", "somme de 110 E, au ler mars", "n® 12 et 1O2 lots", "au 8®™ étage, l'artide 5", "tes parties, ta société ; de-référe", "RECONVENTTONNELS ______ ______ btitlkttf rgtdwter"]
PAIRS = ["Monsieur et Madame {}", "les époux {}", "Daniel et Suhua {}", "Madame Suhua Laprès épouse {}", "Par Maître {}", "{} Avocat"]
BROKEN = ["Il est pro-{n}posé de payer", "Monsieur{n}{n}Dupont est venu.", "Fin de phrase.{n}Nouvelle phrase", "VALOIS est{n}en{n}droit de réclamer", "Suite au{n}{n}{n}bail signé{n}{n}par le locataire"]
SPACED = ["a u Barreau  de Paris", "la r  etraite et 2  lits", "articles 5 - 1 et 22 / 06", "N ° d e  dossier", "l espace d u  lieu"]


def case(key: str, values: list[str], replace: dict[str, str] | None = None) -> str:
    """CASE expression that picks a value by key modulo their number."""

    def text(v: str) -> str:
        out = "'" + v.replace("'", "''") + "'"
        for mark, expr in (replace or {}).items():
            out = out.replace(mark, f"' || {expr} || '")
        return out

    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {k} THEN {text(v)}" for k, v in enumerate(values)) + " END"


def case_files() -> str:
    """SQL of (doc_id, text) over customer: one case file each."""
    k, nl = "c_custkey", "chr(10)"
    first, last, title = case(k, FIRST), case(f"{k} * 3", LAST), case(f"{k} * 5 + 1", TITLES)
    two = "lpad(CAST({} % 90 + 10 AS STRING), 2, '0')".format
    phone = f"'06 ' || {two(k)} || ' ' || {two(k + ' * 7')} || ' 34 ' || {two(k + ' * 3')}"
    lines = [
        f"{title} || ' ' || {first} || ' ' || {last} || ', née le ' || CAST({k} % 28 + 1 AS STRING) || ' mars 19' || {two(k)} || ', demeurant ' || CAST({k} % 200 + 1 AS STRING) || ' ' || {case(k, STREETS)} || ', 750' || {two(k)} || ' PARIS.'",
        f"'Le dossier RG: ' || {two(k)} || '/0' || CAST({k} % 1000 AS STRING) || ' vise la société SARL ' || {case(k + ' * 2', LAST)} || ' ; tél. ' || {phone} || ', courriel contact' || CAST({k} AS STRING) || '@exemple-droit.fr, SIREN 123 456 ' || lpad(CAST({k} % 1000 AS STRING), 3, '0') || '.'",
        case(k, NOISE),
        f"'Selon ' || {last} || ', demandeur, et le défendeur : ' || {title} || ' ' || {case(k + ' + 3', FIRST)} || ' ' || {case(k + ' + 4', LAST)} || '. ' || {last} || ' confirme ; ' || {last} || ' signe.'",
        case(k, PAIRS, {"{}": last}),
        case(k, BROKEN, {"{n}": nl}),
        case(k, SPACED),
    ]
    return f"SELECT CAST(c_custkey AS BIGINT) AS doc_id, {f' || {nl} || '.join(f'({x})' for x in lines)} AS text FROM customer"


def entity_table() -> str:
    """SQL of an entity table over customer: documents are nations. Aliases are in
    alias_1 and alias_2, since the engines write arrays differently."""
    k = "c_custkey"
    types = case(k, ["NOM", "NOM", "ENTITE", "ADRESSE", "DEMANDEUR_1", "Numéro d'écrou", "PRENOM"])
    value = f"{case(k, FIRST)} || ' ' || {case(k + ' * 3', LAST)}"
    single = case(k + " * 3", LAST)
    return (
        f"SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(c_custkey AS INT) AS ord, CAST(c_custkey AS STRING) AS id, CASE WHEN {k} % 3 = 0 THEN {single} ELSE {value} END AS value, {types} AS type, {types} AS label,"
        f" CAST({k} % 9 + 1 AS INT) AS occurrences, {case(k, ['Monsieur {}', 'M. {}', '{}'], {'{}': single})} AS alias_1, {case(k + ' + 2', FIRST)} AS alias_2, {k} % 5 <> 0 AS active, {k} % 11 = 0 AS blocked FROM customer"
    )


def span_table() -> str:
    """SQL of (doc_id, start, end) over lineitem: spans within orders."""
    return 'SELECT l_orderkey AS doc_id, CAST(l_partkey * 7 % 400 AS INT) AS start, CAST(l_partkey * 7 % 400 + l_quantity AS INT) AS "end", l_linenumber AS n FROM lineitem'


def word_boxes() -> str:
    """SQL of pixel boxes over orders: pages of words in lines of four."""
    words = case("o_orderkey * 3 + o_custkey", ["Monsieur", "Dupont", "Élan,", "(BOUCHAABA)", "le", "Jean", "Dupont"])
    return (
        "SELECT o_custkey AS doc_id, 0 AS page, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS word_no, text, x0, y0, x1, y1, page_width, page_height FROM ("
        f"SELECT o_custkey, o_orderkey, {words} AS text, CAST(o_orderkey % 4 * 100 AS INT) AS x0, CAST(o_orderkey % 40 - o_orderkey % 4 AS INT) * 10 AS y0, CAST(o_orderkey % 4 * 100 + 80 AS INT) AS x1, CAST(o_orderkey % 40 - o_orderkey % 4 AS INT) * 10 + 20 AS y1, 800 AS page_width, 1000 AS page_height FROM orders) b"
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the scan as planned has fewer partitions than there
    are cores: a file of one row group is one task, whatever its rows cost. Any other table
    stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A corpus as a DataFrame: its SQL over the Parquet tables, by path."""
    for t in ("customer", "lineitem", "orders"):
        sql = sql.replace(f"FROM {t}", f"FROM parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(sql.replace('"end"', "`end`"))


#: Lines of a page, and where text stands on it: multiples that fractions of the page show exactly.
PAGE_LINES, PAGE_WIDE, PAGE_HIGH, LEFT, TOP, SIZE, LEADING = 90, 500, 1000, 40, 960, 8, 10


def pdf_content(text: Column) -> Column:
    """A PDF file of the text: its lines as they are, PAGE_LINES on a page, shown as UTF-16
    codes through a composite font with a ToUnicode map."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    n = F.ceil(F.size(lines) / PAGE_LINES).cast("int")
    shown = lambda x: F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj T*"))
    body = lambda k: F.array_join(F.transform(F.slice(lines, k * PAGE_LINES + 1, PAGE_LINES), shown), "\n")
    start = f"BT /F1 {SIZE} Tf {LEADING} TL {LEFT} {TOP} Td\n"
    obj = lambda num, *parts: F.concat(F.lit("\n"), num.cast("string"), F.lit(" 0 obj\n"), *parts, F.lit("\nendobj"))
    stream = lambda data: F.concat(F.lit("<</Length "), F.length(data).cast("string"), F.lit(">>\nstream\n"), data, F.lit("\nendstream"))
    pages = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.concat(
            obj(6 + 2 * k, F.lit("<</Type /Page /Parent 2 0 R /Contents "), (7 + 2 * k).cast("string"), F.lit(" 0 R>>")),
            obj(7 + 2 * k, stream(F.concat(F.lit(start), body(k), F.lit("\nET")))),
        ),
    )
    kids = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat((6 + 2 * k).cast("string"), F.lit(" 0 R"))), " ")
    cmap = F.lit("1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange")
    whole = F.concat(
        F.lit("%PDF-1.7"),
        obj(F.lit(1), F.lit("<</Type /Catalog /Pages 2 0 R>>")),
        obj(F.lit(2), F.lit(f"<</Type /Pages /MediaBox [0 0 {PAGE_WIDE} {PAGE_HIGH}] /Resources <</Font <</F1 3 0 R>>>> /Kids ["), kids, F.lit("] /Count "), n.cast("string"), F.lit(">>")),
        obj(F.lit(3), F.lit("<</Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R>>")),
        obj(F.lit(4), F.lit("<</Type /Font /Subtype /CIDFontType2 /DW 500>>")),
        obj(F.lit(5), stream(cmap)),
        F.array_join(pages, ""),
        F.lit("\ntrailer <</Root 1 0 R>>\n%%EOF\n"),
    )
    return F.encode(whole, "ISO-8859-1")
