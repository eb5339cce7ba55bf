"""Content-addressed WARC archive.

An archive is three Parquet tables in one folder. payloads has each payload's bytes
once, under their SHA-256, in buckets sorted by that digest. records has the exact
header block of every record and the digest of its payload. layout says how many
buckets there are. A record is put together again by a join on the digest; the bytes
are verified against it when read back.

Of records with equal payloads of at least revisit_from bytes (100), those with the
smallest page_id are responses and others revisit them; smaller payloads are always
responses. Header blocks follow WARC/1.1 and hold nothing that varies between runs,
so a repeated task writes the same bytes.

Scale: payload bytes are shuffled once, when they are stored, after copies within an
input partition are reduced to one. Reading doesn't move them: the buckets are the
join's partitions, and only records (headers) are shuffled to them. A digest with over
SPREAD records is marked when stored; its records are dealt by salt over one task for
each SPREAD of them, with a copy of the payload for each salt, which adds at most one
payload for SPREAD records. Which record is first is an aggregate over (digest,
page_id) only; digests of one record need no join.

Defined results: null html is an empty payload; null url is written as an empty
target; rows that repeat a page_id with the same payload count as one first record
(all are responses); a record without its payload, or with another, fails the read; an
empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, fresh_path, read_table, written

REVISIT_FROM = 100
SPREAD = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Payload bytes of a bucket at most, on average: a bucket is one task when it is read.
BUCKET_BYTES = 128 << 20


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header_block(page_id: Column, url: Column, digest: Column, n: Column, kind: Column, first: Column) -> Column:
    """The record's header lines up to and with the empty line, exact."""
    end = F.lit("\r\n")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: "), record_id(page_id),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " "),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha256:"), digest,
        F.lit("\r\nContent-Type: text/html; charset=utf-8"),
        F.when(kind == "revisit", F.concat(F.lit("\r\nWARC-Refers-To: "), record_id(first), F.lit("\r\nWARC-Profile: " + REVISIT_PROFILE))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), n.cast("string"), end, end,
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM) -> None:
    """Store (page_id, url, html) rows under path as tables records, payloads and layout."""
    spark = pages.sparkSession
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    light = full.select("page_id", "url", "digest", F.length("payload").cast("long").alias("n"))
    parts = F.ceil(F.count("*") / F.lit(SPREAD)).cast("int").alias("parts")
    several = written(light.groupBy("digest").agg(F.min(F.when(F.col("n") >= revisit_from, F.col("page_id"))).alias("first_id"), parts, F.count("*").alias("c")).where("c > 1").drop("c"), "several")
    kind = F.when(F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")), "response").otherwise("revisit")
    (
        light.join(several, "digest", "left")
        .withColumn("kind", kind)
        .select("page_id", "digest", "n", F.coalesce("parts", F.lit(1)).alias("parts"), header_block(F.col("page_id"), F.col("url"), F.col("digest"), F.col("n"), F.col("kind"), F.col("first_id")).alias("header"))
        .write.parquet(f"{path}/records")
    )
    total = spark.read.schema("n long").parquet(f"{path}/records").agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    once = full.groupBy("digest").agg(F.first("payload").alias("payload"), parts)
    name = f"ombrage_{uuid.uuid4().hex}"
    once.write.format("parquet").bucketBy(buckets, "digest").sortBy("digest").option("path", f"{path}/payloads").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the folder stays
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/layout")


def payload_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads (digest, payload, parts) in their buckets, verified."""
    buckets = spark.read.schema("buckets int").parquet(f"{path}/layout").first()[0]
    name, folder = f"ombrage_{uuid.uuid4().hex}", f"{path}/payloads".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} (digest STRING, payload BINARY, parts INT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'")
    stored = spark.table(name)
    stored.schema  # resolved here; then the catalogue's entry is no longer needed
    spark.sql(f"DROP TABLE {name}")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is not what its digest says: "), F.col("digest"))))
    return stored.select("digest", sound.alias("payload"), "parts")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """digest, header and payload bytes of every record; raises where stored bytes
    do not have the digest they are stored under, or are missing."""
    records = spark.read.schema("page_id long, digest string, parts int, header binary").parquet(f"{path}/records")
    payloads = payload_table(spark, path)
    plain = records.where("parts = 1").select("digest", "header").join(payloads.where("parts = 1").select("digest", "payload"), "digest", "left")
    salted = records.where("parts > 1").select("digest", F.pmod(F.xxhash64("page_id", "header"), "parts").cast("int").alias("salt"), "header")
    copies = payloads.where("parts > 1").select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "payload")
    both = plain.select("digest", "header", "payload").unionByName(salted.join(copies, ["digest", "salt"], "left").select("digest", "header", "payload"))
    return both.withColumn("payload", F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload for "), F.col("digest"))).cast("binary")))


def record_bytes(header: Column, payload: Column) -> Column:
    """The original record as it stands in a WARC file."""
    return F.concat(header, payload, F.lit("\r\n\r\n").cast("binary"))


def export_warc(spark: SparkSession, path: str, target: str) -> None:
    """The archive's records as gzipped WARC files, put together again, one a task."""
    whole = F.decode(F.concat("header", "payload"), "UTF-8")
    read_archive(spark, path).select(whole.alias("value")).write.text(target, compression="gzip", lineSep="\r\n\r\n")


def field(header: Column, name: str) -> Column:
    """A header field's value; null where the record has no such field."""
    found = F.regexp_extract(F.decode(header, "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archive")
    write_archive(read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html"), path)
    back = read_archive(spark, path)
    head = F.col("header")
    page = lambda name: F.regexp_extract(field(head, name), r"^<urn:page:(.*)>$", 1)
    return back.select(
        F.when(page("WARC-Record-ID") != "none", page("WARC-Record-ID")).cast("long").alias("page_id"),
        bind(record_bytes(head, F.col("payload")), lambda r: F.length(r) - F.length(head) - 4).cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        field(head, "WARC-Type").alias("record_type"),
        page("WARC-Refers-To").cast("long").alias("refers_to"),
        (field(head, "Content-Length").cast("long") == F.length("payload")).alias("length_agrees"),
    )


SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= {REVISIT_FROM} GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first_id IS NULL OR p.page_id IS NOT DISTINCT FROM f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to, TRUE AS length_agrees
FROM p LEFT JOIN f USING (d)
"""
