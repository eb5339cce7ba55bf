"""Interleaved document sequences with media columns.

parse_html() turns a page into its ordered parts: texts, and media references with
source and caption (a figure's caption, else the alternative text). Media are stored
by the SHA-256 of their payload; a join on that digest resolves references, and since
it is a left join from the sequence, positions and captions stay where they were even
where a medium is missing.

Media here are PNG images, 64 pixels of 8-bit RGB a row. Any bytes fit: they are
padded with spaces to a positive multiple of 192 and become samples one for one, so the
form is lossless. Features are made from what is read back, in integers.

The store keeps one copy a digest within each Arrow batch and moves no payload in a
shuffle: a stored medium is decoded where it is read, and only its features (a few
hundred bytes) are reduced to one row a digest, written and joined. Both sides of that
join are plain shuffles, so adaptive execution splits a digest with very many references.
The query's pages hold their document's whole text, but of text parts only the length
is shuffled.

Defined results: null text and null html are empty (an empty text is one row of
spaces; an empty page has no parts); rows that repeat a page_id are pages of their own
and give equal values; broken
markup is parsed as far as it goes; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

UNIT = 192
WIDE = 64
LEVEL = 6
SCHEME = "sha256:"
#: Elements whose content is not text of the page.
SILENT = ("script", "style", "noscript", "template")
#: Elements that end a run of text.
BREAKS = ("p", "div", "li", "ul", "ol", "br", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "article", "section", "nav", "header", "footer", "figure", "figcaption", "title", "body", "html", "blockquote", "pre")


class _Parts(HTMLParser):
    """Collects [kind, text, ref, caption] in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.run: list[str] = []
        self.silent = 0
        self.figure: list[list] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.parts.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        if tag in BREAKS:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption" and self.figure is not None:
            self.caption = []
        elif tag in ("img", "audio", "video", "source", "embed"):
            given = dict(attrs)
            if ref := given.get("src"):
                self.flush()
                part = ["media", None, ref, given.get("alt") or None]
                self.parts.append(part)
                if self.figure is not None:
                    self.figure.append(part)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for part in self.figure or []:
                part[3] = text
            self.caption = None
        elif tag in BREAKS:
            self.flush()
        if tag == "figure":
            self.figure = self.caption = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.run if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[list]:
    """[kind, text, ref, caption] of each part, in order."""
    p = _Parts()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.parts


SEQUENCE = "page_row long, page_id long, position int, kind string, text string, ref string, caption string"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_row, page_id, html) batches to SEQUENCE batches."""
    names = [c.split()[0] for c in SEQUENCE.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
    for batch in slices(batches):
        rows = [(r, i, k, *x) for r, i, html in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, x in enumerate(parse_html(html))]
        cols = zip(*rows, strict=True) if rows else ([],) * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def sequences(pages: DataFrame) -> DataFrame:
    """(page_id, html) to one row a part: page_row (which row of pages), page_id, position,
    kind, text, ref, caption."""
    return pages.select(F.monotonically_increasing_id().alias("page_row"), F.col("page_id").cast("long"), "html").mapInArrow(parse_pages, SEQUENCE)


def resolve(parts: DataFrame, media: DataFrame) -> DataFrame:
    """Parts with the columns of media (one row a digest) where a reference names it."""
    named = F.when((F.col("kind") == "media") & F.startswith("ref", F.lit(SCHEME)), F.substring("ref", len(SCHEME) + 1, 64))
    return parts.withColumn("_digest", named).join(media.withColumnRenamed("digest", "_stored"), F.col("_digest") == F.col("_stored"), "left").drop("_stored").withColumnRenamed("_digest", "digest")


def interleave(resolved: DataFrame, *columns: str) -> DataFrame:
    """One row a page: its parts in order as an array of structs, by default of all that
    a sequence has, then of columns."""
    have = [c for c in ("position", "kind", "text", "ref", "caption") if c in resolved.columns]
    part = F.struct(*have, *columns)
    return resolved.groupBy("page_row", "page_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))


def padded(data: bytes) -> bytes:
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """PNG of 64 RGB pixels a row whose samples are the payload's bytes."""
    rows = len(payload) // UNIT
    lines = np.zeros((rows, UNIT + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
    head = struct.pack(">IIBBBBB", WIDE, rows, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of a PNG that to_png() made; raises on damage."""
    at, data, rows = 8, b"", 0
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            rows = struct.unpack(">IIBBBBB", body)[1]
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, UNIT + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean of each channel in thousandths, and a 64-bit mean hash over 64 slices."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    means = x.reshape(-1, 3).sum(0) * 1000 // (len(x) // 3)
    slices = x.reshape(64, -1).sum(1)
    bits = slices * 64 > slices.sum()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return f"{WIDE}x{len(x) // UNIT};rgb={means[0]},{means[1]},{means[2]};hash={value:016x}"


def store(texts: DataFrame) -> DataFrame:
    """(text) to (digest, media), the media column of the store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {hashlib.sha256(p).hexdigest(): p for p in (padded((t or "").encode()) for t in batch.column("text").to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([to_png(p) for p in own.values()], pa.binary())], ["digest", "media"])

    return texts.select("text").mapInArrow(run, "digest string, media binary")


READ_BACK = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame) -> DataFrame:
    """Stored (digest, media) to one row a digest of what the stored bytes hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, png in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
                payload = from_png(png)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature(payload)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in READ_BACK.split(", ")])

    names = [c.split()[0] for c in READ_BACK.split(", ")]
    seen = media.mapInArrow(run, READ_BACK)
    # Copies of a digest are equal in every column.
    return seen.groupBy("digest").agg(F.min(F.struct(*names[1:])).alias("v")).select("digest", *[F.col(f"v.{n}").alias(n) for n in names[1:]])


def document_page(doc_id: int | None, text: str | None) -> str:
    """A page of a document: its lines as paragraphs; after the first a figure of the
    text's medium, captioned with its length in bytes; at the end the medium once more."""
    data = (text or "").encode()
    ref = SCHEME + hashlib.sha256(padded(data)).hexdigest()
    first, *rest = (text or "").split("\n")
    figure = f'<figure><img src="{ref}" alt="text"><figcaption>{len(data)}</figcaption></figure>'
    lines = "".join(f"<p>{escape(x)}</p>" for x in rest)
    return f'<article><h1>Document {doc_id}</h1><p>{escape(first)}</p>{figure}{lines}<img src="{ref}" alt="again"></article>'


def document_sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to the sequences of the documents' pages, page_id the doc_id."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            html = [document_page(i, t) for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(html, pa.string())], ["page_row", "page_id", "html"])

    rows = docs.select(F.monotonically_increasing_id().alias("page_row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda batches: parse_pages(pages(batches)), SEQUENCE)


FEATURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    media = written(read_back(written(store(docs), "media")), "features")
    parts = document_sequences(docs).withColumn("chars", F.length("text")).drop("text")
    pages = interleave(resolve(parts, media), "chars", *FEATURES)
    shown = F.filter("parts", lambda p: p["kind"] == "media")
    aligned = F.forall(F.transform("parts", lambda p, i: p["position"] == i), lambda x: x)
    # The captioned reference is the first; the one at the end must show the same medium.
    one = F.when(aligned & (F.size(shown) == 2) & (F.element_at("parts", -1)["media_sha256"] == shown[0]["media_sha256"]), shown[0]).otherwise(F.raise_error(F.concat(F.lit("parts out of place on page "), F.col("page_id").cast("string"))))
    return pages.select("page_id", "parts", one.alias("m")).select(
        F.col("page_id").alias("doc_id"), F.col("m.caption").cast("long").alias("n_bytes"), *[F.col(f"m.{c}").alias(c) for c in FEATURES], F.col("m.position").alias("position"),
        F.size("parts").alias("n_parts"), F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.coalesce(p["chars"], F.lit(0))).alias("text_chars"),
    )
