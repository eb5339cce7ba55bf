"""Reading documents: uploads as binary files, text extraction, charset detection."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import js_trim
from ..operators.cleaning import clean_text, scored_lines
from .pdf import pdf_text

#: Fixed values.
MAX_BYTES = 100 * 1024 * 1024
EXTENSIONS = ("pdf", "docx", "txt")
NATIVE_CHARS_A_PAGE = 50
PAGE_MARK = "/Page "
OCR_DPI = 300


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of a folder as (filename, extension, length, content), those of a known kind
    and at most MAX_BYTES. The filters on length and path reach the scan."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    ext = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    return raw.where(F.col("length") <= MAX_BYTES).select(name.alias("filename"), ext.alias("extension"), "length", "content").where(F.col("extension").isin(*EXTENSIONS))


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """What read_files() leaves out, and why."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    why = F.when(~ext.isin(*EXTENSIONS), "extension").when(F.col("length") > MAX_BYTES, "size")
    return raw.withColumn("reason", why).where("reason IS NOT NULL")


def page_count(raw: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(raw, F.lit(PAGE_MARK)))


def route_pdf(native: Column, raw: Column, ocr: Column, ocr_ready: Column) -> Column:
    """Struct(text, method): native text where there are 50 characters a page, else
    the recognised text; ocr_unavailable where recognition isn't there."""
    enough = F.length(native) >= NATIVE_CHARS_A_PAGE * page_count(raw)
    text = F.when(enough | ~ocr_ready, native).otherwise(ocr)
    method = F.when(enough, "native").when(~ocr_ready, "ocr_unavailable").otherwise("ocr")
    return F.struct(text.alias("text"), method.alias("method"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX, a blank line between; empty for anything that isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    signs = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    paragraphs = ("".join(n.text or "" if n.tag == f"{_W}t" else signs.get(n.tag, "") for n in p.iter()) for p in root.iter(f"{_W}p"))
    return "\n\n".join(paragraphs).strip()


#: What Mac text read as windows-1252 shows.
MAC_SIGNS = re.compile("[ŽŠˆ˜•–—]")
#: windows-1252 as browsers read it: its five unassigned bytes are control characters.
CP1252 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)]


def decode_text(content: bytes) -> str:
    """UTF-8; with errors, windows-1252; with signs of a wrong guess, Mac Roman. Line ends
    become \\n."""
    text = content.decode("utf-8", "replace").removeprefix("\ufeff")
    if "\ufffd" in text:
        text = "".join(map(CP1252.__getitem__, content))
        if MAC_SIGNS.search(text):
            text = content.decode("mac_roman")
    return re.sub("\r\n?", "\n", text)


def zip_entries(archives: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content) of ZIP files to (key, name, size, crc32, sound): their entries as the
    directory has them, and whether the stored bytes agree; nothing for what is none."""
    kind = archives.schema[key].dataType.simpleString()
    names = ["name", "size", "crc32", "sound"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(batch.column(1)[k].as_py() or b"")) as z:
                        bad = z.testzip()
                        rows = [(i.filename, i.file_size, i.CRC, i.filename != bad) for i in z.infolist()]
                except zipfile.BadZipFile:
                    pass
                ids = pa.array([batch.column(0)[k].as_py()] * len(rows), batch.schema.field(0).type)
                types = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], [key, *names])

    return archives.select(key, "content").mapInArrow(run, f"{key} {kind}, name string, size long, crc32 long, sound boolean")


Extractor = Callable[[bytes], str]
EXTRACTED = "filename string, extension string, text string, method string"


def extract(files: DataFrame, native: Extractor = pdf_text, ocr: Extractor | None = None) -> DataFrame:
    """(filename, extension, content) to text and method. native and ocr read a PDF; a
    failing native extractor gives no text, a missing ocr the method ocr_unavailable."""
    schema = pa.schema([("filename", pa.string()), ("extension", pa.string()), ("text", pa.string()), ("method", pa.string())])

    def one(ext: str, content: bytes) -> tuple[str, str]:
        if ext == "txt":
            return decode_text(content), "txt"
        if ext == "docx":
            return docx_text(content), "docx"
        try:
            text = native(content) or ""
        except Exception:  # noqa: BLE001 - by specification
            text = ""
        if len(text) >= NATIVE_CHARS_A_PAGE * max(1, content.count(PAGE_MARK.encode())):
            return text, "native"
        return (text, "ocr_unavailable") if ocr is None else (ocr(content), "ocr")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, ext, content in zip(*(batch.column(c).to_pylist() for c in ("filename", "extension", "content")), strict=True):
                text, method = one(ext, content)
                rows.append({"filename": name, "extension": ext, "text": text, "method": method})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("filename", "extension", "content").mapInArrow(run, EXTRACTED)


def render_pages(content: bytes, dpi: int = OCR_DPI) -> list[bytes]:
    """PNG of every page through pdftoppm, in page order; files are gone afterwards."""
    import subprocess
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as d:
        (Path(d) / "in.pdf").write_bytes(content)
        subprocess.run(["pdftoppm", "-r", str(dpi), "-png", f"{d}/in.pdf", f"{d}/page"], check=True, capture_output=True)
        return [p.read_bytes() for p in sorted(Path(d).glob("page*.png"))]


def ocr_pages(pages: list[bytes], recognise: Callable[[bytes], tuple[str, list[dict]]]) -> dict:
    """Recognised pages: texts joined by a blank line, word boxes and images as data URLs.
    recognise gives a page's text and words (text, x0, y0, x1, y1)."""
    import base64

    done = [recognise(p) for p in pages]
    return {"text": "\n\n".join(t for t, _ in done), "pageBoxes": [{"words": w} for _, w in done], "pageImages": ["data:image/png;base64," + base64.b64encode(p).decode() for p in pages]}


def ingest(docs: DataFrame) -> DataFrame:
    """Extracted documents (doc_id, text, method) to the working text: what came as plain
    text is cleaned, the rest stays; with counts of characters, words and lines."""
    text = F.coalesce("text", F.lit(""))
    work = F.when(F.col("method") == "txt", clean_text(text)).otherwise(text)
    words = F.size(F.filter(F.split(js_trim(F.col("rawText")), "[\\s\\x{A0}]+"), lambda w: w != ""))
    return docs.select("doc_id", "method", text.alias("originalText"), work.alias("rawText")).select("*", F.length("rawText").alias("n_chars"), words.alias("n_words"), F.size(F.split("rawText", "\n")).alias("n_lines"))


def ingest_lines(docs: DataFrame) -> DataFrame:
    """Scored lines of the documents that came as plain text."""
    return scored_lines(docs.where("method = 'txt'"))


@F.pandas_udf(StringType())
def decode(content: pd.Series) -> pd.Series:
    return content.map(decode_text, na_action="ignore")
