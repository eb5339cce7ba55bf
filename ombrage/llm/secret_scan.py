"""Secret scans: three fixed patterns, and a token-efficiency test for the rest.

Prose and identifiers made of words take few tokens of a byte-pair vocabulary: four
characters and more a token. Random strings find no long entries and take one token
for every one or two characters. A candidate is a maximal run of letters, digits and
+ / _ = - with a letter, of at least min_chars characters, or of MIXED_CHARS where it has
a digit too; it is a secret when it has fewer than `ratio` characters a token. Excluded before the test: hex
strings of a digest's length (MD5, SHA-1, SHA-2), UUIDs, plain numbers and dates, and
dashed or snake-case identifiers whose parts each are one word or one number.

Base spans stay whatever the test says; a run that overlaps a base span adds none.

Defined results: null text is empty; an empty text has no spans; texts are scanned
whole, whatever their length; rows that repeat are scanned alike; an empty table gives
no rows. Offsets count code points, end exclusive. redact() keeps all columns of its
input and replaces each span (joined where they overlap) by a mark.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: The order in which kinds are listed.
KINDS = ("assign", "access", "hex", "token")
VOCABULARY = "byte_bpe_50k.tiktoken"
MIN_CHARS = 20
MIXED_CHARS = 16
RATIO = 2.2
MARK = "[SECRET]"
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PARTS = re.compile(r"(?:[A-Za-z][a-z]*|[A-Z]+|[0-9]+)(?:[-_/=+](?:[A-Za-z][a-z]*|[A-Z]+|[0-9]+))+")


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=8)
def _candidates(min_chars: int) -> re.Pattern[str]:
    return re.compile(rf"[A-Za-z0-9+/_=-]{{{min_chars},}}")


def known(run: str) -> bool:
    """Digests and identifiers, which are no secrets."""
    core = run.strip("=-_/+")
    if len(core) in DIGEST_CHARS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core):
        return True
    return bool(UUID.fullmatch(core) or PARTS.fullmatch(core) or re.fullmatch(r"[0-9+/_=-]*", core))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three fixed patterns."""
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def token_spans(text: str, base: list[tuple[int, int, int]], vocabulary: str, min_chars: int, ratio: float) -> list[tuple[int, int, int]]:
    """(start, 3, end) of the runs that the token-efficiency test exposes."""
    out = []
    for m in _candidates(min(min_chars, MIXED_CHARS)).finditer(text):
        run, a, b = m[0], m.start(), m.end()
        if not re.search("[A-Za-z]", run) or len(run) < min_chars and not re.search("[0-9]", run) or known(run):
            continue
        if any(s < b and a < e for s, _, e in base):
            continue
        if len(run) < ratio * len(encoding(vocabulary).encode_ordinary(run)):
            out.append((a, 3, b))
    return out


def scan(text: str | None, vocabulary: str = VOCABULARY, min_chars: int = MIN_CHARS, ratio: float = RATIO) -> tuple[list, list]:
    """(base spans, all spans) of a text, each sorted by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + token_spans(text, base, vocabulary, min_chars, ratio))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame, vocabulary: str = VOCABULARY, min_chars: int = MIN_CHARS, ratio: float = RATIO) -> DataFrame:
    """(doc_id, text) to doc_id, counts of the base kinds, base_sha256, spans, n_token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for text in batch.column("text").to_pylist():
                base, spans = scan(text, vocabulary, min_chars, ratio)
                kinds = [k for _, k, _ in spans]
                for c, v in zip(cols, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), kinds.count(3)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long")


def redact_text(text: str | None, mark: str = MARK) -> str | None:
    spans = scan(text)[1]
    if not spans:
        return text
    out, done, upto = [], 0, -1
    for a, _, b in spans:
        if a >= upto:
            out += [text[done:a], mark]
        upto = done = max(upto, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """docs with every secret in text replaced by mark; columns as given."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact_text(t, mark) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read_table(spark, sf_dir, "documents"))
