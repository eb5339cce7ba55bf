"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's spaces become the piece mark, one mark goes before it, and each character is
a symbol. All adjacent pairs whose union is in the vocabulary wait in an agenda
ordered by score, then position; the best pair merges and its new neighbours
join the agenda, until none is left. What is then not in the vocabulary is spelled in
byte pieces.

No piece of a usable vocabulary has the mark after another character (checked when
it is loaded; otherwise a text is one chunk), so no merge crosses from the end of a
word into the next mark. A text is coded by chunks, one run of marks and the
characters up to the next, and a chunk's ids are remembered in a table bounded by
CACHE entries and CACHE_CHARS characters, which is emptied when full. Within the Arrow
batches every newly coded chunk is checked against the sentencepiece library; a difference
fails the task. A batch is coded, decoded and put out in slices of SLICE bytes of text (or
one row), so that a worker holds little beside the batch itself.

The chunks that PART chunks of text bring anew are coded together. Those of up to
WIDTHS[-1] characters are rows of a matrix of symbols, beside one of the unions of
adjacent symbols: that is the agenda, from which each row takes its best pair in each
round, so that a round costs a few array operations for all rows. Longer chunks have an
agenda each as a heap, whose cost is not the square of the length.

Defined results: null text is empty and gives the begin and end ids; texts are coded
whole; rows that repeat are coded alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

MODEL = "piece_bpe_32k.model"
CACHE, CACHE_CHARS, SLICE = 200_000, 4_000_000, 1_000_000
#: Chunks and characters of text that are coded together, and how many new chunks the library reads as one text.
PART, PART_CHARS, CHECKED = 100_000, 1_000_000, 64
#: Characters of a chunk, up to which it shares a matrix of this width, and cells of a matrix.
WIDTHS, CELLS = (6, 8, 10, 12, 16, 24, 48), 250_000
MARK = "▁"
POINTS = 0x110000


def pair_table(pieces: list[str], number: dict[str, int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys left * most + right of all pairs of symbols whose union is a piece, and
    the pieces' numbers. The last key is beyond all pairs."""
    unions = {}
    for k, p in enumerate(pieces):
        for i in range(1, len(p)):
            left, right = number.get(p[:i]), number.get(p[i:])
            if left is not None and right is not None:
                unions[left * most + right] = k
    keys = np.array(sorted(unions), np.int64)
    return np.append(keys, np.iinfo(np.int64).max), np.array([*map(unions.get, keys.tolist()), len(pieces)], np.int32)


class Coder:
    """Encoder and decoder of one merge-type model."""

    def __init__(self, model: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        usable = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in usable}
        self.scores = {lib.id_to_piece(i): -lib.get_score(i) for i in usable}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = lib.unk_id()
        self.byte_fallback = all(lib.is_byte(i) for i in self.bytes)
        self.begin, self.end = (array("I", [i]).tobytes() for i in (lib.bos_id(), lib.eos_id()))
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.cache: dict[str, bytes] = {}
        self.cached = 0  # characters of its chunks

        # Symbols: pieces from the best score on, then their other characters, then
        # all code points, then none. The best pair is the one of the smallest union,
        # or, where scores are equal, of the smallest with that score.
        pieces = sorted(self.ids, key=self.scores.__getitem__)
        number = {p: k for k, p in enumerate(pieces)}
        for c in sorted(set("".join(pieces)) - number.keys()):
            number[c] = len(number)
        self.pieces, self.known = len(pieces), len(number)
        self.symbols = np.arange(self.known, self.known + POINTS, dtype=np.int32)
        for c in (c for c in number if len(c) == 1):
            self.symbols[ord(c)] = number[c]
        self.none = self.known + POINTS
        self.keys, self.unions = pair_table(pieces, number, self.none + 1)
        scores = np.array([self.scores[p] for p in pieces])
        self.first = np.append(np.searchsorted(scores, scores), self.pieces).astype(np.int32)
        self.ties = bool((self.first != np.arange(self.pieces + 1))[self.unions].any())
        # Where a symbol's ids stand in the list of ids; width 0: not yet looked up.
        self.listed = np.array([self.ids[p] for p in pieces], np.uint32)
        self.start = np.zeros(self.none, np.int32)
        self.start[: self.pieces] = np.arange(self.pieces)
        self.width = np.zeros(self.none, np.int8)
        self.width[: self.pieces] = 1
        self.others = list(number)[self.pieces :]

    def spelled(self, s: str) -> list[int]:
        """Ids of a symbol that is not in the vocabulary."""
        return [self.bytes[b] for b in s.encode()] if self.byte_fallback else [self.unknown]

    def look_up(self, symbols: np.ndarray) -> None:
        """Add the ids of characters that are not in the vocabulary to the list."""
        more: list[int] = []
        for s in set(symbols.tolist()):
            ids = self.spelled(chr(s - self.known) if s >= self.known else self.others[s - self.pieces])
            self.start[s], self.width[s] = len(self.listed) + len(more), len(ids)
            more += ids
        if more:
            self.listed = np.append(self.listed, np.array(more, np.uint32))

    def union(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or the number of pieces."""
        key = left.astype(np.int64) * (self.none + 1) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.unions[at], np.int32(self.pieces))

    def merge_rows(self, chunks: list[str], width: int) -> list[bytes]:
        """Ids of chunks of up to width characters (spaces already marks), by one round for all."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        held = self.symbols[points]
        # A pair that is no pair stands at either end, so that every symbol has neighbours.
        symbols = np.full((len(chunks), width + 2), self.none, np.int32)
        symbols[:, 1:-1][np.arange(width) < lengths[:, None]] = held
        self.look_up(held[self.width[held] == 0])
        rows, agenda, out = np.arange(len(chunks)), self.union(symbols[:, :-1], symbols[:, 1:]), [b""] * len(chunks)
        while len(rows):
            at = (self.first[agenda] if self.ties else agenda).argmin(axis=1)
            best = agenda[np.arange(len(rows)), at]
            live = best < self.pieces
            if not live.all():
                for r, ids in zip(rows[~live].tolist(), self.ids_of(symbols[~live]), strict=True):
                    out[r] = ids
                rows, symbols, agenda, at, best = (x[live] for x in (rows, symbols, agenda, at, best))
            each = np.arange(len(rows))
            symbols[each, at] = best
            later = np.arange(symbols.shape[1] - 1) > at[:, None]
            symbols = np.where(later, symbols[:, 1:], symbols[:, :-1])
            agenda = np.where(later[:, 1:], agenda[:, 1:], agenda[:, :-1])
            agenda[each, at - 1] = self.union(symbols[each, at - 1], best)
            agenda[each, at] = self.union(best, symbols[each, at + 1])
        return out

    def ids_of(self, symbols: np.ndarray) -> Iterator[bytes]:
        """Ids of each row of symbols."""
        given = symbols != self.none
        flat = symbols[given]
        width = self.width[flat].astype(np.int64)
        begun = np.append(0, np.cumsum(width))
        ids = self.listed[np.repeat(self.start[flat] - begun[:-1], width) + np.arange(begun[-1])].tobytes()
        ends = [0, *(4 * begun[np.cumsum(given.sum(axis=1))]).tolist()]
        return (ids[a:b] for a, b in zip(ends, ends[1:]))

    def merge_all(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks (spaces already marks), little-endian."""
        out, sizes, least = [b""] * len(chunks), np.fromiter(map(len, chunks), np.int64, len(chunks)), 0
        for width in WIDTHS:
            all_rows, most = np.flatnonzero((sizes > least) & (sizes <= width)).tolist(), max(1, CELLS // width)
            least = width
            for begin in range(0, len(all_rows), most):
                some = all_rows[begin : begin + most]
                for k, ids in zip(some, self.merge_rows([chunks[k] for k in some], width), strict=True):
                    out[k] = ids
        for k in np.flatnonzero(sizes > least).tolist():
            out[k] = array("I", self.merge(chunks[k])).tobytes()
        return out

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk (spaces already marks) by the agenda."""
        ids = self.ids
        if chunk in ids and len(chunk) < 2:
            return [ids[chunk]]
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        scores, push, pop = self.scores, heapq.heappush, heapq.heappop
        agenda = []
        for i in range(n - 1):
            s = scores.get(chunk[i : i + 2])
            if s is not None:
                agenda.append((s, i, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, size = pop(agenda)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            # A pair that has changed since it was queued is stale.
            if j >= n or len(left) + len(symbols[j]) != size:
                continue
            symbols[i] = left = left + symbols[j]
            symbols[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = scores.get(left + symbols[k])
                if s is not None:
                    push(agenda, (s, i, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                s = scores.get(symbols[h] + left)
                if s is not None:
                    push(agenda, (s, h, len(symbols[h]) + size))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                i = ids.get(s)
                if i is not None:
                    out.append(i)
                else:
                    out += self.spelled(s)
        return out

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.splits:
            return [MARK + text.replace(" ", MARK)]
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        return text.split(" ")  # the common case: each with one mark before it, left out

    def learn(self, new: list[str]) -> None:
        """Code chunks and hold them against the library."""
        marked = [c if c[:1] == MARK else MARK + c for c in new]
        ours = self.merge_all(marked)
        # The library reads chunks together, but those of marks only, which would run
        # into the next one's marks.
        apart = [k for k, c in enumerate(marked) if c[-1] == MARK] if self.splits else range(len(new))
        left = set(apart)
        some, ids = ([c for k, c in enumerate(x) if k not in left] for x in (marked, ours)) if left else (marked, ours)
        texts = ["".join(some[k : k + CHECKED])[1:] for k in range(0, len(some), CHECKED)]
        theirs = array("I", chain.from_iterable(self.lib.encode(texts, num_threads=1)))
        same = theirs.tobytes() == b"".join(ids)
        for k in apart if same else range(len(new)):
            want = array("I", self.lib.encode(marked[k][1:])).tobytes()
            # Of nothing but the mark that every text begins with the library makes no pieces.
            if want != ours[k] and marked[k] != MARK:
                raise ValueError(f"agenda and library differ on {marked[k]!r}: {array('I', ours[k]).tolist()} {array('I', want).tolist()}")
        if not same:
            raise ValueError("agenda and library differ on chunks that stand together")
        self.cache.update(zip(new, ours, strict=True))
        self.cached += sum(map(len, new))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with begin and end ids."""
        out: list[list[bytes]] = [[self.begin] for _ in texts]
        parts: list[tuple[int, list[str]]] = []
        held = chars = 0
        for i, (text, c) in enumerate(zip(texts, map(self.chunks, texts), strict=True)):
            chars += len(text)
            for k in range(0, len(c), PART):
                parts.append((i, c[k : k + PART]))
                held += len(parts[-1][1])
                if held >= PART or chars >= PART_CHARS:
                    self.encode_parts(parts, out)
                    parts, held, chars = [], 0, 0
        self.encode_parts(parts, out)
        return [b"".join((*ids, self.end)) for ids in out]

    def encode_parts(self, parts: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        """Ids of parts (number of the text, its chunks), appended to their texts' lists."""
        met = set().union(*(c for _, c in parts))
        new = met.difference(self.cache)
        if len(self.cache) + len(new) > CACHE or self.cached + sum(map(len, new)) > CACHE_CHARS:  # known chunks go too
            self.cache.clear()
            self.cached, new = 0, met
        if new:
            self.learn(list(new))
        get = self.cache.__getitem__
        for i, c in parts:
            out[i].append(b"".join(map(get, c)))

    def decode(self, ids: bytes) -> str:
        return self.lib.decode(np.frombuffer(ids, "<u4"))


@lru_cache(maxsize=1)
def coder(model: str) -> Coder:
    import public_tokenizers

    return Coder(public_tokenizers.path(model) if "/" not in model else model)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in order, in slices of SLICE bytes of text at most, or one row."""
    begin = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
        if i > begin and held + n > SLICE:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def coded(c: Coder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], list[str]]]:
    """doc_id, ids and decoded texts of each slice of the batches."""
    for batch in batches:
        for part in slices(batch):
            ids = c.encode_batch([t or "" for t in part.column("text").to_pylist()])
            yield part.column("doc_id"), ids, [c.decode(x) for x in ids]


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) to doc_id, ids (little-endian unsigned 32-bit), decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, decoded in coded(coder(model), batches):
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) to doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for doc_id, ids, decoded in coded(coder(model), batches):
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids]), pa.array([sha(t.encode()).hexdigest() for t in decoded])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read_table(spark, sf_dir, "documents"))
