"""Toxicity scores: a bidirectional gated recurrent network with attention pooling.

Each word enters as its own vector (words of the training sample's vocabulary) and as
the mean vector of its character trigrams, which also reaches spellings never seen.
Both directions read a window of WINDOW words, attention pools the states to one
vector, a linear unit gives the window's logit. Windows overlap (a new one starts every
STRIDE words) and cover the whole text; a document's logit is its highest window's.
The logit is calibrated to a probability by logistic regression on the sample,
weighted back to the class shares of all labelled rows.

Training is in numpy, on the driver, over a sample bounded by MAX_TOXIC and MAX_CLEAN
documents and MAX_BYTES of text of either class (the labelled rows of the training folds
with the smallest hashes of their ids; all parameters) and SAMPLE_WINDOWS windows of each,
drawn from the whole text. A label holds for a document, so after a first round on all windows each step learns from the
window of a document that scores highest. Everything is seeded.

Scoring runs in Arrow batches on the executors; projected word inputs are remembered
in a table bounded by CACHE rows.

Defined results: null texts and texts without a word have score 0; labels of null
documents, null labels and labels without a document are left out; of repeated labels
that disagree 1 wins; other columns of labels are never read; an unlabelled or
one-class sample gives score 0 for all; rows that repeat are scored alike; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table

MAX_TOXIC, MAX_CLEAN, MAX_BYTES, SAMPLE_WINDOWS = 1200, 2400, 48 << 20, 24
WINDOW, STRIDE = 48, 36
WORDS, TRIGRAMS = 4000, 4096
WORD_DIM, CHAR_DIM, HIDDEN = 12, 12, 10
STEPS, BATCH, RATE, SEED = 420, 128, 0.006, 42
CACHE = 300_000
THRESHOLD = 0.3
HELD_OUT = 2
WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def trigram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row of the trigram around each character of the words, line ends between
    words included (row -1), and where each word starts among them."""
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    tri = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) >> np.uint64(7)
    rows = (tri % np.uint64(TRIGRAMS)).astype(np.int64)
    rows[codes[1:-1] == 10] = -1
    starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words[:-1]]))).astype(np.int64)
    return rows, starts


def windows(n: int) -> list[int]:
    """Starts of the overlapping windows that cover n words."""
    return list(range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)) if n else []


class Network:
    """The parameters and both passes."""

    def __init__(self, vocabulary: list[str]):
        rng = np.random.default_rng(SEED)
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        g = lambda *s, k=0.1: rng.normal(0, k, s).astype(np.float32)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        self.p = {
            "word": g(len(vocabulary) + 1, WORD_DIM), "char": g(TRIGRAMS, CHAR_DIM), "wx": g(d, 6 * h, k=d**-0.5), "bx": np.zeros(6 * h, np.float32),
            "uf": g(h, 3 * h, k=h**-0.5), "ub": g(h, 3 * h, k=h**-0.5), "att": g(2 * h), "out": g(2 * h, k=0.3), "bias": np.zeros(1, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Projected inputs (words x 6 HIDDEN) and what the backward pass needs."""
        p = self.p
        ids = np.fromiter((self.ids.get(w, 0) for w in words), np.int64, len(words))
        rows, starts = trigram_rows(words)
        vec = p["char"][rows]
        vec[rows < 0] = 0
        lens = np.maximum(1, np.fromiter(map(len, words), np.int64, len(words))).astype(np.float32)[:, None]
        x = np.concatenate((p["word"][ids], np.add.reduceat(vec, starts, axis=0) / lens), axis=1)
        return x @ p["wx"] + p["bx"], (x, ids, rows, starts, lens)

    def forward(self, px: np.ndarray, idx: np.ndarray, ok: np.ndarray, keep: bool = False):
        """px: projected inputs; idx, ok: windows x WINDOW rows of px and their validity."""
        h, p = HIDDEN, self.p
        n, length = idx.shape
        states = np.zeros((length, n, 2 * h), np.float32)
        saved = []
        for lo, name, order in ((0, "uf", range(length)), (h, "ub", range(length - 1, -1, -1))):
            u, cur = p[name], np.zeros((n, h), np.float32)
            for t in order:
                gx = px[idx[:, t], 3 * lo : 3 * lo + 3 * h]
                hu = cur @ u
                zr = 0.5 + 0.5 * np.tanh(0.5 * (gx[:, : 2 * h] + hu[:, : 2 * h]))
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(gx[:, 2 * h :] + r * hu[:, 2 * h :])
                m = ok[:, t, None]
                nxt = np.where(m, new + z * (cur - new), cur)
                if keep:
                    saved.append((lo, name, t, cur, z, r, new, hu[:, 2 * h :], m))
                cur = nxt
                states[t, :, lo : lo + h] = cur
        e = states @ p["att"]
        e = np.where(ok.T, e, -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnd->nd", a, states)
        logit = pooled @ p["out"] + p["bias"][0]
        return logit, (states, a, pooled, saved)

    def backward(self, dlogit: np.ndarray, px: np.ndarray, idx: np.ndarray, ok: np.ndarray, kept: tuple, source: tuple) -> dict[str, np.ndarray]:
        h, p = HIDDEN, self.p
        states, a, pooled, saved = kept
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["bias"][0] = pooled.T @ dlogit, dlogit.sum()
        dpool = dlogit[:, None] * p["out"]
        da = np.einsum("nd,tnd->tn", dpool, states)
        de = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tn,tnd->d", de, states)
        dstates = a[:, :, None] * dpool[None] + de[:, :, None] * p["att"]
        dpx = np.zeros_like(px)
        carry, last = None, None
        for lo, name, t, cur, z, r, new, hun, m in reversed(saved):
            if name != last:
                carry, last = np.zeros_like(cur), name
            d = dstates[t, :, lo : lo + h] + carry
            dm = np.where(m, d, 0)
            dnew = dm * (1 - z) * (1 - new * new)
            dz = dm * (cur - new) * z * (1 - z)
            dr = dnew * hun * r * (1 - r)
            dg = np.concatenate((dz, dr, dnew), 1)
            dhu = np.concatenate((dz, dr, dnew * r), 1)
            np.add.at(dpx, (idx[:, t], slice(3 * lo, 3 * lo + 3 * h)), dg)
            g[name] += cur.T @ dhu
            carry = np.where(m, d * z, d) + dhu @ p[name].T
        x, ids, rows, starts, lens = source
        g["wx"], g["bx"] = x.T @ dpx, dpx.sum(0)
        dx = dpx @ p["wx"].T
        np.add.at(g["word"], ids, dx[:, :WORD_DIM])
        each = np.repeat(dx[:, WORD_DIM:] / lens, np.diff(np.concatenate((starts, [len(rows)]))), axis=0)
        np.add.at(g["char"], rows[rows >= 0], each[rows >= 0])
        return g

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -40, 40)))


def layout(docs: list[np.ndarray], starts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows and validity of all windows of all documents, and each one's document."""
    flat = np.concatenate([*docs, np.zeros(WINDOW, np.int64)]) if docs else np.zeros(WINDOW, np.int64)
    base = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
    first = np.fromiter((x for s in starts for x in s), np.int64, len(owner))
    room = (base[1:] - base[:-1])[owner] - first
    at = (base[owner] + first)[:, None] + np.arange(WINDOW)
    ok = np.arange(WINDOW)[None, :] < room[:, None]
    return flat[np.minimum(at, len(flat) - 1)], ok, owner


def train(sample: list[tuple[str, int]], share: float) -> Network:
    """sample: (text, label) rows; share: of label 1 among all labelled rows."""
    rng = np.random.default_rng(SEED)
    split = [tokens(t) for t, _ in sample]
    label = np.array([y for _, y in sample], np.float32)
    seen = Counter(w for d in split for w in set(d))
    net = Network([w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:WORDS] if n > 2])
    if not len(label) or label.min() == label.max():
        net.scale, net.shift = 0.0, -40.0
        return net
    words = sorted(seen)
    row = {w: i for i, w in enumerate(words)}
    ids = [np.fromiter((row[w] for w in d), np.int64, len(d)) for d in split]
    starts = []
    for d in split:
        s = windows(len(d))
        starts.append(s if len(s) <= SAMPLE_WINDOWS else [s[k] for k in sorted(rng.choice(len(s), SAMPLE_WINDOWS, replace=False))])
    idx, ok, owner = layout(ids, starts)
    idx = idx.astype(np.int32)
    of = np.split(np.arange(len(owner)), np.cumsum([len(s) for s in starts])[:-1])
    toxic, clean = ([k for k in np.nonzero(label == y)[0] if len(of[k])] for y in (1, 0))
    if not toxic or not clean:
        net.scale, net.shift = 0.0, -40.0
        return net
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))

    def logits() -> np.ndarray:
        px = np.concatenate([net.inputs(words[k : k + 4096])[0] for k in range(0, len(words), 4096)])
        return np.concatenate([net.forward(px, idx[k : k + 2048], ok[k : k + 2048])[0] for k in range(0, len(idx), 2048)])

    best: np.ndarray | None = None
    for step in range(1, STEPS + 1):
        if step > 60 and step % 60 == 1:
            best = logits()
        some = np.concatenate((rng.choice(toxic, BATCH // 2), rng.choice(clean, BATCH // 2)))
        pick = np.array([of[k][np.argmax(best[of[k]])] if best is not None and (label[k] or rng.random() < 0.5) else rng.choice(of[k]) for k in some])
        y = label[some]
        used, local = np.unique(idx[pick], return_inverse=True)
        px, source = net.inputs([words[i] for i in used])
        at, valid = local.reshape(len(pick), WINDOW), ok[pick]
        logit, kept = net.forward(px, at, valid, keep=True)
        g = net.backward((1 / (1 + np.exp(-logit)) - y).astype(np.float32) / len(y), px, at, valid, kept, source)
        rate = RATE * min(1, 1.5 * (1 - step / (STEPS + 1)))
        for k, x in net.p.items():
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.002 * (g[k] * g[k] - v[k])
            x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.998**step)) + 1e-7)
    final = logits()
    known = np.array([k for k in range(len(sample)) if len(of[k])])
    top, y = np.array([final[of[k]].max() for k in known]), label[known]
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, len(y) - y.sum()))
    mid, width = top.mean(), top.std() + 1e-6
    x, a, b = (top - mid) / width, 1.0, float(np.log(share / (1 - share)))
    for _ in range(800):
        r = weight * (1 / (1 + np.exp(-np.clip(a * x + b, -40, 40))) - y)
        a, b = a - 4 * ((r * x).sum() + 0.001 * a), b - 4 * r.sum()
    net.scale, net.shift = float(a / width), float(b - a * mid / width)
    return net


class Scorer:
    """Scores texts with a trained network, remembering projected inputs of words."""

    def __init__(self, net: Network):
        self.net, self.row, self.px = net, {}, np.zeros((1024, 6 * HIDDEN), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        row = self.row
        try:
            return np.fromiter(map(row.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = list(dict.fromkeys(w for w in words if w not in row))
        n = len(row)
        if n + len(new) > len(self.px):
            self.px = np.concatenate((self.px, np.zeros((max(len(self.px), len(new)), 6 * HIDDEN), np.float32)))
        for k in range(0, len(new), 4096):
            self.px[n + k : n + k + len(new[k : k + 4096])] = self.net.inputs(new[k : k + 4096])[0]
        row.update((w, n + k) for k, w in enumerate(new))
        return np.fromiter(map(row.__getitem__, words), np.int64, len(words))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for k in range(0, len(texts), 64):
            if len(self.row) > CACHE:
                self.row, self.px = {}, np.zeros((1024, 6 * HIDDEN), np.float32)
            ids = [self.rows(tokens(t)) for t in texts[k : k + 64]]
            starts = [windows(len(d)) for d in ids]
            best = np.full(len(ids), -np.inf)
            idx, ok, owner = layout(ids, starts)
            for j in range(0, len(owner), 4096):
                part = slice(j, j + 4096)
                np.maximum.at(best, owner[part], self.net.forward(self.px, idx[part], ok[part])[0])
            full = best > -np.inf
            out[k : k + 64][full] = self.net.probability(best[full])
        return out


def fold_of(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def sample_of(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], float]:
    """The bounded training sample and the share of label 1 in the training folds."""
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .where((fold_of(F.col("doc_id")) != HELD_OUT) & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL")
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    order = W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = once.withColumn("upto", F.sum(F.octet_length("text")).over(order)).where(F.col("upto") <= MAX_BYTES).collect()
    rows.sort(key=lambda r: r["doc_id"])
    share = n.get(1, 0) / max(1, sum(n.values()))
    return [(r["text"], r["toxic"]) for r in rows], min(0.99, max(0.01, share))


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, text) to doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            score = scorer.score(batch.column("text").to_pylist())
            held = [zlib.crc32(str(i).encode()) % 4 == HELD_OUT if i is not None else None for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(*sample_of(docs, read_table(spark, sf_dir, "labels")))
    return score_documents(docs, net)
