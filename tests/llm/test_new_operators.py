"""Codes, decontamination and resampling against plain versions."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from ombrage.llm import decontamination, importance_sampling, vector_codes

from .helpers import empty, odd

# ── Vector codes ─────────────────────────────────────────────────────────────

VECTORS = "vec_id long, embedding array<double>, label int, code string"


def plain_codes(rows):
    """The contract with Python's integers, a row at a time."""
    kept = [(i, [math.floor(4096 * x) if abs(x) < 1e15 else int(x) * 4096 for x in v], y) for i, v, y, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1]) // 8
    cut = lambda v: [tuple(v[p * dim : p * dim + dim]) for p in range(8)]
    parts = [cut(v) for _, v, _ in kept]
    books = [[parts[k][p] for k in range(min(16, len(parts)))] for p in range(8)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, part: min(range(len(books[p])), key=lambda e: (away(books[p][e], part), e))
    for _ in range(6):
        new = [list(b) for b in books]
        for p in range(8):
            of = collections.defaultdict(list)
            for v in parts:
                of[best(p, v[p])].append(v[p])
            for e, members in of.items():
                new[p][e] = tuple(sum(c) // len(members) for c in zip(*members, strict=True))
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    codes = [[best(p, v[p]) for p in range(8)] for v in parts]
    errors = [sum(away(books[p][c[p]], v[p]) for p in range(8)) for c, v in zip(codes, parts, strict=True)]
    by_label = collections.Counter()
    for (_, _, y), e in zip(kept, errors, strict=True):
        by_label[y] += e
    return sorted((str(i), "".join(f"{x:02x}" for x in c), e, by_label[y], digest) for (i, _, y), c, e in zip(kept, codes, errors, strict=True))


def codes(spark, rows):
    got = vector_codes.with_label_errors(vector_codes.compress(spark.createDataFrame(rows, VECTORS)))
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect())


@pytest.mark.parametrize("scale", [1.0, 30.0, 1e5, 1e11])
def test_codes_of_every_magnitude(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=16) * (scale if scale < 1e9 or k % 7 == 0 else 1)], [None, 1, 2][k % 3], "x") for k, i in enumerate(rng.permutation(60))]
    got, want = codes(spark, rows), plain_codes(rows)
    cap = vector_codes.LONGEST
    assert got == [(i, c, min(e, cap), got[k][3] if y > cap else y, d) for k, (i, c, e, y, d) in enumerate(want)]
    if scale < 1e9:
        assert got == want


def test_codes_of_odd_rows(spark):
    one = [0.5, -0.5] * 4
    rows = [(1, None, 1, "x"), (2, one, None, "x"), (2, one, None, "x"), (3, [None, *one[1:]], 1, "x"), (4, [math.nan, *one[1:]], 1, "x"), (5, [math.inf, *one[1:]], 1, "x"), (None, one[::-1], 3, "x")]
    assert codes(spark, rows) == plain_codes(rows)
    assert [c[0] for c in codes(spark, [*rows, (9, [1.0], 1, "x"), (10, [], 1, "x")])] == ["2", "2", "None"]
    assert codes(spark, [(1, [], 1, "x")])[0][1:4] == ("00" * 8, 0, 0)
    short = codes(spark, [(1, [1.0, 2.0, 3.0], 1, "x"), (2, [1.0, 2.0, 4.0], 1, "x")])
    assert [c[1:3] for c in short] == [("00" * 8, 0), ("00" * 2 + "01" + "00" * 5, 0)]
    assert codes(spark, []) == [] and codes(spark, rows[:1]) == []


def test_tensors_beyond_a_long():
    near = np.array([[1 << 61]]), np.array([3])
    total = vector_codes.merged(vector_codes.merged(near, near), near)
    assert int(total[0][0, 0]) == 3 << 61 and total[1].tolist() == [9]


def test_vector_query_over_many_blocks(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = sorted(map(str, vector_codes.query(spark, sf).collect()))
    rows = [(r["vec_id"], r["embedding"], r["label"], "") for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert want == sorted(f"Row(vec_id={i}, code='{c}', error={e}, label_error={y}, codebooks_sha256='{d}')" for i, c, e, y, d in plain_codes(rows))


# ── Decontamination ──────────────────────────────────────────────────────────


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(docs, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[x]
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def hits(spark, docs, items, **k):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = decontamination.decontaminate(d, b, **k).collect()
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got)


def passages():
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(12)]
    say = lambda n: " ".join(rng.choice(words, n))
    items = [(k, say(int(rng.integers(8, 60)))) for k in range(60)] + [(None, say(15)), (7, say(4)), (7, say(1) + " zz"), (99, "W1, É-w2 w3"), (100, None), (101, " -- "), (102, items_of := say(300)), (103, items_of)]
    docs = [(k, f"{say(30)} {items[k % len(items)][1] or ''}, {say(40)}") for k in range(200)] + [(500, items_of.upper()), (500, items_of.upper()), (None, None), (501, ""), (502, "w1 É w2\tW3"), (503, "x " * 30_000 + items_of)]
    return docs, items


def test_hits_against_every_window(spark):
    docs, items = passages()
    assert hits(spark, docs, items) == plain_hits(docs, items)
    assert hits(spark, docs, []) == plain_hits(docs, [])
    assert hits(spark, [], items) == []


def test_hits_in_slices_and_pieces(spark, monkeypatch):
    docs, items = passages()
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 25)
    want = plain_hits(docs, items)
    assert hits(spark, docs, items) == want
    assert hits(spark, docs, items, slice_words=900) == want


def test_hits_of_odd_rows(spark):
    table = decontamination.decontaminate(odd(spark), odd(spark).withColumnRenamed("doc_id", "item_id"))
    assert table.count() == odd(spark).count() and decontamination.decontaminate(empty(spark), empty(spark).withColumnRenamed("doc_id", "item_id")).count() == 0


def test_shifts_skip_and_buckets_confirm():
    search = decontamination.Search([("1", b"a b c d e f g h i j k")])
    patterns = search.of[10]
    read = []
    patterns.shift = type("Counted", (dict,), {"get": lambda self, *a: read.append(a) or dict.get(self, *a)})(patterns.shift)
    assert list(patterns.places([0] * 900)) == [] and len(read) == 99
    ids = [search.ids[bytes([w])] for w in b"abcdefghijk"]
    assert [start for start, _ in patterns.places([*ids[:9], 0, *ids, 0])] == [10, 11]


# ── Importance resampling ────────────────────────────────────────────────────


def plain_sample(docs, target, runs):
    feats = lambda t: [" ".join(w[k : k + n]) for w in [plain_words(t)] for n in range(1, runs + 1) for k in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (collections.Counter(bucket(f) for text in texts for f in feats(text)) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        fs = feats(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = k
    return sorted(map(str, (r[:5] for r in rows)))


@pytest.mark.parametrize("runs", [1, 3])
def test_sample_against_plain_version(spark, monkeypatch, runs):
    monkeypatch.setattr(importance_sampling, "NODES", 40)
    rng = np.random.default_rng(2)
    words = [f"Wörd{k}" for k in range(30)] + ["a", "B1"]
    docs = [(k, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for k in range(300)] + [(5, "a " * 25), (5, "a " * 25), (5, "b " * 30), (None, "c-d " * 40), (None, None), (400, ""), (401, "é " * 20_000)]
    target = ["wörd1 a a b1", None, "", "Wörd2 wörd1"]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    got = importance_sampling.resample(d, spark.createDataFrame([(t, 1) for t in target], "text string, rank int"), runs=runs)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in got.collect()) == plain_sample(docs, target, runs)


def test_sample_of_odd_and_empty_tables(spark):
    got = importance_sampling.resample(odd(spark), empty(spark))
    assert got.count() == odd(spark).count()
    assert importance_sampling.resample(empty(spark), odd(spark)).count() == 0
