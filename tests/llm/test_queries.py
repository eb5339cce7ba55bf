"""Queries without SQL against plain versions, over whole small tables."""

import collections
import hashlib
import heapq
import re
import struct
import zlib

import numpy as np
import pytest

from ombrage.llm import piece_coding, secret_scan, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_sharding_query(spark, texts):
    got = {r["doc_id"]: r for r in sharding.query(spark, SF).collect()}
    sizes = {i: len(t.encode()) + 8 for i, t in texts.items()}
    assert {i: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for i, r in got.items()} == {i: (sizes[i], zlib.crc32(t.encode()), "bytes", None) for i, t in texts.items()}
    slots, shards, load = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for i, r in got.items():
        slots[r["shard"]].append(r["slot"])
        shards[texts[i]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert all(len(s) == 1 for s in shards.values())
    groups = collections.Counter()
    for i, t in texts.items():
        groups[t] += sizes[i]
    heap = [0] * 24
    for n in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + n)
    assert sorted(load.values()) == sorted(n for n in heap if n)


def test_secret_query(spark, texts):
    plain = {
        "assign": (re.compile("(?i:(password|passwd|secret|token|api_?key))[\"\']? *[:=] *[\"\']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    for r in secret_scan.query(spark, SF).collect():
        text = texts[r["doc_id"]]
        found = [(m.start(), k, kind, m.end()) for k, (kind, (rx, fine)) in enumerate(plain.items()) for m in rx.finditer(text) if fine(m)]
        base = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[2] == kind for f in found) for kind in plain]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("token:")] == base and len(spans) == len(base) + r["n_token"]
        for s in spans:  # token spans are whole runs apart from base spans
            kind, a, b = s.split(":")
            if kind == "token":
                assert re.fullmatch("[A-Za-z0-9+/_=-]{16,}", text[int(a) : int(b)]) and not any(int(a) < f[3] and f[0] < int(b) for f in found)


def test_simhash_query(spark, texts):
    import xxhash

    def print_of(text):
        words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: print_of(t) for i, t in texts.items()}
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in prints:
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", root(i)) for i, p in prints.items()}


def test_piece_query(spark, texts):
    lib = piece_coding.coder(piece_coding.MODEL).lib
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piece_coding.query(spark, SF).collect()}
    for i, t in texts.items():
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert got[i] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert len(got) == len(texts)


def test_toxicity_query(spark):
    """Held-out rows whose text no training row has, against their labels, some of which
    are given at random: toxic ones that no word tells, and the reverse."""
    sf = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in toxicity.query(spark, sf).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    assert {i: r["held_out"] for i, r in got.items()} == held
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    trained = {docs[i] for i in label if i in docs and not held[i]}
    test = [i for i in label if i in docs and held[i] and docs[i] not in trained]
    bad, good = ([got[i]["score"] for i in test if label[i] == y] for y in (1, 0))
    assert len(bad) > 90 and len(good) > 600
    assert np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad]) > 0.9


def test_sample_is_bounded_and_ignores_other_columns(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "word " * 50) for k in range(100)] + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 1, "x") for k in range(100)] + [(1, 0, 0, "y"), (None, 1, 0, "z"), (5, None, 0, "z"), (500, 1, 1, "z")], "doc_id long, toxic int, quality int, text string")
    sample, share = toxicity.sample_of(docs, labels)
    known = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert len(sample) == len(known) and sum(y for _, y in sample) == sum(k % 2 for k in known) and 0.3 < share < 0.7
    monkeypatch.setattr(toxicity, "MAX_BYTES", 1000)
    assert len(toxicity.sample_of(docs, labels)[0]) == 8
