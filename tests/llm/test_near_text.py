import collections

import numpy as np
import pyarrow as pa
import pytest

from ombrage.llm import near_text as N
from ombrage.llm.common import shared_dir

from .helpers import ODD, empty, odd


def words(rng, n):
    return ["w" + "".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n)]


def test_recall_and_precision(spark):
    """Copies with one word in forty changed are found, other texts left alone."""
    shared_dir(spark)
    rng = np.random.default_rng(5)
    data, want = [], {}
    for g in range(60):
        base = words(rng, 240)
        for c in range(3):
            text = list(base)
            for at in rng.choice(240, c, replace=False):
                text[at] = "changed" + str(c)
            want[len(data)] = g * 3
            data.append((len(data), " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[i] // 3 == i // 3 for i in got)
    assert sum(got[i] == want[i] for i in got) > 0.97 * len(got)


def edges_of(batches):
    return {tuple(r) for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}


def joined(n, edges):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[root(a)] = root(b)
    return [root(i) for i in range(n)]


def crowds():
    """Sketches of three crowds of near ones and of strays."""
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, (3, N.WORDS64), dtype=np.uint64)
    bits = np.stack([centres[k % 3] for k in range(700)])
    for k in range(700):
        for b in rng.choice(64 * N.WORDS64, int(rng.integers(0, 12)), replace=False):
            bits[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return np.concatenate((bits, rng.integers(0, 1 << 63, (20, N.WORDS64), dtype=np.uint64)))


@pytest.mark.parametrize(("crowd", "bucket", "carry", "pairs"), [(10**6, 10**6, 50_000, 64), (10**6, 10**6, 90, 8), (10**6, 30, 90, 8), (5, 2048, 50_000, 64), (5, 30, 90, 8)])
def test_groups_have_all_near_pairs(monkeypatch, crowd, bucket, carry, pairs):
    """Keys of crowds and strays, in sorted batches: groups are those of all pairs, or, where
    crowds are grouped unseen, unions of these."""
    for name, value in (("CROWD", crowd), ("BUCKET", bucket), ("CARRY", carry), ("PAIRS", pairs), ("SLICE", 200)):
        monkeypatch.setattr(N, name, value)
    bits = crowds()
    n = len(bits)
    nodes = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array([b""] * n, pa.binary())], ["node", "sketch", "bands"])
    rows = sorted(r for b in N.emit_keys(iter([nodes])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    batch = lambda part: N.keyed(*(np.array(c) for c in zip(*part, strict=True)))
    often = collections.Counter(r[0] for r in rows)
    met = [r for b in N.shared_variants(batch(rows[at : at + 7000]) for at in range(0, len(rows), 7000)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(met) == [r for r in rows if often[r[0]] > 1]
    full = (batch(part).append_column("sketch", pa.array([bits[r[1]].tobytes() for r in part], pa.binary())) for part in (met[at : at + 5000] for at in range(0, len(met), 5000)))
    found = edges_of(N.verify(full))
    want, got = (groups(joined(n, e)) for e in ([(i, j) for i in range(n) for j in range(i) if N.near(bits[i], bits[j])], found))
    assert all(any(w <= g for g in got) for w in want) and len(found) < 30 * n
    if crowd == bucket == 10**6:
        assert got == want and all(N.near(bits[a], bits[b]) for a, b in found)


def groups(roots):
    out = collections.defaultdict(set)
    for i, r in enumerate(roots):
        out[r].add(i)
    return {frozenset(s) for s in out.values()}


def test_odd_rows(spark):
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(odd(spark)).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[5] == got[6] == 5
    kept = N.drop_near_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in kept.collect()) == [(False, None), *((True, i) for i in (1, 4, 5, 7, 8, 9, 10))]
    assert N.near_duplicates(empty(spark)).count() == 0 and len(ODD) == odd(spark).count()


def test_linked_at_the_limit_and_not_below(spark):
    """Pairs at 0.8 to 0.85 are linked, pairs at 0.7 to just below 0.8 aren't."""
    rng = np.random.default_rng(8)
    data, similar = [], []
    for g in range(240):
        base = words(rng, 240)
        for c in range(2):
            text = list(base)
            # A block of k words changed alters k + 4 of 236 shingles.
            text[100 : 100 + c * (18 + g % 17)] = words(rng, c * (18 + g % 17))
            data.append((len(data), " ".join(text)))
        a, b = (set(N.shingle_hashes(t).tolist()) for _, t in data[-2:])
        similar.append(len(a & b) / len(a | b))
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    linked = [got[2 * g + 1] == 2 * g for g in range(240)]
    assert sum(s >= 0.8 for s in similar) > 40 and sum(s < 0.8 for s in similar) > 100
    assert not any(on for on, s in zip(linked, similar, strict=True) if s < 0.8)
    assert all(on for on, s in zip(linked, similar, strict=True) if s >= 0.8)


def loose(n):
    """A loose group: sets of one base, of similarities around the limit, in chains."""
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = []
    for _ in range(n):
        keep = rng.random(len(base)) > rng.choice([0.02, 0.1, 0.15])
        sets.append(np.unique(np.concatenate((base[keep], rng.integers(0, 1 << 63, int(rng.integers(0, 30)), dtype=np.uint64)))))
    same = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    return sets, groups(joined(n, [(i, j) for i in range(n) for j in range(i) if same(sets[i], sets[j])]))


def test_exact_groups_against_all_pairs():
    sets, want = loose(150)
    bits = np.stack([np.frombuffer(N.sketch_of(x), "<u8") for x in sets])
    assert groups(N.exact_roots(bits, sets)) == want and len(want) > 1
    known = [0, *range(1, 149), 0]  # of the first and the last it is known
    assert groups(N.exact_roots(bits, sets, known)) == groups(joined(150, [(0, 149), *((min(g), x) for g in want for x in g)]))


def test_large_groups_in_blocks_against_all_pairs(spark, monkeypatch):
    shared_dir(spark)
    sets, want = loose(150)
    rows = [(5, 8, i, N.sketch_of(x), x.tobytes()) for i, x in enumerate(sets)]
    monkeypatch.setattr(N, "BLOCK_ROWS", 20)
    got = N.link_large(spark.createDataFrame(rows, "group long, blocks int, node long, sketch binary, shingles binary")).collect()
    assert groups(joined(150, [(r["node"], r["root"]) for r in got])) == want


def test_all_steps_with_small_blocks(spark, monkeypatch):
    """A crowd of near copies dealt into blocks, with chains that leave it."""
    shared_dir(spark)
    monkeypatch.setattr(N, "BLOCK_ROWS", 12)
    rng = np.random.default_rng(4)
    base, data = words(rng, 240), []
    for k in range(120):
        text = list(base)
        for at in rng.choice(240, int(rng.integers(0, 10)), replace=False):
            text[at] = f"other{k}"
        data.append((k, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    sets = [set(N.shingle_hashes(t).tolist()) for _, t in data]
    want = joined(120, [(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert groups([got[i] for i in range(120)]) == groups(want) and 1 < len(groups(want)) < 120


def test_pages_of_a_template_part(spark, monkeypatch):
    """Pages of one template at similarity 0.5 to 0.66, all of one group by their bands: no
    page is dealt out to pairs of blocks, and near copies among them are linked."""
    shared_dir(spark)
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    dealt = []
    link = N.link
    monkeypatch.setattr(N, "link", lambda rows, *task: dealt.append(rows.count()) or link(rows, *task))
    rng = np.random.default_rng(12)
    template = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for n in (300, 600):
        sets = [np.unique(np.concatenate((template, rng.integers(0, 1 << 63, int(rng.integers(52, 100)), dtype=np.uint64)))) for _ in range(n)]
        sets += [np.unique(np.concatenate((x[: int(0.95 * len(x))], rng.integers(0, 1 << 63, 9, dtype=np.uint64)))) for x in sets[:20]]
        rows = spark.createDataFrame([(i, N.sketch_of(x), len(x), x.tobytes()) for i, x in enumerate(sets)], "node long, sketch binary, size long, shingles binary")
        dealt.clear()
        got = {r["node"]: r["root"] for r in N.link_crowds(rows).collect()}
        want = joined(n + 20, [(i, j) for i in range(n, n + 20) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))])
        assert sorted(map(want.count, want))[-40:] == [2] * 40 and len(set(want)) == n
        assert groups(joined(n + 20, list(got.items()))) == groups(want)
        assert sum(dealt) <= 60


def test_sets_at_the_limit_share_a_rare_shingle():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 5, N.COUNTERS)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        k = int(rng.integers(0, len(base) + 1)) // 5
        a, b = base[: len(base) - k], base[int(rng.integers(0, k + 1)) :]
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) and len(a) and len(b):
            assert len(np.intersect1d(N.rarest(a, counts), N.rarest(b, counts)))


def test_chain_in_a_crowded_bucket():
    """A near B, B near C, A not near C, among more than PAIRS copies of A."""
    flips = N.LIMIT - 5
    a = np.zeros(64 * N.WORDS64, np.uint8)
    b, c = a.copy(), a.copy()
    b[96 : 96 + flips] = 1
    c[96 : 96 + 2 * flips] = 1
    rows = [np.packbits(x, bitorder="little").tobytes() for x in [a] * (N.PAIRS + 6) + [b, c]]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([False] * len(rows)), pa.array(rows, pa.binary())], ["variant", "node", "crowd", "sketch"])
    assert len(groups(joined(len(rows), edges_of(N.verify(iter([batch])))))) == 1
