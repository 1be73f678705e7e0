"""Near-duplicates against all pairs of full shingle sets."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm.conftest import sentence, spaced_words
from resight.llm import graph, minhash


def shingle_set(text):
    w = spaced_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    """Smallest id that links lead to, by comparing all pairs of named rows."""
    named = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in named}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(named):
        for j, b in named[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                one, two = sorted((top(i), top(j)))
                parent[two] = one
    return {i: top(i) for i in parent}


def check(df, rows):
    got = minhash.near_duplicates(df).collect()
    want = classes(rows)
    assert len(got) == len(rows)
    sizes = sorted((r.doc_id or -1, r.n_shingles) for r in got)
    assert sizes == sorted((i or -1, len(shingle_set(t))) for i, t in rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_odd_texts(documents, odd_texts):
    check(documents, odd_texts)


def test_chains_and_groups_around_the_threshold(spark):
    rng = random.Random(3)
    rows, base = [], sentence(rng, 200, 5000).split()
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    chain = sentence(rng, 150, 5000).split()
    for i in range(100, 120):
        rows.append((i, " ".join(chain)))
        chain[(i * 7) % 150] = f"c{i}"
        chain[(i * 11) % 150] = f"d{i}"
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_a_doc_id_with_several_texts_loses_no_link(spark):
    rng = random.Random(8)
    rows = []
    for k in range(12):
        # Texts near a hub that is smaller than all of them lead to no leader of their own.
        words = sentence(rng, 120, 5000).split()
        for copy in range(4):
            changed = list(words)
            for place in range(copy):
                changed[40 * place + copy] = f"n{k}-{copy}-{place}"
            rows.append((rng.choice((1, 2, 500, 1000 + 10 * k + copy)), " ".join(changed)))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


NEAR = "bucket long, node long, n long, c long, sketch array<long>, bands array<long>"


def crowd(nodes, buckets, changed):
    """Rows of NEAR: sketches of one base with some bits of their own, each node in some of the buckets."""
    rng = np.random.default_rng(17)
    words = 2 * minhash.FINE // 32
    base = rng.integers(0, 2, words * 64, dtype=np.uint8)
    rows = []
    for node in range(nodes):
        bits = base.copy()
        bits[rng.integers(0, len(bits), int(rng.integers(0, changed)))] ^= 1
        sketch = np.packbits(bits, bitorder="little").view(np.int64).tolist()
        own = sorted(rng.choice(buckets, int(rng.integers(1, buckets + 1)), replace=False).tolist())
        bands = None if node % 11 == 0 else [b if b in own else 1000 * (node + 1) + b for b in range(buckets)]
        for bucket in own:
            rows.append((bucket, node, 100 + node % 40, node - node % 3, sketch, bands))
    return rows


def near_by_bits(rows, percent=75):
    """All pairs of rows, bit by bit."""
    least = int((percent / 100 - minhash.MARGIN + (1 - percent / 100 + minhash.MARGIN) / 4) * 2 * minhash.FINE)
    half = len(rows[0][4]) // 2
    found = Counter()
    for k, (bucket, one, n, c, s, e) in enumerate(rows):
        for other_bucket, other, m, d, t, f in rows[:k]:
            if bucket == other_bucket and c != d and 100 * n >= percent * m and 100 * m >= percent * n:
                apart = [(s[i] ^ t[i]) | (s[i + half] ^ t[i + half]) for i in range(half)]
                same = sum(64 - (x & (2**64 - 1)).bit_count() for x in apart)
                if same >= least and (not e or not f or min(set(e) & set(f)) == bucket):
                    found[min(one, other), max(one, other)] += 1
    return found


@pytest.mark.parametrize("size", [5, 60, 1000])
def test_near_pairs_in_parts_are_all_pairs(spark, size):
    rows = crowd(90, 4, 700)
    want = near_by_bits(rows)
    assert 200 < len(want) < 3500
    got = minhash.near_pairs(spark.createDataFrame(rows, NEAR).repartition(3), 75, size).collect()
    assert Counter((r.a, r.b) for r in got) == want


def test_near_pairs_of_groups_over_several_batches():
    rows = sorted(crowd(60, 3, 700))
    whole = pa.table({k: pa.array([r[i] for r in rows]) for i, k in enumerate(("bucket", "node", "n", "c", "sketch", "bands"))})
    for k in ("low", "high", "part"):
        whole = whole.append_column(k, pa.array(np.zeros(len(rows), np.int64)))
    want = near_by_bits(rows)
    for batch in (1, 7, 1000):
        found = Counter()
        for r in minhash._near(iter(whole.to_batches(batch)), 75):
            found.update(zip(r.column("a").to_pylist(), r.column("b").to_pylist(), strict=True))
        assert found == want
    assert list(minhash._near(iter([]), 75)) == []


def test_no_group_holds_a_large_bucket_and_every_two_rows_meet_once(spark):
    rows = [(b, i, 100, i, [i], None) for b, n in ((1, 400), (2, 30), (3, 1)) for i in range(n)]
    got = minhash.in_parts(spark.createDataFrame(rows, NEAR), 50).collect()
    groups = {}
    for r in got:
        assert r.part in (r.low, r.high) and r.low <= r.high
        groups.setdefault((r.bucket, r.low, r.high), []).append(r)
    assert max(map(len, groups.values())) <= 4 * 50
    met = Counter()
    for (bucket, low, high), g in groups.items():
        met.update((bucket, min(x.node, y.node), max(x.node, y.node)) for k, x in enumerate(g) for y in g[:k] if low == high or x.part != y.part)
    assert met == Counter({(b, i, j): 1 for b, n in ((1, 400), (2, 30), (3, 1)) for j in range(n) for i in range(j)})


def test_a_bucket_of_distant_near_copies_takes_seconds(spark):
    # Two million pairs, not near: as a join of the bucket with itself they took 82 seconds.
    rng = np.random.default_rng(3)
    rows = [(1, i, 100, i, rng.integers(-(2**63), 2**63, 2 * minhash.FINE // 32).tolist(), [1]) for i in range(2000)]
    members = spark.createDataFrame(rows, NEAR).localCheckpoint()
    began = time.monotonic()
    assert minhash.near_pairs(members).count() == 0
    assert time.monotonic() - began < 30


def test_a_band_takes_different_functions():
    functions = minhash.BANDS * minhash.ROWS // 2
    plain = minhash.band_keys(np.zeros((1, 2 * functions), np.uint32), minhash.BANDS, minhash.ROWS)
    for f in range(functions):
        other = np.zeros((1, 2 * functions), np.uint32)
        other[0, [f, functions + f]] = 1
        assert (minhash.band_keys(other, minhash.BANDS, minhash.ROWS) != plain).sum() == 2


def test_no_documents(no_documents):
    assert minhash.near_duplicates(no_documents).count() == 0


def test_signature_is_an_unbiased_estimate():
    rng = np.random.default_rng(5)
    common, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    sets = [np.unique(np.concatenate([common, x])) for x in (one, two)]
    signed = minhash.minmax(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), 1000)
    assert (signed[0] == signed[1]).mean() == pytest.approx(600 / 800, abs=0.04)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    parent = {}

    def top(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            one, two = sorted((top(a), top(b)))
            parent[two] = one
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: top(i) for i in parent}
