"""The trie's sequences, and scores against counting in dictionaries."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import spaced_words
from resight.llm import ngram_lm, queries
from resight.llm.elias_fano import EliasFano, Level
from resight.llm.labelled import held_out


@pytest.mark.parametrize(("n", "universe"), [(0, 100), (1, 1), (5, 7), (1000, 1 << 40), (60_000, 70_000)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
    sequence = EliasFano(EliasFano.encode(values, universe))
    assert (sequence[np.arange(len(values))] == values).all()
    asked = np.concatenate([values, rng.integers(0, universe, 500, dtype=np.uint64)])
    place = {int(v): i for i, v in enumerate(values)}
    assert [int(x) for x in sequence.find(asked)] == [place.get(int(v), -1) for v in asked]


def test_level_searches_within_a_context():
    rng = np.random.default_rng(1)
    grams = np.unique(np.stack([rng.integers(0, 50, 4000), rng.integers(0, 1 << 32, 4000)], 1).astype(np.uint64), axis=0)
    raw = Level.encode(grams[:, 0], grams[:, 1], np.arange(len(grams), dtype=np.uint32), 40, 32)
    level = Level(raw)
    assert (level.find(grams[:, 0], grams[:, 1]) == np.arange(len(grams))).all()
    assert (level.find((grams[:, 0] + np.uint64(1)) % np.uint64(60), grams[:, 1]) == -1).all()
    assert len(raw) < 9 * len(grams)


def test_ascending():
    rng = np.random.default_rng(2)
    for most in (3, 1 << 10, 1 << 32):
        context, successor = (rng.integers(0, most, 5000).astype(np.uint64) for _ in range(2))
        order = ngram_lm._ascending(context, successor)
        want = np.lexsort((successor, context))
        assert sorted(order) == list(range(5000))
        assert (context[order] == context[want]).all() and (successor[order] == successor[want]).all()


def brute(rows, order, prior):
    texts = [(d, spaced_words(t)) for d, t in rows]
    out_of = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts]
    counts = [Counter() for _ in range(order + 1)]
    for (_, w), h in zip(texts, out_of):
        if not h:
            s = ["<s>", *w, "</s>"]
            for n in range(1, order + 1):
                counts[n].update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    tokens = sum(c for g, c in counts[1].items() if g != ("<s>",))
    types = len(counts[1]) - (("<s>",) in counts[1])
    found = []
    for (d, w), h in zip(texts, out_of):
        s = ["<s>", *w, "</s>"]
        base = score = 0.0
        for i in range(1, len(s)):
            p = (counts[1][s[i],] + 1) / (tokens + types + 1)
            base += math.log10(p)
            for n in range(2, min(order, i + 1) + 1):
                p = (counts[n][tuple(s[i - n + 1 : i + 1])] + prior * p) / (counts[n - 1][tuple(s[i - n + 1 : i])] + prior)
            score += math.log10(p)
        found.append((d or -1, h, len(w) + 1, sum(counts[1][x,] > 0 for x in s[1:]), tokens, base, score))
    return sorted(found)


@pytest.mark.parametrize("order", [2, 3])
def test_scores(documents, odd_texts, monkeypatch, order):
    monkeypatch.setattr(ngram_lm, "SHARD", 400)
    got = ngram_lm.scored(documents, held_out(F.col("doc_id"), 7, 2), order=order, prior=5.0).collect()
    got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    want = brute(odd_texts, order, 5.0)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert abs(g[6] - w[6]) <= 2e-3 * g[2]


def test_the_query_asks_trigrams(spark, tmp_path):
    # All words and bigrams of the last text were seen, of its trigrams one was not.
    texts = ["a b c", "d b e", *["x y"] * 3]
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    out = next(i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [*zip(ids, texts), (out, "a b e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op2_lm_scores(spark, str(tmp_path)).collect()}
    for d, _, n, _, _, _, score in brute(rows, 3, 100.0):
        assert abs(got[d] - score) <= 2e-3 * n
    assert abs(got[out] - next(r[6] for r in brute(rows, 2, 100.0) if r[0] == out)) > 2e-3 * 4


def test_no_documents(no_documents):
    assert ngram_lm.scored(no_documents, held_out(F.col("doc_id"), 7, 2)).count() == 0


def test_codes():
    counts = np.array([0, 1, 2, 3, 10, 1000, 10**9])
    assert ngram_lm.decoded(ngram_lm.coded(counts)) == pytest.approx(counts, rel=3e-4)


def test_scores_of_a_block_take_little_memory():
    import tracemalloc

    n, rng = 1_000_000, np.random.default_rng(5)
    words, codes = np.sort(rng.integers(1, 2**64, 30_000, dtype=np.uint64)), (rng.zipf(1.3, n) % 30_000).astype(np.uint32)
    starts = np.arange(0, n + 1, 500)
    answers = {(1, 0): ngram_lm.packed(rng.integers(1, 99, len(words)).astype(np.uint32))}
    for level, (context, *_) in enumerate(ngram_lm.Block(words, codes, starts).levels(3), 2):
        answers[level, 0] = ngram_lm.packed(ngram_lm.coded(rng.integers(1, 99, len(context))))
    tracemalloc.start()
    try:
        ngram_lm._block_scores(words, codes, starts, answers, 3, [1, 1, 1], 10**6, len(words), 100.0)
        assert tracemalloc.get_traced_memory()[1] < 110 * n
    finally:
        tracemalloc.stop()
