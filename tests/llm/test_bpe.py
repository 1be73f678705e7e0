"""Byte-level BPE against the library that the vocabulary is for, and against its definition."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry_points
from resight.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def words():
    return bpe.BytePairs.read(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def ids(words, texts, **how):
    return [[i for part in parts for i in part] for parts in words.encoded(texts, **how)]


def plain(ranks, piece):
    """Merge the leftmost pair of the lowest rank until none is left; a whole token is itself."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_every_character_in_context(words, library):
    some = {*range(0x3100), *range(0x3100, 0x110000, 97), *[c for c in bpe.masks() if c % 7 == 0]}
    texts = [f"a{chr(c)} {chr(c)}b  {chr(c)}1{chr(c)}'s" for c in sorted(some) if not 0xD800 <= c < 0xE000]
    assert ids(words, texts) == [library.encode_ordinary(t) for t in texts]


def test_random_texts_whole_and_in_parts(words, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aabt  \n\t'sre1,é日🙂") for _ in range(rng.randrange(400))) for _ in range(600)]
    wanted = [library.encode_ordinary(t) for t in texts]
    assert ids(words, texts) == wanted
    for size in (1, 9, 100):
        assert ids(words, texts, size=size) == wanted


@pytest.mark.parametrize("text", ["a" * 70_001, " " * 30_000 + "x", "ab" * 40_000, "\n" * 999, "=-" * 5_000, "é" * 20_000])
def test_very_long_pre_tokens(words, library, text):
    assert ids(words, [text]) == [library.encode_ordinary(text)]


def test_a_vocabulary_whose_ranks_fall_after_a_merge():
    """Joined bytes may have a lower rank than the pair that made them possible, and pairs of one rank may overlap."""
    rng = random.Random(3)
    for _ in range(60):
        made = {"".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))).encode() for _ in range(12)}
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(rng.sample(sorted(made), len(made)))}
        words = bpe.BytePairs(ranks, r"[ab]+", long=10)
        pieces = list({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 25))) for _ in range(40)})
        wanted = [plain(ranks, p.encode()) for p in pieces]
        assert ids(words, pieces) == wanted
        assert [words.merged(p.encode()) for p in pieces] == wanted
        assert [np.frombuffer(x, "<u4").tolist() for x in words.merged_many([p.encode() for p in pieces if p.encode() not in ranks])] == [
            w for p, w in zip(pieces, wanted, strict=True) if p.encode() not in ranks
        ]
        assert words.queue.first() == -1 and not any(words.queue.low)


def test_queue_gives_lowest_rank_and_leftmost_place():
    rng = random.Random(8)
    queue = bpe.RankQueue(300_000)
    held = [(rng.randrange(300_000) if k % 3 else 77, k * 31 % 5003) for k in range(5000)]
    for rank, place in held:
        queue.push(rank, place)
    got = []
    while (rank := queue.first()) >= 0:
        got.append((rank, queue.leftmost(rank)))
    assert got == sorted(held)


def test_memory_of_two_generations_changes_nothing(library):
    words = bpe.BytePairs.read(PATH, PATTERN)
    words.remembered = 20
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(60)}x," for _ in range(30)) for _ in range(40)]
    assert [ids(words, [t])[0] for t in texts] == [library.encode_ordinary(t) for t in texts]
    assert len(words.young) < 100


def expected(library, text):
    own = library.encode_ordinary(text or "")
    return len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_rows(spark, documents, no_documents, odd_texts, library):
    got = bpe.round_trips(documents, PATH, PATTERN, ids=True).collect()
    wanted = sorted(((d, *expected(library, t)) for d, t in odd_texts), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == wanted
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    assert bpe.round_trips(no_documents, PATH, PATTERN).count() == 0
    carried = bpe.round_trips(documents, PATH, PATTERN, columns=("doc_id", "text", "block"))
    assert carried.columns == ["doc_id", "text", "block", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert carried.where("text is null and block = '?'").count() == 2


def test_a_text_of_many_parts_and_runs(spark, library, monkeypatch):
    rng = random.Random(1)
    long = " ".join(f"word{rng.randrange(10**5)}" for _ in range(150_000))
    rows = [(k, long[k : k + 400_000 * (k % 3)]) for k in range(5)] + [(9, long)]
    got = bpe.round_trips(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, PATTERN).collect()
    assert sorted(tuple(r) for r in got) == [(d, *expected(library, t)) for d, t in rows]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")
def test_query(spark, library):
    got = entry_points.queries()["op13_byte_bpe"](spark, FOLDER)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert sorted(tuple(r) for r in got.collect()) == sorted((d, *expected(library, t)) for d, t in texts.items())
