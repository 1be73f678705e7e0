"""Packing: exact pieces, no capacity broken, close to the bound."""

import random
import zlib

import numpy as np
import pytest

from resight.llm import packing
from resight.llm.queries import op4_packing, tokenizer_path

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_chunks_give_the_ids_of_whole_texts(tokenizer, odd_texts):
    encoder = packing.ChunkEncoder(tokenizer_path())
    tricky = ["a  b", " a", "a \n b", "\n\n x", "x \t y", "  ", "a ", "\x1c b", "a  \n  b   c", "it's 's", "é  ñ’s\r\n 12 3", " <|endoftext|> x y", "x  y", "a  b"]
    tricky += ["a, b.c d.", "a., b", "a,\nb\n\nc", "1, 2.", "日, 本.", "a\u00a0, b", "\0a \0, b", "a\n\u0301b", "x!\r\ny", "Dr. É. é: ñ; ß?", ",a ,b", "a,", "\na\nb.\n"]
    rng = random.Random(4)
    tricky += ["".join(rng.choice("aéZ1 .,;\n'日") for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts = [*tricky, *[t for _, t in odd_texts if t]]
    for some in (texts, texts[::-1]):
        for text, got in zip(some, encoder.ids(some), strict=True):
            assert got == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:40]


def test_a_small_memory_changes_nothing(tokenizer):
    encoder = packing.ChunkEncoder(tokenizer_path(), remembered=10)
    for k in range(50):
        text = " ".join(f"w{j * k % 37}, x" for j in range(30))
        assert list(encoder.ids([text])) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_new_chunks_are_encoded_together(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "JOINED", 100)
    encoder, asked = packing.ChunkEncoder(tokenizer_path()), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    texts = [" ".join(f"w{k * 7 + j}é\n{j}" for j in range(300)) + " " + "y" * 5000 + "." for k in range(4)]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(encoder.ids(texts)) == want
    assert len(asked) < 30
    asked.clear()
    assert list(encoder.ids(texts)) == want
    assert not asked


def test_a_worker_at_rest_remembers_little(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing.ChunkEncoder.rest, "__defaults__", (20,))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["the a", " ".join(f"q{k}" for k in range(500))])], names=["doc_id", "text"])
    made = [list(packing._pieces(iter([batch]), tokenizer_path(), 2, 1024, False)) for _ in range(2)]
    memory = packing.encoder_of(tokenizer_path()).young
    assert len(memory) <= 20 and not memory.old
    assert made[0] == made[1]


def test_pieces_and_places(documents, odd_texts, tokenizer):
    rows = packing.packed_documents(documents, tokenizer_path()).collect()
    texts = {}
    for doc, text in odd_texts:
        texts.setdefault(doc, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])
    made = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for doc, all_ids in texts.items():
        for ids in all_ids:
            for k, a in enumerate(range(0, len(ids), 1024)):
                part = ids[a : a + 1024]
                want.append((doc or -1, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert made == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 1024) + 2


def test_only_the_first_piece_of_the_query_is_shorter(spark, tokenizer, tmp_path):
    # One token a word, and the end: under, at and over the bounds, and several pieces.
    texts = {n: " ".join(["the"] * n) for n in (0, 1, 1022, 1023, 1024, 2047, 2048, 2600, 5000)}
    rows = [*texts.items(), (-1, None), (2600, texts[2600])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = op4_packing(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024


@pytest.mark.parametrize("measure", ["dot", "norm"])
def test_every_capacity_is_kept(measure):
    lengths = np.sort(np.random.default_rng(2).integers(1, 700, 3000))[::-1]
    bins = packing.best_fit(lengths, 1024, documents=3, attention=600_000, measure=measure)
    assert np.bincount(bins, lengths).max() <= 1024
    assert np.bincount(bins).max() <= 3
    assert np.bincount(bins, lengths.astype(float) ** 2).max() <= 600_000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([900]), attention=100)


def test_close_to_the_bound():
    lengths = np.sort(np.random.default_rng(3).integers(1, 1024, 6000))[::-1]
    bins = packing.best_fit(lengths)
    assert bins.max() + 1 <= 1.02 * lengths.sum() / 1024


def test_no_documents(no_documents):
    assert packing.packed_documents(no_documents, tokenizer_path()).count() == 0
