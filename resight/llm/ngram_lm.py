"""N-gram language model in an Elias-Fano trie, dealt out by n-gram.

Training counts all n-grams up to `order` of all training texts; nothing is pruned. The trie is cut into shards
by a hash of the whole n-gram, so no context, however frequent, lies in one shard. A shard's level holds its
contexts, monotone pointers to their successors and the successors as Elias-Fano sequences, and for each n-gram
its relative frequency as a 16-bit logarithm (counts of single words are kept exactly); it is mapped into memory
and asked for n-grams by context-relative search. Probabilities are smoothed towards the shorter context,

    P(w | c) = (n(c w) + prior * P(w | shorter c)) / (n(c) + prior),   P(w) = (n(w) + 1) / (N + V + 1).

Texts are worked on in blocks of about BLOCK bytes. A block counts its n-grams once and sends every distinct one
to its shard; the shard adds up the blocks' counts, builds its level, looks up what each block holds, and sends
the codes back. So what travels is distinct n-grams of blocks, not tokens, and no task or the driver holds the
model. Blocks are found anew on the way back; they carry a digest, and a block without its answers is an error.

Nulls are empty texts of only an end. Held-out texts are scored, and never counted. An empty table gives an
empty result. Repeated rows are texts like others. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.llm import text as tx
from resight.llm.elias_fano import Level
from resight.llm.store import kept

BLOCK = 12 << 20
#: Distinct n-grams of a shard and level, about.
SHARD = 1_000_000
#: Codes of a block that are smoothed together.
PART = 1 << 18
CONTEXT_BITS, SUCCESSOR_BITS = 40, 32
_U = np.uint64
BEGIN, END = _U(0x1234567890ABCDEF), _U(0xFEDCBA0987654321)
#: Codes of log10 counts: 0 is none, and 1 stands for a count of one.
STEPS_A_DECADE = 4000


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes in planes (all lowest bytes, then the next ones), compressed."""
    raw = b"".join(np.array([len(a), a.dtype.itemsize], np.int64).tobytes() + a.view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), codec="zstd", asbytes=True)
    at, out = 0, []
    while at < len(raw):
        n, width = (int(x) for x in np.frombuffer(raw, np.int64, 2, at))
        planes = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}"))
        at += 16 + n * width
    return out


@dataclass
class Block:
    """Texts as codes into the block's sorted words, each text between BEGIN and END."""

    words: np.ndarray
    codes: np.ndarray
    starts: np.ndarray  # of the texts among the codes, and one past the last

    @staticmethod
    def of(data: np.ndarray, at: np.ndarray) -> Block:
        # Words are hashed slice by slice, so that little is in memory at once.
        texts, first = len(at) - 1, 0
        parts, counts = [], []
        while first < texts:
            last = max(first + 1, int(np.searchsorted(at, at[first] + tx.SLICE, side="right")) - 1)
            h, f = tx.words(data[at[first] : at[last]], at[first : last + 1] - at[first])
            parts.append(h)
            counts.append(np.diff(f))
            first = last
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(counts + 2)])
        sequence = np.empty(int(starts[-1]), np.uint64)
        marks = np.ones(len(sequence), bool)
        marks[starts[:-1]] = marks[starts[1:] - 1] = False
        sequence[marks] = hashes
        sequence[starts[:-1]], sequence[starts[1:] - 1] = BEGIN, END
        del hashes, parts, marks
        words, codes = np.unique(sequence, return_inverse=True)
        return Block(words, codes.astype(np.uint32), starts)

    def of_text(self) -> np.ndarray:
        """The number of the text of every code."""
        return np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))

    def levels(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For lengths 2 to order: contexts and successors of the distinct n-grams as hashes, the n-gram of each
        code (or -1), the n-gram of the level below that is each one's context, and its last word."""
        text, size = self.of_text(), len(self.words)
        below, context_hash = self.codes, self.words
        for length in range(2, order + 1):
            inside = np.append(np.zeros(length - 1, bool), text[length - 1 :] == text[: len(text) - length + 1])
            key = below[np.flatnonzero(inside) - 1].astype(np.int64)
            key *= size
            key += self.codes[inside]
            key, inverse = np.unique(key, return_inverse=True)
            ids = np.full(len(self.codes), -1, np.int32)
            ids[inside] = inverse
            context, last = key // size, key % size
            del key, inverse, inside
            yield context_hash[context], self.words[last], ids, context, last
            context_hash = tx.mixed(context_hash[context] * _U(0x9E3779B97F4A7C15) + self.words[last])
            below = ids


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _gram_shard(context: np.ndarray, successor: np.ndarray, shards: int) -> np.ndarray:
    return _shard_of(tx.mixed(context * _U(0xD6E8FEB86659FD93) + successor), shards)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str, Block]]:
    for first, last, data, at in tx.slices(batch.column("text"), BLOCK):
        ids = ",".join(map(str, batch.column("doc_id").slice(first, last - first).to_pylist()))
        name = hashlib.sha256(ids.encode() + b"\0" + at.tobytes() + data.tobytes()).hexdigest()
        yield first, last, name[:32], Block.of(data, at)


def _sent(batches: Iterator[pa.RecordBatch], order: int, shards: list[int]) -> Iterator[pa.RecordBatch]:
    """(level, shard, block, grams): the distinct n-grams of each block with their training counts."""
    for batch in batches:
        held = batch.column("held").to_numpy(zero_copy_only=False)
        for first, last, name, block in _blocks(batch):
            trained = ~held[first:last][block.of_text()]
            rows = []
            counts = np.bincount(block.codes[trained], minlength=len(block.words)).astype(np.uint32)
            shard = _shard_of(block.words, shards[0])
            edges = np.searchsorted(shard, np.arange(shards[0] + 1))
            for s in np.unique(shard):
                part = slice(edges[s], edges[s + 1])
                rows.append((1, int(s), name, packed(block.words[part], counts[part])))
            for level, (context, successor, ids, _, _) in enumerate(block.levels(order), 2):
                counts = np.bincount(ids[trained & (ids >= 0)], minlength=len(context)).astype(np.uint32)
                by, edges = _by_shard(context, successor, shards[level - 1])
                for s in range(shards[level - 1]):
                    own = by[edges[s] : edges[s + 1]]
                    if len(own):
                        rows.append((level, s, name, packed(*_keys(context[own], successor[own]), counts[own])))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["level", "shard", "block", "grams"])


def _by_shard(context: np.ndarray, successor: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams by shard and context, and the edges of the shards in it."""
    shard = _gram_shard(context, successor, shards)
    by = np.lexsort((context, shard))
    return by, np.searchsorted(shard[by], np.arange(shards + 1))


def _keys(context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """40 bits of ascending contexts as steps of 32 and 8, and 32 of the successor; the shard was chosen by others."""
    step = np.diff(context >> _U(24), prepend=_U(0))
    return (step >> _U(8)).astype(np.uint32), (step & _U(255)).astype(np.uint8), (successor >> _U(32)).astype(np.uint32)


def _ascending(context: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """The order by context (40 bits), then successor (32 bits): by 64 bits at once, then the few that these leave open."""
    key = (context << _U(24)) | (successor >> _U(8))
    order = np.argsort(key)
    key, low = key[order], successor[order] & _U(255)
    new = key[1:] != key[:-1]
    open_ = ~new & (low[1:] != low[:-1])
    if open_.any():
        run = np.concatenate([[0], np.cumsum(new)])
        several = np.zeros(int(run[-1]) + 1, bool)
        several[run[1:][open_]] = True
        at = np.flatnonzero(several[run])
        order[at] = order[at][np.lexsort((low[at], key[at]))]
    return order


def coded(counts: np.ndarray) -> np.ndarray:
    """16-bit codes of log10 counts."""
    code = 1 + np.rint(np.log10(np.maximum(counts, 1)) * STEPS_A_DECADE)
    return np.where(counts > 0, np.minimum(code, 65535), 0).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10 ** ((codes.astype(float) - 1) / STEPS_A_DECADE), 0.0)


def _answered(part: pd.DataFrame) -> pd.DataFrame:
    """Builds the level of a shard from all its blocks and answers each block's n-grams with it."""
    level, shard = int(part["level"].iloc[0]), int(part["shard"].iloc[0])
    asked = [unpacked(x) for x in part["grams"]]
    if level == 1:
        keys = [(np.zeros(len(a), np.uint64), a) for a, _ in asked]
        bits = (1, 64)
    else:
        keys = [(np.cumsum((a.astype(np.uint64) << _U(8)) | b, dtype=np.uint64), c) for a, b, c, _ in asked]
        bits = (CONTEXT_BITS, SUCCESSOR_BITS)
    counts = np.concatenate([x[-1] for x in asked])
    asked.clear()
    seen = np.flatnonzero(counts)
    context, successor = (np.concatenate([k[i] for k in keys]).astype(np.uint64, copy=False)[seen] for i in (0, 1))
    order = np.argsort(successor) if level == 1 else _ascending(context, successor)
    context, successor, counts = context[order], successor[order], counts[seen[order]].astype(np.int64)
    del seen, order
    heads = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])])) if len(counts) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts, heads) if len(heads) else counts
    context, successor = context[heads], successor[heads]
    if level == 1:
        # A 64-bit word is its own sequence: the upper half is its context, the lower its successor.
        context, successor, bits = successor >> _U(32), successor & _U(0xFFFFFFFF), (32, 32)
        keys = [(k >> _U(32), k & _U(0xFFFFFFFF)) for _, k in keys]
    values = total.astype(np.uint32) if level == 1 else coded(total)
    trie = Level(Level.encode(context, successor, values, *bits))
    rows = []
    for (c, s), name in zip(keys, part["block"], strict=True):
        at = trie.find(c, s.astype(np.uint64, copy=False))
        rows.append((level, shard, name, packed(np.where(at >= 0, trie.values[at], 0).astype(values.dtype) if len(values) else np.zeros(len(c), values.dtype)), 0, 0))
    if level == 1:
        words = (context << _U(32)) | successor
        tokens = words != BEGIN
        rows.append((0, shard, "", b"", int(total[tokens].sum()), int(tokens.sum())))
    return pd.DataFrame(rows, columns=["level", "shard", "block", "answer", "tokens", "types"])


def _coded_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, name, block in _blocks(batch):
            ids = batch.column("doc_id").slice(first, last - first)
            held = batch.column("held").slice(first, last - first)
            one = pa.array([0, last - first], pa.int32())
            texts = packed(block.words, block.codes, block.starts.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, held), pa.array([texts], pa.binary())], names=["block", "ids", "held", "texts"]
            )


def _block_scores(words: np.ndarray, codes: np.ndarray, starts: np.ndarray, answers: dict[tuple[int, int], bytes], order: int, shards: list[int], tokens: int, types: int, prior: float) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score and score of each text of a block."""
    block = Block(words, codes, starts.astype(np.int64))
    edges = np.searchsorted(_shard_of(words, shards[0]), np.arange(shards[0] + 1))
    counts = np.zeros(len(words), np.int64)
    for s in range(shards[0]):
        if edges[s] < edges[s + 1]:
            (counts[edges[s] : edges[s + 1]],) = unpacked(answers[1, s])
    token = np.ones(len(codes), bool)
    token[block.starts[:-1]] = False
    text = block.of_text()
    logs = np.log10((counts + 1) / (tokens + types + 1))
    n = len(starts) - 1
    base = np.bincount(text[token], logs[codes[token]], n)
    known = np.bincount(text[token], counts[codes[token]] > 0, n).astype(np.int64)
    del logs
    p = ((counts + 1) / (tokens + types + 1))[codes]
    before = counts.astype(float)
    for level, (context, successor, ids, own, _) in enumerate(block.levels(order), 2):
        by, cut = _by_shard(context, successor, shards[level - 1])
        value = np.zeros(len(context))
        for s in range(shards[level - 1]):
            if cut[s] < cut[s + 1]:
                value[by[cut[s] : cut[s + 1]]] = decoded(unpacked(answers[level, s])[0])
        del context, successor, by
        for first in range(0, len(ids), PART):
            at = first + np.flatnonzero(ids[first : first + PART] >= 0)
            gram = ids[at]
            p[at] = (value[gram] + prior * p[at]) / (np.maximum(before[own[gram]], value[gram]) + prior)
        before = value
    score = np.bincount(text[token], np.log10(p[token]), n)
    return np.bincount(text[token], minlength=n), known, base, score


def scored(documents: DataFrame, held_out, order: int = 2, prior: float = 100.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    held_out: a condition on the rows; those that meet it are not counted. documents must give the same rows in
    the same batches when read twice, as a table does.
    """
    rows = documents.select("doc_id", "text", held_out.alias("held"))
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    # Shards by a bound on distinct n-grams: a token takes some six bytes.
    shards = [max(1, size // 24 // SHARD), *[max(1, size // 6 // SHARD)] * (order - 1)]
    sent = rows.mapInArrow(lambda b: _sent(b, order, shards), "level int, shard int, block string, grams binary")
    answered = kept(
        sent.groupBy("level", "shard").applyInPandas(_answered, "level int, shard int, block string, answer binary, tokens long, types long"), "answers"
    )
    stats = answered.where("level = 0").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(stats[0] or 0), int(stats[1] or 0)
    blocks = rows.mapInArrow(_coded_blocks, "block string, ids array<long>, held array<boolean>, texts binary")
    by_block = answered.where("level > 0").groupBy("block").agg(F.collect_list(F.struct("level", "shard", "answer")).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, held, texts, answers = (batch.column(c)[k] for c in ("ids", "held", "texts", "answers"))
                if not answers.is_valid:
                    raise ValueError("a block of texts was not counted: the documents changed between two readings")
                own = {(a["level"].as_py(), a["shard"].as_py()): a["answer"].as_py() for a in answers}
                found = _block_scores(*unpacked(texts.as_py()), own, order, shards, tokens, types, prior)
                n = len(ids)
                names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                yield pa.RecordBatch.from_arrays([ids.values, held.values, pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(np.full(n, tokens), pa.int64()), pa.array(found[2]), pa.array(found[3])], names=names)

    joined = blocks.join(by_block, "block", "left").select("ids", "held", "texts", "answers")
    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
