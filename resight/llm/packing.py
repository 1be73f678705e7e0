"""Token pieces and their packing into sequences by vector best-fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths, as
attention is masked to the piece). A piece goes to the open sequence that fits under every one of them and is
tightest by the chosen measure: the weighted dot product of the piece's and the sequence's remaining needs, or
the norm of what would remain. Pieces come longest first, so of the sequences that fit the fullest are tried.

Pieces are dealt by hash to runs of about `run` pieces, and each run is packed in its own task, so at most one
sequence a run is left loose, whatever the size of the table. Pieces that fill a sequence alone are not packed.

Nulls: a null text is an empty text, so its only token is the end. Repeated rows are packed like any others. An
empty table gives no pieces. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.llm.store import kept

TOKENS = 1024
#: Pieces that one task packs, about.
RUN = 6000
#: Chunks in one of the two generations that a worker remembers (some 80 MB each), and texts learned together.
REMEMBERED, TOGETHER = 400_000, 512
#: Chunks that a worker still remembers when its task is over: it may wait for long.
RESTING = 50_000
#: Chunks joined into one text for the tokenizer, and the most characters of such a chunk.
JOINED, SHORT = 4096, 64
#: A text can be cut before a single space that a word follows: pre-tokens never reach over it.
CUT = re.compile(r"(?= \S)")
#: A space that no word follows.
BLANKS = re.compile(r" (?!\S)")
#: Pre-tokens of one character that stand between others without a space: a stop after a Latin letter and before white
#: space or the end, and a line end between something else than white space and a Latin letter.
STOP = re.compile(r"([,.;:!?])(?<=[A-Za-zÀ-ÖØ-öø-ÿ].)(?=[ \n]|\Z)")
LINE = re.compile(r"\n(?<=\S\n)(?=[A-Za-zÀ-ÖØ-öø-ÿ])")
MARK = "\0"
#: How a byte-level vocabulary writes a space.
SPACE = "\u0120"


class _Memory(dict):
    """Ids of chunks. A chunk that is asked for and not known has an empty run of bytes, to be filled: all that were
    handed out stand in `new`."""

    def __init__(self, old: dict[str, bytes]):
        super().__init__()
        self.old = old
        self.new: dict[str, bytearray] = {}

    def __missing__(self, chunk: str) -> bytes | bytearray:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.new[chunk] = bytearray()
        self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids of texts as little-endian 32-bit bytes. Chunks between cuts recur: those of many texts that are new are
    encoded together, each once, and the last ones met are remembered in two generations of `remembered`.

    A chunk is named by what follows the space that it begins with, or by MARK and itself if it begins without one.
    Short ones that hold no other space are encoded as one text, whose tokens that begin with a space begin a chunk.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        assert array("I").itemsize == 4 and sys.byteorder == "little"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        words = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(words.values()) + 1, bool)
        self.leads[[i for word, i in words.items() if word[:1] == SPACE]] = True
        self.remembered = remembered
        self.young = _Memory({})

    def _chunks(self, text: str) -> list[str] | None:
        """The names of a text's chunks; None for a text that is not cut."""
        # A special token that holds a space, or text that it is found in, is not cut.
        if MARK in text or any(t in text for t in self.whole):
            return None
        # Every space before a word: the common case. Stops and single line ends after words are chunks, too.
        if BLANKS.search(text) is None:
            text = STOP.sub(" \0\\1", text)
            if "\n" in text:
                text = LINE.sub(" \0\n \0", text)
            first, *rest = text.split(" ")
        else:
            first, *rest = CUT.split(text)
            rest = [x[1:] for x in rest]
        return [MARK + first, *rest] if first else rest

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield array("I", found.ids).tobytes()

    def _joined(self, chunks: list[str]) -> Iterator[bytes]:
        """The ids of chunks that hold no space but their first."""
        for first in range(0, len(chunks), JOINED):
            own = chunks[first : first + JOINED]
            (ids,) = self._encoded([" " + " ".join(own)])
            starts = (4 * np.flatnonzero(self.leads[np.frombuffer(ids, "<u4")])).tolist()
            for _, a, b in zip(own, starts, [*starts[1:], len(ids)], strict=True):
                yield ids[a:b]

    def _learn(self, memory: _Memory) -> None:
        """Fill what was handed out."""
        joined = [c for c in memory.new if len(c) <= SHORT and " " not in c and c[0] != MARK]
        others = [c for c in memory.new if len(c) > SHORT or " " in c or c[0] == MARK]
        for chunks, found in ((joined, self._joined(joined)), (others, self._encoded([c[1:] if c[0] == MARK else " " + c for c in others]))):
            for chunk, ids in zip(chunks, found, strict=True):
                memory.new[chunk][:] = ids
                memory[chunk] = ids
        memory.new.clear()

    def rest(self, most: int = RESTING) -> None:
        """Forget all but the chunks met first, the frequent ones among them."""
        few = _Memory({})
        few.update(islice(self.young.items(), most))
        self.young = few

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        if len(self.young) >= self.remembered:
            self.young.old = {}
            self.young = _Memory(self.young)
        known = self.young.__getitem__
        parts = [None if chunks is None else list(map(known, chunks)) for chunks in map(self._chunks, texts)]
        self._learn(self.young)
        for text, own in zip(texts, parts, strict=True):
            if own is None:
                yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                yield b"".join(own)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for each worker process, which may run many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, tokens: int, ids_too: bool, short_first: bool = False) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(path)
    stop = np.array([end], dtype="<u4").tobytes()
    for batch in batches:
        names, texts = batch.column(0), batch.column(1)
        for first in range(0, batch.num_rows, TOGETHER):
            rows: list[tuple] = []
            own = texts.slice(first, TOGETHER).to_pylist()
            for doc, ids in zip(names.slice(first, TOGETHER).to_pylist(), encoder.ids([t or "" for t in own]), strict=True):
                ids += stop
                # With the short piece first, the first cut lies so that all after it are full.
                early = -len(ids) % (4 * tokens) if short_first else 0
                for piece, a in enumerate(range(-early, len(ids), 4 * tokens)):
                    part = ids[max(a, 0) : a + 4 * tokens]
                    rows.append((doc, piece, max(a, 0) // 4, len(part) // 4, zlib.crc32(part), part if ids_too else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + ids_too], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids_too])
    encoder.rest()


def token_pieces(documents: DataFrame, tokenizer: str, end: int = 2, tokens: int = TOKENS, ids: bool = False, short_first: bool = False) -> DataFrame:
    """Pieces of at most `tokens` ids of every text and its end: doc_id, piece, start, length, ids_crc32, and
    with `ids` the ids themselves as little-endian 32-bit bytes. Only a longer text is cut: all its pieces are full
    but the last one or, with `short_first`, the first one."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return documents.select("doc_id", "text").mapInArrow(lambda b: _pieces(b, tokenizer, end, tokens, ids, short_first), schema)


def best_fit(
    lengths: np.ndarray,
    tokens: int = TOKENS,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.25),
    measure: str = "dot",
) -> np.ndarray:
    """The bin of each piece; lengths in descending order. No bin is over any capacity.

    `dot` takes the bin of the smallest weighted product of the piece's share of each capacity with the bin's
    remaining share (the most used one in the dimensions that the piece needs most), `norm` the smallest
    weighted Euclidean norm of what remains after the piece. Ties go to the older bin.
    """
    n = len(lengths)
    most = np.array([tokens, documents or n + 1, attention or tokens * tokens], dtype=float)
    w = np.asarray(weights, dtype=float)
    placed = np.empty(n, np.int64)
    # Open bins as columns: tokens, documents and attention left, and the bin's number.
    left, names, size, made = np.empty((3, n)), np.empty(n, np.int64), 0, 0
    shortest = float(lengths[-1]) if n else 0.0
    for i, length in enumerate(lengths.astype(float)):
        need = np.array([length, 1.0, length * length])
        if (need > most).any():
            raise ValueError("a piece is over the capacity of an empty sequence; cut pieces shorter")
        now = left[:, :size]
        fit = np.flatnonzero((now[0] >= need[0]) & (now[1] >= need[1]) & (now[2] >= need[2]))
        if len(fit):
            part = now[:, fit]
            if measure == "dot":
                score = (w * need / most / most) @ part
            else:
                score = w @ np.square((part - need[:, None]) / most[:, None])
            at = fit[int(np.argmin(score))]
            left[:, at] -= need
            placed[i] = names[at]
            if left[0, at] < shortest or left[1, at] < 1:  # closed: nothing fits any more
                size -= 1
                left[:, at], names[at] = left[:, size], names[size]
        else:
            placed[i] = made
            if most[0] - need[0] >= shortest and most[1] >= 2:
                left[:, size], names[size] = most - need, made
                size += 1
            made += 1
    return placed


def pack(
    pieces: DataFrame,
    tokens: int = TOKENS,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.25),
    measure: str = "dot",
    run: int = RUN,
) -> DataFrame:
    """pieces (with doc_id, piece, length) with the sequence_id and offset of each.

    Other columns are carried along. Numbers of sequences are unique, not consecutive.
    """
    schema = pieces.schema
    loose = pieces.where(F.col("length") < tokens)
    runs = max(1, -(-loose.count() // run))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part["_run"].iloc[0])
        part = part.drop(columns="_run").sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        part["sequence_id"] = best_fit(part["length"].to_numpy(), tokens, documents, attention, weights, measure) + (number << 32)
        part["offset"] = part.groupby("sequence_id")["length"].cumsum() - part["length"]
        return part

    out = schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"
    dealt = loose.withColumn("_run", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(runs)))
    packed = dealt.groupBy("_run").applyInPandas(solve, out)
    alone = pieces.where(F.col("length") >= tokens)
    # Full pieces: one number each, by run, below zero so that none is met twice.
    number = -(F.monotonically_increasing_id() + 1)
    return packed.unionByName(alone.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long")))


def packed_documents(documents: DataFrame, tokenizer: str, end: int = 2, tokens: int = TOKENS, short_first: bool = False) -> DataFrame:
    """Pieces of all documents with their places, tokenised once."""
    return pack(kept(token_pieces(documents, tokenizer, end, tokens, short_first=short_first), "pieces"), tokens)
