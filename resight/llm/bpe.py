"""Byte-level BPE by a rank queue under a hierarchical bitmap, and its decoding.

The bytes of pre-tokens are doubly linked lists of tokens. Every adjacent pair whose joined bytes are a token of the
vocabulary lies in the bucket of that token's rank, by the place of its left token. A bitmap of three levels marks
the buckets that hold something, so the lowest rank is three find-first-set steps away, however many ranks there
are. A merge writes the two new pairs into their buckets and leaves the old ones where they are: an entry whose
place has another rank by now is stale and skipped. Within a rank a pre-token's leftmost place goes first.

Long pre-tokens (over LONG bytes) go through the queue place by place: one of n bytes takes some n log n steps and a
few numbers a byte, also where it is megabytes long. Short ones of many texts share one list and one queue: pre-tokens
don't touch each other, so of a rank's bucket the leftmost place of each is merged at once by array operations.

Texts are cut before every space that something else than white space follows, since no match of the pattern
reaches over such a place; pieces recur, so a worker remembers the ids of the last ones it saw, in two generations.
Which characters are letters, numbers and white space differs by the Unicode version of the library that a pattern
runs in. The vocabulary's own library is asked, and characters that it classes otherwise are masked while a piece is
cut. A text of any length is hashed and decoded in parts of about PART characters (a piece without such a cut is a part
of its own).

Nulls are empty texts, which have no ids. Repeated rows and ties give equal rows. An empty table gives no rows.
Columns other than the named ones are not read, so any may be there.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters of a text that are worked on at a time, and of texts whose new pieces are encoded together.
PART, TOGETHER = 1 << 18, 8 << 20
#: Bytes from which a pre-token goes through the queue by itself.
LONG = 256
#: Pieces in one generation of a worker's memory.
REMEMBERED = 400_000
#: A space that does not end a run of white space before something else.
BLANKS = re.compile(r" (?!\S)")
CUT = re.compile(r"(?= \S)")


#: Classes of characters, and a character of each that no pattern names by itself; of none of them U+E000.
CLASSES = {r"\p{L}": "\u00e9", r"\p{N}": "\u00b2", r"\s": "\u2028"}


@lru_cache(maxsize=1)
def masks() -> dict[int, str]:
    """Characters that tiktoken's patterns class otherwise than `regex` does, each with one of the class it has there."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    found: dict[int, str] = {}
    for name, like in CLASSES.items():
        # What a pattern does not match is left out of the ids.
        theirs = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        there, here = set(theirs.decode(theirs.encode_ordinary(every))), set(regex.findall(name, every))
        found |= {ord(c): "\ue000" for c in here - there if ord(c) not in found} | {ord(c): like for c in there - here}
    return found


class RankQueue:
    """Buckets by rank; the lowest one that holds something is found by three steps through bitmaps."""

    def __init__(self, ranks: int):
        self.buckets: list[list | None] = [None] * ranks
        self.grown = bytearray(ranks)
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, places) -> None:
        bucket = self.buckets[rank]
        if bucket is not None:
            bucket.append(places)
            self.grown[rank] = 1
            return
        self.buckets[rank] = [places]
        word = rank >> 6
        if not self.low[word]:
            if not self.middle[word >> 6]:
                self.top |= 1 << (word >> 6)
            self.middle[word >> 6] |= 1 << (word & 63)
        self.low[word] |= 1 << (rank & 63)

    def first(self) -> int:
        """The lowest rank whose bucket holds something, or -1."""
        if not self.top:
            return -1
        word = (self.top & -self.top).bit_length() - 1
        bits = self.middle[word]
        word = word << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def clear(self, rank: int) -> None:
        self.buckets[rank] = None
        self.grown[rank] = 0
        word = rank >> 6
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.middle[word >> 6] &= ~(1 << (word & 63))
            if not self.middle[word >> 6]:
                self.top &= ~(1 << (word >> 6))

    def take(self, rank: int) -> list:
        """All that a bucket holds."""
        bucket = self.buckets[rank]
        self.clear(rank)
        return bucket

    def leftmost(self, rank: int) -> int:
        """The least place of a bucket, removed."""
        bucket = self.buckets[rank]
        if self.grown[rank]:
            bucket.sort(reverse=True)
            self.grown[rank] = 0
        place = bucket.pop()
        if not bucket:
            self.clear(rank)
        return place


class BytePairs:
    """A vocabulary of byte strings by rank, with the pattern that cuts texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED, long: int = LONG):
        self.ranks, self.remembered, self.long = ranks, remembered, long
        self.pattern, self.masks = regex.compile(pattern), masks()
        self.masked = set(map(chr, self.masks))
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.decimals = list(map(str, range(len(self.tokens))))
        self.queue = RankQueue(len(self.tokens))
        # Every pair of tokens whose joined bytes are a token, as one sorted number, and that token's rank.
        pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)
        # Ids of pieces as little-endian 32-bit bytes.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def read(path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as lines:
            return BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens, -1 where their bytes are no token."""
        if not len(self.pairs):
            return np.full(len(left), -1, np.int64)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], -1)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, place by place."""
        n, ranks, tokens, queue = len(piece), self.ranks, self.tokens, self.queue
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        start = self.bytes[np.frombuffer(piece, np.uint8)]
        ids, before, after = start.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        # The rank of the pair that begins at a place; -1: none, or its left token is gone.
        pair = [*self._ranks(start[:-1], start[1:]).tolist(), -1]
        for place, rank in enumerate(pair):
            if rank >= 0:
                queue.push(rank, place)
        while (rank := queue.first()) >= 0:
            place = queue.leftmost(rank)
            if pair[place] != rank:
                continue  # stale
            gone = after[place]
            follows, comes, token = after[gone], before[place], tokens[rank]
            ids[place], pair[gone], after[place] = rank, -1, follows
            pair[place] = ranks.get(token + tokens[ids[follows]], -1) if follows < n else -1
            if pair[place] >= 0:
                queue.push(pair[place], place)
            if follows < n:
                before[follows] = place
            if comes >= 0:
                pair[comes] = ranks.get(tokens[ids[comes]] + token, -1)
                if pair[comes] >= 0:
                    queue.push(pair[comes], comes)
        found, place = [], 0
        while place < n:
            found.append(ids[place])
            place = after[place]
        return found

    def merged_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids, as bytes, of each of many short pre-tokens, by one queue over all their bytes."""
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        n, queue = int(ends[-1]), self.queue
        owner = np.repeat(np.arange(len(pieces)), sizes)
        # One place more than there are bytes, which none is linked with: what is written to it is never read.
        ids = np.append(self.bytes[np.frombuffer(b"".join(pieces), np.uint8)], 0)
        before, after = np.arange(-1, n), np.arange(1, n + 2)
        before[ends - sizes], after[ends - 1], before[n], after[n] = n, n, n, n
        pair = np.full(n + 1, -1, np.int64)
        alive = np.ones(n, bool)

        def put(places: np.ndarray) -> None:
            """Find the ranks of the pairs that begin at places, and push them."""
            right = after[places]
            found = np.where((places < n) & (right < n), self._ranks(ids[places], ids[right]), -1)
            pair[places] = found
            places, found = places[found >= 0], found[found >= 0]
            if not len(places):
                return
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for rank, part in zip(found[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                queue.push(rank, part)

        put(np.arange(n))
        while (rank := queue.first()) >= 0:
            held = queue.take(rank)
            places = np.concatenate(held) if len(held) > 1 else held[0]
            places = places[pair[places] == rank]  # the others are stale
            if not len(places):
                continue
            places = np.unique(places)
            own = owner[places]
            leads = np.append(True, own[1:] != own[:-1])
            if not leads.all():
                queue.push(rank, places[~leads])
                places = places[leads]
            gone = after[places]
            follows, comes = after[gone], before[places]
            ids[places], pair[gone], alive[gone] = rank, -1, False
            after[places], before[follows] = follows, places
            put(places)
            put(comes[comes < n])
        left = np.flatnonzero(alive)
        bounds = (4 * np.searchsorted(left, np.append(0, ends))).tolist()
        flat = ids[left].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def pre_tokens(self, piece: str) -> list[str]:
        """The matches of the pattern."""
        if piece.isascii() or self.masked.isdisjoint(piece):
            return self.pattern.findall(piece)
        return [piece[slice(*m.span())] for m in self.pattern.finditer(piece.translate(self.masks))]

    def _pieces(self, part: str) -> list[str]:
        if BLANKS.search(part) is None:
            first, *rest = part.split(" ")
            return ([first] if first else []) + [" " + x for x in rest]
        return [x for x in CUT.split(part) if x]

    def _parts(self, text: str, size: int) -> Iterator[list[str]]:
        """Successive parts of a text, each as its pieces."""
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + size) if at + size < len(text) else None
            end = cut.start() if cut else len(text)
            yield self._pieces(text[at:end])
            at = end

    def learn(self, pieces: Iterable[str]) -> None:
        """Remember the ids of pieces: their pre-tokens that are new are encoded together."""
        if len(self.young) >= self.remembered:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, {}
        for x in pieces:
            if x in old:
                young[x] = old[x]
            elif x not in young:
                new[x] = self.pre_tokens(x)
        words = list({w for own in new.values() for w in own if w not in young and w not in old})
        raw = [w.encode() for w in words]
        short = [k for k, b in enumerate(raw) if len(b) <= self.long and b not in self.ranks]
        found = dict(zip(short, self.merged_many([raw[k] for k in short]), strict=True))
        for k, w in enumerate(words):
            young[w] = found[k] if k in found else np.array(self.merged(raw[k]), "<u4").tobytes()
        for x, own in new.items():
            if x not in young:
                young[x] = b"".join([young[w] if w in young else old[w] for w in own])

    def encoded(self, texts: list[str], size: int = PART) -> Iterator[Iterator[list[int]]]:
        """For each text the ids of its successive parts."""
        known = self.young if len(self.young) < self.remembered else {}
        self.learn({x for t in texts for own in self._parts(t, size) for x in own if x not in known})
        ids_of = self.young.__getitem__
        return ((np.frombuffer(b"".join(map(ids_of, own)), "<u4").tolist() for own in self._parts(t, size)) for t in texts)

    def decoded(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def written(self, ids: list[int]) -> bytes:
        """Ids as decimals with single spaces between."""
        return " ".join(map(self.decimals.__getitem__, ids)).encode()


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> BytePairs:
    """One for each worker process, which may run many tasks."""
    return BytePairs.read(path, pattern)


def _runs(texts: list[str], size: int) -> Iterator[list[str]]:
    """Successive texts of about `size` characters together."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def round_trips(documents: DataFrame, path: str, pattern: str, columns: tuple[str, ...] = ("doc_id",), text: str = "text", ids: bool = False) -> DataFrame:
    """The given columns and, of every whole text, n_tokens, ids_sha256 (hex of its decimal ids joined by one space)
    and decoded_sha256 (hex of the bytes that its ids decode to); with `ids` also `ids`, little-endian 32-bit bytes.

    path: a file of tokens and ranks that every executor can read, as installed beside the library that reads it.
    """
    columns = tuple(columns)
    own = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    own += [("ids", T.BinaryType(), pa.binary())] * ids
    schema = T.StructType([*documents.select(*columns).schema.fields, *[T.StructField(n, kind) for n, kind, _ in own]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            at = 0
            # The last column is the text; only a run of texts is held as Python strings at a time.
            for few in range(0, batch.num_rows, 4096):
                texts = [x or "" for x in batch.column(len(columns)).slice(few, 4096).to_pylist()]
                for some in _runs(texts, TOGETHER):
                    rows = []
                    for parts in words.encoded(some):
                        numbers, back, n, held = hashlib.sha256(), hashlib.sha256(), 0, []
                        for some_ids in parts:
                            numbers.update((b" " if n else b"") + words.written(some_ids))
                            back.update(words.decoded(some_ids))
                            n += len(some_ids)
                            if ids:
                                held.append(np.array(some_ids, "<u4").tobytes())
                        rows.append((n, numbers.hexdigest(), back.hexdigest(), b"".join(held)))
                    arrays = [batch.column(i).slice(at, len(rows)) for i in range(len(columns))]
                    arrays += [pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(own)]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                    at += len(rows)

    return documents.select(*columns, documents[text].alias("_text")).mapInArrow(run, schema)
