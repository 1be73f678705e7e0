"""Words and shingles of Arrow text columns as numpy arrays.

Arrow hands a batch of texts over as one UTF-8 buffer with bounds, so words are found and hashed for many
texts at once, without a Python object per word. Buffers are worked on in slices of about SLICE bytes (a
longer text is a slice of its own), which bounds the memory of a task whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: The white space that separates words: x20 and x09 to x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 2**64)
_PLACES = np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the bounds of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of texts of about `size` bytes together."""
    data, at = utf8(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text (and one past the last) the number of its first word.

    `apart` marks the bytes that stand between words; no word reaches over the end of a text.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~apart[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    heads = at[:-1][at[:-1] < at[1:]]
    opens[heads] = inside[heads]
    tails = at[1:][at[:-1] < at[1:]] - 1
    closes[tails] = inside[tails]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, at)


class _Powers:
    """Powers of the step and of its inverse modulo 2**64, as many as were ever asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, step in (("up", _STEP), ("down", _STEP_INVERSE)):
                powers = np.full(n, _U(step), np.uint64)
                powers[0] = 1
                setattr(cls, name, np.multiply.accumulate(powers))
        return cls.up[:n], cls.down[:n]


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and the number of each text's first word."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, at, apart)
    return hashed(low, starts, ends), first


def sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of equally long columns of hashes, depending on their order."""
    total = np.full(len(parts[0]), _U(len(parts)), np.uint64)
    for place, part in enumerate(parts):
        total += mixed(part ^ _PLACES[place % 64]) * _PLACES[(place * 7 + 3) % 64]
    return mixed(total)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, and the bounds of the texts among them.

    A text of fewer than `width` words has its whole sequence as its one shingle; a text without words none.
    """
    counts = np.diff(first)
    if len(hashes) >= width:
        last = len(hashes) - width + 1
        spread = [mixed(hashes ^ _PLACES[j]) * _PLACES[(j * 7 + 3) % 64] for j in range(width)]
        total = np.full(last, _U(width), np.uint64)
        for j in range(width):
            total += spread[j][j : j + last]
        rolled = mixed(total)
    else:
        rolled = np.zeros(0, np.uint64)
    found = []
    for i, n in enumerate(counts):
        a = first[i]
        if n >= width:
            found.append(np.unique(rolled[a : a + n - width + 1]))
        elif n:
            found.append(sequence_hash([hashes[a + j : a + j + 1] for j in range(n)]))
        else:
            found.append(rolled[:0])
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum([len(x) for x in found], out=bounds[1:])
    return (np.concatenate(found) if found else rolled[:0]), bounds
