"""Elias-Fano sequences and the levels of an n-gram trie made of them.

A monotone sequence of n numbers below u keeps log2(u/n) low bits of each number packed, and the high bits in
unary in a bit vector with a count of ones for every 64 bits. All operations work on arrays of queries.
"""

from __future__ import annotations

import mmap

import numpy as np

_U = np.uint64


def _ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).astype(np.int64)


class EliasFano:
    """Immutable; `raw` is a self-contained run of bytes that can be mapped from anywhere."""

    def __init__(self, raw):
        head = np.frombuffer(raw, np.int64, 4)
        self.n, self.low_bits, n_low, n_high = (int(x) for x in head)
        at = 32
        self._low = np.frombuffer(raw, np.uint8, n_low, at)
        at += n_low
        self._high = np.frombuffer(raw, np.uint64, n_high, at)
        at += 8 * n_high
        self._before = np.frombuffer(raw, np.uint32, n_high + 1, at)
        self.size = at + 4 * (n_high + 1)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        """Bytes of an ascending sequence of numbers below `universe`, padded to whole words."""
        n = len(values)
        low_bits = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
        values = values.astype(np.uint64)
        packed = np.zeros((n * low_bits + 7) // 8 + 8, np.uint8)
        if low_bits:
            step = 8 * 8192  # a whole number of bytes for any width
            for first in range(0, n, step):
                part = values[first : first + step]
                bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits]
                run = np.packbits(bits.ravel(), bitorder="little")
                packed[first * low_bits // 8 : first * low_bits // 8 + len(run)] = run
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)])
        high = (values >> _U(low_bits)).astype(np.int64) + np.arange(n)
        top = ((universe - 1) >> low_bits) + 1 if universe else 1
        words = np.zeros((n + top) // 64 + 1, np.uint64)
        if n:
            np.bitwise_or.at(words, high >> 6, _U(1) << (high & 63).astype(np.uint64))
        before = np.zeros(len(words) + 1, np.uint32)
        np.cumsum(_ones(words), out=before[1:])
        head = np.array([n, low_bits, len(packed), len(words)], np.int64)
        raw = head.tobytes() + packed.tobytes() + words.tobytes() + before.tobytes()
        return raw + b"\0" * (-len(raw) % 8)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """The place of the k-th (from 0) one or zero of the bit vector."""
        before = np.arange(len(self._before)) * 64 - self._before if zeros else self._before
        word = np.searchsorted(before, k, side="right") - 1
        left = k - before[word].astype(np.int64)
        bits = ~self._high[word] if zeros else self._high[word]
        place = word * 64
        for half in (32, 16, 8, 4, 2, 1):
            under = _ones(bits & _U((1 << half) - 1))
            over = left >= under
            left = np.where(over, left - under, left)
            bits = np.where(over, bits >> _U(half), bits)
            place = place + np.where(over, half, 0)
        return place

    def _lows(self, index: np.ndarray) -> np.ndarray:
        if self.low_bits == 0:
            return np.zeros(len(index), np.uint64)
        bit = index * self.low_bits
        byte = bit >> 3
        word = np.zeros(len(index), np.uint64)
        for k in range(8):
            word |= self._low[byte + k].astype(np.uint64) << _U(8 * k)
        return (word >> (bit & 7).astype(np.uint64)) & _U((1 << self.low_bits) - 1)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index, np.int64)
        high = (self._select(index, zeros=False) - index).astype(np.uint64)
        return (high << _U(self.low_bits)) | self._lows(index)

    def find(self, values: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Where each value stands, or -1; looked for among [first, end) only, if given."""
        values = values.astype(np.uint64)
        if self.n == 0 or len(values) == 0:
            return np.full(len(values), -1, np.int64)
        h = (values >> _U(self.low_bits)).astype(np.int64)
        zeros = len(self._high) * 64 - self.n
        inside = h + 1 <= zeros
        h = np.where(inside, h, 0)
        low = np.where(h > 0, self._select(np.maximum(h - 1, 0), zeros=True) - h + 1, 0)
        high = np.minimum(self._select(h, zeros=True) - h, self.n)
        if first is not None:
            low, high = np.maximum(low, first), np.minimum(high, end)
        high = np.where(inside, high, low)
        want = values & _U((1 << self.low_bits) - 1)
        stop = high.copy()
        # The first of the range whose low bits reach those looked for.
        while True:
            open_ = np.flatnonzero(low < high)
            if len(open_) == 0:
                break
            middle = (low[open_] + high[open_]) >> 1
            less = self._lows(middle) < want[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        found = np.flatnonzero(low < stop)
        out = np.full(len(values), -1, np.int64)
        hit = found[self._lows(low[found]) == want[found]]
        out[hit] = low[hit]
        return out


class Level:
    """One level of a trie: contexts, monotone pointers to their successors, the successors (each lifted by its
    context's number, so that the whole level ascends), and a value for each."""

    def __init__(self, raw: bytes):
        room = mmap.mmap(-1, max(1, len(raw)))
        room.write(raw)
        view = memoryview(room)
        width, bits = (int(x) for x in np.frombuffer(view, np.int64, 2))
        self.successor_bits, at = bits, 16
        parts = []
        for _ in range(3):
            parts.append(EliasFano(view[at:]))
            at += -(-parts[-1].size // 8) * 8
        self.contexts, self.pointers, self.successors = parts
        self.values = np.frombuffer(view, np.uint16 if width == 2 else np.uint32, self.successors.n, at)

    @staticmethod
    def encode(context: np.ndarray, successor: np.ndarray, values: np.ndarray, context_bits: int, successor_bits: int) -> bytes:
        """Bytes of a level; (context, successor) in ascending order, each once."""
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(context))))
        lifted = (number.astype(np.uint64) << _U(successor_bits)) | successor.astype(np.uint64)
        return b"".join(
            [
                np.array([values.dtype.itemsize, successor_bits], np.int64).tobytes(),
                EliasFano.encode(context[heads], 1 << context_bits),
                EliasFano.encode(np.append(heads, len(context)), len(context) + 1),
                EliasFano.encode(lifted, max(1, len(heads)) << successor_bits),
                values.tobytes(),
            ]
        )

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The place of each n-gram, or -1: its context's pointers bound the search for the successor."""
        own, which = np.unique(context, return_inverse=True)
        number = self.contexts.find(own)[which]
        known = np.flatnonzero(number >= 0)
        out = np.full(len(context), -1, np.int64)
        if len(known):
            n = number[known]
            lifted = (n.astype(np.uint64) << _U(self.successor_bits)) | successor[known].astype(np.uint64)
            out[known] = self.successors.find(lifted, self.pointers[n].astype(np.int64), self.pointers[n + 1].astype(np.int64))
        return out
