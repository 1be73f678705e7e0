"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its character n-grams (SHORTEST to LONGEST code points, A-Z and the Latin-1 capitals
lower-cased, white space as a blank, a blank before and after the text). From labelled texts come, for every
n-gram, the numbers of toxic and of other texts that hold it, and the logarithm of the ratio of its smoothed
shares in both. A held n-gram has that ratio as its feature value, and a regularised logistic regression on
these values weighs them anew. The n-grams with the clearest difference, `features` of them, are kept.

An n-gram is named by a 64-bit hash of its code points, each of which has a number of its own in every script, so a
batch is scanned with array operations, and hits are looked up by the whole hash.

Nulls are empty texts; empty texts have the score of a text without any kept n-gram. Without labels of both
kinds every score is the prior (0.5 if there are no labels at all). Repeated rows score alike. Columns other
than doc_id and text of documents, and doc_id and the target of labels, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resight.llm import text as tx
from resight.llm.labelled import labelled_texts
from resight.llm.store import kept

SHORTEST, LONGEST = 3, 6
FIT_ROWS = 16_000
FEATURES = 6_000
_U = np.uint64


def _folded() -> np.ndarray:
    fold = np.arange(1024, dtype=np.uint64)
    fold[ord("A") : ord("Z") + 1] += 32
    fold[0xC0:0xDF] += 32
    fold[0xD7] = 0xD7
    fold[[9, 10, 11, 12, 13, 0x85, 0xA0]] = 32
    return fold


#: The numbers of the first code points, after folding.
_CODES = tx.mixed(_folded() + _U(1))
_STEP = _U(0x9E3779B97F4A7C15)


def _codes(points: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point, the same for those that are folded into one."""
    high = np.flatnonzero(points >= len(_CODES))
    codes = _CODES[np.minimum(points, len(_CODES) - 1)]
    codes[high] = tx.mixed(points[high].astype(np.uint64) + _U(1))
    return codes


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all code points with a blank around each text, and the bounds of the texts."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(at) - 1
    bounds = lead[at]
    out = np.full(len(points) + 2 * n, _CODES[32], np.uint64)
    out[np.arange(len(points)) + 2 * np.repeat(np.arange(n), np.diff(bounds)) + 1] = _codes(points)
    return out, bounds + 2 * np.arange(n + 1)


def ngrams(chars: np.ndarray, length: int) -> np.ndarray:
    """The hash of the n-gram that begins at each character; none begins at the last ones of an array."""
    size = max(0, len(chars) - length + 1)
    key = np.full(size, _U(length), np.uint64)
    for k in range(length):
        key *= _STEP
        key += chars[k : k + size]
    return key


def _inside(bounds: np.ndarray, length: int, size: int) -> np.ndarray:
    """Whether an n-gram that begins at each character ends in the same text."""
    good = np.ones(size, bool)
    for back in range(1, length):
        edge = bounds[1:] - back
        good[edge[(edge >= 0) & (edge < size)]] = False
    return good


@dataclass
class Linear:
    """Sorted hashes of n-grams with their ratio and weight; `weight` already holds the ratio."""

    grams: np.ndarray
    weight: np.ndarray
    bias: float
    _maybe: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self._maybe = np.zeros(1 << 20, bool)
        self._maybe[self._slot(self.grams)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _U(0xD6E8FEB86659FD93)) >> _U(44)

    def held(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, gram) of every kept n-gram in every text, each once."""
        chars, bounds = characters(data, at)
        pairs = []
        for length in range(SHORTEST, LONGEST + 1):
            keys = ngrams(chars, length)
            where = np.flatnonzero(self._maybe[self._slot(keys)] & _inside(bounds, length, len(keys)))
            found = np.searchsorted(self.grams, keys[where])
            found[found == len(self.grams)] = 0
            same = self.grams[found] == keys[where] if len(self.grams) else np.zeros(len(where), bool)
            rows = np.searchsorted(bounds, where[same], side="right") - 1
            pairs.append(rows * max(1, len(self.grams)) + found[same])
        each = np.unique(np.concatenate(pairs))
        return each // max(1, len(self.grams)), each % max(1, len(self.grams))

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows, grams = self.held(data, at)
        total = np.bincount(rows, self.weight[grams], len(at) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, ones, zeros): in how many texts of each label an n-gram stands, added up for each slice."""
    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        for first, last, data, at in tx.slices(batch.column("text"), tx.SLICE // 2):
            chars, bounds = characters(data, at)
            found, own = [], []
            for length in range(SHORTEST, LONGEST + 1):
                keys = ngrams(chars, length)
                for i in range(last - first):
                    each = np.unique(keys[bounds[i] : max(bounds[i], bounds[i + 1] - length + 1)])
                    found.append(each)
                    own.append(np.full(len(each), labels[first + i], np.int64))
            grams, inverse = np.unique(np.concatenate(found), return_inverse=True)
            label = np.concatenate(own)
            ones = np.bincount(inverse, label, len(grams)).astype(np.int64)
            zeros = np.bincount(inverse, minlength=len(grams)) - ones
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(ones), pa.array(zeros)], names=["gram", "ones", "zeros"])


def _featured(batches: Iterator[pa.RecordBatch], model: Linear) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in tx.slices(batch.column("text")):
            rows, grams = model.held(data, at)
            offsets = pa.array(np.searchsorted(rows, np.arange(last - first + 1)).astype(np.int32))
            part = slice(first, last)
            ids = batch.column("doc_id").slice(part.start, last - first)
            yield pa.RecordBatch.from_arrays([ids, batch.column("label").slice(first, last - first), pa.ListArray.from_arrays(offsets, pa.array(grams.astype(np.int32)))], names=["doc_id", "label", "grams"])


PART = 1 << 19


def logistic(columns: np.ndarray, starts: np.ndarray, ratio: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression, by accelerated gradient steps.

    Row i holds the features columns[starts[i]:starts[i + 1]], each with its ratio as value. Rows are worked on
    in parts of about PART entries, so that little beside `columns` is in memory. The step is the inverse of
    the loss's curvature bound, found by power iteration.
    """
    n, width = len(y), len(ratio)
    edges = [0]
    while edges[-1] < n:
        edges.append(max(edges[-1] + 1, int(np.searchsorted(starts, starts[edges[-1]] + PART, side="right")) - 1))

    def times(v: np.ndarray) -> np.ndarray:
        scaled, out = v[:width] * ratio, np.full(n, v[width])
        for a, b in zip(edges, edges[1:]):
            sums = np.concatenate([[0.0], np.cumsum(scaled[columns[starts[a] : starts[b]]])])
            out[a:b] += sums[starts[a + 1 : b + 1] - starts[a]] - sums[starts[a:b] - starts[a]]
        return out

    def back(u: np.ndarray) -> np.ndarray:
        out = np.zeros(width)
        for a, b in zip(edges, edges[1:]):
            out += np.bincount(columns[starts[a] : starts[b]], np.repeat(u[a:b], np.diff(starts[a : b + 1])), width)
        return np.append(out * ratio, u.sum())

    v = np.full(width + 1, 1 / np.sqrt(width + 1))
    bound = 1.0
    for _ in range(12):
        v = back(times(v))
        bound = float(np.linalg.norm(v))
        v /= bound
    step = 1 / (bound / 4 * 1.05 + penalty)
    w, ahead, t = np.zeros(width + 1), np.zeros(width + 1), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(ahead), -35, 35)))
        gradient = back(p - y)
        gradient[:width] += penalty * ahead[:width]
        new = ahead - step * gradient
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / following * (new - w), new, following
    return w[:width], float(w[width])


def fit(documents: DataFrame, labels: DataFrame, target: str = "toxic", fit_rows: int = FIT_ROWS, features: int = FEATURES, smoothing: float = 1.0) -> Linear:
    """A model for the target of `labels` from at most `fit_rows` labelled texts that are not held out.

    Counts are summed by Spark; `features` n-grams with their counts and, for each fitted text, the numbers of
    those that it holds reach the driver.
    """
    texts = kept(labelled_texts(documents, labels, target, fit_rows), "fit-texts")
    sizes = texts.agg(F.count("*"), F.sum("label")).first()
    n, ones = int(sizes[0]), int(sizes[1] or 0)
    none = Linear(np.zeros(0, np.uint64), np.zeros(0), float(np.log((ones + 0.5) / (n - ones + 0.5))))
    if not 0 < ones < n:
        return none
    counts = texts.select("label", "text").mapInArrow(_counted, "gram long, ones long, zeros long").groupBy("gram").agg(F.sum("ones").alias("p"), F.sum("zeros").alias("q"))
    p, q = F.col("p") / ones, F.col("q") / (n - ones)
    pooled = (F.col("p") + F.col("q")) / n
    clear = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) + F.lit(1.0 / n))
    best = counts.where("p + q >= 3").select("gram", "p", "q", clear.alias("clear")).orderBy(F.desc("clear"), "gram").limit(features).toPandas()
    best["gram"] = best["gram"].to_numpy(np.int64).view(np.uint64)
    best = best.sort_values("gram")
    p, q = best["p"].to_numpy(float) + smoothing, best["q"].to_numpy(float) + smoothing
    ratio = np.log(p / (ones + 2 * smoothing)) - np.log(q / (n - ones + 2 * smoothing))
    shape = Linear(best["gram"].to_numpy(np.uint64), ratio, none.bias)
    rows: pd.DataFrame = texts.mapInArrow(lambda b: _featured(b, shape), "doc_id long, label int, grams array<int>").toPandas().sort_values("doc_id")
    starts = np.concatenate([[0], np.cumsum([len(g) for g in rows["grams"]])]).astype(np.int64)
    columns = np.empty(int(starts[-1]), np.uint16 if len(ratio) <= 65_536 else np.int64)
    for a, b, own in zip(starts, starts[1:], rows["grams"]):
        columns[a:b] = own
    y = rows["label"].to_numpy(float)
    del rows
    weight, bias = logistic(columns, starts, ratio, y)
    return Linear(shape.grams, weight * ratio, bias)


def _scored(batches: Iterator[pa.RecordBatch], model: Linear, columns: tuple[str, ...], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in tx.slices(batch.column("text")):
            carried = [batch.column(c).slice(first, last - first) for c in columns]
            found = model.scores(data, at)
            yield pa.RecordBatch.from_arrays([*carried, pa.array(found)], names=[*columns, name])


def scored(documents: DataFrame, model: Linear, columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The given columns and, as `name`, the probability of label 1 for the whole text of every row."""
    columns = tuple(columns)
    taken = documents.select(*dict.fromkeys([*columns, "text"]))
    schema = T.StructType([*documents.select(*columns).schema.fields, T.StructField(name, T.DoubleType())])
    return taken.mapInArrow(lambda batches: _scored(batches, model, columns, name), schema)
