"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (shares of character classes, words, lines and repeats) are found for many texts at
once from their bytes. Trees are grown level by level on binned statistics, each split chosen from histograms of
gradients, on a bounded sample of labelled rows (`fit_rows`, documented in `fit`). The fitted trees are flat
arrays, and scoring walks all texts of a batch down a tree by array indexing.

Nulls and empty texts have the statistics of an empty text and a score like any other. Without labels of both
kinds the model has no trees and scores every text with the prior (0.5 if there are no labels at all). Repeated
rows score alike. Columns other than doc_id and text of documents, and doc_id and the target of labels, are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from resight.llm import text as tx
from resight.llm.labelled import labelled_texts

FIT_ROWS = 20_000
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (32,),
    "line": (10,),
    "stop": (46,),
    "comma": (44,),
    "bang": (33, 63),
    "bar": (124,),
    "symbol": (35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126),
    "bracket": (40, 41, 91, 93, 47, 58, 59, 34, 39, 45),
    "beyond": range(192, 256),
}
_WORDS = ("word_mean", "word_deviation", "word_longest", "word_distinct", "word_twice", "word_common", "pair_distinct", "shingle_distinct", "word_capital", "word_bare")
_LINES = ("line_mean", "line_distinct", "line_stop")
STATISTICS = ("bytes_log", "words_log", "byte_classes", *_CLASSES, *_WORDS, *_LINES)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(at) - 1
    out = np.zeros((n, len(STATISTICS)))
    place = {name: i for i, name in enumerate(STATISTICS)}
    sizes = np.diff(at)
    some = np.maximum(sizes, 1)
    out[:, place["bytes_log"]] = np.log1p(sizes)
    sums = np.zeros(len(data) + 1, np.int64)
    for name, members in _CLASSES.items():
        table = np.zeros(256, np.int8)
        table[list(members)] = 1
        np.cumsum(table[data], out=sums[1:])
        out[:, place[name]] = (sums[at[1:]] - sums[at[:-1]]) / some
    starts, ends, first = tx.word_spans(data, at)
    hashes, counts, lengths = tx.hashed(data, starts, ends), np.diff(first), (ends - starts).astype(float)
    out[:, place["words_log"]] = np.log1p(counts)
    capital = ((data[starts] >= 65) & (data[starts] <= 90)).astype(float) if len(starts) else lengths
    last = data[ends - 1] if len(starts) else data[:0]
    # Words that end in neither letter, digit nor a byte beyond ASCII carry a mark.
    bare = ((last >= 97) & (last <= 122) | (last >= 65) & (last <= 90) | (last >= 48) & (last <= 57) | (last >= 128)).astype(float)
    apart = np.zeros(256, bool)
    apart[10] = True
    line_starts, line_ends, first_line = tx.word_spans(data, at, apart)
    lines = tx.hashed(data, line_starts, line_ends)
    stops = np.isin(data[line_ends - 1], (46, 33, 63, 58)) if len(lines) else np.zeros(0, bool)
    for i in range(n):
        a, b = first[i], first[i + 1]
        row = out[i]
        row[place["byte_classes"]] = np.count_nonzero(np.bincount(data[at[i] : at[i + 1]], minlength=256)) / 256
        if b > a:
            own, length = hashes[a:b], lengths[a:b]
            _, times = np.unique(own, return_counts=True)
            row[place["word_mean"]], row[place["word_deviation"]], row[place["word_longest"]] = length.mean(), length.std(), np.log1p(length.max())
            row[place["word_distinct"]], row[place["word_common"]] = len(times) / (b - a), times.max() / (b - a)
            row[place["word_capital"]], row[place["word_bare"]] = capital[a:b].mean(), bare[a:b].mean()
            if b - a > 1:
                row[place["word_twice"]] = np.count_nonzero(own[1:] == own[:-1]) / (b - a - 1)
                row[place["pair_distinct"]] = len(np.unique(own[1:] * np.uint64(3) + own[:-1])) / (b - a - 1)
            if b - a > 4:
                five = own[4:] * np.uint64(81) + own[3:-1] * np.uint64(27) + own[2:-2] * np.uint64(9) + own[1:-3] * np.uint64(3) + own[:-4]
                row[place["shingle_distinct"]] = len(np.unique(five)) / (b - a - 4)
        a, b = first_line[i], first_line[i + 1]
        if b > a:
            row[place["line_mean"]] = np.log1p((line_ends[a:b] - line_starts[a:b]).mean())
            row[place["line_distinct"]] = len(np.unique(lines[a:b])) / (b - a)
            row[place["line_stop"]] = stops[a:b].mean()
    return out


@dataclass
class Trees:
    """Complete binary trees as arrays: node k of a tree has the children 2k+1 and 2k+2."""

    prior: float
    depth: int
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes): greater goes right
    value: np.ndarray  # (trees, leaves)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, penalty: float = 2.0, least: float = 3.0) -> Trees:
    """Boosted trees for labels 0 and 1 by the logistic loss, Newton steps and histograms of `bins` bins."""
    n, features = x.shape
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    inner, leaves = 2**depth - 1, 2**depth
    model = Trees(float(np.log(share / (1 - share))), depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    flat = binned + (np.arange(features) * bins)[:, None]
    total = np.full(n, model.prior)
    all_features, all_thresholds, all_values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins, np.int64)
        for level in range(depth):
            width = 2**level
            local = node - (width - 1)
            index = (flat + local * features * bins).ravel()
            shape = (width, features, bins)
            g = np.bincount(index, np.tile(gradient, features), width * features * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(index, np.tile(hessian, features), width * features * bins).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + penalty) + (g_all - g) ** 2 / (h_all - h + penalty) - g_all**2 / (h_all + penalty)
            gain[(h < least / 4) | (h_all - h < least / 4)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[width - 1 + k], threshold[width - 1 + k], cut[width - 1 + k] = j, edges[j][b], b
            node = 2 * node + 1 + (binned[feature[node], np.arange(n)] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, hessian, leaves) + penalty)
        total += value[leaf]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_values.append(value)
    return Trees(model.prior, depth, np.array(all_features), np.array(all_thresholds), np.array(all_values))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in tx.slices(batch.column("text")):
            found = statistics(data, at).ravel()
            offsets = pa.array(np.arange(last - first + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(first, last - first), pa.ListArray.from_arrays(offsets, pa.array(found))], names=["label", "x"]
            )


def fit(documents: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = FIT_ROWS) -> Trees:
    """Trees for the target of `labels`. At most `fit_rows` labelled rows are used: that many numbers for each
    statistic are all that reaches the driver. Held-out rows are never used."""
    rows = labelled_texts(documents, labels, target, fit_rows).select("label", "text").mapInArrow(_measured, "label int, x array<double>").toPandas()
    rows = rows.iloc[np.lexsort(np.stack(rows["x"]).T)] if len(rows) else rows
    x = np.stack(rows["x"]) if len(rows) else np.zeros((0, len(STATISTICS)))
    return grow(x, rows["label"].to_numpy(float))


def _scored(batches: Iterator[pa.RecordBatch], model: Trees, columns: tuple[str, ...], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in tx.slices(batch.column("text")):
            carried = [batch.column(c).slice(first, last - first) for c in columns]
            found = model.scores(statistics(data, at))
            yield pa.RecordBatch.from_arrays([*carried, pa.array(found)], names=[*columns, name])


def scored(documents: DataFrame, model: Trees, columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The given columns and, as `name`, the probability of label 1 for the whole text of every row."""
    columns = tuple(columns)
    taken = documents.select(*dict.fromkeys([*columns, "text"]))
    schema = T.StructType([*documents.select(*columns).schema.fields, T.StructField(name, T.DoubleType())])
    return taken.mapInArrow(lambda batches: _scored(batches, model, columns, name), schema)
