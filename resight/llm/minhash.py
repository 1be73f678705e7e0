"""Near-duplicates by min-max hashing.

A document is the set of its distinct word shingles. Every hash function gives two signature values, the
smallest and the largest hash of the set; either one agrees between two sets with the probability of their
Jaccard similarity, so half the hash evaluations give a signature of the same length, with less variance than
minima alone (the two ends of one function are negatively correlated). Values are banded, documents that share
a band are candidates, and candidates are confirmed on their full shingle sets.

Work is kept linear in the copies. Documents of equal sets are one node from the start. In a band's bucket
every node is first compared with one leader only; what is joined by a confirmed link needs no more
comparisons, so after components are known only pairs of one bucket that are still in different components are
looked at, and only those whose fine sketches (2048 values of two bits) come near the threshold are built. With 40 bands of
4 values, each of its own function, a pair at a similarity of 0.75 is missed with a probability under 3e-7: half of
the bands are of minima, half of maxima, and for short sets the two fail together less often than if independent.

Nulls, empty texts and texts without words have an empty set and are linked with nothing. Rows that share a
doc_id count as one document. A row with a null doc_id cannot be named as a link: it stays as a component of
its own with a null id. Columns other than the named ones are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.llm import text as tx
from resight.llm.graph import components
from resight.llm.store import kept

BANDS = 40
ROWS = 4
#: Functions of the fine sketch that thins out the pairs of a bucket, and how far its estimate may fall short of
#: the similarity: 0.08 is 7 standard deviations of it (5 for sets of a single shingle).
FINE = 1024
MARGIN = 0.08
#: Rows of a bucket that are compared in one group; larger buckets are cut into parts.
PART = 1024
_U = np.uint64


def minmax(shingles: np.ndarray, bounds: np.ndarray, functions: int) -> np.ndarray:
    """Signatures, a row for each non-empty set: `functions` minima, then as many maxima."""
    draws = np.random.default_rng(41).integers(0, 2**32, (2, functions), dtype=np.uint32)
    filled = bounds[:-1][bounds[:-1] < bounds[1:]]
    high = (shingles >> _U(32)).astype(np.uint32)
    low = shingles.astype(np.uint32)
    out = np.empty((len(filled), 2 * functions), np.uint32)
    for k in range(functions):
        value = (high ^ draws[0, k]) * (draws[1, k] | np.uint32(1))
        value ^= value >> np.uint32(15)
        value += low
        value *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(value, filled)
        out[:, functions + k] = np.maximum.reduceat(value, filled)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band. A band takes `rows` values in a row, so they are of different functions."""
    if rows > signatures.shape[1] // 2:
        raise ValueError("a band cannot have more values than there are functions")
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        total = np.full(len(signatures), _U(b), np.uint64)
        for column in range(b * rows, (b + 1) * rows):
            total = tx.mixed(total * _U(0x9E3779B97F4A7C15) + signatures[:, column].astype(np.uint64))
        keys[:, b] = total
    return keys


def _signed(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, last, data, at in tx.slices(batch.column(1)):
            sets, bounds = tx.shingles(*tx.words(data, at), width)
            sizes = np.diff(bounds)
            filled = bounds[:-1][sizes > 0]
            digests = np.zeros((len(sizes), 2), np.uint64)
            keys = np.zeros((len(sizes), bands), np.uint64)
            if len(filled):
                for side, spin in enumerate((_U(0), _U(0x5851F42D4C957F2D))):
                    digests[sizes > 0, side] = np.add.reduceat(tx.mixed(sets ^ spin), filled)
                keys[sizes > 0] = band_keys(minmax(sets, bounds, bands * rows // 2), bands, rows)
            flat = pa.array(keys[sizes > 0].ravel().view(np.int64))
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, last - first),
                    pa.array(sizes),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(sizes), [None, pa.py_buffer(digests.tobytes())]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), flat),
                ],
                names=["doc_id", "n_shingles", "set_hash", "bands"],
            )


def signatures(documents: DataFrame, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits of the whole set) and band keys of every row."""
    if bands * rows % 2:
        raise ValueError("an even number of signature values is needed, each function gives two")
    return documents.select("doc_id", "text").mapInArrow(
        lambda batches: _signed(batches, width, bands, rows), "doc_id long, n_shingles long, set_hash binary, bands array<long>"
    )


def _finely(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(node, sketch): two bits of each of 2 * FINE signature values, the first bits of all, then the second."""
    for batch in batches:
        for first, last, data, at in tx.slices(batch.column(1), 1 << 20):
            sets, bounds = tx.shingles(*tx.words(data, at), width)
            some = np.flatnonzero(np.diff(bounds))
            if len(some):
                signed = minmax(sets, bounds, FINE)
                planes = [np.packbits((signed >> np.uint32(bit)) & np.uint32(1), axis=1, bitorder="little") for bit in (7, 19)]
                flat = np.concatenate(planes, axis=1).view(np.int64)
                offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * flat.shape[1])
                ids = batch.column(0).slice(first, last - first).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], names=["node", "sketch"])


def likely(one: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
    """Whether two fine sketches, row by row, agree as often as sets of similarity `least` do."""
    # Unsigned: of negative numbers the bits of the absolute value would be counted.
    apart = (one ^ other).view(np.uint64)
    half = apart.shape[1] // 2
    differ = np.bitwise_count(apart[:, :half] | apart[:, half:]).sum(axis=1, dtype=np.int64)
    return 64 * half - differ >= int((least + (1 - least) / 4) * 64 * half)


def _rows_of(column: pa.ListArray, where: np.ndarray) -> np.ndarray:
    """The lists of the rows in `where`, all of one length, as rows of a matrix; of the others zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), len(flat) // max(1, int(where.sum()))), np.int64)
    out[where] = flat.reshape(-1, out.shape[1])
    return out


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """near_pairs of the rows of in_parts, in the order of bucket, low and high.

    Every row meets the next one of its group, then the second next and so on, all groups of a batch at once; the
    last group may go on in the next batch and waits for it.
    """
    least = percent / 100 - MARGIN
    waiting: list[pa.RecordBatch] = []
    for batch in chain(batches, (None,)):
        found = [x for x in (*waiting, batch) if x is not None and x.num_rows]
        if not found:
            continue
        rows = pa.Table.from_batches(found).combine_chunks()
        plain = {k: rows.column(k).to_numpy() for k in ("bucket", "low", "high", "part", "node", "n", "c")}
        new = np.ones(rows.num_rows + 1, bool)
        new[1:-1] = np.any([plain[k][1:] != plain[k][:-1] for k in ("bucket", "low", "high")], axis=0)
        heads = np.flatnonzero(new)
        ready = rows.num_rows if batch is None else int(heads[-2])
        waiting = rows.slice(ready).to_batches()
        if not ready:
            continue
        rows = rows.slice(0, ready).combine_chunks()
        ends = np.repeat(heads[1:], np.diff(heads))
        sketch = _rows_of(rows.column("sketch").combine_chunks(), np.ones(ready, bool))
        bands = rows.column("bands").combine_chunks()
        one_set = bands.is_valid().to_numpy(zero_copy_only=False)
        keys = _rows_of(bands, one_set)
        bucket, node, n, c, part, low, high = (plain[k] for k in ("bucket", "node", "n", "c", "part", "low", "high"))
        live, step = np.arange(ready), 0
        while len(live):
            step += 1
            live = live[ends[live] > live + step]
            i, j = live, live + step
            i = i[(c[i] != c[j]) & ((low[i] == high[i]) | (part[i] != part[j])) & (n[i] * 100 >= n[j] * percent) & (n[j] * 100 >= n[i] * percent)]
            for first in range(0, len(i), 1024):
                x = i[first : first + 1024]
                x = x[likely(sketch[x], sketch[x + step], least)]
                if not len(x):
                    continue
                y = x + step
                # Of the buckets that a pair shares one builds it; those of a doc_id with several sets all do.
                earliest = np.where(keys[x] == keys[y], keys[x], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
                once = ~(one_set[x] & one_set[y]) | (earliest >= bucket[x])
                x, y = x[once], y[once]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], names=["a", "b"])


def in_parts(members: DataFrame, size: int = PART) -> DataFrame:
    """The rows, those of a bucket of more than `size` rows cut into parts of about as many by a hash. Every two parts
    of a bucket, and every part alone, are a group of their own: (bucket, low, high) with low <= high; `part` is the row's own."""
    large = members.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > size)
    cut = members.join(large.select("bucket", F.ceil(F.col("rows") / size).alias("parts")), "bucket", "left")
    cut = cut.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node", "sketch"), "parts"))
    met = cut.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return met.withColumn("low", F.least("part", "with")).withColumn("high", F.greatest("part", "with")).drop("with", "parts")


def near_pairs(members: DataFrame, percent: int = 75, size: int = PART) -> DataFrame:
    """Pairs (a < b) of nodes of one bucket in different components `c`, of sizes `n` and fine sketches that come near the
    threshold; `bands` are all buckets of a node, or null where it has several sets. No task holds a whole large bucket."""
    dealt = in_parts(members, size).repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return dealt.mapInArrow(lambda batches: _near(batches, percent), "a long, b long")


def _overlaps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            sides = []
            for name in ("text_a", "text_b"):
                found = [tx.shingles(*tx.words(data, at), width) for _, _, data, at in tx.slices(part.column(name))]
                sides.append([s[b[i] : b[i + 1]] for s, b in found for i in range(len(b) - 1)])
            common = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sides, strict=True)]
            every = [len(a) + len(b) - c for a, b, c in zip(*sides, common, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(common, pa.int64()), pa.array(every, pa.int64())],
                names=["a", "b", "common", "every"],
            )


def overlaps(pairs: DataFrame, texts: DataFrame, width: int = 5) -> DataFrame:
    """pairs (a, b) of doc_ids with the sizes of the intersection and the union of their full shingle sets."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda batches: _overlaps(batches, width), "a long, b long, common long, every long")


def near_duplicates(
    documents: DataFrame, width: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; linked are sets of a Jaccard similarity of at
    least `percent` in a hundred, component_id is the smallest doc_id that links lead to."""
    signed = kept(signatures(documents, width, bands, rows), "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = filled.groupBy("set_hash").agg(F.min("doc_id").alias("node"))
    # One row for each distinct set, under the smallest of its doc_ids; a doc_id with several sets has several.
    leads = filled.join(nodes, "set_hash").where("doc_id = node").select("node", "n_shingles", "set_hash", "bands").dropDuplicates(["node", "set_hash"])
    placed = leads.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("top")).where("lead < top").drop("top")
    members = kept(placed.join(shared, "bucket"), "buckets")
    named = members.select(F.col("node").alias("doc_id")).distinct()
    texts = kept(documents.select("doc_id", "text").join(named, "doc_id", "left_semi"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        linked = overlaps(pairs, texts, width).where(F.col("common") * 100 >= F.col("every") * percent)
        return linked.select(F.col("a").alias("u"), F.col("b").alias("v"))

    # A doc_id with several sets: its sets are linked through it.
    own = filled.join(nodes, "set_hash").where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    repeated = own.join(filled.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("u")), "u", "left_semi")
    first = members.where("node <> lead").groupBy("node").agg(F.min("lead").alias("a")).select("a", F.col("node").alias("b"))
    known = components(confirmed(first).union(repeated))
    for step in ("leads", "rest"):
        at = known.select(F.col("node").alias("x"), F.col("component").alias("c"))
        here = members.join(at, F.col("node") == F.col("x"), "left").withColumn("c", F.coalesce("c", "node")).drop("x")
        if step == "leads":
            there = at.select(F.col("x").alias("lead"), F.col("c").alias("lead_c"))
            pairs = here.where("node <> lead").select("node", "lead", "c").distinct().join(there, "lead", "left")
            pairs = pairs.where("c <> coalesce(lead_c, lead)").select(F.col("lead").alias("a"), F.col("node").alias("b"))
        else:
            mixed = here.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
            open_ = here.join(mixed, "bucket").where("node <> lead").select("bucket", "node", "n", "c")
            named = open_.select(F.col("node").alias("doc_id")).distinct()
            fine = texts.join(named, "doc_id", "left_semi").mapInArrow(lambda b: _finely(b, width), "node long, sketch array<long>").distinct()
            # A doc_id with several sets has all their sketches, and no one list of bands.
            every = leads.groupBy("node").agg(F.when(F.count("*") == 1, F.first("bands")).alias("bands"))
            open_ = kept(open_.join(fine.join(every, "node"), "node"), "open")
            pairs = near_pairs(open_, percent)
        pairs = kept(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            continue
        joined = known.select(F.col("node").alias("u"), F.col("component").alias("v")).union(confirmed(pairs))
        known = kept(components(joined), "components")
    named = signed.join(nodes, "set_hash", "left").join(known, "node", "left")
    own_id = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(own_id)
    return named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
