"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every shingle hash below a fixed fraction of the hash range, the same for all documents, so the
same shingle is retained in every document that has it. Sketches can be merged (the result is the sketch of the
joined set), and the share of one sketch found in another estimates containment, however unequal the documents are.
Beside it, a set of at most `whole` shingles keeps the others too, as a floor: two such sets are compared exactly,
any other pair by what lies below the fraction.

As text a sketch is `size:fraction:digest:hashes:others`: the number of shingles (where the set is not kept whole, the
retained hashes times the divisor), the fraction as a divisor, a digest of all hashes kept, the hashes below the
fraction and the other ones, ascending, 8 bytes each in base 64. Equal texts have equal fingerprints.

Nulls are empty texts; an empty set's sketch is `0:4:0::`, and two empty sets are alike (1). A text of fewer than
five words is one shingle. Texts of any length are read whole. Repeated rows and ties have equal fingerprints. An empty
table gives no rows. Columns other than the named ones are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resight.llm import text as tx

DIVISOR = 4
WHOLE = 64
WIDTH = 5


def _digest(hashes: np.ndarray) -> int:
    return int(np.add.reduce(tx.mixed(hashes))) if len(hashes) else 0


def _packed(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype(">u8").tobytes()).decode()


def _unpacked(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


@dataclass(frozen=True)
class Sketch:
    size: int
    divisor: int
    digest: int
    #: Ascending: those below the fraction, and the others of a set that is kept whole.
    hashes: np.ndarray
    others: np.ndarray

    @staticmethod
    def of(shingles: np.ndarray, divisor: int = DIVISOR, whole: int = WHOLE) -> Sketch:
        """Of distinct hashes, ascending."""
        below = int(np.searchsorted(shingles, np.uint64((2**64 - 1) // divisor), side="right"))
        hashes, others = shingles[:below], shingles[below:]
        if len(shingles) <= whole:
            return Sketch(len(shingles), divisor, _digest(shingles), hashes, others)
        return Sketch(len(hashes) * divisor, divisor, _digest(hashes), hashes, others[:0])

    def complete(self, whole: int = WHOLE) -> bool:
        """Whether the set is kept whole."""
        return self.size == len(self.hashes) + len(self.others) <= whole

    def __str__(self) -> str:
        return f"{self.size}:{self.divisor}:{self.digest:x}:{_packed(self.hashes)}:{_packed(self.others)}"

    @staticmethod
    def parse(text: str) -> Sketch:
        size, divisor, digest, hashes, others = text.split(":")
        return Sketch(int(size), int(divisor), int(digest, 16), _unpacked(hashes), _unpacked(others))

    def _shared(self, other: Sketch, whole: int) -> tuple[int, int, int]:
        if self.divisor != other.divisor:
            raise ValueError("sketches of different fractions")
        one, two = self.hashes, other.hashes
        if self.complete(whole) and other.complete(whole):
            one, two = np.concatenate([one, self.others]), np.concatenate([two, other.others])
        return len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two)

    def likeness(self, other: Sketch, whole: int = WHOLE) -> float:
        """Estimated Jaccard similarity."""
        if (self.size, self.digest) == (other.size, other.digest):
            return 1.0
        common, one, two = self._shared(other, whole)
        return common / (one + two - common) if one + two > common else 0.0

    def containment(self, other: Sketch, whole: int = WHOLE) -> float:
        """Estimated share of this set that is in the other; 1 for an empty set."""
        if self.size == 0 and self.complete(whole):
            return 1.0
        common, one, _ = self._shared(other, whole)
        return common / one if one else 0.0

    def merged(self, other: Sketch, whole: int = WHOLE) -> Sketch:
        """The sketch of the joined set."""
        if self.divisor != other.divisor:
            raise ValueError("sketches of different fractions")
        if self.complete(whole) and other.complete(whole):
            return Sketch.of(np.unique(np.concatenate([self.hashes, self.others, other.hashes, other.others])), self.divisor, whole)
        hashes = np.union1d(self.hashes, other.hashes)
        return Sketch(len(hashes) * self.divisor, self.divisor, _digest(hashes), hashes, hashes[:0])


def sketches(column: pa.Array, width: int = WIDTH, divisor: int = DIVISOR, whole: int = WHOLE) -> Iterator[tuple[int, list[Sketch]]]:
    """(first row, sketches) for slices of a text column."""
    for first, _, data, at in tx.slices(column):
        sets, bounds = tx.shingles(*tx.words(data, at), width)
        yield first, [Sketch.of(sets[bounds[i] : bounds[i + 1]], divisor, whole) for i in range(len(bounds) - 1)]


def fingerprints(documents: DataFrame, texts: dict[str, str], likeness: dict[str, tuple[str, str]], columns: tuple[str, ...] = ("doc_id",), divisor: int = DIVISOR, whole: int = WHOLE) -> DataFrame:
    """The given columns, a fingerprint for each named text column, and likenesses of pairs of text columns.

    texts: text column to the name of its fingerprint ('' for none); likeness: name to two text columns.
    """
    texts, likeness, columns = dict(texts), dict(likeness), tuple(columns)
    named = [name for name in texts.values() if name]
    schema = T.StructType(
        [*documents.select(*columns).schema.fields, *[T.StructField(n, T.StringType()) for n in named], *[T.StructField(n, T.DoubleType()) for n in likeness]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, min(512, batch.num_rows * (2 << 20) // max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, size):
                part = batch.slice(first, size)
                found = {c: [s for _, own in sketches(part.column(c), WIDTH, divisor, whole) for s in own] for c in texts}
                arrays = [part.column(c) for c in columns]
                arrays += [pa.array([str(s) for s in found[c]], pa.string()) for c, n in texts.items() if n]
                arrays += [pa.array([a.likeness(b, whole) for a, b in zip(found[one], found[two], strict=True)], pa.float64()) for one, two in likeness.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *named, *likeness])

    return documents.select(*dict.fromkeys([*columns, *texts])).mapInArrow(run, schema)


def with_next_text(documents: DataFrame, rows: int = 5000) -> DataFrame:
    """doc_id, text and next_text: the text of the next row by ascending doc_id (ties by the text's hash; a null
    doc_id comes first), after the last row that of the first.

    Rows are dealt once, to ranges of about `rows` ids that begin at quantiles of doc_id, and put in order range
    by range. What follows a range's last row is the first row of the next range, so that row is sent to both.
    The driver holds the beginnings of the ranges, one number for `rows` rows.
    """
    held = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, nulls, least = held.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    if n == 0:
        return held.withColumn("next_text", F.lit(""))
    ranges = max(1, n // rows)
    shares = [k / ranges for k in range(1, ranges)]
    marks = held.agg(F.percentile_approx("doc_id", shares, min(10 * ranges + 1000, 100_000))).first()[0] if shares else []
    # Every beginning is an id of the table, so no range is empty; the first holds what is below them all.
    marks = np.array(sorted({m for m in marks or [] if nulls or m > least}), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.fillna(np.iinfo(np.int64).min).astype(np.int64)
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(marks, known, side="right")).astype(np.int32))

    @F.pandas_udf("boolean")
    def begins(ids: pd.Series) -> pd.Series:
        return pd.Series(np.isin(ids.fillna(0).astype(np.int64), marks) & ids.notna().to_numpy())

    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == least
    order = F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))
    heads = held.where(begins("doc_id") | first).groupBy(range_of("doc_id").alias("_range")).agg(F.min(order).alias("o"))
    tails = heads.select(F.lit(None).cast("long").alias("doc_id"), F.col("o.t").alias("text"), F.pmod(F.col("_range") - 1, F.lit(len(marks) + 1)).alias("_range"), F.lit(True).alias("_tail"))
    every = held.withColumn("_range", range_of("doc_id")).withColumn("_tail", F.lit(False)).unionByName(tails)
    before = Window.partitionBy("_range").orderBy("_tail", F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    return every.withColumn("next_text", F.lead("text").over(before)).where(~F.col("_tail")).select("doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))
