"""Labelled rows for fitting classifiers, and the split that keeps rows out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a document is kept from fitting: the CRC-32 of its id as text modulo parts; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_texts(documents: DataFrame, labels: DataFrame, target: str, rows: int, parts: int = 4, part: int = 2) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents that are not held out, in the order of a hash.

    A doc_id with several labels has the larger one, with several texts the smallest. Labels other than 0 and 1
    are left out. At most `rows` ids are broadcast, whatever the table.
    """
    usable = labels.select(F.col("doc_id"), F.col(target).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    once = usable.where(~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
