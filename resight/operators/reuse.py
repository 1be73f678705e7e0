"""Keep an intermediate table for the length of a fit that reads it several times."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


@contextmanager
def cached(df: DataFrame, wanted: bool = True) -> Iterator[DataFrame]:
    """Persist on memory and disk inside the block; lost blocks are recomputed from the lineage."""
    if not wanted or df.is_cached:
        yield df
        return
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()
