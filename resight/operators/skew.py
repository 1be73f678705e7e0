"""Joins and group values shared by every operator that looks at whole groups of raw rows.

One individual may hold a third of all rows, so no operator windows raw rows by individual. Group values come
from a map-side combined aggregate that is joined back: a join on equal keys with plain exchanges on both
sides, which adaptive execution broadcasts where the aggregate is small and splits where a key is skewed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys match each other; keeps one copy of the keys."""
    if not keys:
        raise ValueError("a join needs keys")
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def with_group_values(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Add per-group aggregates to every row."""
    table = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in values.items()])
    return null_safe_join(df, table, keys)
