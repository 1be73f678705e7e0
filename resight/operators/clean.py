"""Cleaning: successful nests, date parts, the season filter, long-lived cohort, size at maturity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resight.functions.scalar import normalise_text, parse_mdy
from resight.operators.skew import with_group_values

# Outcomes that count as a successful nest.
SUCCESSFUL = ("relocate", "lay", "probable lay", "in situ")


def successful_nests(
    df: DataFrame, outcomes: Sequence[str] = SUCCESSFUL, result: str = "result"
) -> DataFrame:
    """Rows whose normalised outcome is in the list; a null outcome is dropped."""
    return df.where(normalise_text(F.col(result)).isin(list(outcomes)))


def with_date_parts(df: DataFrame, dt: str = "dt") -> DataFrame:
    """Parse text dates and add ``season``, ``month`` and ``day``."""
    if isinstance(df.schema[dt].dataType, T.StringType):
        df = df.withColumn(dt, parse_mdy(F.col(dt)))
    return df.withColumns(
        {"season": F.year(dt), "month": F.month(dt), "day": F.dayofmonth(dt)}
    )


def season_consistent(df: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Rows within ``tolerance`` of the first size of their individual and season.

    A null first size is kept as the first and so removes the whole season. Equal dates are ordered
    by event id. The first sizes are combined before the shuffle and joined back to the rows.
    """
    first = F.min_by("size", F.struct("dt", "event_id"))
    rows = with_group_values(df, ["id", "season"], {"first_size": first})
    return rows.where(F.abs(F.col("size") - F.col("first_size")) <= tolerance)


def long_lived(df: DataFrame, years: int = 10) -> DataFrame:
    """All rows of individuals whose last season is at least ``years`` after the first."""
    rows = with_group_values(df, ["id"], {"__first": F.min("season"), "__last": F.max("season")})
    return rows.where(F.col("__last") - F.col("__first") >= years).drop("__first", "__last")


def size_at_maturity(df: DataFrame, one_per_id: bool = False) -> DataFrame:
    """Rows of each individual's first season, or only its first row in date order."""
    if one_per_id:
        whole = F.struct(*[F.col(c) for c in df.columns])
        return (
            df.where(F.col("season").isNotNull())
            .groupBy("id")
            .agg(F.min_by(whole, F.struct("dt", "event_id")).alias("row"))
            .select("row.*")
        )
    rows = with_group_values(df, ["id"], {"first_season": F.min("season")})
    return rows.where(F.col("season") == F.col("first_season"))
