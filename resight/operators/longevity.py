"""Reproductive span per individual and its summaries. One row per individual from here on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reproductive_span(df: DataFrame) -> DataFrame:
    """First and last season and their difference; an individual without dates keeps nulls."""
    return (
        df.groupBy("id")
        .agg(F.min("season").alias("first_year"), F.max("season").alias("last_year"))
        .withColumn("longevity", F.col("last_year") - F.col("first_year"))
    )


def cohort(
    span: DataFrame,
    min_longevity: int | None = None,
    first_year_from: int | None = None,
    positive: bool = False,
) -> DataFrame:
    """Individuals by span and first season."""
    if positive:
        span = span.where(F.col("longevity") > 0)
    if min_longevity is not None:
        span = span.where(F.col("longevity") >= min_longevity)
    if first_year_from is not None:
        span = span.where(F.col("first_year") >= first_year_from)
    return span


def longevity_summary(span: DataFrame) -> DataFrame:
    """One summary row. Spans are whole years, so the exact built-in median holds few values."""
    x = F.col("longevity")
    return span.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean"),
        F.median(x).alias("median"),
        F.stddev_samp(x).alias("sd"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


def repeat_only(span: DataFrame) -> DataFrame:
    """Individuals seen in more than one year (inclusive span above one)."""
    return span.where(F.col("last_year") - F.col("first_year") + 1 > 1)


def survival_input(span: DataFrame, seasons: DataFrame) -> DataFrame:
    """``time`` = span; ``event`` = 0 when the last season is the end of the study.

    ``seasons`` is the table that defines the study end: every nest, before the size filter.
    """
    end = seasons.agg(F.max("season")).scalar()
    return span.select(
        "id",
        "first_year",
        "last_year",
        F.col("longevity").alias("time"),
        F.when(F.col("last_year") == end, F.lit(0)).otherwise(F.lit(1)).alias("event"),
    )
