"""Growth between sightings and between seasons, phases and longevity groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from resight.functions.scalar import days_between, label_ranges, label_upto

DAYS_PER_YEAR = 365.25

# Growth phases are closed ranges with gaps; longevity groups go by upper edge.
PHASES = (("1-10", 1, 10), ("11-20", 11, 20), ("21-31", 21, 31))
SPAN_GROUPS_INCLUSIVE = (("1-10", 10), ("10-20", 20), ("20-30", 30), ("30+", None))
SPAN_GROUPS = (("1-10", 10), ("11-20", 20), ("20+", None))


def interval_growth(df: DataFrame) -> DataFrame:
    """Annualised growth between consecutive sightings of an individual.

    Rows of the same day as the one before them are dropped after the lag, so the rows that remain are
    exactly the first sighting of each day against the last sighting of the day before. Days are
    therefore combined before the shuffle, and the window sees at most one row per calendar day.
    ``event_id`` orders sightings within a day, a null one comes first.
    """
    days = (
        df.where(F.col("dt").isNotNull())
        .groupBy("id", "dt")
        .agg(
            F.min("event_id").alias("event_id"),
            F.min_by("size", F.struct("event_id")).alias("size"),
            F.max_by("size", F.struct("event_id")).alias("__last_size"),
        )
    )
    w = W.partitionBy("id").orderBy("dt")
    years = F.col("days_elapsed") / DAYS_PER_YEAR
    return (
        days.withColumns(
            {
                "prev_dt": F.lag("dt").over(w),
                "prev_size": F.lag("__last_size").over(w),
                "__first_dt": F.min("dt").over(W.partitionBy("id")),
            }
        )
        .withColumn("days_elapsed", days_between(F.col("dt"), F.col("prev_dt")))
        .withColumn("growth", F.col("size") - F.col("prev_size"))
        .withColumn("growth_rate", F.try_divide(F.col("growth"), years))
        .withColumn(
            "years_since_first", days_between(F.col("dt"), F.col("__first_dt")) / DAYS_PER_YEAR
        )
        .where((F.col("days_elapsed") > 0) & F.col("growth_rate").isNotNull())
        .drop("__last_size", "__first_dt")
    )


def season_size(df: DataFrame, min_measurements: int = 2) -> DataFrame:
    """Mean size per individual and season with enough measurements."""
    return (
        df.where(F.col("size").isNotNull() & F.col("season").isNotNull())
        .groupBy("id", "season")
        .agg(F.avg("size").alias("mean_size"), F.count(F.lit(1)).alias("n_meas"))
        .where(F.col("n_meas") >= min_measurements)
    )


def season_growth(df: DataFrame, min_measurements: int = 2) -> DataFrame:
    """Growth per year between qualifying seasons. The window holds one row per season."""
    w = W.partitionBy("id").orderBy("season")
    return (
        season_size(df, min_measurements)
        .withColumns(
            {"prev_season": F.lag("season").over(w), "prev_size": F.lag("mean_size").over(w)}
        )
        .withColumn("interval", F.col("season") - F.col("prev_season"))
        .withColumn("growth", F.col("mean_size") - F.col("prev_size"))
        .withColumn("growth_rate", F.try_divide(F.col("growth"), F.col("interval")))
        .where(F.col("growth_rate").isNotNull())
    )


def growth_phase(
    growth: DataFrame,
    phases: Sequence[tuple[str, float, float]] = PHASES,
    gapless: bool = False,
) -> DataFrame:
    """Label rows by years since first sighting; rows in the gaps between phases are dropped.

    ``gapless`` stretches each phase up to the start of the next.
    """
    ranges = list(phases)
    years = F.col("years_since_first")
    if gapless:
        steps: Column = F.lit(None).cast("string")
        for label, low, _ in ranges:
            steps = F.when(years >= low, F.lit(label)).otherwise(steps)
        label = F.when(years <= ranges[-1][2], steps)
    else:
        label = label_ranges(years, ranges)
    return growth.withColumn("phase", label).where(F.col("phase").isNotNull())


def longevity_group(
    span: DataFrame,
    groups: Sequence[tuple[str, float | None]] = SPAN_GROUPS,
    inclusive: bool = False,
) -> DataFrame:
    """``id``, ``years_reproducing`` and its group; the inclusive span counts both end seasons."""
    years = F.col("longevity") + (1 if inclusive else 0)
    return span.select(
        "id",
        years.alias("years_reproducing"),
        label_upto(years, groups).alias("longevity_group"),
    )


def years_reproducing(df: DataFrame) -> DataFrame:
    """Elapsed years since the first season, one row per individual and season."""
    seasons = df.where(F.col("season").isNotNull()).select("id", "season").distinct()
    first = F.min("season").over(W.partitionBy("id"))
    return seasons.withColumn("years_reproducing", F.col("season") - first)


def individual_growth(growth: DataFrame, group: str = "longevity_group") -> DataFrame:
    """Mean growth rate per individual and group."""
    return growth.groupBy("id", group).agg(F.avg("growth_rate").alias("mean_rate"))
