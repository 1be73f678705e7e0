"""The three report tables over one cleaned table: longevity, size, growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.functions.scalar import level_order
from resight.operators import chart, clean, growth, longevity
from resight.operators.quantiles import summarise


def measured(
    sightings: DataFrame,
    outcomes: Sequence[str] = clean.SUCCESSFUL,
    tolerance: float = 1.0,
) -> DataFrame:
    """Successful nests with date parts, season-filtered."""
    nests = clean.with_date_parts(clean.successful_nests(sightings, outcomes))
    return clean.season_consistent(nests, tolerance)


def longevity_table(rows: DataFrame, digits: int = 2) -> DataFrame:
    span = longevity.cohort(longevity.reproductive_span(rows), positive=True)
    return chart.rounded(longevity.longevity_summary(span), digits)


def size_summary(rows: DataFrame) -> DataFrame:
    """Mean, sd and range of length and width."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            f(c).alias(f"{name}_{c}")
            for c in ("size", "width")
            for name, f in (
                ("min", F.min),
                ("mean", F.avg),
                ("sd", F.stddev_samp),
                ("max", F.max),
            )
        ],
    )


def size_table(rows: DataFrame, digits: int = 2) -> DataFrame:
    return chart.rounded(size_summary(clean.size_at_maturity(rows)), digits)


def growth_table(
    rows: DataFrame,
    years: int = 10,
    above: float | None = -1.0,
    phases: Sequence[tuple[str, float, float]] = growth.PHASES,
) -> DataFrame:
    """Growth by phase for long-lived individuals: n, mean, median, sd, standard error."""
    rates = growth.interval_growth(clean.long_lived(rows, years))
    if above is not None:
        rates = rates.where(F.col("growth_rate") > above)
    return phase_summary(growth.growth_phase(rates, phases), "phase", [p[0] for p in phases])


def phase_summary(rates: DataFrame, by: str, levels: Sequence[str]) -> DataFrame:
    """Summary by label with the label's ordinal and the standard error over all rows."""
    s = summarise(rates, "growth_rate", [by])
    return s.select(
        by,
        level_order(F.col(by), levels).alias("level"),
        "n",
        "mean",
        "median",
        "sd",
        "min",
        "max",
        (F.col("sd") / F.sqrt("n")).alias("se"),
    )
