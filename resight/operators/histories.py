"""Capture histories: grid, 0/1 strings, collapsed frequencies, m-array, and the way back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seasons(df: DataFrame) -> DataFrame:
    """Season set per individual; it can hold no more entries than the study has seasons."""
    return (
        df.where(F.col("season").isNotNull())
        .groupBy("id")
        .agg(F.collect_set("season").alias("seasons"))
    )


def _study(sets: DataFrame) -> Column:
    """First and last season over all season sets, as one scalar subquery that shares their exchange."""
    ends = F.struct(F.min(F.array_min("seasons")).alias("first"), F.max(F.array_max("seasons")).alias("last"))
    return sets.agg(ends).scalar()


def study_years(df: DataFrame) -> tuple[Column, Column]:
    """First and last season of the study."""
    study = _study(_seasons(df))
    return study["first"], study["last"]


def complete_grid(df: DataFrame) -> DataFrame:
    """Individual x season with ``obs`` 1 or 0 over contiguous study years, in one shuffle."""
    sets = _seasons(df)
    study = _study(sets)
    return sets.select(
        "id", "seasons", F.explode(F.sequence(study["first"], study["last"])).alias("season")
    ).select("id", "season", F.array_contains("seasons", F.col("season")).cast("int").alias("obs"))


def capture_histories(df: DataFrame) -> DataFrame:
    """``id`` and its history string, one character per study year."""
    sets = _seasons(df)
    study = _study(sets)
    years = sets.select("id", "seasons", F.sequence(study["first"], study["last"]).alias("years"))
    marks = F.transform(
        "years", lambda y: F.when(F.array_contains("seasons", y), F.lit("1")).otherwise(F.lit("0"))
    )
    return years.select("id", F.array_join(marks, "").alias("ch"))


def history_frequencies(histories: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Animals of each history, of each group where ``by`` names its columns."""
    return histories.groupBy(*by, "ch").agg(F.count(F.lit(1)).alias("n"))


def history_spans(histories: DataFrame, first_season: int | Column = 1) -> DataFrame:
    """First and last season and span recovered from ``ch``; other columns are kept."""
    base = first_season if isinstance(first_season, Column) else F.lit(first_season)
    length = F.length("ch")
    seen = histories.where(F.instr(F.col("ch"), "1") > 0)
    return seen.withColumns(
        {
            "first_year": base + F.instr(F.col("ch"), "1") - 1,
            "last_year": base + length - F.instr(F.reverse(F.col("ch")), "1"),
        }
    ).withColumn("longevity", F.col("last_year") - F.col("first_year"))


def _captures(frequencies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Occasions of capture of each history (1-based, ascending)."""
    occasions = F.filter(
        F.sequence(F.lit(1), F.length("ch")), lambda i: F.substr("ch", i, F.lit(1)) == "1"
    )
    return frequencies.select(
        *by, "ch", "n", F.length("ch").alias("occasions"), occasions.alias("seen")
    ).where(F.size("seen") > 0)


def m_array(frequencies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reduced m-array: animals by release occasion and next capture (null: never seen again), within ``by``.

    Each capture is a release; those at the last occasion carry no information and are left out.
    ``occasions`` is the length of the study.
    """
    step = F.transform(
        "seen",
        lambda s, i: F.struct(s.alias("release"), F.get(F.col("seen"), i + 1).alias("recapture")),
    )
    return (
        _captures(frequencies, by)
        .select(*by, "occasions", "n", F.explode(step).alias("s"))
        .select(*by, "occasions", "s.release", "s.recapture", "n")
        .where(F.col("release") < F.col("occasions"))
        .groupBy(*by, "occasions", "release", "recapture")
        .agg(F.sum("n").alias("n"))
    )
