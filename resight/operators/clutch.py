"""Clutch tables: merge, attach body size, return interval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from resight.functions.scalar import parse_mdy
from resight.operators.skew import null_safe_join

MEASURES = ("unhatched", "eggs", "hatch")
BLOCK = 1_000_000
CLUTCH_COLUMNS = ("event_id", *MEASURES, "id", "dt")


def join_suffixed(left: DataFrame, right: DataFrame, key: str, how: str = "full") -> DataFrame:
    """Join on ``key``; shared columns get ``_x``/``_y``; null keys match each other.

    The null-safe condition stays an equi-join, so both sides shuffle on the key.
    """
    shared = (set(left.columns) & set(right.columns)) - {key}
    a = left.withColumnsRenamed({c: f"{c}_x" for c in shared}).withColumnRenamed(key, "__a")
    b = right.withColumnsRenamed({c: f"{c}_y" for c in shared}).withColumnRenamed(key, "__b")
    joined = a.join(b, F.col("__a").eqNullSafe(F.col("__b")), how)
    return joined.withColumn(key, F.coalesce("__a", "__b")).drop("__a", "__b")


def _with_date(df: DataFrame) -> DataFrame:
    """Text dates parsed next to the source, so that a row is parsed once and not again after a join."""
    if "dt" in df.columns and isinstance(df.schema["dt"].dataType, T.StringType):
        return df.withColumn("dt", parse_mdy(F.col("dt")))
    return df


def unify_clutches(excavated: DataFrame, identified: DataFrame, older: DataFrame) -> DataFrame:
    """Merge excavation and identity tables, append the older table, keep complete rows.

    ``excavated`` and ``identified`` share ``event_id``; each of ``id`` and ``dt`` is on one of them.
    Measures come from the excavation side. The merge is a full join of which only complete rows stay:
    rows without an event, or without excavation, never do, so they are left out before the shuffle
    and the join that remains can be split by the runtime where a key is skewed.
    """
    excavated, identified, older = (_with_date(d) for d in (excavated, identified, older))
    needs_identity = any(c not in excavated.columns for c in CLUTCH_COLUMNS)
    merged = join_suffixed(
        excavated.dropna("any", subset=[c for c in CLUTCH_COLUMNS if c in excavated.columns]),
        identified.where(F.col("event_id").isNotNull()),
        "event_id",
        "inner" if needs_identity else "left",
    )
    pick = [
        F.col(f"{c}_x").alias(c) if f"{c}_x" in merged.columns else F.col(c) for c in CLUTCH_COLUMNS
    ]
    rows = older.select(*CLUTCH_COLUMNS).unionByName(merged.select(*pick))
    return rows.withColumns(
        {"year": F.year("dt"), "month": F.month("dt"), "day": F.dayofmonth("dt")}
    ).dropna("any")


def clutch_with_size(clutches: DataFrame, measured: DataFrame) -> DataFrame:
    """Left join of the season-filtered body size on individual and event; fan-out is kept."""
    sizes = measured.select("id", "event_id", "size")
    return null_safe_join(clutches, sizes, ["id", "event_id"], "left")


def clutch_return_interval(df: DataFrame) -> DataFrame:
    """Years since the previous clutch of the individual (0 within a season); complete rows only.

    The lag runs before incomplete rows are dropped. Ties within a year are ordered by event id and
    then by the remaining columns. No individual is windowed whole: only the first clutch of a year can
    have a non-zero interval, so years are combined first.
    """
    order = ["year", "event_id", *[c for c in df.columns if c not in ("id", "year", "event_id")]]
    return (
        _lag_by_year(df, order)
        .withColumn("return_interval", F.col("year") - F.col("prev_year"))
        .dropna("any")
    )


def _lag_by_year(rows: DataFrame, order: list[str]) -> DataFrame:
    """Same result without a window over all rows of an individual.

    The first row of each year gets the earlier year, every other row its own. Exact copies of a first
    row are counted before the shuffle; one of them takes the earlier year (which one does not
    matter, they are alike) and the rest are written out again in blocks spread over the tasks.
    """
    rest = order[1:]
    tagged = rows.withColumn("__first_of", F.struct(*rest))
    years = tagged.groupBy("id", "year").agg(F.min("__first_of").alias("__first"))
    before = F.lag("year").over(W.partitionBy("id").orderBy("year"))
    years = years.withColumn("__before", before)
    marked = null_safe_join(tagged, years, ["id", "year"])
    is_first = F.col("__first_of").eqNullSafe(F.col("__first"))
    columns = rows.columns
    later = marked.where(~is_first).select(*columns, F.col("year").alias("prev_year"))
    copies = marked.where(is_first).groupBy(*columns, "__before").agg(F.count(F.lit(1)).alias("__n"))
    leader = copies.select(*columns, F.col("__before").alias("prev_year"))
    followers = (
        copies.where(F.col("__n") > 1)
        .withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 2) / BLOCK))))
        .repartition(*columns, "__block")
        .withColumn("__start", F.col("__block") * BLOCK)
        .withColumn(
            "__copy",
            F.explode(
                F.sequence(
                    F.col("__start"),
                    F.least(F.col("__start") + (BLOCK - 1), F.col("__n") - 2),
                )
            ),
        )
        .select(*columns, F.col("year").alias("prev_year"))
    )
    return reduce(DataFrame.unionByName, [later, leader, followers])
