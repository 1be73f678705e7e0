"""The engine's roles mapped onto the star-schema tables: customers are individuals, orders sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.operators import clean

OUTCOMES = ("1-urgent", "2-high", "5-low")
TOLERANCE = 100_000.0
LONG_LIVED = 5
PHASES = (("1-2", 1, 2), ("3-4", 3, 4), ("5-6", 5, 6))
GROUPS_INCLUSIVE = (("1-3", 3), ("3-5", 5), ("5-6", 6), ("6+", None))
GROUPS = (("1-3", 3), ("4-5", 5), ("5+", None))
NEW_TABLE_FROM = "1998-01-01"
UNIT = 100_000.0
"""Sizes are prices; models use them in this unit so that coefficients have readable magnitudes."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sightings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").cast("date").alias("dt"),
        F.col("o_orderpriority").alias("result"),
        F.col("o_totalprice").alias("size"),
    )


def nests(spark: SparkSession, folder: str) -> DataFrame:
    return clean.with_date_parts(clean.successful_nests(sightings(spark, folder), OUTCOMES))


def measured(spark: SparkSession, folder: str) -> DataFrame:
    return clean.season_consistent(nests(spark, folder), TOLERANCE)


def with_width(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Width is the quantity on an order's lines, null for an order without lines."""
    width = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("event_id"))
        .agg(F.sum("l_quantity").alias("width"))
    )
    return rows.join(width, "event_id", "left")


def excavations(spark: SparkSession, folder: str) -> DataFrame:
    """One clutch per order with lines; the last ship date tells the newer table from the older."""
    return (
        table(spark, folder, "lineitem")
        # Stated here so that every use of this table has the same plan and shares one exchange.
        .where(F.col("l_orderkey").isNotNull())
        .groupBy(F.col("l_orderkey").alias("event_id"))
        .agg(
            F.sum("l_quantity").alias("unhatched"),
            F.count(F.lit(1)).cast("double").alias("eggs"),
            F.avg("l_discount").alias("hatch"),
            F.max("l_shipdate").alias("shipped"),
        )
    )


def clutch_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Newer excavations, identities (sharing a measure column), older excavations with identity."""
    lines = excavations(spark, folder)
    identity = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_totalprice").alias("eggs"),
        F.col("o_custkey").alias("id"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("dt"),
    )
    newer = F.col("shipped") >= F.lit(NEW_TABLE_FROM).cast("timestamp_ntz")
    old = lines.where(~newer).drop("shipped").join(identity.drop("eggs"), "event_id")
    return lines.where(newer).drop("shipped"), identity, old


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_type", "value")
