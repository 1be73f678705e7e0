"""Text forms of encounter histories: ``101 3;`` lines, and observed/expected tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_LINE = r"^\s*([01]+)\s+(\d+)\s*;\s*$"


def parse_history_lines(lines: DataFrame, occasions: int | None = None) -> DataFrame:
    """History lines among any other lines; ``occasions`` keeps only histories of that length."""
    rows = lines.where(F.col("value").rlike(HISTORY_LINE)).select(
        F.regexp_extract("value", HISTORY_LINE, 1).alias("ch"),
        F.regexp_extract("value", HISTORY_LINE, 2).cast("long").alias("n"),
    )
    return rows if occasions is None else rows.where(F.length("ch") == occasions)


def read_histories(spark: SparkSession, path: str, occasions: int | None = None) -> DataFrame:
    return parse_history_lines(spark.read.text(path), occasions)


def history_lines(frequencies: DataFrame) -> DataFrame:
    return frequencies.select(F.format_string(" %s %d;", "ch", "n").alias("value"))


def write_histories(frequencies: DataFrame, path: str, mode: str = "errorifexists") -> None:
    history_lines(frequencies).write.mode(mode).text(path)


def parse_expected_lines(lines: DataFrame) -> DataFrame:
    """``history observed expected`` separated by white space."""
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    return (
        lines.select(parts.alias("p"))
        .where((F.size("p") == 3) & F.col("p")[0].rlike("^[01]+$"))
        .select(
            F.col("p")[0].alias("ch"),
            F.col("p")[1].try_cast("double").alias("observed"),
            F.col("p")[2].try_cast("double").alias("expected"),
        )
    )


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    return parse_expected_lines(spark.read.text(path))
