"""Sighting and clutch tables: declared types, permissive reads, rejects, profile, export."""

from __future__ import annotations

import csv
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# Column names of the input files, with the name and type used from there on.
SIGHTINGS = {
    "OriginalTagID": ("id", T.StringType()),
    "SPNWR_ID": ("event_id", T.StringType()),
    "DateOfActivity": ("dt", T.StringType()),
    "Result": ("result", T.StringType()),
    "CurvedCarapaceLength_NtoN": ("size", T.DoubleType()),
    "CurvedCarapaceWidth": ("width", T.DoubleType()),
}
EXCAVATION = {
    "SPNWR_ID": ("event_id", T.StringType()),
    "Total unhatched": ("unhatched", T.DoubleType()),
    "Total eggs": ("eggs", T.DoubleType()),
    "Hatch success (%)": ("hatch", T.DoubleType()),
    "OriginalTagID": ("id", T.StringType()),
    "Date": ("dt", T.StringType()),
    "DateOfActivity": ("dt", T.StringType()),
}

Columns = Mapping[str, tuple[str, T.DataType]]


def read_csv(spark: SparkSession, path: str, columns: Columns, keep_corrupt: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV with a header. Named columns get their declared type, all others stay text.

    Only the header line is looked at beforehand; nothing is inferred from data. ``NA`` and empty
    cells are null. With ``keep_corrupt`` each row is parsed in full and a bad one also carries its
    source line; without it only the columns a query uses are parsed.
    """
    header = spark.read.csv(path, header=True).columns
    fields = [
        T.StructField(c, columns[c][1] if c in columns else T.StringType()) for c in header
    ]
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
    reader = spark.read.option("columnPruning", not keep_corrupt)
    return reader.schema(T.StructType(fields)).csv(
        path,
        header=True,
        nullValue="NA",
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        multiLine=multi_line,
        enforceSchema=False,
    )


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as CSV lines, ``value``; null cells are ``NA``."""
    return df.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"nullValue": "NA"}).alias("value"))


def parse_csv_lines(lines: DataFrame, header: list[str], columns: Columns, keep_corrupt: bool = False) -> DataFrame:
    """CSV lines without a header line, ``value``, as columns of their declared types."""
    return lines.select(_parsed(F.col("value"), header, columns, keep_corrupt).alias("row")).select("row.*")


def _parsed(line: Column, header: list[str], columns: Columns, keep_corrupt: bool) -> Column:
    """A CSV line as a struct with the header's names and their declared types."""
    fields = [T.StructField(c, columns[c][1] if c in columns else T.StringType()) for c in header]
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
    options = {
        "nullValue": "NA",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true",
    }
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return F.from_csv(line, schema, options)


LAYOUTS = 64
"""More different headers under one path are taken for files without any: an error."""


def read_layouts(spark: SparkSession, path: str | list[str], columns: Columns, keep_corrupt: bool = False) -> DataFrame:
    """CSV files of different headers under one path: known columns under their short names, and `source_file`.

    Each file's first line is its header; columns are bound by name, file by file, in any order. A short name that a
    file has not is null in its rows. With ``keep_corrupt`` a bad row carries its source line. Files without lines
    give no rows; records over several lines are not read this way. Only the different headers reach the driver;
    the lines are read once for them, and then parsed in one pass.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        "value", meta["file_path"].alias("source_file"), meta["file_block_start"].alias("__start"), F.monotonically_increasing_id().alias("__at")
    )
    headers = lines.where("__start = 0").groupBy("source_file").agg(F.min_by("value", "__at").alias("__header"))
    found = sorted(r[0] for r in headers.select("__header").distinct().limit(LAYOUTS + 1).collect())
    if len(found) > LAYOUTS:
        raise ValueError(f"more than {LAYOUTS} different headers under {path}")
    short = {name: kind for name, kind in columns.values()}
    empty = F.struct(*[F.lit(None).cast(kind).alias(name) for name, kind in short.items()])
    record, bad = empty, F.lit(None).cast("string")
    for line in found:
        header = [c.strip() for c in next(csv.reader([line], skipinitialspace=True))]
        if len(set(header)) < len(header):
            raise ValueError(f"a header names a column twice: {line}")
        row = _parsed(F.col("value"), header, columns, keep_corrupt)
        cells = {name: [row[c] for c, (n, _) in columns.items() if n == name and c in header] for name in short}
        own = F.struct(*[F.coalesce(*cells[n], F.lit(None).cast(kind)).alias(n) for n, kind in short.items()])
        here = F.col("__header") == line
        record = F.when(here, own).otherwise(record)
        if keep_corrupt:
            bad = F.when(here, row[CORRUPT]).otherwise(bad)
    rows = lines.join(headers, "source_file").where((F.col("value") != F.col("__header")) & (F.trim("value") != ""))
    out = rows.select("source_file", record.alias("__row"), *([bad.alias(CORRUPT)] if keep_corrupt else []))
    return out.select("__row.*", "source_file", *([CORRUPT] if keep_corrupt else []))


def canonical(df: DataFrame, columns: Columns) -> DataFrame:
    """Keep the known columns under their short names. Where several have the same one, the first that has
    a value is taken."""
    found: dict[str, list[Column]] = {}
    for c, (name, _) in columns.items():
        if c in df.columns:
            found.setdefault(name, []).append(F.col(f"`{c}`"))
    return df.select(*[F.coalesce(*cells).alias(name) for name, cells in found.items()])


def read_sightings(spark: SparkSession, path: str, columns: Columns = SIGHTINGS) -> DataFrame:
    df = read_csv(spark, path, columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return canonical(df, columns)


def read_clutches(spark: SparkSession, path: str | list[str], columns: Columns = EXCAVATION) -> DataFrame:
    """Excavations from files whose headers may differ, one row a line."""
    return read_layouts(spark, path, columns).drop("source_file")


def rejects(df: DataFrame) -> DataFrame:
    """Rows of a ``keep_corrupt`` read that did not parse, with all their columns."""
    return df.where(F.col(CORRUPT).isNotNull())


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values. One pass with approximate distinct values;
    ``exact`` ones cost a shuffle of each column's values, combined beforehand."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("type"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"),
            distinct(F.col(f"`{c}`")).alias("distinct"),
        )
        for c, t in df.dtypes
    ]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Export a cleaned table as parquet or CSV."""
    if kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "csv":
        df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)
    else:
        raise ValueError(f"unknown kind: {kind}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; on one machine without it, a temporary one."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="resight-")
    return f"{own.rstrip('/')}/{name}-{uuid.uuid4().hex}"
