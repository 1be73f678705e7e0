"""Exact medians and quartiles, and summaries built on them.

The built-in exact ``percentile`` keeps every distinct value of a group in one task's memory, which a
continuous measure does not survive at scale. A first pass takes the moments of each group and sketches its
quantiles; the sketch brackets the wanted order statistics. A second pass counts the values inside the brackets,
while those between brackets collapse to one count each before the shuffle. What is put in order, by group, are
those counts: the share SHARE of a group's values for each quantile, or all of a group too small for a bracket.

It is one lazy plan of two aggregates, one join and one window, and reads its input twice; moments travel along
as a struct, so that nothing is joined again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resight.operators.skew import null_safe_join

ACCURACY = 100_000
SMALL = 20_000
"""Up to so many values two positions are more than the margin: the bracket is the group's range."""
# Twice the sketch error, plus two positions in the smallest group that relies on the sketch.
MARGIN = 2 / ACCURACY + 2 / SMALL
SHARE = 2 * MARGIN

ALL = "__all"


def _brackets(probs: Sequence[float]) -> list[float]:
    return [min(1.0, max(0.0, p + side)) for p in probs for side in (-MARGIN, MARGIN)]


def summarise(
    df: DataFrame, value: str, by: Sequence[str] = (), probs: dict[str, float] | None = None
) -> DataFrame:
    """Per group: ``n`` (all rows), ``n_valid``, ``mean``, ``sd``, ``min``, ``max`` and exact quantiles.

    Quantiles interpolate linearly between order statistics; the default is ``{"median": 0.5}``. Without
    ``by`` there is one row, also for an empty table. If a bracket ever missed, the query fails.
    """
    probs = {"median": 0.5} if probs is None else probs
    keys = list(by) or [ALL]
    qs = list(probs.values())
    rows = df.select(*by, F.col(value).cast("double").alias("__v"))
    v = F.col("__v")
    first = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(v).alias("n_valid"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.percentile_approx(v, _brackets(qs), ACCURACY).alias("__q"),
    )
    if not by:
        rows, first = rows.withColumn(ALL, F.lit(0)), first.withColumn(ALL, F.lit(0))
    moments = ["n", "n_valid", "mean", "sd", "min", "max"]
    small = F.col("n_valid") <= SMALL
    edges = [
        F.when(small, F.col(bound)).otherwise(F.col("__q")[2 * i + side]).alias(f"__{i}{tag}")
        for i in range(len(qs))
        for side, tag, bound in ((0, "lo", "min"), (1, "hi", "max"))
    ]
    # Rows without a value keep their group; they count nothing and come first.
    placed = null_safe_join(rows, first.select(*keys, F.struct(*moments).alias("__m"), *edges), keys)
    inside, region = F.lit(False), F.lit(0)
    for i in range(len(qs)):
        inside = inside | v.between(F.col(f"__{i}lo"), F.col(f"__{i}hi"))
        region = region + (v > F.col(f"__{i}hi")).cast("int")
    counts = (
        placed.withColumn("__in", F.coalesce(inside, F.lit(False)))
        .withColumn("__kept", F.when(F.col("__in"), v))
        .withColumn("__region", F.when(F.col("__in"), F.lit(-1)).otherwise(F.coalesce(region, F.lit(-2))))
        .groupBy(*keys, "__region", "__kept")
        .agg(F.count(v).alias("__n"), F.max(v).alias("__top"), F.first("__m").alias("__m"))
    )
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__top")))
    picks = [F.first("__m").alias("__m")]
    for i, p in enumerate(qs):
        h = (F.col("__m.n_valid") - 1) * p
        for tag, position in (("a", F.floor(h) + 1), ("b", F.ceil(h) + 1)):
            hit = F.struct(F.col("__top"), F.col("__kept").isNull().alias("lost"))
            picks.append(F.min(F.when((F.col("upto") >= position) & F.col("__top").isNotNull(), hit)).alias(f"__{i}{tag}"))
        picks.append(F.max(h - F.floor(h)).alias(f"__{i}f"))
    out = []
    for i, name in enumerate(probs):
        a, b, f = F.col(f"__{i}a"), F.col(f"__{i}b"), F.col(f"__{i}f")
        missed = F.raise_error(F.lit("quantile bracket missed")).cast("double")
        exact = a["__top"] + f * (b["__top"] - a["__top"])
        out.append(F.when(a["lost"] | b["lost"], missed).otherwise(exact).alias(name))
    picked = counts.withColumn("upto", upto).groupBy(*by).agg(*picks)
    # Without groups an empty table has one row, which counts nothing.
    known = [F.coalesce(F.col(f"__m.{m}"), F.lit(0).cast("long")).alias(m) if m in ("n", "n_valid") else F.col(f"__m.{m}").alias(m) for m in moments]
    return picked.select(*by, *known, *out)
