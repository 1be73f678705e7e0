"""The tables behind the charts: histogram, box, density, Q-Q, bars. Drawing is left to the caller."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.functions.scalar import normal_quantile
from resight.operators.quantiles import summarise
from resight.operators.ranks import midranks
from resight.operators.skew import null_safe_join


def pretty_step(span: Column, cells: Column) -> Column:
    """Step of 1, 2, 5 or 10 times a power of ten that cuts ``span`` into about ``cells`` parts."""
    cell = span / cells
    power = F.pow(F.lit(10.0), F.floor(F.log10(cell)))
    # Larger steps are preferred by these factors (the usual rule for axis breaks).
    prefer, prefer5 = 1.5, 0.5 + 1.5 * 1.5
    return (
        F.when(10 * power - cell < prefer * (cell - 5 * power), 10 * power)
        .when(5 * power - cell < prefer5 * (cell - 2 * power), 5 * power)
        .when(2 * power - cell < prefer * (cell - power), 2 * power)
        .otherwise(power)
    )


def histogram(df: DataFrame, value: str) -> DataFrame:
    """Bins ``(low, high]`` (the lowest also closed below) with counts, empty bins included."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull()).select(v.alias("v"))
    ends = rows.agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    cells = F.ceil(F.log2("n") + 1)
    step = F.when(F.col("hi") > F.col("lo"), pretty_step(F.col("hi") - F.col("lo"), cells)).otherwise(1.0)
    breaks = ends.withColumn("step", step).select(
        F.struct(
            "step",
            F.floor(F.col("lo") / F.col("step") + 1e-7).alias("first"),
            F.greatest(
                F.ceil(F.col("hi") / F.col("step") - 1e-7),
                F.floor(F.col("lo") / F.col("step") + 1e-7) + 1,
            ).alias("last"),
        ).alias("b")
    )
    cut = rows.withColumn("b", breaks.scalar())
    index = F.greatest(
        F.ceil(F.col("v") / F.col("b.step") - 1e-7), F.col("b.first") + 1
    )
    counts = cut.groupBy(F.least(index, F.col("b.last")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # Sturges' rule gives about log2(n) bins, so this list stays tiny.
    bins = breaks.select("b", F.explode(F.sequence(F.col("b.first") + 1, F.col("b.last"))).alias("bin"))
    return bins.join(counts, "bin", "left").select(
        ((F.col("bin") - 1) * F.col("b.step")).alias("low"),
        (F.col("bin") * F.col("b.step")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _with_fences(df: DataFrame, value: str, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    keys = list(by) or ["__all"]
    rows = (df if by else df.withColumn("__all", F.lit("all"))).where(F.col(value).isNotNull())
    box = summarise(rows, value, keys, QUARTILES)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    box = box.select(
        *keys,
        *QUARTILES,
        (F.col("q1") - reach).alias("fence_low"),
        (F.col("q3") + reach).alias("fence_high"),
    )
    return null_safe_join(rows, box, keys), keys


def box_statistics(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (last values inside 1.5 IQR) and number of outliers."""
    rows, keys = _with_fences(df, value, by)
    v = F.col(value)
    inside = v.between(F.col("fence_low"), F.col("fence_high"))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(q).alias(q) for q in QUARTILES],
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
    return out if by else out.drop("__all")


def box_outliers(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows outside the whiskers."""
    rows, _ = _with_fences(df, value, by)
    out = rows.where(~F.col(value).between(F.col("fence_low"), F.col("fence_high")))
    return out.select(*by, value)


CELLS_A_BANDWIDTH = 8
"""Cells of the density are this much narrower than the kernel, whatever the range of the data."""

ORDER = 5
"""Moments that a cell keeps; with six of them a density is exact to nine digits or more."""


def _hermite(u: Column) -> list[Column]:
    """Polynomials by which the normal curve at ``u`` is expanded in a shift of its centre."""
    out = [F.lit(1.0), u]
    for k in range(1, ORDER):
        out.append(u * out[k] - k * out[k - 1])
    return out


def density(df: DataFrame, value: str, by: Sequence[str] = (), points: int = 512) -> DataFrame:
    """Gaussian kernel density on an even grid reaching three bandwidths past the data.

    Rows are summed up in cells, a fixed part of a bandwidth wide, as moments about the cell's middle, from
    which the kernel's sum over the cell follows by expansion. So the work after the first aggregation goes
    with the range in bandwidths, not with the rows.
    """
    keys = list(by) or ["__all"]
    rows = (df if by else df.withColumn("__all", F.lit("all"))).where(F.col(value).isNotNull())
    stats = summarise(rows, value, keys, {"q1": 0.25, "q3": 0.75})
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    spread = F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd"))
    stats = stats.withColumn(
        "bw", 0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    ).where(F.col("bw") > 0)
    span = (
        stats.select(
            *keys,
            "n",
            "bw",
            F.col("min").alias("lo"),
            (F.col("bw") / CELLS_A_BANDWIDTH).alias("width"),
            (F.col("min") - 3 * F.col("bw")).alias("start"),
            ((F.col("max") - F.col("min") + 6 * F.col("bw")) / (points - 1)).alias("step"),
        )
    )
    spot = (F.col(value) - F.col("lo")) / F.col("width")
    off = (spot - F.col("cell") - 0.5) / CELLS_A_BANDWIDTH
    cells = (
        null_safe_join(rows.select(*keys, value), span.select(*keys, "lo", "width"), keys)
        .withColumn("cell", F.floor(spot))
        .groupBy(*keys, "cell")
        .agg(*[F.sum(F.pow(off, F.lit(k)) / math.factorial(k)).alias(f"__m{k}") for k in range(ORDER + 1)])
    )
    centre = F.col("lo") + (F.col("cell") + 0.5) * F.col("width")
    x = F.col("start") + F.col("i") * F.col("step")
    u = (x - centre) / F.col("bw")
    moments = reduce(lambda a, b: a + b, [h * F.col(f"__m{k}") for k, h in enumerate(_hermite(u))])
    kernel = F.exp(-u * u / 2) * moments / (F.col("bw") * F.sqrt(2 * F.pi()))
    out = (
        null_safe_join(cells, span, keys)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(*keys, "i")
        .agg(
            F.max(x).alias("x"), F.sum(kernel / F.col("n")).alias("density")
        )
        .drop("i")
    )
    return out if by else out.drop("__all")


def qq_points(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Normal Q-Q table: each distinct value with its count and normal quantile at its mid-rank."""
    ranked = midranks(df, value, by)
    keys = list(by) or ["__all"]
    if not by:
        ranked = ranked.withColumn("__all", F.lit(0))
    sizes = ranked.groupBy(*keys).agg(F.sum("n").cast("double").alias("__size"))
    offset = F.when(F.col("__size") <= 10, 0.375).otherwise(0.5)
    return (
        null_safe_join(ranked, sizes, keys)
        .withColumn("share", (F.col("midrank") - offset) / (F.col("__size") + 1 - 2 * offset))
        .withColumn("theoretical", normal_quantile("share"))
        .select(*by, value, "n", "midrank", "theoretical")
    )


# Fixed value: upper quartile of the standard normal distribution.
NORMAL_Q3 = 0.6744897501960817


def qq_line(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Line through the quartiles of data and normal distribution."""
    q = summarise(df, value, by, {"q1": 0.25, "q3": 0.75})
    slope = (F.col("q3") - F.col("q1")) / (2 * NORMAL_Q3)
    return q.select(
        *by, slope.alias("slope"), ((F.col("q1") + F.col("q3")) / 2).alias("intercept")
    )


def mean_sd_bars(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Bar height with one standard deviation down and up."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        (F.avg(value) - F.stddev_samp(value)).alias("lower"),
        (F.avg(value) + F.stddev_samp(value)).alias("upper"),
    )


def group_points(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean and exact median per group, the marks put over a violin or box."""
    return summarise(df, value, by).select(*by, "mean", "median")


def mean_line(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"))


def label_heights(df: DataFrame, value: str, by: Sequence[str], factor: float = 1.1) -> DataFrame:
    """Where to put a label over each group: one height for all, above the largest value of them all."""
    tops = df.groupBy(*by).agg(F.max(value).alias("__top"))
    return tops.select(*by, (tops.select(F.max("__top")).scalar() * factor).alias("height"))


def scatter(
    df: DataFrame, x: str, y: str, fraction: float | None = None, seed: int = 1
) -> DataFrame:
    """Points of a scatter, rug or jitter plot; all rows unless a fraction is asked for."""
    points = df.select(x, y)
    return points if fraction is None else points.sample(fraction, seed)


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """All fractional columns rounded, for display."""
    return df.select(
        *[
            F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes
        ]
    )
