"""Kaplan-Meier curves and their summaries.

Times are whole years, so the risk table has one row per year however many individuals there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Fixed value: normal quantile of a 95% two-sided interval.
Z95 = 1.959963984540054


def kaplan_meier(df: DataFrame, strata: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Survival curve from ``time`` and ``event``: at risk, events, survival, Greenwood SE, log-type CI."""
    if not isinstance(df.schema["time"].dataType, T.IntegralType):
        raise TypeError("time must be a whole number of years")
    n = F.col(weight) if weight else F.lit(1)
    keys = list(strata)
    table = (
        df.where(F.col("time").isNotNull() & F.col("event").isNotNull())
        .groupBy(*keys, "time")
        .agg(
            F.sum(n * F.col("event")).cast("long").alias("n_event"),
            F.sum(n * (1 - F.col("event"))).cast("long").alias("n_censor"),
        )
    )
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    later = part.orderBy("time").rowsBetween(W.currentRow, W.unboundedFollowing)
    sofar = part.orderBy("time").rowsBetween(W.unboundedPreceding, W.currentRow)
    d, r = F.col("n_event"), F.col("n_risk")
    curve = (
        table.withColumn("n_risk", F.sum(F.col("n_event") + F.col("n_censor")).over(later))
        # The product keeps a zero factor, which a sum of logarithms would lose.
        .withColumn("survival", F.product(1 - d / r).over(sofar))
        .withColumn("__g", F.sum(F.try_divide(d.cast("double"), r * (r - d))).over(sofar))
        .withColumn("__se_log", F.when(F.col("survival") > 0, F.sqrt("__g")))
    )
    s, e = F.col("survival"), F.col("__se_log")
    return curve.select(
        *keys,
        "time",
        "n_risk",
        "n_event",
        "n_censor",
        "survival",
        (s * e).alias("std_err"),
        F.when(e.isNotNull(), s * F.exp(-Z95 * e)).alias("lower"),
        F.when(e.isNotNull(), F.least(F.lit(1.0), s * F.exp(Z95 * e))).alias("upper"),
    )


def survival_summary(curve: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """Median, right-endpoint area, true step area (restricted mean) and the ad-hoc ratio.

    The right-endpoint area multiplies each survival value by the interval before it and therefore
    undercounts; the step area uses the value that holds over the interval. The ratio is
    sum(t * S) / max(t). When the curve is flat at one half the median is the middle of that stretch.
    """
    keys = list(strata)
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    w = part.orderBy("time")
    s, t = F.col("survival"), F.col("time")
    gap = t - F.lag("time", 1, 0).over(w)
    half = 1e-9
    rows = curve.withColumns(
        {
            "__gap": gap,
            "__held": F.coalesce(F.lag("survival").over(w), F.lit(1.0)),
        }
    )
    reached = F.min(F.when(s <= 0.5 + half, t))
    below = F.min(F.when(s < 0.5 - half, t))
    flat = F.max(F.when(F.abs(s - 0.5) <= half, F.lit(1)).otherwise(0)) == 1
    last = F.max(t)
    return rows.groupBy(*keys).agg(
        F.max("n_risk").alias("n"),
        F.sum("n_event").alias("events"),
        F.when(flat, (reached + F.coalesce(below, reached)) / 2)
        .otherwise(reached.cast("double"))
        .alias("median"),
        F.sum(s * F.col("__gap")).alias("right_endpoint_area"),
        F.sum(F.col("__held") * F.col("__gap")).alias("restricted_mean"),
        F.try_divide(F.sum(t * s), last).alias("ratio"),
    )
