"""Mid-ranks and rank tests over whole tables.

Rows are first counted per distinct value, so copies and ties never travel. Distinct values are then
cut into ordered buckets at sketch quantiles, one bucket per shuffle partition; counts run inside a
bucket and the totals of earlier buckets are added. No step sorts all values in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from resight.functions import tails
from resight.operators.skew import null_safe_join


def _bucket(value: Column, cuts: Column, step: int) -> Column:
    """How many cut points are below the value, by a coarse and then a fine scan."""
    below = lambda points: F.size(F.filter(points, lambda c: c < value))
    size = F.size(cuts)
    marks = F.transform(
        F.sequence(F.lit(1), F.ceil(size / F.lit(step)).cast("int")),
        lambda i: cuts[F.least(i * step, size) - 1],
    )
    block = below(marks)
    return block * step + below(F.slice(cuts, block * step + 1, F.lit(step)))


def bucketed(counts: DataFrame, value: str) -> DataFrame:
    """Add ``__bucket``, an ordered cut of the value's range that depends on the value alone."""
    buckets = max(2, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = counts.agg(
        F.array_distinct(F.percentile_approx(value, probs, max(10_000, 4 * buckets)))
    ).scalar()
    step = max(2, math.isqrt(buckets))
    return counts.withColumn("__cuts", cuts).withColumn(
        "__bucket", F.coalesce(_bucket(F.col(value), F.col("__cuts"), step), F.lit(0))
    ).drop("__cuts")


def running_totals(counts: DataFrame, value: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``upto``, the total of ``n`` over rows of the same ``by`` key with a value not above this one."""
    by = list(by)
    counts = bucketed(counts, value)
    # The range frame takes in all rows that share the value.
    inside = W.partitionBy(*by, "__bucket").orderBy(value)
    placed = counts.withColumn(
        "__within", F.sum(n).over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    )
    totals = counts.groupBy(*by, "__bucket").agg(F.sum(n).alias("__total"))
    before = W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *by, "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before")
    )
    return null_safe_join(placed, totals, [*by, "__bucket"]).withColumn(
        "upto", F.col("__before") + F.col("__within")
    ).drop("__before", "__within")


def midranks(
    df: DataFrame, value: str, by: Sequence[str] = (), group: str | None = None
) -> DataFrame:
    """One row per distinct value (and group): ``n``, ``ties``, ``first_rank``, ``midrank``.

    Ranks run over all groups within each ``by`` key. ``ties`` counts the rows of all groups that share
    the value, ``first_rank`` is the lowest of their positions.
    """
    by = list(by)
    columns = [*by, *([group] if group else []), value]
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    )
    placed = running_totals(counts, value, "n", by)
    if group:
        # Equal values are in the same bucket, whose layout this window shares.
        same = W.partitionBy(*by, "__bucket", value)
        placed = placed.withColumn("ties", F.sum("n").over(same))
    else:
        placed = placed.withColumn("ties", F.col("n"))
    return placed.select(
        *columns,
        "n",
        "ties",
        (F.col("upto") - F.col("ties") + 1).alias("first_rank"),
        (F.col("upto") - (F.col("ties") - 1) / 2).alias("midrank"),
    )


def rank_sums(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: ``n``, ``rank_sum`` and its share of the tie term sum(t^3 - t)."""
    t = F.col("ties").cast("double")
    return (
        midranks(df.where(F.col(group).isNotNull()), value, by, group)
        .groupBy(*by, group)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("midrank")).alias("rank_sum"),
            F.sum(F.col("n") * (t * t - 1)).alias("tie_term"),
        )
    )


def kruskal_wallis(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-corrected H, degrees of freedom and p."""
    n = F.col("n_total").cast("double")
    out = (
        rank_sums(df, value, group, by)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("n_total"),
            F.count(F.lit(1)).alias("k"),
            F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("__r2"),
            F.sum("tie_term").alias("__ties"),
        )
        .withColumn("__h", 12 / (n * (n + 1)) * F.col("__r2") - 3 * (n + 1))
        .withColumn("h", F.try_divide(F.col("__h"), 1 - F.try_divide(F.col("__ties"), n * n * n - n)))
        .withColumn("df", (F.col("k") - 1).cast("double"))
    )
    p = tails.columns()["chi2"](F.col("h"), F.col("df"))
    return out.select(*by, F.col("n_total").alias("n"), "k", "h", "df", p.alias("p"))


def pairs(groups: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Each unordered pair of group rows as structs ``a`` and ``b``, from per-group aggregates."""
    rest = [F.col(c) for c in groups.columns if c not in (group, *by)]
    row = F.struct(F.col(group), *rest)
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    a = groups.select(*by, row.alias("a"), F.count(F.lit(1)).over(whole).alias("k"))
    b = groups.select(*by, row.alias("b"))
    keys = list(by) or ["__all"]
    if not by:
        a, b = a.withColumn("__all", F.lit(0)), b.withColumn("__all", F.lit(0))
    both = null_safe_join(a, b, keys).where(F.col(f"a.{group}") < F.col(f"b.{group}"))
    return both if by else both.drop("__all")


def _dunn(df: DataFrame, value: str, group: str, by: Sequence[str], alpha: float) -> DataFrame:
    sums = rank_sums(df, value, group, by)
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    sums = sums.withColumns(
        {"n_total": F.sum("n").over(whole), "tie_total": F.sum("tie_term").over(whole)}
    )
    n = F.col("a.n_total").cast("double")
    variance = (n * (n + 1) / 12 - F.col("a.tie_total") / (12 * (n - 1))) * (
        1 / F.col("a.n") + 1 / F.col("b.n")
    )
    z = F.try_divide(
        F.col("a.rank_sum") / F.col("a.n") - F.col("b.rank_sum") / F.col("b.n"), F.sqrt(variance)
    )
    m = F.col("k") * (F.col("k") - 1) / 2
    out = pairs(sums, group, by).select(
        *by,
        F.col(f"a.{group}").alias("__first"),
        F.col(f"b.{group}").alias("__second"),
        z.alias("z"),
        m.alias("__m"),
    )
    return (
        out.withColumn("p", tails.columns()["normal"](F.col("z")))
        .withColumn("p_adjusted", F.col("p") * F.col("__m"))
        .withColumn("p_adjusted", F.when(F.col("p_adjusted") > 1, 1.0).otherwise(F.col("p_adjusted")))
        .withColumn("significant", F.col("p_adjusted") < alpha)
        .drop("__m")
    )


def dunn(
    df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = 0.05
) -> DataFrame:
    """Pairwise comparisons after the rank test, with the Bonferroni correction."""
    comparison = F.concat_ws(" - ", "__first", "__second").alias("comparison")
    return _dunn(df, value, group, by, alpha).select(*by, comparison, "z", "p", "p_adjusted", "significant")


def letters(
    tests: DataFrame, first: str, second: str, significant: str = "significant", by: Sequence[str] = (), name: str = "group"
) -> DataFrame:
    """Compact letters of pairwise tests: groups share a letter just if no test tells them apart.

    ``tests`` has a row per compared pair. The letters are the largest sets of groups without a significant pair:
    starting from all groups, each significant pair splits the sets that hold both, and sets inside another go.
    They are named in the order of their sorted members, after z with a number added. An unknown significance is
    none; rows without both names, or of a group with itself, are left out, and so are groups compared with nothing.
    One row per group and ``by`` keys, from map-side combined sets of names. It is a display for tens of groups: in
    the worst case the sets grow exponentially with them, as letters do.
    """
    a, b = F.col(first), F.col(second)
    told = F.when(F.col(significant), F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    known = tests.where(a.isNotNull() & b.isNotNull() & (a != b)).groupBy(*by).agg(
        F.array_sort(F.array_union(F.collect_set(a), F.collect_set(b))).alias("__groups"),
        F.array_sort(F.collect_set(told)).alias("__told"),
    )

    def split(sets: Column, pair: Column) -> Column:
        def parts(c: Column) -> Column:
            both = F.array_contains(c, pair["a"]) & F.array_contains(c, pair["b"])
            return F.when(both, F.array(F.array_remove(c, pair["a"]), F.array_remove(c, pair["b"]))).otherwise(F.array(c))

        found = F.array_distinct(F.flatten(F.transform(sets, parts)))

        def inside(c: Column) -> Column:
            return F.exists(found, lambda d: (F.size(d) > F.size(c)) & (F.size(F.array_except(c, d)) == 0))

        return F.filter(found, lambda c: ~inside(c))

    def letter(k: Column) -> Column:
        return F.concat(F.char(97 + k % 26), F.when(k >= 26, F.floor(k / 26).cast("string")).otherwise(""))

    rows = known.withColumn("__sets", F.array_sort(F.aggregate("__told", F.array("__groups"), split)))

    def named(group: Column) -> Column:
        own = F.transform("__sets", lambda c, k: F.when(F.array_contains(c, group), letter(k)))
        return F.struct(group.alias("g"), F.array_join(own, "").alias("l"))

    out = rows.select(*by, F.explode(F.transform("__groups", named)).alias("__row"))
    return out.select(*by, F.col("__row.g").alias(name), F.col("__row.l").alias("letters"))


def dunn_letters(
    df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = 0.05
) -> DataFrame:
    """The letters of Dunn's comparisons, one row per group."""
    return letters(_dunn(df, value, group, by, alpha), "__first", "__second", "significant", by, group)


def comparison_key(c: Column) -> Column:
    """The form that labels are matched on: ranges of numbers as ``1_10``, the two groups parted by a hyphen."""
    return F.regexp_replace(F.regexp_replace(c, r"([0-9]+)-([0-9]+)", "$1_$2"), " - ", "-")


def signed_rank(
    df: DataFrame, value: str, mu: float, by: Sequence[str] = (), exact: bool | None = None
) -> DataFrame:
    """One-sample signed-rank test: V, z with continuity correction, p.

    ``exact`` asks for the exact p (given where there are no ties or zeros) or the normal one; by default it
    is exact below 50 differences without ties or zeros, as in common practice.
    """
    away = df.where(F.col(value).isNotNull()).withColumn("__d", F.col(value) - F.lit(mu))
    away = away.select(
        *by, F.abs("__d").alias("__abs"), (F.col("__d") > 0).alias("__up")
    )
    zeros = away.groupBy(*(by or [F.lit(0).alias("__all")])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("__abs") == 0).alias("zeros")
    )
    t = F.col("ties").cast("double")
    ranked = midranks(away.where(F.col("__abs") > 0), "__abs", by, "__up")
    sums = ranked.groupBy(*(by or [F.lit(0).alias("__all")])).agg(
        F.sum("n").alias("n_used"),
        F.sum(F.when(F.col("__up"), F.col("n") * F.col("midrank")).otherwise(0.0)).alias("v"),
        F.sum(F.col("n") * (t * t - 1)).alias("__ties"),
    )
    both = null_safe_join(zeros, sums, list(by) or ["__all"], "left")
    m = F.col("n_used").cast("double")
    spread = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("__ties") / 48)
    shift = F.col("v") - m * (m + 1) / 4
    out = both.withColumn("z", F.try_divide(shift - F.signum(shift) * 0.5, spread))
    countable = (F.col("__ties") == 0) & (F.col("zeros") == 0)
    counted = countable & {None: F.col("n_used") < 50, True: F.lit(True), False: F.lit(False)}[exact]
    p_exact = tails.columns()["signed_rank"](
        F.when(counted, F.col("v")), F.when(counted, F.col("n_used").cast("double"))
    )
    p = F.coalesce(p_exact, tails.columns()["normal"](F.col("z")))
    return out.select(*by, "n", "n_used", "v", "z", p.alias("p"))
