"""Random-intercept model by restricted maximum likelihood, for all rows or for every group of some columns.

For a random intercept an individual enters the likelihood only through its number of rows, its means and the
spread around them, and individuals with the same number of rows add up. So two aggregates leave one row per
distinct number of rows (and group): of r rows at most sqrt(2 r), whatever the individuals. Those of a group meet in
one row, where its ratio of variances is sought on ever finer grids, for all groups of a batch together.

Everything is one lazy plan that reads its input once. Sums are kept as means and spreads around them, so that values
far from zero (years, say) lose no digits.

Rows with a null value or individual are left out; a group of none has no row in the result. Null keys are a group.
Estimates are null for fewer than three rows, for a predictor of one value and for values that are no numbers. Where
every individual has one row, or there is only one, the ratio cannot be told and is 0 (`singular`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resight.operators.skew import null_safe_join

SINGULAR = 1e-4


@dataclass(frozen=True)
class MixedFit:
    intercept: float
    slope: float
    se: tuple[float, float]
    sigma: float
    tau: float
    criterion: float
    rows: int
    groups: int

    @property
    def singular(self) -> bool:
        return self.tau <= SINGULAR * self.sigma

    def summary(self, spark: SparkSession) -> DataFrame:
        rows = [
            (name, est, se, est / se if se > 0 else None)
            for name, est, se in zip(("intercept", "slope"), (self.intercept, self.slope), self.se)
        ]
        fixed = spark.createDataFrame(
            rows, "term string, estimate double, se double, t double"
        )
        extra = {
            "sigma": self.sigma,
            "tau": self.tau,
            "reml": self.criterion,
            "singular": self.singular,
        }
        counts = {"n": F.lit(self.rows).cast("long"), "groups": F.lit(self.groups).cast("long")}
        return fixed.withColumns({**{k: F.lit(v) for k, v in extra.items()}, **counts})

    def random_effects(self, df: DataFrame, y: str, x: str, group: str = "id") -> DataFrame:
        """Predicted intercept offset per individual."""
        ratio = (self.tau / self.sigma) ** 2 if self.sigma > 0 else 0.0
        off = F.col(y) - F.lit(self.intercept) - F.lit(self.slope) * F.col(x)
        return (
            _complete(df, y, x, group)
            .groupBy(group)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(off).alias("__s"))
            .select(group, "n", (ratio * F.col("__s") / (1 + ratio * F.col("n"))).alias("effect"))
        )

    def fixed_residuals(self, df: DataFrame, y: str, x: str) -> DataFrame:
        """Rows with the population-level fit and residual."""
        fit = F.lit(self.intercept) + F.lit(self.slope) * F.col(x)
        return df.withColumn("fitted", fit).withColumn("residual", F.col(y) - F.col("fitted"))


    def conditional(self, df: DataFrame, y: str, x: str, group: str = "id") -> DataFrame:
        """Complete rows with the fit and residual that include the individual's offset."""
        rows = self.fixed_residuals(_complete(df, y, x, group), y, x)
        effects = self.random_effects(df, y, x, group).select(group, "effect")
        return (
            null_safe_join(rows, effects, [group])
            .withColumn("fitted", F.col("fitted") + F.col("effect"))
            .withColumn("residual", F.col(y) - F.col("fitted"))
        )


def _complete(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(x).isNotNull() & F.col(group).isNotNull())


POINTS = 96
"""Roots of the variance ratio that one round tries."""
ROUNDS = 5

SIZE = ("n", "groups", "x", "y", "vxx", "vxy", "vyy", "wxx", "wxy", "wyy", "low", "high")
"""Of the individuals with `n` rows: how many, the mean and spread of their means, the spread within, the range of x."""

ESTIMATES = ("intercept", "slope", "intercept_se", "slope_se", "sigma", "tau", "reml")


def _sizes(rows: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """One row per group with the array of its SIZE rows."""
    n, x, y = F.col("__n"), F.col("__x"), F.col("__y")
    spread = {"xx": F.var_pop(x), "xy": F.covar_pop(x, y), "yy": F.var_pop(y)}
    individuals = rows.groupBy(*by, group).agg(
        F.count(F.lit(1)).cast("double").alias("__n"),
        F.avg(x).alias("__mx"),
        F.avg(y).alias("__my"),
        *[agg.alias(f"__{name}") for name, agg in spread.items()],
        F.min(x).alias("__low"),
        F.max(x).alias("__high"),
    )
    x, y = F.col("__mx"), F.col("__my")
    values = {
        "groups": F.count(F.lit(1)).cast("double"),
        "x": F.avg(x),
        "y": F.avg(y),
        "vxx": F.var_pop(x),
        "vxy": F.covar_pop(x, y),
        "vyy": F.var_pop(y),
        **{f"w{c}": F.sum(n * F.col(f"__{c}")) for c in spread},
        "low": F.min("__low"),
        "high": F.max("__high"),
    }
    sizes = individuals.groupBy(*by, n).agg(*[agg.alias(f"__{name}") for name, agg in values.items()])
    return sizes.groupBy(*by).agg(F.collect_list(F.struct(*[F.col(f"__{c}").alias(c) for c in SIZE])).alias("__sizes"))


def _profile(sizes: dict[str, np.ndarray], starts: np.ndarray):
    """A function from one root a group to the criterion and estimates of all groups; and their means and rows."""

    def total(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, starts, axis=-1)

    n, m = sizes["n"], sizes["groups"]
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
    rows = total(m * n)
    mean_x, mean_y = total(m * n * sizes["x"]) / rows, total(m * n * sizes["y"]) / rows
    dx, dy = sizes["x"] - mean_x[of], sizes["y"] - mean_y[of]
    spreads = (sizes["vxx"] + dx * dx, sizes["vxy"] + dx * dy, sizes["vyy"] + dy * dy)
    between = m * n * np.stack([np.ones_like(dx), dx, dy, *spreads])
    within = total(np.stack([sizes["wxx"], sizes["wxy"], sizes["wyy"]]))
    free = np.where(rows > 2, rows - 2, np.nan)

    def at(root: np.ndarray):
        grown = (root * root)[of] * n
        a11, a12, c1, *shared = total(between / (1 + grown))
        a22, c2, yy = (w + b for w, b in zip(within, shared, strict=True))
        det = a11 * a22 - a12 * a12
        first, second = (a22 * c1 - a12 * c2) / det, (a11 * c2 - a12 * c1) / det
        rss = np.maximum(yy - first * c1 - second * c2, 1e-300)
        score = total(m * np.log1p(grown)) + np.log(det) + free * (1 + np.log(2 * np.pi * rss / free))
        return score, first, second, rss / free, (a22 / det, a12 / det, a11 / det)

    return at, mean_x, mean_y, rows


def _solved(sizes: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
    """Estimates of groups whose SIZE rows lie one after the other from `starts` on."""
    at, mean_x, mean_y, rows = _profile(sizes, starts)
    each = np.arange(len(starts))
    grid = np.tile(np.concatenate([[0.0], np.geomspace(1e-3, 1e3, POINTS - 1)]), (len(starts), 1))
    zero, *_ = at(np.zeros(len(starts)))
    for _ in range(ROUNDS):
        scores = np.stack([at(grid[:, k])[0] for k in range(POINTS)], axis=1)
        best = np.argmin(np.where(np.isnan(scores), np.inf, scores), axis=1)
        root, score = grid[each, best], scores[each, best]
        low, high = grid[each, np.maximum(best - 1, 0)], grid[each, np.minimum(best + 1, POINTS - 1)]
        grid = np.linspace(low, high, POINTS, axis=1)
    individuals = np.add.reduceat(sizes["groups"], starts)
    told = (individuals > 1) & (individuals < rows) & (score < zero)
    root = np.where(told, root, 0.0)
    score, first, second, variance, (i11, i12, i22) = at(root)
    # Back from centred variables: the intercept moves, and so does its variance.
    found = {
        "intercept": mean_y + first - second * mean_x,
        "slope": second,
        "intercept_se": np.sqrt(variance * (i11 + 2 * mean_x * i12 + mean_x * mean_x * i22)),
        "slope_se": np.sqrt(variance * i22),
        "sigma": np.sqrt(variance),
        "tau": root * np.sqrt(variance),
        "reml": score,
    }
    varied = np.maximum.reduceat(sizes["high"], starts) > np.minimum.reduceat(sizes["low"], starts)
    fine = varied & (rows > 2) & np.logical_and.reduce([np.isfinite(v) for v in found.values()])
    return {"n": rows.astype(np.int64), "groups": individuals.astype(np.int64), "fine": fine, **found}


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, the arrays of SIZE rows, by the estimates."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        lengths = np.asarray(lists.value_lengths())
        if not lengths.sum():
            continue
        # Only a table without keys and rows has an empty list, and then it is the only one.
        flat = lists.flatten()
        sizes = {c: np.asarray(flat.field(k), dtype=np.float64) for k, c in enumerate(SIZE)}
        with np.errstate(all="ignore"):
            found = _solved(sizes, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        empty = ~found["fine"]
        singular = found["tau"] <= SINGULAR * found["sigma"]
        columns = [pa.array(found["n"]), pa.array(found["groups"])]
        columns += [pa.array(found[c], mask=empty) for c in ESTIMATES] + [pa.array(singular, mask=empty)]
        kept = [batch.column(k) for k in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(kept + columns, names=[*batch.schema.names[:-1], "n", "groups", *ESTIMATES, "singular"])


def fit_random_intercept_by(df: DataFrame, y: str, x: str, by: Sequence[str] = (), group: str = "id") -> DataFrame:
    """One row per group: n, groups, intercept, slope, their standard errors, sigma, tau, reml and singular.

    Lazy: no job runs until the result is read. Keys may be of any type.
    """
    rows = _complete(df, y, x, group).select(*by, group, F.col(y).cast("double").alias("__y"), F.col(x).cast("double").alias("__x"))
    sizes = _sizes(rows, by, group)
    fields = [sizes.schema[c] for c in by]
    fields += [T.StructField(c, T.LongType()) for c in ("n", "groups")] + [T.StructField(c, T.DoubleType()) for c in ESTIMATES]
    return sizes.mapInArrow(_fitted, T.StructType([*fields, T.StructField("singular", T.BooleanType())]))


def terms_by(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two rows a group: estimate, standard error and t of the intercept and the slope."""
    both = F.array(
        *[F.struct(F.lit(c).alias("term"), F.col(c).alias("estimate"), F.col(f"{c}_se").alias("se")) for c in ("intercept", "slope")]
    )
    rest = ("sigma", "tau", "reml", "singular", "n", "groups")
    rows = fits.select(*by, F.explode(both).alias("__term"), *rest)
    t = F.try_divide(F.col("__term.estimate"), F.col("__term.se"))
    return rows.select(*by, "__term.*", t.alias("t"), *rest)


def _offset(n: Column, total: Column) -> Column:
    ratio = F.pow(F.col("__tau") / F.nullif(F.col("__sigma"), F.lit(0.0)), 2)
    return F.coalesce(ratio, F.lit(0.0)) * total / (1 + F.coalesce(ratio, F.lit(0.0)) * n)


def _estimated(df: DataFrame, fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the estimates of their group; groups without estimates drop out."""
    names = ("intercept", "slope", "sigma", "tau")
    known = fits.where("reml is not null").select(*by, *[F.col(c).alias(f"__{c}") for c in names])
    return null_safe_join(df, known, list(by))


def random_effects_by(df: DataFrame, fits: DataFrame, y: str, x: str, by: Sequence[str], group: str = "id") -> DataFrame:
    """Predicted intercept offset per individual of each group with estimates, from its sums."""
    sums = _complete(df, y, x, group).groupBy(*by, group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("__y"), F.avg(F.col(x).cast("double")).alias("__x")
    )
    n, off = F.col("n"), F.col("__y") - F.col("__intercept") - F.col("__slope") * F.col("__x")
    return _estimated(sums, fits, by).select(*by, group, "n", _offset(n, n * off).alias("effect"))


def fit_random_intercept(df: DataFrame, y: str, x: str, group: str = "id") -> MixedFit:
    """The fit of all rows; one job, one row to the driver."""
    row = fit_random_intercept_by(df, y, x, (), group).first()
    if row is None:
        raise ValueError("no complete rows")
    if row["reml"] is None:
        raise ValueError("a line needs three rows and two values of the predictor")
    return MixedFit(
        row["intercept"], row["slope"], (row["intercept_se"], row["slope_se"]),
        row["sigma"], row["tau"], row["reml"], row["n"], row["groups"],
    )
