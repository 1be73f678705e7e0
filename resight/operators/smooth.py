"""Penalised regression splines, one predictor or several added up, smoothing chosen by REML.

The basis is a natural cubic spline with knots at quantiles of the distinct predictor values, written
as column expressions. One aggregation gives all means and covariances (a few hundred numbers at
most); the rest is algebra on a matrix with four columns per predictor.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.operators.quantiles import summarise
from resight.operators.reuse import cached


@dataclass(frozen=True)
class Basis:
    """Spline columns of one predictor on the unit interval, without the constant."""

    name: str
    low: float
    high: float
    knots: tuple[float, ...]

    @property
    def size(self) -> int:
        return len(self.knots) - 1

    def columns(self, x: Column) -> list[Column]:
        u = (x.cast("double") - self.low) / (self.high - self.low)
        cube = [F.pow(F.greatest(u - k, F.lit(0.0)), F.lit(3.0)) for k in self.knots]
        last = self.knots[-1]
        arcs = [(cube[j] - cube[-1]) / (last - self.knots[j]) for j in range(len(self.knots) - 1)]
        return [u] + [arc - arcs[-1] for arc in arcs[:-1]]

    def penalty(self) -> np.ndarray:
        """Integral of products of second derivatives, which are linear between knots."""
        last = self.knots[-1]

        def bend(u):
            ramp = [6 * np.maximum(u - k, 0) for k in self.knots]
            arcs = [(ramp[j] - ramp[-1]) / (last - self.knots[j]) for j in range(len(self.knots) - 1)]
            return np.array([np.zeros_like(u)] + [a - arcs[-1] for a in arcs[:-1]])

        out = np.zeros((self.size, self.size))
        for a, b in zip(self.knots, self.knots[1:]):
            points, weights = np.array([a, (a + b) / 2, b]), np.array([1, 4, 1]) * (b - a) / 6
            values = bend(points)
            out += (values * weights) @ values.T
        return out


def make_bases(df: DataFrame, xs: Sequence[str], k: int = 5) -> tuple[Basis, ...]:
    """Knots at even quantiles of each predictor's distinct values; fewer knots when there are fewer values.

    The distinct values of all predictors are one table, and their knots come from it together.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("term"), F.col(x).cast("double").alias("value")) for i, x in enumerate(xs)])
    distinct = df.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    found = {r["term"]: r for r in summarise(distinct, "value", ["term"], {f"q{i}": i / (k - 1) for i in range(k)}).collect()}
    few = [i for i, r in found.items() if r["n"] < k]
    # Fewer than k values each: all of them are knots.
    values = distinct.where(F.col("term").isin(few)).collect() if few else []
    out = []
    for i, x in enumerate(xs):
        if i not in found or found[i]["n"] < 2:
            raise ValueError(f"{x} needs at least two distinct values")
        at = np.array(sorted(r["value"] for r in values if r["term"] == i) if i in few else [found[i][f"q{j}"] for j in range(k)])
        low, high = float(at[0]), float(at[-1])
        out.append(Basis(x, low, high, tuple(float(v) for v in (at - low) / (high - low))))
    return tuple(out)


@dataclass(frozen=True)
class SmoothFit:
    y: str
    bases: tuple[Basis, ...]
    n: int
    mean_y: float
    means: tuple[float, ...]
    coefficients: np.ndarray
    covariance: np.ndarray
    lambdas: tuple[float, ...]
    edf: tuple[float, ...]
    rss: float
    tss: float
    scale: float
    criterion: float

    def _blocks(self):
        start = 0
        for b in self.bases:
            yield b, slice(start, start + b.size)
            start += b.size

    def _centred(self, basis: Basis, part: slice, x: Column) -> list[Column]:
        return [c - m for c, m in zip(basis.columns(x), self.means[part])]

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row per smooth with its effective degrees of freedom, and the model's fit measures."""
        total = 1 + sum(self.edf)
        aic = self.n * (math.log(2 * math.pi * self.rss / self.n) + 1) + 2 * (total + 1)
        adj = 1 - (self.rss / (self.n - total)) / (self.tss / (self.n - 1))
        rows = [
            (b.name, float(e), float(v), self.n, self.mean_y, total, adj, 1 - self.rss / self.tss,
             self.scale, self.criterion, aic)
            for b, e, v in zip(self.bases, self.edf, self.lambdas)
        ]
        return spark.createDataFrame(
            rows,
            "term string, edf double, lambda double, n long, intercept double, total_edf double, "
            "adj_r2 double, deviance_explained double, scale double, reml double, aic double",
        )

    def fitted(self) -> Column:
        out = F.lit(self.mean_y)
        for basis, part in self._blocks():
            for c, g in zip(self._centred(basis, part, F.col(basis.name)), self.coefficients[part]):
                out = out + c * F.lit(float(g))
        return out

    def residuals(self, df: DataFrame) -> DataFrame:
        """Complete rows with fitted value and residual; coefficients travel as literals."""
        rows = _complete(df, self.y, [b.name for b in self.bases])
        return rows.withColumn("fitted", self.fitted()).withColumn(
            "residual", F.col(self.y) - F.col("fitted")
        )

    def grid(
        self, spark: SparkSession, x: str, points: int = 200, centred: bool = False
    ) -> DataFrame:
        """Smooth of ``x`` on an even grid with a two-standard-error band.

        ``centred`` gives the smooth alone; otherwise the mean is added, which for a single smooth is
        the prediction of the model.
        """
        basis, part = next((b, p) for b, p in self._blocks() if b.name == x)
        at = basis.low + (basis.high - basis.low) * F.col("id") / (points - 1)
        z = self._centred(basis, part, F.col(x))
        v = self.covariance[part, part]
        fit = F.lit(0.0 if centred else self.mean_y)
        var = F.lit(0.0 if centred else self.scale / self.n)
        for i, a in enumerate(z):
            fit = fit + a * F.lit(float(self.coefficients[part][i]))
            for j, b in enumerate(z):
                var = var + a * b * F.lit(float(v[i, j]))
        rows = spark.range(points).select(at.alias(x)).withColumns(
            {"fit": fit, "se": F.sqrt(F.greatest(var, F.lit(0.0)))}
        )
        return rows.withColumns(
            {"lower": F.col("fit") - 2 * F.col("se"), "upper": F.col("fit") + 2 * F.col("se")}
        )


def _complete(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=[y, *xs])


def _reml(logs, gram, zy, yy, n, penalties, ranks, null_dim):
    total = np.zeros_like(gram)
    for log, s in zip(logs, penalties):
        total += math.exp(log) * s
    a = gram + total
    sign, logdet = np.linalg.slogdet(a)
    gamma = np.linalg.solve(a, zy)
    d = max(yy - gamma @ zy, 1e-300)
    free = n - null_dim
    score = free * (math.log(2 * math.pi * d / free) + 1) + logdet + math.log(n)
    score -= sum(r * log for r, log in zip(ranks, logs))
    return score, gamma, a


def fit_smooths(df: DataFrame, y: str, xs: Sequence[str], k: int = 5) -> SmoothFit:
    """Fit ``y`` on the sum of smooths of ``xs`` over complete rows."""
    with cached(_complete(df, y, xs).select(y, *xs)) as rows:
        bases = make_bases(rows, xs, k)
        n, means, cross = _moments(rows, y, bases)
    return _fit_moments(y, bases, n, means, cross)


def fit_each(df: DataFrame, y: str, xs: Sequence[str], k: int = 5) -> list[SmoothFit]:
    """One single-smooth fit per predictor, all on the rows complete in every predictor."""
    with cached(_complete(df, y, xs).select(y, *xs)) as rows:
        bases = make_bases(rows, xs, k)
        n, means, cross = _moments(rows, y, bases)
    out, start = [], 0
    for b in bases:
        # The moments of all columns hold those of every single smooth.
        own = [*range(start, start + b.size), len(means) - 1]
        start += b.size
        out.append(_fit_moments(y, (b,), n, [means[i] for i in own], cross[np.ix_(own, own)]))
    return out


def _moments(rows: DataFrame, y: str, bases: tuple[Basis, ...]):
    """Row count, column means, and sums of centred squares and products of basis columns and y."""
    columns = [c for b in bases for c in b.columns(F.col(b.name))] + [F.col(y).cast("double")]
    names = [f"z{i}" for i in range(len(columns))]
    design = rows.select(*[c.alias(n) for n, c in zip(names, columns)])
    centre = design.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names]).first()
    means = [centre[c] for c in names]
    centred = design.select(*[(F.col(c) - m).alias(c) for c, m in zip(names, means)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = centred.agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
    cross = np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, sums):
        cross[i, j] = cross[j, i] = value
    return centre["n"], means, cross


def _fit_moments(y: str, bases: tuple[Basis, ...], n: int, means: list[float], cross) -> SmoothFit:
    gram, zy, yy = cross[:-1, :-1], cross[:-1, -1], cross[-1, -1]

    penalties, ranks, parts, start = [], [], [], 0
    for b in bases:
        part = slice(start, start + b.size)
        start += b.size
        full = np.zeros_like(gram)
        # Scaled so that a smoothing parameter near one is neither loose nor stiff.
        block = b.penalty()
        weight = np.trace(gram[part, part]) / np.trace(block) if np.trace(block) > 0 else 0.0
        full[part, part] = block * weight
        penalties.append(full)
        ranks.append(b.size - 1)
        parts.append(part)
    null_dim = 1 + len(bases)

    def score(logs):
        return _reml(logs, gram, zy, yy, n, penalties, ranks, null_dim)[0]

    logs = np.zeros(len(bases))
    golden = (math.sqrt(5) - 1) / 2
    previous = math.inf
    for sweep in range(40):
        for j in range(len(bases)):
            if ranks[j] == 0:
                continue

            def along(v, j=j):
                trial = logs.copy()
                trial[j] = v
                return score(trial)

            near = np.linspace(-16, 16, 33) if sweep == 0 else logs[j] + np.array([-2.0, 0.0, 2.0])
            near = np.clip(near, -16, 16)
            best = int(np.argmin([along(v) for v in near]))
            low, high = near[max(best - 1, 0)], near[min(best + 1, len(near) - 1)]
            while high - low > 1e-7:
                a, b = high - golden * (high - low), low + golden * (high - low)
                if along(a) <= along(b):
                    high = b
                else:
                    low = a
            logs[j] = (low + high) / 2
        current = score(logs)
        if previous - current < 1e-10 * (1 + abs(current)):
            break
        previous = current
    criterion, gamma, a = _reml(logs, gram, zy, yy, n, penalties, ranks, null_dim)
    inverse = np.linalg.inv(a)
    influence = inverse @ gram
    edf = tuple(float(np.trace(influence[p, p])) for p in parts)
    rss = float(yy - 2 * gamma @ zy + gamma @ gram @ gamma)
    scale = rss / (n - 1 - sum(edf))
    return SmoothFit(
        y, bases, n, means[-1], tuple(means[:-1]), gamma,
        inverse * scale, tuple(float(math.exp(v)) for v in logs), edf, rss, float(yy), scale,
        float(criterion),
    )
