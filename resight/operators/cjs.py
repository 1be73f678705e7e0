"""Capture-recapture survival with constant survival (phi) and detection (p).

Spark reduces any number of histories to at most two counts per season; two parameters are then found
by Newton steps on the logit scale. The functions ending in ``_by`` do so for every group of some columns
in one lazy plan; the others hold one fit on the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resight.operators.histories import m_array
from resight.operators.skew import null_safe_join

# The steps of the grouped fit travel to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _never_again(phi: float, p: float, top: int) -> list[np.ndarray]:
    """Value, gradient (phi, p) and second derivatives (phi phi, phi p, p p) of the probability of
    not being seen again with 0..top occasions left, by recursion over occasions."""
    q = 1 - p
    rows = [np.array([np.ones_like(phi), *np.zeros((5, *np.shape(phi)))])]
    for _ in range(top):
        c, a, b, aa, ab, bb = rows[-1]
        rows.append(
            np.array(
                [
                    1 - phi + phi * q * c,
                    -1 + q * c + phi * q * a,
                    -phi * c + phi * q * b,
                    2 * q * a + phi * q * aa,
                    -c + q * b - phi * a + phi * q * ab,
                    -2 * phi * b + phi * q * bb,
                ]
            )
        )
    return rows


def _log_likelihood(beta: np.ndarray, gaps: np.ndarray, lost: np.ndarray):
    """Value, gradient and second derivatives on the logit scale of every group: rows of ``beta``; ``gaps`` and ``lost``
    hold its counts for 0, 1, ... years."""
    with np.errstate(all="ignore"):
        phi, p = (1 / (1 + np.exp(-beta))).T
        years = np.arange(gaps.shape[1])
        n, total = gaps[:, 1:].sum(1), gaps @ years
        value = total * np.log(phi) + (total - n) * np.log1p(-p) + n * np.log(p)
        g = np.stack([total / phi, n / p - (total - n) / (1 - p)], 1)
        h = np.zeros((len(beta), 2, 2))
        h[:, 0, 0], h[:, 1, 1] = -total / phi**2, -n / p**2 - (total - n) / (1 - p) ** 2
        for left, chi in enumerate(_never_again(phi, p, lost.shape[1] - 1)):
            m = lost[:, left]
            if not left or not m.any():
                continue
            c, a, b, aa, ab, bb = chi
            d = np.stack([a, b], 1) / c[:, None]
            value = value + m * np.log(c)
            g += m[:, None] * d
            bend = np.stack([np.stack([aa, ab], 1), np.stack([ab, bb], 1)], 1) / c[:, None, None]
            h += m[:, None, None] * (bend - d[:, :, None] * d[:, None, :])
        slope = np.stack([phi * (1 - phi), p * (1 - p)], 1)
        turn = slope * np.stack([1 - 2 * phi, 1 - 2 * p], 1)
        out = h * slope[:, :, None] * slope[:, None, :]
        out[:, [0, 1], [0, 1]] += g * turn
        return value, g * slope, out


def _newton(gaps: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimates, standard errors (logit scale) and log-likelihoods of all groups at once, each with steps of its own
    length until it stands still."""
    beta = np.zeros((len(gaps), 2))
    value, g, h = _log_likelihood(beta, gaps, lost)
    active = np.ones(len(gaps), bool)
    for _ in range(200):
        det = h[:, 0, 0] * h[:, 1, 1] - h[:, 0, 1] ** 2
        with np.errstate(all="ignore"):
            step = -np.stack([h[:, 1, 1] * g[:, 0] - h[:, 0, 1] * g[:, 1], h[:, 0, 0] * g[:, 1] - h[:, 0, 1] * g[:, 0]], 1) / det[:, None]
        uphill = np.isfinite(step).all(1) & ((step * g).sum(1) > 0)
        largest = np.abs(g).max(1, keepdims=True)
        step = np.where(uphill[:, None], step, g / np.maximum(1.0, largest))
        longest = np.abs(step).max(1)
        scale = np.where(longest > 5, 5.0 / np.maximum(longest, 1e-300), 1.0)
        waiting = active.copy()
        while waiting.any():
            trial = beta + np.where(waiting, scale, 0.0)[:, None] * step
            some = np.flatnonzero(waiting & (np.abs(trial).max(1) < 30))
            new = _log_likelihood(trial[some], gaps[some], lost[some])
            better = new[0] >= value[some] - 1e-12 * np.abs(value[some])
            took = some[better]
            beta[took] = trial[took]
            for old, own in zip((value, g, h), new, strict=True):
                old[took] = own[better]
            waiting[took] = False
            active[took[scale[took] * longest[took] < 1e-12]] = False
            scale = np.where(waiting, scale / 2, scale)
            stuck = waiting & (scale < 1e-12)
            active[stuck] = waiting[stuck] = False
        if not active.any():
            break
    with np.errstate(all="ignore"):
        det = h[:, 0, 0] * h[:, 1, 1] - h[:, 0, 1] ** 2
        spread = np.sqrt(np.stack([-h[:, 1, 1] / det, -h[:, 0, 0] / det], 1))
    return beta, spread, value


@dataclass(frozen=True)
class CjsFit:
    beta: tuple[float, float]
    se: tuple[float, float]
    log_likelihood: float
    releases: int
    occasions: int

    @property
    def real(self) -> tuple[float, float]:
        return tuple(1 / (1 + math.exp(-b)) for b in self.beta)

    def estimates(self, spark: SparkSession) -> DataFrame:
        """Link-scale and real-scale estimates; real limits are the back-transformed link limits."""
        rows = []
        for name, b, s in zip(("phi", "p"), self.beta, self.se):
            low, high = b - 1.96 * s, b + 1.96 * s
            back = [1 / (1 + math.exp(-v)) for v in (b, low, high)]
            rows.append((name, b, s, low, high, back[0], s * back[0] * (1 - back[0]), *back[1:]))
        return spark.createDataFrame(
            rows,
            "parameter string, beta double, beta_se double, beta_lower double, beta_upper double, "
            "estimate double, se double, lower double, upper double",
        )

    def expected_longevity(self, spark: SparkSession) -> DataFrame:
        """1 / (1 - phi) with ordered bounds."""
        phi = self.real[0]
        bounds = [1 / (1 + math.exp(-(self.beta[0] + side * 1.96 * self.se[0]))) for side in (-1, 1)]
        return spark.createDataFrame(
            [(phi, 1 / (1 - phi), 1 / (1 - bounds[0]), 1 / (1 - bounds[1]))],
            "phi double, longevity double, lower double, upper double",
        )


def _dense(counts: dict[int, int], top: int) -> np.ndarray:
    return np.array([[counts.get(k, 0) for k in range(top + 1)]], dtype=float)


def fit_counts(gaps: dict[int, int], lost: dict[int, int], occasions: int) -> CjsFit:
    """``gaps``: re-sightings by years since release; ``lost``: never seen again, by occasions left."""
    top = max([occasions - 1, *gaps, *lost])
    beta, spread, value = _newton(_dense(gaps, top), _dense(lost, top))
    releases = sum(gaps.values()) + sum(lost.values())
    return CjsFit(tuple(beta[0].tolist()), tuple(spread[0].tolist()), float(value[0]), releases, occasions)


def _counts(frequencies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Releases by whether they were lost and by years since release, or left: two rows a season and group at most."""
    return (
        m_array(frequencies, by)
        .groupBy(
            *by,
            "occasions",
            F.col("recapture").isNull().alias("lost"),
            F.coalesce(
                F.col("recapture") - F.col("release"), F.col("occasions") - F.col("release")
            ).alias("years"),
        )
        .agg(F.sum("n").alias("n"))
    )


def fit_cjs(frequencies: DataFrame) -> CjsFit:
    """Fit from ``ch`` and ``n``; brings at most two counts per season to the driver."""
    rows = _counts(frequencies).collect()
    gaps = {r["years"]: r["n"] for r in rows if not r["lost"]}
    lost = {r["years"]: r["n"] for r in rows if r["lost"]}
    if not gaps:
        raise ValueError("no animal was ever seen again")
    return fit_counts(gaps, lost, rows[0]["occasions"])


FITTED = ["phi_beta", "p_beta", "phi_beta_se", "p_beta_se", "log_likelihood"]


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in FITTED]))
def _fitted(gaps: pd.Series, lost: pd.Series) -> pd.DataFrame:
    top = max((len(x) for x in lost), default=0)
    counts = [np.stack([np.pad(np.asarray(x, dtype=float), (1, top - len(x))) for x in own]) for own in (gaps, lost)]
    beta, spread, value = _newton(*counts)
    return pd.DataFrame(np.column_stack([beta, spread, value]), columns=FITTED)


def fit_cjs_by(frequencies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One fit for each group of ``by``, as a lazy plan: the groups' estimates and standard errors on the logit scale,
    log-likelihood, ``releases`` and ``occasions``.

    Spark reduces a group to two counts a season; the groups of a batch then step together, as rows of arrays. A group
    without a re-sighting has null estimates; null keys are a group. Histories of different lengths are not mixed
    within a group: its longest sets its occasions.
    """
    counts = _counts(frequencies, by).groupBy(*by, "years", "lost").agg(F.sum("n").alias("n"), F.max("occasions").alias("occasions"))

    def by_years(lost: bool) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("lost") == lost, F.struct("years", F.col("n").cast("double")))))

    wide = counts.groupBy(*by).agg(
        F.max("occasions").alias("occasions"), F.sum("n").cast("double").alias("releases"),
        by_years(False).alias("__gaps"), by_years(True).alias("__lost"),
    ).where(F.col("occasions").isNotNull())

    def every_year(counts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.col("occasions") - 1), lambda y: F.coalesce(F.try_element_at(counts, y), F.lit(0.0)))

    dense = {c: every_year(F.col(c)) for c in ("__gaps", "__lost")}
    fits = wide.withColumn("__seen", F.size("__gaps") > 0).withColumns(dense).withColumn("__f", _fitted("__gaps", "__lost"))
    values = [F.when(F.col("__seen"), F.col(f"__f.{c}")).alias(c) for c in FITTED]
    return fits.select(*by, *values, "releases", "occasions")


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def estimates_by(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two rows a group: link-scale and real-scale estimates; real limits are the back-transformed link limits."""
    both = F.explode(
        F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(f"{n}_beta").alias("beta"), F.col(f"{n}_beta_se").alias("beta_se")) for n in ("phi", "p")])
    )
    b, s = F.col("beta"), F.col("beta_se")
    low, high, back = b - 1.96 * s, b + 1.96 * s, _logistic(b)
    return fits.select(*by, both.alias("e")).select(*by, "e.*").select(
        *by, "parameter", "beta", "beta_se", low.alias("beta_lower"), high.alias("beta_upper"),
        back.alias("estimate"), (s * back * (1 - back)).alias("se"), _logistic(low).alias("lower"), _logistic(high).alias("upper"),
    )


def expected_longevity_by(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """1 / (1 - phi) of each group with ordered bounds; null where phi is 1 within rounding."""
    b, s = F.col("phi_beta"), F.col("phi_beta_se")
    return fits.select(
        *by, _logistic(b).alias("phi"), *[F.try_divide(F.lit(1.0), 1 - _logistic(x)).alias(n) for n, x in (("longevity", b), ("lower", b - 1.96 * s), ("upper", b + 1.96 * s))]
    )


def _first(ch: str = "ch") -> Column:
    return F.instr(F.col(ch), "1")


def cohorts(frequencies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Animals by occasion of first capture, one row per season (and group) at most."""
    return (
        frequencies.where(_first() > 0)
        .groupBy(*by, _first().alias("first"))
        .agg(F.sum("n").alias("released"))
    )


def _released(frequencies: DataFrame) -> DataFrame:
    """Histories with their first and last capture, and captures after the first."""
    last = F.length("ch") - F.instr(F.reverse(F.col("ch")), "1") + 1
    seen_again = F.length(F.regexp_replace("ch", "0", "")) - 1
    return frequencies.where(_first() > 0).withColumns({"first": _first(), "last": last, "again": seen_again})


def _chance(phi: Column, p: Column) -> Column:
    """Of a history, given its first capture."""
    alpha = phi * (1 - p)
    alive = F.col("last") - F.col("first")
    left = F.length("ch") - F.col("last")
    unseen = 1 - F.try_divide(p * phi * (1 - F.pow(alpha, left)), 1 - alpha)
    return F.pow(phi, alive) * F.pow(p, F.col("again")) * F.pow(1 - p, alive - F.col("again")) * unseen


def expected_counts(frequencies: DataFrame, fit: CjsFit) -> DataFrame:
    """Observed and expected number of animals for each history."""
    phi, p = map(F.lit, fit.real)
    # One row per season at most, so the broadcast is bounded by the length of the study.
    return _released(frequencies).join(F.broadcast(cohorts(frequencies)), "first").select(
        "ch", F.col("n").alias("observed"), (F.col("released") * _chance(phi, p)).alias("expected")
    )


def expected_counts_by(frequencies: DataFrame, fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Observed and expected number of animals for each history of each group; null where a group has no estimates."""
    real = fits.select(*by, _logistic(F.col("phi_beta")).alias("__phi"), _logistic(F.col("p_beta")).alias("__p"))
    known = null_safe_join(cohorts(frequencies, by), real, list(by))
    rows = null_safe_join(_released(frequencies), known, [*by, "first"])
    return rows.select(*by, "ch", F.col("n").alias("observed"), (F.col("released") * _chance(F.col("__phi"), F.col("__p"))).alias("expected"))


def _statistics(m2: Column, ess: Column) -> list[Column]:
    """Of one row a fit with histories, __nlogn, pearson, __k and __rlogr."""
    saturated = -2 * (F.col("__nlogn") - F.col("__rlogr"))
    df = F.col("histories") - F.col("__k") - 2
    return [
        F.col("histories"),
        F.col("__k").alias("cohorts"),
        ess.alias("effective_sample_size"),
        m2.alias("m2_log_likelihood"),
        saturated.alias("saturated"),
        (m2 - saturated).alias("deviance"),
        df.alias("df"),
        F.try_divide(m2 - saturated, df).alias("c_hat"),
        (m2 + 4).alias("aic"),
        (m2 + 4 + F.lit(12.0) / (ess - 3)).alias("aicc"),
        (m2 + 2 * F.ln(ess)).alias("bic"),
        F.col("pearson"),
    ]


def _history_sums() -> list[Column]:
    n = F.col("observed").cast("double")
    return [
        F.count(F.lit(1)).alias("histories"),
        F.sum(n * F.ln(n)).alias("__nlogn"),
        F.sum(F.pow(n - F.col("expected"), 2) / F.col("expected")).alias("pearson"),
    ]


def fit_statistics(frequencies: DataFrame, fit: CjsFit) -> DataFrame:
    """-2lnL of model and saturated model, deviance, df, c-hat, AIC, AICc, BIC and Pearson chi-square."""
    histories = expected_counts(frequencies, fit).agg(*_history_sums())
    r = F.col("released").cast("double")
    sizes = cohorts(frequencies).agg(
        F.struct(F.count(F.lit(1)).alias("k"), F.sum(r * F.ln(r)).alias("rlogr"))
    ).scalar()
    rows = histories.withColumn("__c", sizes).withColumns({"__k": F.col("__c.k"), "__rlogr": F.col("__c.rlogr")})
    return rows.select(*_statistics(F.lit(-2 * fit.log_likelihood), F.lit(float(fit.releases))))


def fit_statistics_by(frequencies: DataFrame, fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same for each group with estimates."""
    keys = list(by)
    known = fits.where("log_likelihood is not null")
    r = F.col("released").cast("double")
    sizes = cohorts(frequencies, by).groupBy(*by).agg(F.count(F.lit(1)).alias("__k"), F.sum(r * F.ln(r)).alias("__rlogr"))
    sums = expected_counts_by(frequencies, known, by).groupBy(*by).agg(*_history_sums())
    rows = null_safe_join(null_safe_join(sums, sizes, keys), known.select(*by, "log_likelihood", "releases"), keys)
    return rows.select(*by, *_statistics(-2 * F.col("log_likelihood"), F.col("releases")))


def constant_by_year(estimate: DataFrame, first: int | Column, last: int | Column) -> DataFrame:
    """Repeat a one-row estimate for every study year, the table behind a flat band."""
    lo = first if isinstance(first, Column) else F.lit(first)
    hi = last if isinstance(last, Column) else F.lit(last)
    return estimate.withColumn("season", F.explode(F.sequence(lo, hi)))
