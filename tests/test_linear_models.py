import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from resight.functions import tails
from resight.functions.scalar import normal_quantile
from resight.operators import chart, linear, mixed, smooth


def test_least_squares_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0), (None, 1.0)], "x double, y double")
    fit = linear.fit_line(df, "y", "x").first()
    assert (fit.n, fit.slope, fit.df) == (3, 2.5, 1.0)
    assert fit.intercept == pytest.approx(-2 / 3) and fit.r2 == pytest.approx(0.9868421, abs=1e-7)
    assert fit.rss == pytest.approx(1 / 6)
    d = linear.diagnostics(df, "y", "x").orderBy("x").collect()
    assert [r.residual for r in d] == pytest.approx([1 / 6, -1 / 3, 1 / 6])
    assert [r.leverage for r in d] == pytest.approx([5 / 6, 1 / 3, 5 / 6])
    keyed = linear.diagnostics(df.withColumn("g", F.lit("a")), "y", "x", ["g"]).orderBy("x").collect()
    assert [r.cooks_distance for r in keyed] == pytest.approx([r.cooks_distance for r in d])
    # n (log(2 pi rss / n) + 1) + 2 * 3 parameters
    aic = 3 * (math.log(2 * math.pi / 18) + 1) + 6
    assert linear.line_aic(df, "y", "x").first().aic == pytest.approx(aic)


def test_constant_predictor_has_no_slope(spark):
    fit = linear.fit_line(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "y", "x").first()
    assert fit.slope is None and fit.rss is None


def test_no_complete_rows(spark):
    df = spark.createDataFrame([(None, 2.0), (1.0, None)], "x double, y double")
    fit = linear.fit_line(df, "y", "x").first()
    assert (fit.n, fit.slope, fit.p_slope) == (0, None, None)
    assert linear.diagnostics(df, "y", "x").count() == 0
    assert {r.fit for r in linear.band(df, "y", "x").collect()} == {None}
    assert linear.t_test(df.where("x > 5"), "x", 0).first().t is None


def test_anova_levene_tukey_by_hand(spark):
    data = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 6.0), ("b", 8.0)]
    df = spark.createDataFrame(data, "g string, x double")
    a = linear.anova(df, "x", "g").first()
    assert (a.ss_between, a.ss_within, a.f, a.df1, a.df2) == pytest.approx((24, 10, 9.6, 1, 4))
    assert linear.levene(df, "x", "g").first().f == pytest.approx(0.8)
    t = linear.tukey(df, "x", "g").first()
    assert t["diff"] == 4 and t.q == pytest.approx(math.sqrt(2 * 9.6))
    # Two groups: same p as the analysis of variance, and the interval is the t interval.
    assert t.p_adjusted == pytest.approx(a.p, abs=1e-7)
    half = tails.t_critical(0.05, 4) * math.sqrt(2.5 * 2 / 3)
    assert t.upper - t["diff"] == pytest.approx(half, rel=1e-6)


def test_tails():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi2_upper(3.5864, 2) == pytest.approx(math.exp(-3.5864 / 2))
    assert tails.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert tails.f_upper(4.964602743730712, 1, 10) == pytest.approx(0.05)
    assert tails.f_upper(3.0, 2, 8) == pytest.approx((8 / (8 + 6)) ** 4)
    # Published 5% points of the studentised range.
    for q, k, df in ((3.877, 3, 10), (4.232, 5, 20), (3.314, 3, 1e6), (3.151, 2, 10), (3.958, 4, 20)):
        assert tails.tukey_upper(q, k, df) == pytest.approx(0.05, abs=1e-4)
    assert tails.tukey_critical(0.05, 3, 10) == pytest.approx(3.877, abs=1e-3)
    assert tails.signed_rank_exact(0, 5) == pytest.approx(2 / 32)


def test_normal_quantile_column(spark):
    p = [1e-12, 1e-5, 0.01, 0.075, 0.3, 0.5, 0.925, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(v,) for v in p], "p double")
    got = [r[0] for r in df.select(normal_quantile("p")).collect()]
    want = [statistics.NormalDist().inv_cdf(v) for v in p]
    assert got == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_shapiro_of_many_tied_values(spark):
    """20,000 values on a coarse normal grid: W exists and is near one, p is given but not as published."""
    df = spark.range(20_000).selectExpr("round(sqrt(-2 * ln((id + 0.5) / 20000)) * cos(id * 2.399963), 1) as x")
    r = linear.shapiro(df, "x").first()
    assert r.n == 20_000 and 0.99 < r.w <= 1 and r.p is not None and not r.p_published


def test_shapiro(spark):
    # Weights of men, the worked example of the test's literature: W = 0.79.
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rng = random.Random(4)
    data = [("men", float(v)) for v in men] + [("two", 1.0), ("two", 2.0)]
    data += [("three", 1.0), ("three", 2.0), ("three", 4.0)]
    data += [("many", rng.random()) for _ in range(5001)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r for r in linear.shapiro(df, "x", ["g"]).collect()}
    assert got["men"].w == pytest.approx(0.7888, abs=1e-4)
    assert got["men"].p == pytest.approx(0.0067, abs=1e-4)
    # Three values: W is the squared range over twice the sum of squares.
    assert got["three"].w == pytest.approx(4.5 / (14 / 3))
    assert got["two"].w is None and got["many"].n == 5001
    assert 0 < got["many"].w < 1 and not got["many"].p_published and got["men"].p_published


def test_breusch_pagan(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 5, 300)
    y = 2 + x + rng.normal(0, 0.3 + x)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    design = np.column_stack([np.ones(300), x])
    e2 = (y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2
    r2 = np.corrcoef(x, e2)[0, 1] ** 2
    got = linear.breusch_pagan(df, "y", "x").first()
    assert got.bp == pytest.approx(300 * r2) and got.p < 0.01


def test_band_meets_the_points(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)], "x double, y double")
    grid = linear.band(df, "y", "x").orderBy("x").collect()
    assert len(grid) == 80 and (grid[0].x, grid[-1].x) == (1.0, 3.0)
    assert grid[0].fit == pytest.approx(2 - 1 / 6)
    half = tails.t_critical(0.05, 1) * math.sqrt(1 / 6) * math.sqrt(5 / 6)
    assert grid[0].upper - grid[0].fit == pytest.approx(half)


def grouped_data(seed=1, tau=1.0):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(40):
        u = rng.normal(0, tau)
        for _ in range(1 + g % 6):
            x = float(rng.integers(0, 20))
            out.append((g, x, float(1 + 0.3 * x + u + rng.normal(0, 0.8))))
    return out


def brute_reml(data, ratio):
    g, x, y = (np.array(c) for c in zip(*data))
    design = np.column_stack([np.ones(len(x)), x])
    v = np.eye(len(x)) + ratio * (g[:, None] == g[None, :])
    vi = np.linalg.inv(v)
    info = design.T @ vi @ design
    beta = np.linalg.solve(info, design.T @ vi @ y)
    r = y - design @ beta
    free = len(x) - 2
    rss = r @ vi @ r
    score = np.linalg.slogdet(v)[1] + np.linalg.slogdet(info)[1] + free * (1 + math.log(2 * math.pi * rss / free))
    return score, beta, rss / free, np.linalg.inv(info)


def test_random_intercept_against_dense_matrices(spark):
    data = grouped_data()
    df = spark.createDataFrame(data, "id long, x double, y double")
    fit = mixed.fit_random_intercept(df, "y", "x")
    ratio = (fit.tau / fit.sigma) ** 2
    score, beta, var, cov = brute_reml(data, ratio)
    assert fit.criterion == pytest.approx(score, rel=1e-9)
    assert (fit.intercept, fit.slope) == pytest.approx(tuple(beta), rel=1e-8)
    assert fit.sigma**2 == pytest.approx(var) and fit.se == pytest.approx(tuple(np.sqrt(var * np.diag(cov))))
    assert all(score <= brute_reml(data, r)[0] + 1e-9 for r in (ratio * 0.9, ratio * 1.1, 0.0, ratio + 1))
    assert not fit.singular and fit.groups == 40
    effects = {r.id: r.effect for r in fit.random_effects(df, "y", "x").collect()}
    for g in (0, 5, 17):
        off = [y - fit.intercept - fit.slope * x for h, x, y in data if h == g]
        assert effects[g] == pytest.approx(ratio * sum(off) / (1 + ratio * len(off)))


def test_random_intercept_by_group(spark):
    """Every group as if it were alone, null keys and groups without estimates included."""
    parts = {"a": grouped_data(1), "b": grouped_data(2, 0.3), None: [(g, x + 2000, y) for g, x, y in grouped_data(3)]}
    rows = [(k, *r) for k, part in parts.items() for r in part]
    rows += [("one value", 1, 5.0, y) for y in (1.0, 2.0, 3.0)] + [("two rows", 1, 1.0, 1.0), ("two rows", 1, 2.0, 2.0)]
    rows += [("no pairs", 1, None, 1.0), ("a", None, 1.0, 9.0), ("a", 3, None, 9.0), ("a", 3, 1.0, None)]
    single = [(g, float(g % 7), float(g % 5)) for g in range(12)]
    rows += [("single rows", *r) for r in single] + [("one id", 1, x, y) for _, x, y in single]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double").repartition(7)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy-fit", "fit")
    fits = mixed.fit_random_intercept_by(df, "y", "x", ["k"])
    assert not tracker.getJobIdsForGroup("lazy-fit")
    spark.sparkContext.setJobGroup("rest", "rest")
    found = {r.k: r for r in fits.collect()}
    assert set(found) == {*parts, "one value", "two rows", "single rows", "one id"}
    for k, part in parts.items():
        fit = found[k]
        score, beta, var, cov = brute_reml(part, (fit.tau / fit.sigma) ** 2)
        assert fit.reml == pytest.approx(score, rel=1e-9) and (fit.n, fit.groups) == (len(part), 40)
        assert (fit.intercept, fit.slope) == pytest.approx(tuple(beta), rel=1e-6)
        assert (fit.intercept_se, fit.slope_se) == pytest.approx(tuple(np.sqrt(var * np.diag(cov))), rel=1e-6)
        ratio = (fit.tau / fit.sigma) ** 2
        assert all(score <= brute_reml(part, r)[0] + 1e-9 for r in (ratio * 0.9, ratio * 1.1, 0.0, ratio + 1))
    for k in ("one value", "two rows"):
        assert found[k].reml is None and found[k].slope is None and found[k].singular is None
    slope, intercept = np.polyfit([x for _, x, _ in single], [y for _, _, y in single], 1)
    for k in ("single rows", "one id"):
        assert found[k].singular and found[k].tau == 0
        assert (found[k].slope, found[k].intercept) == pytest.approx((slope, intercept))
    terms = {(r.k, r.term): r for r in mixed.terms_by(fits, ["k"]).collect()}
    assert len(terms) == 14 and terms["a", "slope"].t == pytest.approx(found["a"].slope / found["a"].slope_se)
    effects = {(r.k, r.id): r for r in mixed.random_effects_by(df, fits, "y", "x", ["k"]).collect()}
    assert {k for k, _ in effects} == {*parts, "single rows", "one id"}
    for k, part in parts.items():
        fit = found[k]
        alone = spark.createDataFrame(part, "id long, x double, y double")
        whole = mixed.fit_random_intercept(alone, "y", "x")
        assert whole.tau == pytest.approx(fit.tau, rel=1e-6) and whole.slope == pytest.approx(fit.slope)
        for r in whole.random_effects(alone, "y", "x").collect():
            assert effects[k, r.id].n == r.n and effects[k, r.id].effect == pytest.approx(r.effect, rel=1e-5, abs=1e-8)


def test_random_intercept_without_rows(spark):
    empty = spark.createDataFrame([], "k string, id long, x double, y double")
    assert mixed.fit_random_intercept_by(empty, "y", "x", ["k"]).collect() == []
    with pytest.raises(ValueError, match="no complete rows"):
        mixed.fit_random_intercept(empty, "y", "x")
    flat = spark.createDataFrame([("a", 1, 2.0, y) for y in (1.0, 2.0, 4.0)], empty.schema)
    with pytest.raises(ValueError, match="two values"):
        mixed.fit_random_intercept(flat, "y", "x")


def test_random_intercept_singular(spark):
    rng = np.random.default_rng(3)
    data = []
    for g in range(20):
        e = rng.normal(0, 1, 4)
        e -= e.mean()
        data += [(g, float(i), float(2 * i + v)) for i, v in enumerate(e)]
    df = spark.createDataFrame(data, "id long, x double, y double")
    fit = mixed.fit_random_intercept(df, "y", "x")
    assert fit.singular and fit.tau == 0
    assert {r.singular for r in fit.summary(spark).collect()} == {True}


def test_smooth_against_dense_matrices(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(3, 9, 250)
    w = rng.integers(0, 4, 250).astype(float)
    y = np.sin(x) + 0.1 * w + rng.normal(0, 0.2, 250)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, w, y)], "x double, w double, y double")
    fit = smooth.fit_smooths(df, "y", ["x"])
    basis = fit.bases[0]
    u = (x - basis.low) / (basis.high - basis.low)
    arcs = [
        (np.maximum(u - k, 0) ** 3 - np.maximum(u - basis.knots[-1], 0) ** 3) / (basis.knots[-1] - k)
        for k in basis.knots[:-1]
    ]
    z = np.column_stack([u] + [a - arcs[-1] for a in arcs[:-1]])
    z = z - z.mean(axis=0)
    s = basis.penalty()
    s = s * np.trace(z.T @ z) / np.trace(s) * fit.lambdas[0]
    gamma = np.linalg.solve(z.T @ z + s, z.T @ (y - y.mean()))
    assert fit.coefficients == pytest.approx(gamma, rel=1e-6)
    edf = np.trace(np.linalg.solve(z.T @ z + s, z.T @ z))
    assert fit.edf[0] == pytest.approx(edf) and 3 < edf <= 4
    fitted = {round(r.x, 9): r.fitted for r in fit.residuals(df).collect()}
    want = y.mean() + z @ gamma
    assert [fitted[round(float(v), 9)] for v in x] == pytest.approx(list(want), abs=1e-9)
    grid = fit.grid(spark, "x").orderBy("x").collect()
    assert len(grid) == 200 and all(r.lower < r.fit < r.upper for r in grid)
    both = smooth.fit_smooths(df, "y", ["x", "w"])
    assert len(both.bases[1].knots) == 4 and both.rss < fit.rss
    assert both.summary(spark).count() == 2
    assert [f.y for f in smooth.fit_each(df, "y", ["x", "w"])] == ["y", "y"]


def test_smooth_of_a_straight_line_is_straight(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(float(i), float(3 + 2 * i + rng.normal(0, 1))) for i in range(80)], "x double, y double")
    fit = smooth.fit_smooths(df, "y", ["x"])
    line = linear.fit_line(df, "y", "x").first()
    assert fit.edf[0] == pytest.approx(1, abs=0.35)
    ends = fit.grid(spark, "x", 2).orderBy("x").collect()
    assert (ends[1].fit - ends[0].fit) / 79 == pytest.approx(line.slope, rel=0.01)


def test_charts(spark):
    values = [1.0, 1.5, 2.0, 2.0, 3.0, 3.5, 4.0, 9.0, 30.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, x double")
    h = chart.histogram(df, "x").orderBy("low").collect()
    assert [(r.low, r.high, r.n) for r in h] == [(0, 5, 7), (5, 10, 1), (10, 15, 0), (15, 20, 0), (20, 25, 0), (25, 30, 1)]
    b = chart.box_statistics(df, "x", ["g"]).first()
    assert (b.q1, b.median, b.q3, b.whisker_low, b.whisker_high, b.outliers) == (2, 3, 4, 1, 4, 2)
    assert sorted(r.x for r in chart.box_outliers(df, "x", ["g"]).collect()) == [9, 30]
    curve = chart.density(df, "x", ["g"]).orderBy("x").collect()
    area = sum((b.x - a.x) * (a.density + b.density) / 2 for a, b in zip(curve, curve[1:]))
    assert len(curve) == 512 and area == pytest.approx(1, abs=0.01)
    q = {r.x: r for r in chart.qq_points(df, "x").collect()}
    assert q[3.0].theoretical == pytest.approx(0, abs=1e-12) and q[2.0].n == 2
    line = chart.qq_line(df, "x").first()
    assert line.slope == pytest.approx(1 / 0.6744897501960817) and line.intercept == 3
    assert chart.histogram(df.where("x = 9"), "x").collect()[0].n == 1


def test_density_matches_direct_sum(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(10, 2, 400)
    df = spark.createDataFrame([(float(a),) for a in v], "x double")
    sd, iqr = v.std(ddof=1), np.subtract(*np.quantile(v, [0.75, 0.25]))
    bw = 0.9 * min(sd, iqr / 1.34) * 400**-0.2
    for r in chart.density(df, "x").orderBy("x").collect()[::60]:
        direct = np.exp(-(((r.x - v) / bw) ** 2) / 2).sum() / (400 * bw * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(direct, rel=1e-3, abs=1e-6)
