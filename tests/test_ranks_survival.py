import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import counted, rows
from resight.operators import linear, longevity, quantiles, ranks, survival

# Number of individuals by span in years, of the known 1175 histories over 45 seasons.
SPANS = {
    0: 600, 1: 1, 2: 63, 3: 60, 4: 70, 5: 54, 6: 42, 7: 33, 8: 33, 9: 31, 10: 30, 11: 26, 12: 19, 13: 24,
    14: 18, 15: 8, 16: 14, 17: 10, 18: 11, 19: 1, 20: 6, 21: 5, 22: 4, 23: 4, 25: 1, 26: 2, 27: 2, 31: 3,
}
CENSORED = {0: 4, 14: 1}
FROM_1985 = {
    3: 58, 4: 68, 5: 50, 6: 41, 7: 31, 8: 33, 9: 31, 10: 30, 11: 25, 12: 19, 13: 23, 14: 17, 15: 7, 16: 13,
    17: 10, 18: 11, 19: 1, 20: 5, 21: 5, 22: 4, 23: 3, 25: 1, 26: 2, 27: 2, 31: 2,
}
FROM_1992 = {
    3: 53, 4: 61, 5: 47, 6: 38, 7: 31, 8: 32, 9: 30, 10: 29, 11: 23, 12: 16, 13: 21, 14: 16, 15: 7, 16: 8,
    17: 7, 18: 7, 19: 1, 20: 4, 21: 4, 22: 3, 23: 1, 26: 1, 27: 1,
}


def at_least(low):
    return {k: v for k, v in SPANS.items() if k >= low}


@pytest.mark.parametrize(
    "counts,n,mean,median,sd,top",
    [
        (SPANS, 1175, 3.932766, 0, 5.574468, 31),
        (at_least(1), 575, 8.036522, 6, 5.524452, 31),
        (at_least(3), 511, 8.794521, 7, 5.401420, 31),
        (FROM_1985, 492, 8.733740, 7, 5.288446, 31),
        (FROM_1992, 441, 8.263039, 7, 4.666001, 27),
    ],
)
def test_longevity_golden(spark, counts, n, mean, median, sd, top):
    got = longevity.longevity_summary(counted(spark, counts, "longevity")).first()
    assert (got.n, got["max"], got.median) == (n, top, median)
    assert got["mean"] == pytest.approx(mean, abs=5e-7) and got.sd == pytest.approx(sd, abs=5e-7)


def test_one_sample_tests_golden(spark):
    x = counted(spark, at_least(3), "x")
    t = linear.t_test(x, "x", 8).first()
    assert t.t == pytest.approx(3.325122, abs=1e-6) and t.df == 510
    assert t.lower < t["mean"] < t.upper and t.p == pytest.approx(0.000948, abs=2e-5)
    w = ranks.signed_rank(x, "x", 8).first()
    assert (w.v, w.n_used) == (60536.5, 478)
    assert w.z == pytest.approx(1.093729, abs=1e-6) and w.p == pytest.approx(0.274074, abs=1e-6)


def survival_rows(spark, counts, censored):
    data = []
    for time, n in counts.items():
        c = censored.get(time, 0)
        data += [(time, 0)] * c + [(time, 1)] * (n - c)
    return spark.createDataFrame(data, "time int, event int")


def test_kaplan_meier_golden(spark):
    curve = survival.kaplan_meier(survival_rows(spark, SPANS, CENSORED))
    s = {r.time: r.survival for r in curve.collect()}
    want = {0: 0.492766, 1: 0.491909, 2: 0.437919, 3: 0.386500, 4: 0.326511, 27: 0.002607, 31: 0.0}
    assert {k: s[k] for k in want} == pytest.approx(want, abs=5e-7)
    total = survival.survival_summary(curve).first()
    assert (total.n, total.events, total.median) == (1175, 1170, 0)
    assert total.right_endpoint_area == pytest.approx(3.463086, abs=5e-7)
    assert total.restricted_mean == pytest.approx(3.964542, abs=5e-7)
    assert total.ratio == pytest.approx(0.681397, abs=5e-7)
    repeat = survival.survival_summary(
        survival.kaplan_meier(survival_rows(spark, at_least(1), {14: 1}))
    ).first()
    assert (repeat.events, repeat.median) == (574, 6)
    assert repeat.right_endpoint_area == pytest.approx(7.027851, abs=5e-7)
    assert repeat.restricted_mean == pytest.approx(8.045487, abs=5e-7)


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 1)], "time int, event int")
    curve = survival.kaplan_meier(df)
    assert [r.survival for r in curve.orderBy("time").collect()] == [0.75, 0.5, 0.0]
    s = survival.survival_summary(curve).first()
    assert (s.right_endpoint_area, s.restricted_mean, s.median) == (1.25, 2.25, 2.5)


def test_kaplan_meier_without_censoring_is_the_empirical_tail(spark):
    df = survival_rows(spark, SPANS, {}).withColumn("g", F.col("time") % 2)
    for r in survival.kaplan_meier(df).collect():
        tail = sum(n for t, n in SPANS.items() if t > r.time) / 1175
        assert r.survival == pytest.approx(tail, abs=1e-12)
    strata = survival.kaplan_meier(df, ["g"])
    alone = survival.kaplan_meier(df.where("g = 1"))
    assert rows(strata.where("g = 1").drop("g")) == rows(alone)


def test_all_censored(spark):
    df = spark.createDataFrame([(1, 0), (4, 0)], "time int, event int")
    curve = survival.kaplan_meier(df)
    assert {r.survival for r in curve.collect()} == {1.0}
    assert survival.survival_summary(curve).first().median is None


def test_times_must_be_whole(spark):
    with pytest.raises(TypeError):
        survival.kaplan_meier(spark.createDataFrame([(1.5, 1)], "time double, event int"))


def test_censoring_uses_the_study_end(spark):
    span = spark.createDataFrame([("a", 2000, 2004, 4), ("b", 2001, 2003, 2)], "id string, first_year int, last_year int, longevity int")
    seasons = spark.createDataFrame([(2004,), (1999,)], "season int")
    assert {r.id: r.event for r in longevity.survival_input(span, seasons).collect()} == {"a": 0, "b": 1}


GROUPS = [("g1", 1.0), ("g1", 2.0), ("g1", 2.0), ("g2", 3.0), ("g2", 4.0)]


def test_rank_tests_by_hand(spark):
    df = spark.createDataFrame(GROUPS, "g string, x double")
    mid = {(r.g, r.x): r.midrank for r in ranks.midranks(df, "x", group="g").collect()}
    assert mid == {("g1", 1.0): 1.0, ("g1", 2.0): 2.5, ("g2", 3.0): 4.0, ("g2", 4.0): 5.0}
    h = ranks.kruskal_wallis(df, "x", "g").first()
    assert h.h == pytest.approx(3.1578947, abs=1e-7) and h.df == 1
    z = ranks.dunn(df, "x", "g").first()
    assert z.z == pytest.approx(-1.7770466, abs=1e-7) and z.z**2 == pytest.approx(h.h)
    assert z.comparison == "g1 - g2" and not z.significant
    keyed = df.withColumn("part", F.lit("one")).unionByName(df.withColumn("part", F.lit("two")).withColumn("x", -F.col("x")))
    assert [r.h for r in ranks.kruskal_wallis(keyed, "x", "g", ["part"]).collect()] == pytest.approx([h.h, h.h])


@pytest.mark.parametrize("buckets", [1, 4, 37])
def test_midranks_brute_force_with_a_dominant_value(spark, buckets):
    rng = random.Random(1)
    data = [("ab"[rng.randrange(2)], 7.0 if rng.random() < 0.4 else rng.gauss(0, 1e3)) for _ in range(1500)]
    df = spark.createDataFrame(data, "g string, x double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(buckets))
    try:
        got = {(r.g, r.x): (r.n, r.midrank) for r in ranks.midranks(df, "x", group="g").collect()}
        within = {(r.g, r.x): r.midrank for r in ranks.midranks(df, "x", ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)

    def mid(pool, v):
        return sum(x < v for x in pool) + (sum(x == v for x in pool) + 1) / 2

    pool = [x for _, x in data]
    assert got == {
        (g, x): (data.count((g, x)), mid(pool, x)) for g, x in set(data)
    }
    assert within == {(g, x): mid([v for h, v in data if h == g], x) for g, x in set(data)}
    assert sum(n * m for n, m in got.values()) == pytest.approx(1500 * 1501 / 2)


def test_signed_rank_exact(spark):
    df = spark.createDataFrame([(float(v),) for v in (1.1, 2.3, -0.4, 3.7, 5.2)], "x double")
    r = ranks.signed_rank(df, "x", 0.0).first()
    # All but one of the 32 sign patterns at least as far out: V = 14, p = 2 * 2 / 32.
    assert r.v == 14 and r.p == pytest.approx(0.125)


def test_signed_rank_exact_is_a_choice(spark):
    df = spark.createDataFrame([(float(v),) for v in (1.1, 2.3, -0.4, 3.7, 5.2)], "x double")
    assert ranks.signed_rank(df, "x", 0.0, exact=False).first().p != pytest.approx(0.125, abs=1e-6)
    many = spark.createDataFrame([((-1) ** i * float(i + 1),) for i in range(60)], "x double")
    exact, normal = (ranks.signed_rank(many, "x", 0.0, exact=e).first().p for e in (True, False))
    assert exact == pytest.approx(normal, abs=0.01) and exact != normal


def test_comparison_keys(spark):
    df = spark.createDataFrame([("1-10 - 11-20",), ("click - view",)], "c string")
    got = [r[0] for r in df.select(ranks.comparison_key(df.c)).collect()]
    assert got == ["1_10-11_20", "click-view"]


def brute_quantile(values, p):
    return float(np.quantile(np.array(values), p))


@pytest.mark.parametrize("small", [True, False])
def test_exact_quantiles(spark, monkeypatch, small):
    """Once over whole ranges and once through the sketch brackets."""
    if not small:
        monkeypatch.setattr(quantiles, "SMALL", 50)
        monkeypatch.setattr(quantiles, "ACCURACY", 200)
        monkeypatch.setattr(quantiles, "MARGIN", 2 / 200 + 2 / 50)
    rng = random.Random(2)
    data = [("big", rng.gauss(0, 1)) for _ in range(3000)] + [("big", 0.25)] * 1500
    data += [("tiny", 4.0), ("tiny", 1.0), ("one", 2.0), ("none", None), (None, 5.0)]
    df = spark.createDataFrame(data, "g string, x double")
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    got = {r.g: r for r in quantiles.summarise(df, "x", ["g"], probs).collect()}
    for g in ("big", "tiny", "one", None):
        values = [x for k, x in data if k == g]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(brute_quantile(values, p), abs=1e-12)
    assert (got["none"].n, got["none"].n_valid, got["none"].median) == (1, 0, None)
    assert got["one"].sd is None
    whole = quantiles.summarise(df, "x").first()
    assert whole.median == pytest.approx(brute_quantile([x for _, x in data if x is not None], 0.5))


def test_quantiles_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "x double")
    row = quantiles.summarise(empty, "x").first()
    assert (row.n, row.median) == (0, None)


def test_equal_values_have_no_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, x double")
    assert ranks.kruskal_wallis(df, "x", "g").first().h is None
    assert linear.t_test(df, "x", 1.0).first().t is None
    assert math.isclose(linear.shapiro(df, "x").first().n, 3)
    assert linear.shapiro(df, "x").first().w is None


def test_letters_are_the_largest_sets_without_a_significant_pair(spark):
    rng = random.Random(6)
    tests, want = [], {}
    for case in range(25):
        groups = [f"g{i}" for i in range(rng.randrange(2, 8))]
        told = {p for p in itertools.combinations(groups, 2) if rng.random() < rng.choice((0.1, 0.5, 0.9))}
        for a, b in itertools.combinations(groups, 2):
            one, two = rng.sample((a, b), 2)
            tests.append((case, one, two, True if (a, b) in told else rng.choice((False, None))))
        free = [
            set(c) for n in range(1, len(groups) + 1) for c in itertools.combinations(groups, n)
            if not any(p in told for p in itertools.combinations(c, 2))
        ]
        top = sorted(sorted(c) for c in free if not any(c < d for d in free))
        for g in groups:
            want[case, g] = "".join("abcdefghijklmnopqrstuvwxyz"[k] for k, c in enumerate(top) if g in c)
    tests += [(0, "g0", "g0", True), (0, None, "g1", True), (99, "alone", None, True), (None, "x", "y", True)]
    want |= {(None, "x"): "a", (None, "y"): "b"}
    df = spark.createDataFrame(tests + tests[:40], "k int, one string, two string, significant boolean")
    got = {(r.k, r.group): r.letters for r in ranks.letters(df, "one", "two", by=["k"]).collect()}
    assert got == want
    assert ranks.letters(df.where("k = 99"), "one", "two").collect() == []


def test_more_letters_than_the_alphabet(spark):
    groups = [f"g{i:02}" for i in range(30)]
    df = spark.createDataFrame([(*p, True) for p in itertools.combinations(groups, 2)], "one string, two string, significant boolean")
    got = [r.letters for r in ranks.letters(df, "one", "two").orderBy("group").collect()]
    assert got == [*"abcdefghijklmnopqrstuvwxyz", "a1", "b1", "c1", "d1"]
