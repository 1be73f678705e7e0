import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from resight.operators import cjs, clean, histories
from resight.sources import histories as text
from resight.sources import tables

# Re-sightings by years since release, and releases never seen again by seasons left, of
# the known 1175 histories over 45 seasons.
GAPS = {
    1: 13, 2: 709, 3: 340, 4: 189, 5: 96, 6: 56, 7: 25, 8: 16, 9: 9, 10: 4, 11: 3, 12: 6, 13: 1, 16: 1,
    19: 1, 21: 1,
}
LOST = {
    1: 5, 2: 3, 3: 13, 4: 19, 5: 3, 6: 16, 7: 28, 8: 21, 9: 38, 10: 42, 11: 46, 12: 58, 13: 55, 14: 54,
    15: 37, 16: 76, 17: 47, 18: 60, 19: 32, 20: 44, 21: 30, 22: 42, 23: 36, 24: 50, 25: 29, 26: 14, 27: 12,
    28: 26, 29: 9, 30: 15, 31: 19, 32: 15, 33: 24, 34: 12, 35: 8, 36: 13, 37: 26, 38: 18, 39: 10, 40: 20,
    41: 19, 42: 5, 43: 13, 44: 8,
}


def check_estimates(fit, spark):
    assert -2 * fit.log_likelihood == pytest.approx(9353.1918, abs=5e-5)
    got = {r.parameter: r for r in fit.estimates(spark).collect()}
    want = {
        "phi": (1.8707209, 0.0384388, 1.7953809, 1.9460609, 0.8665417, 0.0044453, 0.8575857, 0.8750165),
        "p": (-1.3793234, 0.0367914, -1.4514346, -1.3072122, 0.2011177, 0.0059113, 0.1897809, 0.2129537),
    }
    for name, values in want.items():
        assert tuple(got[name])[1:] == pytest.approx(values, abs=2e-7)
    longevity = fit.expected_longevity(spark).first()
    assert longevity.longevity == pytest.approx(7.492975, abs=1e-6)
    assert longevity.lower == pytest.approx(7.02, abs=0.01) and longevity.upper == pytest.approx(8.0, abs=0.01)


def test_estimates_golden(spark):
    fit = cjs.fit_counts(GAPS, LOST, 45)
    assert fit.releases == 2640
    check_estimates(fit, spark)
    doubled = cjs.fit_counts({k: 2 * v for k, v in GAPS.items()}, {k: 2 * v for k, v in LOST.items()}, 45)
    assert doubled.real == pytest.approx(fit.real, abs=1e-9)


@pytest.mark.skipif("RESIGHT_HISTORIES" not in os.environ, reason="needs the full history file")
def test_full_history_file(spark):
    freq = text.read_histories(spark, os.environ["RESIGHT_HISTORIES"], 45)
    assert freq.count() == 484
    fit = cjs.fit_cjs(freq)
    check_estimates(fit, spark)
    s = cjs.fit_statistics(freq, fit).first()
    assert (s.histories, s.cohorts, s.df, s.effective_sample_size) == (484, 44, 438, 2640)
    assert s.saturated == pytest.approx(4481.9480, abs=5e-5) and s.deviance == pytest.approx(4871.2438, abs=5e-5)
    assert (s.c_hat, s.aic, s.aicc, s.bic) == pytest.approx((11.121561, 9357.1918, 9357.1963, 9368.9489), abs=6e-5)
    assert s.pearson == pytest.approx(0.4027202e11, rel=1e-6)
    if "RESIGHT_EXPECTED" in os.environ:
        known = {r.ch: r.expected for r in text.read_expected(spark, os.environ["RESIGHT_EXPECTED"]).collect()}
        got = {r.ch: r.expected for r in cjs.expected_counts(freq, fit).collect()}
        assert len(known) == 484 and got == pytest.approx(known, rel=2e-7)


def simulated(seed=9, n=300, occasions=12):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        first = rng.randrange(occasions)
        ch = ["0"] * occasions
        ch[first] = "1"
        for i in range(first + 1, occasions):
            if rng.random() > 0.85:
                break
            if rng.random() < 0.4:
                ch[i] = "1"
        out.append("".join(ch))
    return out


def brute_m_array(chs):
    counts = {}
    for ch in chs:
        pos = [i + 1 for i, c in enumerate(ch) if c == "1"]
        for a, b in zip(pos, pos[1:] + [None]):
            if a < len(ch):
                counts[(a, b)] = counts.get((a, b), 0) + 1
    return counts


def test_m_array_and_recovery(spark):
    chs = simulated()
    freq = histories.history_frequencies(spark.createDataFrame([(c,) for c in chs], "ch string"))
    got = {(r.release, r.recapture): r.n for r in histories.m_array(freq).collect()}
    assert got == brute_m_array(chs)
    fit = cjs.fit_cjs(freq)
    assert fit.real[0] == pytest.approx(0.85, abs=0.06) and fit.real[1] == pytest.approx(0.4, abs=0.08)
    expected = cjs.expected_counts(freq, fit)
    assert expected.count() == freq.count()
    years = cjs.constant_by_year(fit.expected_longevity(spark), 1990, 1995).collect()
    assert [r.season for r in years] == list(range(1990, 1996))


def test_expected_counts_of_all_histories_add_up(spark):
    fit = cjs.fit_counts({1: 30, 2: 12}, {1: 10, 2: 12, 3: 20}, 4)
    chs = [(f"1{i:03b}", 5) for i in range(8)]
    total = cjs.expected_counts(spark.createDataFrame(chs, "ch string, n long"), fit).agg(F.sum("expected")).first()[0]
    assert total == pytest.approx(40)


def test_nothing_seen_again(spark):
    with pytest.raises(ValueError):
        cjs.fit_cjs(spark.createDataFrame([("100", 3), ("010", 1)], "ch string, n long"))


def test_groups_fit_as_they_do_alone(spark):
    groups = {"a": simulated(1), "b": simulated(2, n=40), None: simulated(3, occasions=7), "long": simulated(4, occasions=20)}
    rows_ = [(g, k, ch) for g, chs in groups.items() for k, ch in enumerate(chs)] + [("never", k, "0100") for k in range(5)]
    rows_ += [("last", 0, "0001"), ("again", 0, "1100"), ("again", 1, "1111")]
    freq = histories.history_frequencies(spark.createDataFrame(rows_, "g string, id long, ch string"), ["g"])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fits", "fits")
    fits = cjs.fit_cjs_by(freq, ["g"])
    more = [cjs.estimates_by(fits, ["g"]), cjs.expected_counts_by(freq, fits, ["g"]), cjs.fit_statistics_by(freq, fits, ["g"]), cjs.expected_longevity_by(fits, ["g"])]
    assert not tracker.getJobIdsForGroup("fits")
    spark.sparkContext.setJobGroup("rest", "rest")
    found = [{} for _ in more]
    for k, frame in enumerate(more):
        for r in frame.collect():
            found[k].setdefault(r.g, []).append(r)
    assert set(found[0]) == {*groups, "never", "again"}
    assert all(r.estimate is None for r in found[0]["never"])
    for g in groups:
        own = freq.where(freq.g.eqNullSafe(g)).drop("g")
        fit = cjs.fit_cjs(own)
        for got, want in zip(sorted(found[0][g]), sorted(fit.estimates(spark).collect()), strict=True):
            assert tuple(got)[1] == want[0] and tuple(got)[2:] == pytest.approx(tuple(want)[1:], rel=1e-9)
        want = {r.ch: r.expected for r in cjs.expected_counts(own, fit).collect()}
        assert {r.ch: r.expected for r in found[1][g]} == pytest.approx(want, rel=1e-9)
        assert tuple(found[2][g][0])[1:] == pytest.approx(tuple(cjs.fit_statistics(own, fit).first()), rel=1e-9)
        assert tuple(found[3][g][0])[1:] == pytest.approx(tuple(fit.expected_longevity(spark).first()), rel=1e-9)
    assert cjs.fit_cjs_by(freq.where("false"), ["g"]).count() == 0


def test_many_groups_step_by_themselves():
    # A group that runs to the edge or has no information beside ordinary ones changes nothing for them.
    rng = random.Random(3)
    counts = [({k: rng.randrange(1, 90) for k in range(1, 9)}, {k: rng.randrange(1, 90) for k in range(1, 12)}) for _ in range(60)]
    counts += [({1: 50}, {1: 5, 2: 5}), ({11: 3}, {1: 1}), ({1: 1}, {})]
    gaps, lost = ([[c.get(k, 0) for k in range(12)] for c in own] for own in zip(*counts, strict=True))
    beta, spread, value = cjs._newton(np.array(gaps, float), np.array(lost, float))
    for k, (g, m) in enumerate(counts):
        alone = cjs.fit_counts(g, m, 12)
        assert beta[k].tolist() == pytest.approx(alone.beta, rel=1e-9, abs=1e-9) and value[k] == pytest.approx(alone.log_likelihood, rel=1e-12)
        if k < 60:
            assert spread[k].tolist() == pytest.approx(alone.se, rel=1e-7)


def test_history_text(spark, tmp_path):
    freq = spark.createDataFrame([("0101", 3), ("1000", 12)], "ch string, n long")
    path = str(tmp_path / "h")
    text.write_histories(freq, path)
    assert rows(text.read_histories(spark, path)) == rows(freq)
    mixed = spark.createDataFrame([("title x;",), (" 0101 3;",), ("  11\t4 ;",), ("1 1 1 ;",)], "value string")
    assert rows(text.parse_history_lines(mixed)) == [("0101", 3), ("11", 4)]
    assert rows(text.parse_history_lines(mixed, 4)) == [("0101", 3)]
    lines = spark.createDataFrame([(" 0101\t  4.0\t  4.25 \t",), ("noise",)], "value string")
    assert rows(text.parse_expected_lines(lines)) == [("0101", 4.0, 4.25)]


CSV = """Extra,OriginalTagID,SPNWR_ID,DateOfActivity,Result,CurvedCarapaceLength_NtoN,CurvedCarapaceWidth
x,A1,1,4/1/1990, Lay ,150.5, NA
y,A2,2,4/2/1990,lay,,110
z,A3,3,4/3/1990,lay,tall,110
w,A4,4,4/4/1990,lay,151,111,surplus
"""


def test_csv_read_rejects_profile(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    with open(path, "w") as f:
        f.write(CSV)
    df = tables.read_sightings(spark, path)
    assert df.columns == ["id", "event_id", "dt", "result", "size", "width"]
    assert dict(df.dtypes)["size"] == "double"
    got = {r.id: (r.size, r.width) for r in df.collect()}
    assert got["A1"] == (150.5, None) and got["A2"] == (None, 110.0) and got["A3"][0] is None
    bad = tables.rejects(tables.read_csv(spark, path, tables.SIGHTINGS, keep_corrupt=True))
    assert sorted(r.OriginalTagID for r in bad.collect()) == ["A3", "A4"]
    assert clean.successful_nests(df).count() == 4
    p = {r.column: r for r in tables.profile(df).collect()}
    assert (p["size"].type, p["size"].rows, p["size"].nulls) == ("double", 4, 2)
    assert tables.distinct_count(df, "result").first().n >= 1
    with pytest.raises(ValueError):
        tables.read_sightings(spark, path, {"missing": ("m", None), **tables.SIGHTINGS})


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, t string")
    for kind in ("parquet", "csv"):
        path = str(tmp_path / kind)
        tables.write_table(df, path, kind)
        back = spark.read.schema(df.schema).option("header", True).option("nullValue", "NA").format(kind).load(path)
        assert rows(back) == rows(df)
    with pytest.raises(ValueError):
        tables.write_table(df, str(tmp_path / "x"), "xlsx")


def test_cjs_is_math_safe_at_the_edge():
    # Everything seen again at once: detection runs to one and must not overflow.
    fit = cjs.fit_counts({1: 50}, {1: 5, 2: 5}, 3)
    assert math.isfinite(fit.log_likelihood) and fit.real[1] > 0.99


def test_clutch_files_of_two_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'SPNWR_ID,Total eggs,Total unhatched,Hatch success (%),OriginalTagID,Date,Notes\n'
        'e1,100,10,90.5,T1,5/1/1999,"fine, all"\ne2,NA, 4 ,x,T2,,\n\n'
    )
    (tmp_path / "b.csv").write_text('DateOfActivity, "Hatch success (%)",OriginalTagID,SPNWR_ID\r\n6/2/2000,80,T3,e3\r\nNA,,T4,e4\r\n')
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("SPNWR_ID,Date\n")
    names = ("event_id", "dt", "unhatched", "eggs", "hatch", "id")
    got = tables.read_clutches(spark, str(tmp_path))
    assert set(got.columns) == set(names)
    assert rows(got, *names) == [
        ("e1", "5/1/1999", 10.0, 100.0, 90.5, "T1"),
        ("e2", None, 4.0, None, None, "T2"),
        ("e3", "6/2/2000", None, None, 80.0, "T3"),
        ("e4", None, None, None, None, "T4"),
    ]
    full = tables.read_layouts(spark, str(tmp_path), tables.EXCAVATION, keep_corrupt=True)
    (bad,) = tables.rejects(full).collect()
    assert bad.event_id == "e2" and bad.source_file.endswith("a.csv") and bad[tables.CORRUPT].startswith("e2,NA")
    for k in range(tables.LAYOUTS):
        (tmp_path / f"many{k}.csv").write_text(f"c{k}\n1\n")
    with pytest.raises(ValueError, match="different headers"):
        tables.read_layouts(spark, str(tmp_path), tables.EXCAVATION)
