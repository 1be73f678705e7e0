import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from resight.functions.scalar import label_ranges, label_upto, level_order, parse_mdy
from resight.operators import clean, clutch, growth, histories, longevity
from resight.plans import report


def nests(sightings):
    return clean.with_date_parts(clean.successful_nests(sightings))


def test_outcomes_and_dates(sightings):
    found = nests(sightings)
    assert [r[0] for r in rows(found, "event_id")] == sorted(
        [1, 2, 3, 4, 5, 6, 7, 8, 10], key=str
    )
    dates = {r.event_id: r.dt for r in found.collect()}
    assert dates[8] == dt.date(1985, 6, 5)
    assert dates[10] is None


@pytest.mark.parametrize(
    "text,date",
    [
        ("1/2/2003", dt.date(2003, 1, 2)),
        (" 12/31/68 ", dt.date(2068, 12, 31)),
        ("12/31/69", dt.date(1969, 12, 31)),
        ("2/29/99", None),
        ("2-3-1999", dt.date(1999, 2, 3)),
        ("soon", None),
        (None, None),
    ],
)
def test_parse_mdy(spark, text, date):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_mdy(F.col("t")).alias("d")).first()["d"] == date


def test_season_filter(sightings):
    kept = clean.season_consistent(nests(sightings))
    assert sorted(r.event_id for r in kept.collect()) == [1, 2, 4, 5, 8, 10]


def test_span_and_summary(sightings):
    span = longevity.reproductive_span(clean.season_consistent(nests(sightings)))
    got = {r.id: (r.first_year, r.last_year, r.longevity) for r in span.collect()}
    assert got == {"A": (1990, 1992, 2), "C": (1985, 1985, 0), "E": (None, None, None)}
    positive = longevity.longevity_summary(longevity.cohort(span, positive=True)).first()
    assert (positive.n, positive["mean"], positive.sd) == (1, 2.0, None)


def test_season_and_interval_growth(sightings):
    kept = clean.season_consistent(nests(sightings))
    g = growth.season_growth(kept).collect()
    assert len(g) == 1
    assert (g[0].season, g[0].prev_season, g[0].interval) == (1992, 1990, 2)
    assert g[0].growth_rate == pytest.approx(0.55)
    rates = {r.days_elapsed: r.growth_rate for r in growth.interval_growth(kept).collect()}
    assert rates == pytest.approx({10.0: 29.22, 721.0: 0.1013176, 11.0: 33.2045455}, rel=1e-6)


def test_histories(sightings):
    kept = clean.season_consistent(nests(sightings)).where(F.col("season").isNotNull())
    got = {r.id: r.ch for r in histories.capture_histories(kept).collect()}
    assert got == {"A": "00000101", "C": "10000000"}
    grid = histories.complete_grid(kept)
    assert grid.count() == 16 and grid.agg(F.sum("obs")).first()[0] == 3
    spans = histories.history_spans(histories.capture_histories(kept), 1985)
    assert {r.id: (r.first_year, r.last_year) for r in spans.collect()} == {
        "A": (1990, 1992),
        "C": (1985, 1985),
    }


def random_sightings(spark, seed=3, n=900):
    """Many equal dates and sizes missing, one individual with a third of the rows."""
    rng = random.Random(seed)
    data = []
    for event in range(n):
        who = "hot" if event % 3 == 0 else f"i{rng.randrange(40)}"
        day = None if rng.random() < 0.02 else dt.date(1990 + rng.randrange(14), 1 + rng.randrange(3), 1 + rng.randrange(5))
        size = None if rng.random() < 0.05 else 150 + rng.randrange(30) / 10
        data.append((event, who, day, "lay", size))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "event_id long, id string, dt date, result string, size double")
    return clean.with_date_parts(df), data


def brute_interval_growth(data):
    out = []
    for who in {r[1] for r in data}:
        mine = sorted((r for r in data if r[1] == who and r[2]), key=lambda r: (r[2], r[0]))
        for before, now in zip(mine, mine[1:]):
            days = (now[2] - before[2]).days
            if days > 0 and now[4] is not None and before[4] is not None:
                out.append((now[0], round((now[4] - before[4]) / (days / 365.25), 9)))
    return sorted(out)


def test_interval_growth_matches_row_by_row_lag(spark):
    df, data = random_sightings(spark)
    got = sorted((r.event_id, round(r.growth_rate, 9)) for r in growth.interval_growth(df).collect())
    assert got == brute_interval_growth(data)


def test_group_values_match_brute_force_with_a_hot_individual(spark):
    df, data = random_sightings(spark)
    dated = [r for r in data if r[2]]
    firsts, years = {}, {}
    for r in sorted(dated, key=lambda r: (r[2], r[0])):
        firsts.setdefault((r[1], r[2].year), r[4])
        years.setdefault(r[1], []).append(r[2].year)
    consistent = sorted(
        r[0] for r in dated
        if r[4] is not None and firsts[r[1], r[2].year] is not None and abs(r[4] - firsts[r[1], r[2].year]) <= 1.0
    )
    assert sorted(r.event_id for r in clean.season_consistent(df, 1.0).where("dt is not null").collect()) == consistent
    lived = sorted(r[0] for r in data if r[1] in years and max(years[r[1]]) - min(years[r[1]]) >= 10)
    assert sorted(r.event_id for r in clean.long_lived(df, 10).collect()) == lived
    maiden = sorted(r[0] for r in dated if r[2].year == min(years[r[1]]))
    assert sorted(r.event_id for r in clean.size_at_maturity(df).collect()) == maiden


def test_a_null_event_id_keeps_its_day(spark):
    day = dt.date
    data = [(None, "a", day(2000, 1, 1), 10.0), (None, "a", day(2001, 1, 1), 12.0), (3, "a", day(2002, 1, 1), 13.0)]
    df = spark.createDataFrame(data, "event_id long, id string, dt date, size double")
    assert sorted(r.growth for r in growth.interval_growth(df).collect()) == [1.0, 2.0]


def test_return_interval_by_year_matches_lag(spark):
    rng = random.Random(5)
    data = [
        ("hot" if i % 3 == 0 else f"i{rng.randrange(9)}", rng.randrange(60), 2000 + rng.randrange(8), float(rng.randrange(2)))
        for i in range(400)
    ]
    # Exact copies of one clutch, which is also the first of its year.
    data += [("hot", -1, 2003, 1.0)] * 25
    df = spark.createDataFrame(data, "id string, event_id long, year int, hatch double")
    got = sorted((r.id, r.event_id, r.year, r.hatch, r.return_interval) for r in clutch.clutch_return_interval(df).collect())
    brute = []
    for who in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == who), key=lambda r: (r[2], r[1], r[3]))
        brute += [(*now, now[2] - before[2]) for before, now in zip(mine, mine[1:])]
    assert got == sorted((who, event, year, hatch, gap) for who, event, year, hatch, gap in brute)


def test_size_at_maturity_first_row(spark):
    df, data = random_sightings(spark)
    got = {r.id: r.event_id for r in clean.size_at_maturity(df, one_per_id=True).collect()}
    want = {
        who: min((r for r in data if r[1] == who and r[2]), key=lambda r: (r[2], r[0]))[0]
        for who in {r[1] for r in data}
    }
    assert got == want


def test_labels(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.0, 10.0, 10.5, 11.0, 20.5, 31.0, 31.5, None)], "x double")
    phases = [r[0] for r in df.select(label_ranges(F.col("x"), growth.PHASES)).collect()]
    assert phases == [None, "1-10", "1-10", None, "11-20", None, "21-31", None, None]
    spans = spark.createDataFrame([("a", 9), ("b", 10), ("c", 20), ("d", 30), ("e", None)], "id string, longevity int")
    v1 = {r.id: r.longevity_group for r in growth.longevity_group(spans, growth.SPAN_GROUPS_INCLUSIVE, True).collect()}
    assert v1 == {"a": "1-10", "b": "10-20", "c": "20-30", "d": "30+", "e": None}
    v2 = {r.id: r.longevity_group for r in growth.longevity_group(spans).collect()}
    assert v2 == {"a": "1-10", "b": "1-10", "c": "11-20", "d": "20+", "e": None}
    order = df.select(level_order(label_upto(F.col("x"), growth.SPAN_GROUPS), ["1-10", "11-20", "20+"])).collect()
    assert [r[0] for r in order] == [1, 1, 1, 2, 2, 3, 3, 3, None]


def test_gapless_phases(spark):
    df = spark.createDataFrame([(0.5,), (10.5,), (20.9,), (31.0,), (32.0,)], "years_since_first double")
    got = [r.phase for r in growth.growth_phase(df, gapless=True).collect()]
    assert got == ["1-10", "11-20", "21-31"]


def test_shift_leaves_growth_unchanged(spark):
    df, _ = random_sightings(spark)
    shifted = df.withColumn("size", F.col("size") + 7)
    a = {r.event_id: r.growth_rate for r in growth.interval_growth(df).collect()}
    b = {r.event_id: r.growth_rate for r in growth.interval_growth(shifted).collect()}
    assert a == pytest.approx(b, abs=1e-6)


def test_partitioning_does_not_matter(spark):
    df, _ = random_sightings(spark)
    one = rows(growth.season_growth(clean.season_consistent(df.coalesce(1))), "id", "season", "n_meas")
    many = rows(growth.season_growth(clean.season_consistent(df.repartition(7))), "id", "season", "n_meas")
    assert one == many


def test_unify_clutches(spark):
    excavated = spark.createDataFrame(
        [("e1", 3.0, 80.0, 90.0, "t1"), ("e2", 1.0, 70.0, 95.0, "t2"), ("e3", None, 60.0, 50.0, "t3"), (None, 1.0, 1.0, 1.0, "t9")],
        "event_id string, unhatched double, eggs double, hatch double, id string",
    )
    identified = spark.createDataFrame(
        [("e1", 9.0, 9.0, 9.0, "5/1/2012"), ("e4", 9.0, 9.0, 9.0, "5/2/2012"), (None, 0.0, 0.0, 0.0, "5/3/2012"), ("e2", 0.0, 0.0, 0.0, "bad")],
        "event_id string, unhatched double, eggs double, hatch double, dt string",
    )
    older = spark.createDataFrame(
        [("o1", 2.0, 75.0, 88.0, "t1", "6/7/10")],
        "event_id string, unhatched double, eggs double, hatch double, id string, dt string",
    )
    merged = clutch.join_suffixed(excavated, identified, "event_id")
    # Null keys match each other, so four excavations and one unmatched identity remain.
    assert merged.count() == 5
    got = rows(clutch.unify_clutches(excavated, identified, older), "event_id", "eggs", "id", "year")
    assert got == [("e1", 80.0, "t1", 2012), ("o1", 75.0, "t1", 2010)]


def test_join_on_null_ids_and_fan_out(spark):
    c = spark.createDataFrame([("e1", None), ("e2", "t"), ("e3", "t")], "event_id string, id string")
    m = spark.createDataFrame([("e1", None, 1.0), ("e2", "t", 2.0), ("e2", "t", 3.0)], "event_id string, id string, size double")
    assert rows(clutch.clutch_with_size(c, m), "event_id", "size") == [("e1", 1.0), ("e2", 2.0), ("e2", 3.0), ("e3", None)]


def test_report_tables(spark, sightings):
    measured = report.measured(sightings.withColumn("width", F.lit(100.0)))
    assert report.longevity_table(measured).first().n == 1
    size = report.size_table(measured).first()
    assert (size.n, size.mean_size) == (3, 151.93)
    table = report.growth_table(measured, years=2, phases=(("all", 0, 31),))
    row = table.first()
    assert row.n == 3 and row.se == pytest.approx(row.sd / 3**0.5)
