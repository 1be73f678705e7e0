"""Every registered query against its SQL, and the shape of the plans."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from resight.operators import clean, growth, ranks
from resight.plans import driver_tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or v != v:
        return "null"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(n for n in entry_points.queries() if n.startswith("q_")))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(v) for v in r) for r in df.select(*columns).collect())
    assert got
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[i]) for i in order) for r in cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_growth_plan_has_one_row_exchange_and_no_python(spark):
    rows = driver_tables.measured(spark, FOLDER)
    text = plan(growth.season_growth(rows))
    # First sizes, both sides of their join, season means: no exchange of raw rows by individual alone.
    assert len(re.findall(r"Exchange hashpartitioning\(id", text)) <= 4
    assert "SinglePartition" not in text and "Python" not in text
    assert "PushedFilters" in text and "o_orderstatus" not in text


def test_rank_plan_sorts_nothing_in_one_task(spark):
    text = plan(ranks.midranks(driver_tables.events(spark, FOLDER), "value", group="event_type"))
    main = text.split("Subquery")[0]
    for window in re.findall(r"Window \[.*?\n", main):
        assert "__bucket" in window or "__total" in window
    assert "Python" not in text and "CartesianProduct" not in text


def test_no_cross_joins(spark):
    for name in ("q_m_array", "q_kruskal", "q_ols_diagnostics", "q_hist", "q_grid_complete", "q_box"):
        text = plan(entry_points.queries()[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_the_season_filter_windows_no_raw_rows(spark):
    text = plan(clean.season_consistent(driver_tables.nests(spark, FOLDER), 1e5))
    assert "Window" not in text and "partial_min_by" in text


def test_queries_are_built_without_a_job(spark):
    tracker = spark.sparkContext.statusTracker()
    for name in (
        "q_season_consistent", "q_long_lived", "q_size_at_maturity_all", "q_clutch_interval",
        "q_growth_summary_all", "q_growth_by_phase", "q_levene", "q_box", "q_density", "q_group_points",
    ):
        group = f"built-{name}"
        spark.sparkContext.setJobGroup(group, name)
        entry_points.queries()[name](spark, FOLDER)
        # Reading a parquet footer is a job of its own.
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        assert sum(len(j.stageIds) for j in jobs) == len(jobs) and len(jobs) <= 4, name
    spark.sparkContext.setJobGroup("rest", "rest")
