"""One registered query per operator, over the whole driver tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resight.operators import chart, clean, clutch, growth, linear, longevity, ranks
from resight.operators import cjs as capture
from resight.operators import histories as hist
from resight.operators import mixed, smooth, survival
from resight.operators.quantiles import summarise
from resight.operators.skew import null_safe_join
from resight.plans import driver_tables as t
from resight.plans import report
from resight.sources import histories as history_text
from resight.sources import tables as io

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(name: str, digits: int | None = 6):
    """Register a query; fractional columns are rounded so that summation order cannot show."""

    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(spark, folder)
            return out if digits is None else chart.rounded(out, digits)

        _registry[name] = run
        return run

    return register


def registered() -> dict[str, Query]:
    return dict(_registry)


# Cleaning


@query("q_successful_nests")
def _(spark, d):
    return clean.successful_nests(t.sightings(spark, d), t.OUTCOMES)


@query("q_date_parts")
def _(spark, d):
    """Dates go through their month/day/year text form."""
    text = t.sightings(spark, d).withColumn("dt", F.date_format("dt", "M/d/yyyy"))
    return clean.with_date_parts(text).drop("result", "size")


@query("q_season_consistent")
def _(spark, d):
    return t.measured(spark, d).select("id", "event_id", "dt", "season", "size", "first_size")


@query("q_long_lived")
def _(spark, d):
    rows = clean.long_lived(t.measured(spark, d), t.LONG_LIVED)
    return rows.select("id", "event_id", "season", "size")


@query("q_size_at_maturity_all", 4)
def _(spark, d):
    first = clean.size_at_maturity(t.measured(spark, d))
    return report.size_summary(t.with_width(first, spark, d))


@query("q_size_at_maturity_first", 4)
def _(spark, d):
    first = clean.size_at_maturity(t.measured(spark, d), one_per_id=True)
    return report.size_summary(t.with_width(first, spark, d))


@query("q_size_first_rows")
def _(spark, d):
    return clean.size_at_maturity(t.measured(spark, d), one_per_id=True).select(
        "id", "event_id", "dt", "season", "size"
    )


# Longevity


@query("q_span")
def _(spark, d):
    return longevity.reproductive_span(t.measured(spark, d))


def _longevity(name: str, **limits):
    @query(name)
    def _(spark, d):
        span = longevity.reproductive_span(t.measured(spark, d))
        return longevity.longevity_summary(longevity.cohort(span, **limits))


_longevity("q_longevity_summary_all")
_longevity("q_longevity_summary_gt0", positive=True)
_longevity("q_longevity_summary_ge3", min_longevity=3)
_longevity("q_longevity_summary_cohort", min_longevity=3, first_year_from=1996)


@query("q_report_longevity", None)
def _(spark, d):
    return report.longevity_table(t.measured(spark, d))


# Growth


def _interval(spark, d):
    return growth.interval_growth(t.measured(spark, d))


@query("q_interval_growth", None)
def _(spark, d):
    return _interval(spark, d).select(
        "id", "event_id", "dt", "prev_dt", "days_elapsed", "growth", "growth_rate", "years_since_first"
    )


@query("q_interval_growth_unfiltered", None)
def _(spark, d):
    """As the earliest analysis does it: without season filter or cohort."""
    return growth.interval_growth(t.nests(spark, d)).select(
        "id", "event_id", "days_elapsed", "growth", "growth_rate"
    )


def _growth_summary(name: str, condition=None, long_only: bool = True):
    @query(name, 3)
    def _(spark, d):
        rows = t.measured(spark, d)
        if long_only:
            rows = clean.long_lived(rows, t.LONG_LIVED)
        rates = growth.interval_growth(rows)
        if condition is not None:
            rates = rates.where(condition)
        return summarise(rates, "growth_rate").drop("n_valid")


_growth_summary("q_growth_summary_all")
_growth_summary("q_growth_summary_pos", "growth_rate > 0")
_growth_summary("q_growth_summary_realistic", "growth_rate > -1")


@query("q_season_growth")
def _(spark, d):
    return growth.season_growth(t.measured(spark, d)).select(
        "id", "season", "mean_size", "n_meas", "prev_season", "prev_size", "interval", "growth",
        "growth_rate",
    )


@query("q_growth_sample_sizes")
def _(spark, d):
    return _interval(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("q_growth_by_phase", 3)
def _(spark, d):
    return report.growth_table(
        t.measured(spark, d), t.LONG_LIVED, None, t.PHASES
    )


def _grouped_growth(spark, d, groups=t.GROUPS, inclusive=False):
    rows = t.measured(spark, d)
    span = longevity.reproductive_span(rows)
    labels = growth.longevity_group(span, groups, inclusive)
    return null_safe_join(growth.season_growth(rows), labels, ["id"], "left")


@query("q_growth_by_group_v1", 3)
def _(spark, d):
    rates = _grouped_growth(spark, d, t.GROUPS_INCLUSIVE, True)
    return report.phase_summary(rates, "longevity_group", [g[0] for g in t.GROUPS_INCLUSIVE])


@query("q_growth_by_group_v2", 3)
def _(spark, d):
    rates = _grouped_growth(spark, d)
    return report.phase_summary(rates, "longevity_group", [g[0] for g in t.GROUPS])


@query("q_individual_growth")
def _(spark, d):
    return growth.individual_growth(_grouped_growth(spark, d))


@query("q_years_reproducing")
def _(spark, d):
    return growth.years_reproducing(t.measured(spark, d))


@query("q_growth_with_years")
def _(spark, d):
    return _growth_with_years(spark, d).select("id", "season", "growth_rate", "years_reproducing")


def _growth_with_years(spark, d):
    rows = t.measured(spark, d)
    return null_safe_join(
        growth.season_growth(rows), growth.years_reproducing(rows), ["id", "season"], "left"
    )


# Clutches


def _clutches(spark, d):
    return clutch.unify_clutches(*t.clutch_tables(spark, d))


def _sized(spark, d):
    rows = clutch.clutch_with_size(_clutches(spark, d), t.measured(spark, d))
    return rows.withColumn("size", F.col("size") / t.UNIT)


def _returned(spark, d):
    return clutch.clutch_return_interval(_sized(spark, d))


@query("q_clutch_full_join")
def _(spark, d):
    excavated, identified, _ = t.clutch_tables(spark, d)
    return clutch.join_suffixed(excavated, identified, "event_id").drop("dt")


@query("q_clutch_unify")
def _(spark, d):
    return _clutches(spark, d)


@query("q_clutch_with_size", 8)
def _(spark, d):
    return _sized(spark, d)


@query("q_clutch_interval", 8)
def _(spark, d):
    return _returned(spark, d).select("id", "event_id", "year", "prev_year", "return_interval", "size")


# Histories and capture-recapture


@query("q_grid_complete")
def _(spark, d):
    return hist.complete_grid(t.measured(spark, d))


@query("q_histories")
def _(spark, d):
    return hist.capture_histories(t.measured(spark, d))


def _frequencies(spark, d):
    return hist.history_frequencies(hist.capture_histories(t.measured(spark, d)))


def _fitted_frequencies(spark, d):
    """Kept for the fit and for what is derived from it: a small table at the end of the whole cleaning."""
    return _frequencies(spark, d).persist(StorageLevel.MEMORY_AND_DISK)


@query("q_history_freq")
def _(spark, d):
    return _frequencies(spark, d)


@query("q_history_lines")
def _(spark, d):
    """Written as text lines and parsed back."""
    return history_text.parse_history_lines(history_text.history_lines(_frequencies(spark, d)))


@query("q_history_file")
def _(spark, d):
    """As the lines of a text file, read back."""
    return history_text.parse_history_lines(history_text.history_lines(_frequencies(spark, d)))


@query("q_expected_lines")
def _(spark, d):
    """Observed and expected counts through their text form."""
    rows = _fitted_frequencies(spark, d)
    counts = capture.expected_counts(rows, capture.fit_cjs(rows))
    text = F.format_string(" %s\t %.1f\t %.6f", "ch", F.col("observed").cast("double"), "expected")
    return history_text.parse_expected_lines(counts.select(text.alias("value")))


@query("q_history_to_span")
def _(spark, d):
    rows = t.measured(spark, d)
    first, _ = hist.study_years(rows)
    return hist.history_spans(hist.capture_histories(rows), first).select(
        "id", "first_year", "last_year", "longevity"
    )


@query("q_m_array")
def _(spark, d):
    return hist.m_array(_frequencies(spark, d)).drop("occasions")


@query("q_cjs")
def _(spark, d):
    return capture.estimates_by(capture.fit_cjs_by(_frequencies(spark, d)))


@query("q_cjs_fit", 4)
def _(spark, d):
    rows = _fitted_frequencies(spark, d)
    return capture.fit_statistics(rows, capture.fit_cjs(rows))


@query("q_expected_counts")
def _(spark, d):
    rows = _fitted_frequencies(spark, d)
    return capture.expected_counts(rows, capture.fit_cjs(rows))


def _balance_level(spark, d):
    level = F.when(F.col("c_acctbal") >= 4500, "high").otherwise("low").alias("balance")
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), level)


def _by_balance(spark, d):
    """Histories of customers by the level of their balance, collapsed."""
    rows = hist.capture_histories(t.measured(spark, d)).join(_balance_level(spark, d), "id")
    return hist.history_frequencies(rows, ["balance"])


@query("q_cjs_by_balance")
def _(spark, d):
    """A fit for each group, in one plan."""
    return capture.estimates_by(capture.fit_cjs_by(_by_balance(spark, d), ["balance"]), ["balance"])


@query("q_cjs_fit_by_balance", 4)
def _(spark, d):
    rows = _by_balance(spark, d)
    return capture.fit_statistics_by(rows, capture.fit_cjs_by(rows, ["balance"]), ["balance"])


@query("q_expected_counts_by_balance")
def _(spark, d):
    rows = _by_balance(spark, d)
    return capture.expected_counts_by(rows, capture.fit_cjs_by(rows, ["balance"]), ["balance"])


@query("q_expected_longevity_by_balance", 4)
def _(spark, d):
    return capture.expected_longevity_by(capture.fit_cjs_by(_by_balance(spark, d), ["balance"]), ["balance"])


@query("q_expected_longevity_by_year", 4)
def _(spark, d):
    rows = t.measured(spark, d)
    fit = capture.fit_cjs(hist.history_frequencies(hist.capture_histories(rows)))
    return capture.constant_by_year(fit.expected_longevity(spark), *hist.study_years(rows))


# Survival


def _survival(spark, d, repeat=False):
    span = longevity.reproductive_span(t.measured(spark, d))
    return longevity.survival_input(longevity.repeat_only(span) if repeat else span, t.nests(spark, d))


@query("q_survival_input")
def _(spark, d):
    return _survival(spark, d)


@query("q_km")
def _(spark, d):
    return survival.kaplan_meier(_survival(spark, d))


@query("q_km_summary")
def _(spark, d):
    return survival.survival_summary(survival.kaplan_meier(_survival(spark, d)))


@query("q_km_repeat")
def _(spark, d):
    return survival.kaplan_meier(_survival(spark, d, repeat=True))


@query("q_km_repeat_summary")
def _(spark, d):
    return survival.survival_summary(survival.kaplan_meier(_survival(spark, d, repeat=True)))


@query("q_km_by_first_year")
def _(spark, d):
    return survival.kaplan_meier(_survival(spark, d), ["first_year"])


# Rank tests and tests on means, on event values by event type


@query("q_midrank")
def _(spark, d):
    return ranks.midranks(t.events(spark, d), "value", group="event_type")


@query("q_midrank_within_group")
def _(spark, d):
    return ranks.midranks(t.events(spark, d), "value", ["event_type"])


@query("q_kruskal")
def _(spark, d):
    return ranks.kruskal_wallis(t.events(spark, d), "value", "event_type")


@query("q_kruskal_growth")
def _(spark, d):
    means = growth.individual_growth(_grouped_growth(spark, d))
    return ranks.kruskal_wallis(means, "mean_rate", "longevity_group")


@query("q_dunn")
def _(spark, d):
    out = ranks.dunn(t.events(spark, d), "value", "event_type")
    return out.withColumn("comparison_key", ranks.comparison_key(F.col("comparison")))


@query("q_dunn_letters")
def _(spark, d):
    """Letters of the lengths of texts by their place in a conversation, later places together."""
    rows = t.table(spark, d, "conversations").select(
        F.length("text").cast("double").alias("length"), F.least("turn", F.lit(6)).cast("string").alias("place")
    )
    return ranks.dunn_letters(rows, "length", "place")


@query("q_signed_rank")
def _(spark, d):
    return ranks.signed_rank(t.events(spark, d), "value", 40.0)


@query("q_signed_rank_longevity")
def _(spark, d):
    span = longevity.cohort(longevity.reproductive_span(t.measured(spark, d)), min_longevity=3)
    return ranks.signed_rank(span, "longevity", 5)


@query("q_shapiro")
def _(spark, d):
    return linear.shapiro(t.events(spark, d), "value", ["event_type"])


@query("q_shapiro_growth")
def _(spark, d):
    """Per phase of growth between seasons, small groups included."""
    means = growth.individual_growth(_grouped_growth(spark, d))
    return linear.shapiro(means, "mean_rate", ["longevity_group"])


@query("q_t_test")
def _(spark, d):
    return linear.t_test(t.events(spark, d), "value", 49.5)


@query("q_t_test_by_group")
def _(spark, d):
    return linear.t_test(t.events(spark, d), "value", 49.5, ["event_type"])


@query("q_anova", 5)
def _(spark, d):
    return linear.anova(t.events(spark, d), "value", "event_type")


@query("q_levene", 5)
def _(spark, d):
    return linear.levene(t.events(spark, d), "value", "event_type")


@query("q_tukey_pairs")
def _(spark, d):
    return linear.tukey_statistic(t.events(spark, d), "value", "event_type")


@query("q_tukey")
def _(spark, d):
    return linear.tukey(t.events(spark, d), "value", "event_type")


# Least squares


@query("q_ols_hatch_size")
def _(spark, d):
    return linear.fit_line(_sized(spark, d), "hatch", "size")


@query("q_ols_hatch_interval")
def _(spark, d):
    return linear.fit_line(_returned(spark, d), "hatch", "return_interval")


def _first_sizes(spark, d):
    rows = clean.size_at_maturity(t.measured(spark, d), one_per_id=True)
    return rows.select("id", "season", (F.col("size") / t.UNIT).alias("size"))


@query("q_ols_eggs_size", 5)
def _(spark, d):
    return linear.fit_line(_sized(spark, d), "eggs", "size")


@query("q_ols_eggs_interval", 5)
def _(spark, d):
    return linear.fit_line(_returned(spark, d), "eggs", "return_interval")


@query("q_ols_season_size", 5)
def _(spark, d):
    """Season on size, the way round the fit is made; the chart shows size on season."""
    return linear.fit_line(_first_sizes(spark, d), "season", "size")


def _scaled_growth(spark, d):
    return _growth_with_years(spark, d).withColumn("growth_rate", F.col("growth_rate") / t.UNIT)


@query("q_ols_growth_years")
def _(spark, d):
    return linear.fit_line(_scaled_growth(spark, d), "growth_rate", "years_reproducing")


@query("q_ols_by_group")
def _(spark, d):
    rows = _sized(spark, d).withColumn("quarter", F.quarter("dt"))
    return linear.fit_line(rows, "hatch", "size", ["quarter"])


@query("q_ols_diagnostics")
def _(spark, d):
    return linear.diagnostics(_sized(spark, d), "hatch", "size").drop(
        "unhatched", "eggs", "hatch", "size", "dt", "month", "day", "year"
    )


@query("q_breusch_pagan")
def _(spark, d):
    return linear.breusch_pagan(_sized(spark, d), "hatch", "size")


@query("q_aic", 4)
def _(spark, d):
    return linear.line_aic(_scaled_growth(spark, d), "growth_rate", "years_reproducing")


@query("q_aic_line_vs_smooth", 4)
def _(spark, d):
    rows = _scaled_growth(spark, d)
    fit = smooth.fit_smooths(rows, "growth_rate", ["years_reproducing"])
    line = linear.line_aic(rows, "growth_rate", "years_reproducing")
    curve = fit.summary(spark).select((F.col("total_edf") + 1).alias("df"), "aic")
    return line.select(F.lit("line").alias("model"), "df", "aic").unionByName(
        curve.select(F.lit("smooth").alias("model"), "df", "aic")
    )


# Mixed model and smooths


@query("q_lmm", 5)
def _(spark, d):
    rows = _scaled_growth(spark, d)
    return mixed.fit_random_intercept(rows, "growth_rate", "years_reproducing").summary(spark)


@query("q_lmm_effects", 5)
def _(spark, d):
    rows = _scaled_growth(spark, d)
    fit = mixed.fit_random_intercept(rows, "growth_rate", "years_reproducing")
    return fit.random_effects(rows, "growth_rate", "years_reproducing")


def _growth_by_balance(spark, d):
    return _scaled_growth(spark, d).join(_balance_level(spark, d), "id")


def _lmm_by_balance(spark, d):
    return mixed.fit_random_intercept_by(_growth_by_balance(spark, d), "growth_rate", "years_reproducing", ["balance"])


@query("q_lmm_by_balance", 5)
def _(spark, d):
    """A fit for each group, in one plan."""
    return mixed.terms_by(_lmm_by_balance(spark, d), ["balance"])


@query("q_lmm_effects_by_balance", 5)
def _(spark, d):
    rows = _growth_by_balance(spark, d)
    return mixed.random_effects_by(rows, _lmm_by_balance(spark, d), "growth_rate", "years_reproducing", ["balance"])


def _smooth_rows(spark, d):
    rows = t.measured(spark, d)
    span = longevity.reproductive_span(rows).select(
        "id", F.col("longevity").alias("years_reproducing")
    )
    joined = null_safe_join(growth.season_growth(rows), span, ["id"], "left")
    return joined.select(
        "id",
        "season",
        "interval",
        "years_reproducing",
        (F.col("prev_size") / t.UNIT).alias("prev_size"),
        (F.col("growth_rate") / t.UNIT).alias("growth_rate"),
    )


PREDICTORS = ("prev_size", "interval", "years_reproducing")


@query("q_smooth", 4)
def _(spark, d):
    rows = _smooth_rows(spark, d)
    fits = smooth.fit_each(rows, "growth_rate", PREDICTORS)
    return functools.reduce(DataFrame.unionByName, [f.summary(spark) for f in fits])


@query("q_smooth_additive", 4)
def _(spark, d):
    return smooth.fit_smooths(_smooth_rows(spark, d), "growth_rate", PREDICTORS).summary(spark)


@query("q_smooth_grid", 4)
def _(spark, d):
    fit = smooth.fit_smooths(_smooth_rows(spark, d), "growth_rate", ["prev_size"])
    return fit.grid(spark, "prev_size")


@query("q_smooth_residuals", 4)
def _(spark, d):
    rows = _smooth_rows(spark, d)
    fit = smooth.fit_smooths(rows, "growth_rate", PREDICTORS)
    return fit.residuals(rows).select("id", "season", "fitted", "residual")


# Chart tables


@query("q_hist")
def _(spark, d):
    return chart.histogram(t.events(spark, d), "value")


@query("q_hist_longevity")
def _(spark, d):
    return chart.histogram(longevity.reproductive_span(t.measured(spark, d)), "longevity")


@query("q_box")
def _(spark, d):
    return chart.box_statistics(t.events(spark, d), "value", ["event_type"])


@query("q_box_outliers")
def _(spark, d):
    return chart.box_outliers(t.events(spark, d), "value", ["event_type"])


@query("q_density")
def _(spark, d):
    return chart.density(t.events(spark, d), "value", ["event_type"])


@query("q_qq")
def _(spark, d):
    return chart.qq_points(t.events(spark, d), "value")


@query("q_qq_line")
def _(spark, d):
    return chart.qq_line(t.events(spark, d), "value")


@query("q_mean_sd_bar")
def _(spark, d):
    return chart.mean_sd_bars(t.events(spark, d), "value", ["event_type"])


@query("q_group_points")
def _(spark, d):
    return chart.group_points(t.events(spark, d), "value", ["event_type"])


@query("q_label_heights")
def _(spark, d):
    return chart.label_heights(t.events(spark, d), "value", ["event_type"])


@query("q_mean_line", 4)
def _(spark, d):
    return chart.mean_line(_first_sizes(spark, d), "size")


@query("q_ols_band")
def _(spark, d):
    return linear.band(_sized(spark, d), "hatch", "size")


@query("q_scatter", 8)
def _(spark, d):
    return chart.scatter(_first_sizes(spark, d), "season", "size")


# Sources


@query("q_distinct_ids")
def _(spark, d):
    return io.distinct_count(t.measured(spark, d), "id")


@query("q_profile")
def _(spark, d):
    return io.profile(t.table(spark, d, "orders"), exact=True)


SIGHTING_FILE = {
    "o_custkey": ("id", T.LongType()),
    "o_orderkey": ("event_id", T.LongType()),
    "o_orderdate": ("dt", T.StringType()),
    "o_orderpriority": ("result", T.StringType()),
    "o_totalprice": ("size", T.DoubleType()),
}


def _sighting_lines(spark: SparkSession, d: str, damage: bool):
    """The orders as CSV lines with month/day/year dates; ``damage`` spoils the price of urgent orders."""
    rows = t.table(spark, d, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.date_format("o_orderdate", "M/d/yyyy").alias("o_orderdate"),
        "o_orderpriority",
        F.when(
            F.lit(damage) & (F.col("o_orderpriority") == "1-URGENT"), F.lit("lost")
        ).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
    )
    return io.csv_lines(rows), rows.columns


@query("q_export")
def _(spark, d):
    """The merged clutch table as CSV lines, read back with its types."""
    rows = _clutches(spark, d)
    types = {f.name: (f.name, f.dataType) for f in rows.schema}
    return io.parse_csv_lines(io.csv_lines(rows), rows.columns, types)


@query("q_csv_sightings")
def _(spark, d):
    lines, header = _sighting_lines(spark, d, damage=False)
    rows = io.canonical(io.parse_csv_lines(lines, header, SIGHTING_FILE), SIGHTING_FILE)
    return clean.with_date_parts(rows).select("id", "event_id", "dt", "result", "size", "season")


@query("q_rejects")
def _(spark, d):
    lines, header = _sighting_lines(spark, d, damage=True)
    bad = io.rejects(io.parse_csv_lines(lines, header, SIGHTING_FILE, keep_corrupt=True))
    return bad.select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")


@query("q_csv_clutches")
def _(spark, d):
    """Excavations as CSV lines in which either of two columns holds the date, read under their short names."""
    rows = t.clutch_tables(spark, d)[2]
    by_header = {"SPNWR_ID": "event_id", "Total unhatched": "unhatched", "Total eggs": "eggs", "Hatch success (%)": "hatch", "OriginalTagID": "id"}
    lines = io.csv_lines(
        rows.select(
            *[F.col(c).alias(h) for h, c in by_header.items()],
            F.when(F.col("id") % 2 == 0, F.col("dt")).alias("Date"),
            F.when(F.col("id") % 2 == 1, F.col("dt")).alias("DateOfActivity"),
        )
    )
    header = [*by_header, "Date", "DateOfActivity"]
    return io.canonical(io.parse_csv_lines(lines, header, io.EXCAVATION), io.EXCAVATION)


@query("q_clutch_files")
def _(spark, d):
    """Excavations written as CSV files of two layouts and read by their headers."""
    rows = t.clutch_tables(spark, d)[2]
    even = rows.where("id % 2 = 0").select(
        F.col("event_id").alias("SPNWR_ID"), F.col("unhatched").alias("Total unhatched"), F.col("eggs").alias("Total eggs"),
        F.col("hatch").alias("Hatch success (%)"), F.col("id").alias("OriginalTagID"), F.col("dt").alias("Date"),
    )
    odd = rows.where("id % 2 = 1").select(
        F.col("dt").alias("DateOfActivity"), F.lit("none").alias("Notes"), F.col("id").alias("OriginalTagID"), F.col("hatch").alias("Hatch success (%)"),
        F.col("eggs").alias("Total eggs"), F.col("unhatched").alias("Total unhatched"), F.col("event_id").alias("SPNWR_ID"),
    )
    folder = io.shared_folder(spark, "clutches")
    for name, layout in (("even", even), ("odd", odd)):
        io.write_table(layout, f"{folder}/{name}", "csv")
    return io.read_clutches(spark, [f"{folder}/even", f"{folder}/odd"])


@query("q_dunn_growth")
def _(spark, d):
    """Pairs of growth groups, whose names hold number ranges, with the keys that labels are matched on."""
    out = ranks.dunn(growth.individual_growth(_grouped_growth(spark, d)), "mean_rate", "longevity_group")
    return out.withColumn("comparison_key", ranks.comparison_key(F.col("comparison")))


@query("q_report_size")
def _(spark, d):
    return report.size_table(t.with_width(t.measured(spark, d), spark, d))


@query("q_report_growth", 3)
def _(spark, d):
    """The report's growth by phase: rates above minus one only."""
    return report.growth_table(t.measured(spark, d), t.LONG_LIVED, -1.0, t.PHASES)


@query("q_lmm_conditional", 5)
def _(spark, d):
    rows = _scaled_growth(spark, d)
    fit = mixed.fit_random_intercept(rows, "growth_rate", "years_reproducing")
    out = fit.conditional(rows, "growth_rate", "years_reproducing")
    return out.select("id", "season", "fitted", "residual")


@query("q_ols_residual_qq", None)
def _(spark, d):
    out = linear.residual_quantiles(_sized(spark, d), "hatch", "size")
    digits = {"hatch": 8, "size": 8, "std_residual": 4, "normal_quantile": 4}
    return out.select("n", *[F.round(c, k).alias(c) for c, k in digits.items()])
