"""SQL counterparts of the registered queries, written row by row in the plainest form.

They follow the definitions (lags over rows, global ranks, window products) and share none of the
Spark-side reductions, so that a shortcut that changed a result would show.
"""

from __future__ import annotations

from resight.functions.scalar import normal_quantile_sql
from resight.functions.tails import (
    ROYSTON_C1,
    ROYSTON_C2,
    ROYSTON_LARGE_MEAN,
    ROYSTON_LARGE_SD,
    ROYSTON_SMALL_MEAN,
    ROYSTON_SMALL_SD,
)
from resight.plans import driver_tables as t

_OUT = ", ".join(f"'{o}'" for o in t.OUTCOMES)

# Labels of comparisons: number ranges with an underscore, then the groups parted by a bare hyphen.
_KEY = r"replace(regexp_replace(ga || ' - ' || gb, '([0-9]+)-([0-9]+)', '\1_\2', 'g'), ' - ', '-')"

# Each relation names the relations it is built on.
_CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "sightings": (
        (),
        """SELECT o_custkey AS id, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS dt,
           o_orderpriority AS result, o_totalprice AS size FROM orders""",
    ),
    "nests": (
        ("sightings",),
        f"""SELECT *, CAST(year(dt) AS INTEGER) AS season, CAST(month(dt) AS INTEGER) AS month,
            CAST(day(dt) AS INTEGER) AS day FROM sightings WHERE lower(trim(result)) IN ({_OUT})""",
    ),
    "measured": (
        ("nests",),
        f"""SELECT * FROM (SELECT *, first_value(size) OVER (PARTITION BY id, season
            ORDER BY dt, event_id) AS first_size FROM nests)
            WHERE abs(size - first_size) <= {t.TOLERANCE}""",
    ),
    "lasting": (
        ("measured",),
        f"""SELECT * FROM (SELECT *, max(season) OVER (PARTITION BY id)
            - min(season) OVER (PARTITION BY id) AS lived FROM measured) WHERE lived >= {t.LONG_LIVED}""",
    ),
    "span": (
        ("measured",),
        """SELECT id, min(season) AS first_year, max(season) AS last_year,
           max(season) - min(season) AS longevity FROM measured GROUP BY id""",
    ),
    "maiden": (
        ("measured",),
        """SELECT * FROM (SELECT *, min(season) OVER (PARTITION BY id) AS first_season FROM measured)
           WHERE season = first_season""",
    ),
    "maiden_one": (
        ("maiden",),
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dt, event_id) AS rn
           FROM maiden) WHERE rn = 1""",
    ),
    "width": ((), "SELECT l_orderkey AS event_id, sum(l_quantity) AS width FROM lineitem GROUP BY 1"),
    "season_growth": (
        ("measured",),
        """SELECT *, season - prev_season AS interval, mean_size - prev_size AS growth,
           (mean_size - prev_size) / (season - prev_season) AS growth_rate
           FROM (SELECT *, lag(season) OVER w AS prev_season, lag(mean_size) OVER w AS prev_size
             FROM (SELECT id, season, avg(size) AS mean_size, count(*) AS n_meas FROM measured
                   GROUP BY id, season HAVING count(*) >= 2)
             WINDOW w AS (PARTITION BY id ORDER BY season)) WHERE prev_size IS NOT NULL""",
    ),
    "years": (
        ("measured",),
        """SELECT DISTINCT id, season, season - min(season) OVER (PARTITION BY id)
           AS years_reproducing FROM measured""",
    ),
    "growth_years": (
        ("season_growth", "years"),
        """SELECT g.id, g.season, growth_rate, years_reproducing FROM season_growth g
           LEFT JOIN years y ON g.id = y.id AND g.season = y.season""",
    ),
    "scaled_growth": (
        ("growth_years",),
        f"SELECT id, season, growth_rate / {t.UNIT} AS y, years_reproducing AS x FROM growth_years",
    ),
    "grouped": (
        ("season_growth", "span"),
        """SELECT g.*, CASE WHEN longevity <= 3 THEN '1-3' WHEN longevity <= 5 THEN '4-5'
           WHEN longevity > 5 THEN '5+' END AS longevity_group,
           CASE WHEN longevity <= 3 THEN 1 WHEN longevity <= 5 THEN 2 ELSE 3 END AS level
           FROM season_growth g LEFT JOIN span s ON g.id = s.id""",
    ),
    "grouped_inclusive": (
        ("season_growth", "span"),
        """SELECT g.*, CASE WHEN longevity + 1 <= 3 THEN '1-3' WHEN longevity + 1 <= 5 THEN '3-5'
           WHEN longevity + 1 <= 6 THEN '5-6' ELSE '6+' END AS longevity_group,
           CASE WHEN longevity + 1 <= 3 THEN 1 WHEN longevity + 1 <= 5 THEN 2
           WHEN longevity + 1 <= 6 THEN 3 ELSE 4 END AS level
           FROM season_growth g LEFT JOIN span s ON g.id = s.id""",
    ),
    "individual": (
        ("grouped",),
        """SELECT id, longevity_group, avg(growth_rate) AS mean_rate FROM grouped
           GROUP BY id, longevity_group""",
    ),
    "excavations": (
        (),
        """SELECT l_orderkey AS event_id, sum(l_quantity) AS unhatched,
           CAST(count(*) AS DOUBLE) AS eggs, avg(l_discount) AS hatch, max(l_shipdate) AS shipped
           FROM lineitem GROUP BY 1""",
    ),
    "clutches": (
        ("excavations",),
        f"""SELECT *, CAST(year(dt) AS INTEGER) AS year, CAST(month(dt) AS INTEGER) AS month,
            CAST(day(dt) AS INTEGER) AS day FROM (
            SELECT e.event_id, unhatched, eggs, hatch, o_custkey AS id, CAST(o_orderdate AS DATE) AS dt
            FROM (SELECT * FROM excavations WHERE shipped >= TIMESTAMP '{t.NEW_TABLE_FROM}') e
            FULL JOIN orders ON e.event_id = o_orderkey
            UNION ALL
            SELECT e.event_id, unhatched, eggs, hatch, o_custkey, CAST(o_orderdate AS DATE)
            FROM excavations e JOIN orders ON e.event_id = o_orderkey
            WHERE shipped < TIMESTAMP '{t.NEW_TABLE_FROM}')
            WHERE event_id IS NOT NULL AND unhatched IS NOT NULL AND eggs IS NOT NULL
            AND hatch IS NOT NULL AND id IS NOT NULL AND dt IS NOT NULL""",
    ),
    "sized": (
        ("clutches", "measured"),
        f"""SELECT c.*, m.size / {t.UNIT} AS size FROM clutches c
            LEFT JOIN measured m ON c.id = m.id AND c.event_id = m.event_id""",
    ),
    "returned": (
        ("sized",),
        """SELECT *, year - prev_year AS return_interval FROM (SELECT *, lag(year) OVER
           (PARTITION BY id ORDER BY year, event_id) AS prev_year FROM sized)
           WHERE prev_year IS NOT NULL AND size IS NOT NULL""",
    ),
    "grid": (
        ("measured",),
        """SELECT i.id, CAST(s.season AS INTEGER) AS season,
           CASE WHEN d.id IS NULL THEN 0 ELSE 1 END AS obs
           FROM (SELECT DISTINCT id FROM measured) i
           CROSS JOIN (SELECT unnest(generate_series(min(season), max(season))) AS season
                       FROM measured) s
           LEFT JOIN (SELECT DISTINCT id, season FROM measured) d
           ON d.id = i.id AND d.season = s.season""",
    ),
    "histories": (
        ("grid",),
        """SELECT id, string_agg(CAST(obs AS VARCHAR), '' ORDER BY season) AS ch
           FROM grid GROUP BY id""",
    ),
    "survival_rows": (
        ("span", "nests"),
        """SELECT id, first_year, last_year, longevity AS time, CASE WHEN last_year =
           (SELECT max(season) FROM nests) THEN 0 ELSE 1 END AS event FROM span""",
    ),
}


def _with(needs: tuple[str, ...], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for below in _CTE[name][0]:
            visit(below)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = ", ".join(f"{n} AS ({_CTE[n][1]})" for n in order)
    return f"WITH {parts} {body}" if parts else body


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"


# Numeric integration (Simpson) for tails that SQL has no function for.
_STEPS = 4000


def _simpson(density: str, upper: str) -> str:
    """Integral of ``density`` (in x) from 0 to ``upper``."""
    h = f"(({upper}) / {_STEPS})"
    weight = f"CASE WHEN k IN (0, {_STEPS}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    at = density.replace("{x}", f"(k * {h})")
    return f"(list_sum(list_transform(range(0, {_STEPS} + 1), lambda k: ({weight}) * ({at}))) * {h} / 3)"


def _normal_p(z: str) -> str:
    area = _simpson("exp(-{x} * {x} / 2) / sqrt(2 * pi())", f"least(abs({z}), 38e0)")
    return f"greatest(0e0, 1e0 - 2 * {area})"


def _t_p(tval: str, df: str) -> str:
    scale = f"(exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()))"
    # Substituting x = tan(u) sqrt(df) keeps the range finite for any t.
    area = _simpson(f"pow(cos({{x}}), {df} - 1) * sqrt({df})", f"atan(abs({tval}) / sqrt({df}))")
    return f"greatest(0e0, 1e0 - 2 * {scale} * {area})"


def _t_critical(df: str) -> str:
    """Two-sided 5% point by the expansion of the t quantile in 1/df (df of a thousand or more)."""
    z = 1.959963984540054
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    return "(" + " + ".join([repr(z)] + [f"{c!r} / pow({df}, {i})" for i, c in enumerate(terms, 1)]) + ")"


def _chi2_p(x: str, df: str) -> str:
    return (
        f"CASE WHEN {df} = 1 THEN {_normal_p(f'sqrt({x})')} WHEN {df} = 2 THEN exp(-{x} / 2) "
        f"WHEN {df} = 4 THEN exp(-{x} / 2) * (1 + {x} / 2) END"
    )


def _f4_p(f: str, df2: str) -> str:
    """Upper F tail with four numerator degrees of freedom."""
    x = f"({df2} / ({df2} + 4 * {f}))"
    return f"pow({x}, {df2} / 2) * (1 + {df2} / 2 * (1 - {x}))"


def _poly(coefs, x: str) -> str:
    return "(" + " + ".join(f"{c!r} * pow({x}, {i})" for i, c in enumerate(coefs)) + ")"


def _interval(source: str) -> str:
    return f"""SELECT *, growth / (days_elapsed / 365.25) AS growth_rate FROM (
        SELECT id, event_id, dt, prev_dt, CAST(date_diff('day', prev_dt, dt) AS DOUBLE) AS days_elapsed,
        size - prev_size AS growth, date_diff('day', first_dt, dt) / 365.25 AS years_since_first
        FROM (SELECT *, lag(dt) OVER w AS prev_dt, lag(size) OVER w AS prev_size,
              min(dt) OVER (PARTITION BY id) AS first_dt FROM {source}
              WINDOW w AS (PARTITION BY id ORDER BY dt, event_id)))
        WHERE days_elapsed > 0 AND growth IS NOT NULL"""


def _summary(source: str, where: str, d: int) -> str:
    v = "growth_rate"
    return f"""SELECT count(*) AS n, {_r(f'avg({v})', d)} AS mean, {_r(f'stddev_samp({v})', d)} AS sd,
        {_r(f'min({v})', d)} AS min, {_r(f'max({v})', d)} AS max,
        {_r(f'quantile_cont({v}, 0.5)', d)} AS median FROM ({source}) WHERE {where}"""


def _longevity(where: str, d: int = 6) -> str:
    return _with(
        ("span",),
        f"""SELECT count(*) AS n, {_r('avg(longevity)', d)} AS mean,
        {_r('median(longevity)', d)} AS median, {_r('stddev_samp(longevity)', d)} AS sd,
        min(longevity) AS min, max(longevity) AS max FROM span WHERE {where}""",
    )


def _by_label(source: str, label: str, level: str, d: int = 3) -> str:
    v = "growth_rate"
    return f"""SELECT {label}, CAST(min({level}) AS INTEGER) AS level, count(*) AS n,
        {_r(f'avg({v})', d)} AS mean, {_r(f'quantile_cont({v}, 0.5)', d)} AS median,
        {_r(f'stddev_samp({v})', d)} AS sd, {_r(f'min({v})', d)} AS min, {_r(f'max({v})', d)} AS max,
        {_r(f'stddev_samp({v}) / sqrt(count(*))', d)} AS se FROM {source} GROUP BY {label}"""


def _sizes(source: str) -> str:
    cols = ", ".join(
        f"{_r(f'{fn}({c})', 4)} AS {name}_{c}"
        for c in ("size", "width")
        for name, fn in (("min", "min"), ("mean", "avg"), ("sd", "stddev_samp"), ("max", "max"))
    )
    return _with(
        (source, "width"),
        f"SELECT count(*) AS n, {cols} FROM {source} m LEFT JOIN width w ON m.event_id = w.event_id",
    )


def _km_cte(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""risk AS (SELECT {k}time, CAST(sum(event) AS BIGINT) AS n_event,
        CAST(sum(1 - event) AS BIGINT) AS n_censor FROM {source} GROUP BY {k}time),
        risk2 AS (SELECT *, CAST(sum(n_event + n_censor) OVER ({part}ORDER BY time
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS n_risk FROM risk),
        curve AS (SELECT *, product(1 - n_event / n_risk) OVER ({part}ORDER BY time) AS survival,
          sqrt(sum(CASE WHEN n_risk > n_event THEN n_event / (CAST(n_risk AS DOUBLE) * (n_risk - n_event)) END)
          OVER ({part}ORDER BY time)) AS g FROM risk2)"""


_REPEAT = "(SELECT * FROM survival_rows WHERE last_year - first_year + 1 > 1)"


def _km(source: str, keys: str = "") -> str:
    body = f"""SELECT {keys + ', ' if keys else ''}time, n_risk, n_event, n_censor, {_r('survival')} AS survival,
        CASE WHEN survival > 0 THEN {_r('survival * g')} END AS std_err,
        CASE WHEN survival > 0 THEN {_r('survival * exp(-1.959963984540054 * g)')} END AS lower,
        CASE WHEN survival > 0 THEN {_r('least(1, survival * exp(1.959963984540054 * g))')} END AS upper
        FROM curve"""
    return _with(("survival_rows",), "").rstrip() + ", " + _km_cte(source, keys) + " " + body


def _km_summary(source: str) -> str:
    body = f"""SELECT max(n_risk) AS n, CAST(sum(n_event) AS BIGINT) AS events,
        {_r('''CASE WHEN max(CASE WHEN abs(survival - 0.5) <= 1e-9 THEN 1 ELSE 0 END) = 1 THEN
          (min(CASE WHEN survival <= 0.5 + 1e-9 THEN time END)
           + coalesce(min(CASE WHEN survival < 0.5 - 1e-9 THEN time END),
                      min(CASE WHEN survival <= 0.5 + 1e-9 THEN time END))) / 2
          ELSE CAST(min(CASE WHEN survival <= 0.5 + 1e-9 THEN time END) AS DOUBLE) END''')} AS median,
        {_r('sum(survival * (time - before))')} AS right_endpoint_area,
        {_r('sum(held * (time - before))')} AS restricted_mean,
        {_r('sum(time * survival) / max(time)')} AS ratio
        FROM (SELECT *, lag(time, 1, 0) OVER (ORDER BY time) AS before,
              coalesce(lag(survival) OVER (ORDER BY time), 1) AS held FROM curve)"""
    return _with(("survival_rows",), "").rstrip() + ", " + _km_cte(source) + " " + body


def _ols(source: str, y: str, x: str, d: int = 6, by: str = "") -> str:
    """Least squares from centred sums."""
    k = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = "USING (" + by + ")" if by else "ON true"
    names = (
        "mean_x slope intercept sxx syy sxy rss df sigma r2 adj_r2 slope_se intercept_se t_slope "
        "t_intercept f"
    ).split()
    cols = ", ".join(f"{_r(c, d)} AS {c}" for c in names)
    return f"""SELECT {k}n, {cols}, {_r(_t_p('t_slope', 'df'), d)} AS p_slope,
        {_r(_t_p('t_intercept', 'df'), d)} AS p_intercept FROM ({_ols_core(source, y, x, by)})"""


def _ols_core(source: str, y: str, x: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN centre USING ({by})" if by else "CROSS JOIN centre"
    return f"""WITH complete AS (SELECT {k}CAST({y} AS DOUBLE) AS yy, CAST({x} AS DOUBLE) AS xx
          FROM {source} WHERE {y} IS NOT NULL AND {x} IS NOT NULL),
        centre AS (SELECT {k}count(*) AS n, avg(xx) AS mean_x, avg(yy) AS mean_y FROM complete {group}),
        sums AS (SELECT {k}max(n) AS n, max(mean_x) AS mean_x, max(mean_y) AS mean_y,
          sum((xx - mean_x) * (xx - mean_x)) AS sxx, sum((yy - mean_y) * (yy - mean_y)) AS syy,
          sum((xx - mean_x) * (yy - mean_y)) AS sxy FROM complete {join} {group}),
        a AS (SELECT *, sxy / sxx AS slope, mean_y - sxy / sxx * mean_x AS intercept,
          syy - sxy * sxy / sxx AS rss, CAST(n - 2 AS DOUBLE) AS df,
          sxy * sxy / (sxx * syy) AS r2 FROM sums),
        b AS (SELECT *, sqrt(rss / df) AS sigma, 1 - (1 - r2) * (n - 1) / df AS adj_r2 FROM a),
        c AS (SELECT *, sigma / sqrt(sxx) AS slope_se,
          sigma * sqrt(1.0 / n + mean_x * mean_x / sxx) AS intercept_se FROM b)
        SELECT *, slope / slope_se AS t_slope, intercept / intercept_se AS t_intercept,
          (slope / slope_se) * (slope / slope_se) AS f FROM c"""


_TUKEY_PAIRS = """m AS (SELECT event_type AS g, count(*) AS n, avg(value) AS mean,
          var_samp(value) * (count(*) - 1) AS ss FROM events GROUP BY 1),
        s AS (SELECT count(*) AS k, CAST(sum(n) - count(*) AS DOUBLE) AS df, sum(ss) AS ssw FROM m),
        d AS (SELECT b.g || '-' || a.g AS comparison, b.mean - a.mean AS diff, k, df,
          sqrt(ssw / df / 2 * (1.0 / a.n + 1.0 / b.n)) AS se FROM m a JOIN m b ON a.g < b.g CROSS JOIN s)"""


def _tukey(level: float = 0.95) -> str:
    """Tails of the studentised range by Simpson's rule in both variables, the critical value by halving.

    The normal distribution function is the running Simpson sum of its density over steps of 1/64, and between them
    the sum to the step below and one panel more.
    """
    density = "(exp(-({0}) * ({0}) / 2) / sqrt(2 * pi()))"

    def panel(a: str, b: str) -> str:
        mid = density.format(f"(({a}) + ({b})) / 2")
        return f"((({b}) - ({a})) / 6 * ({density.format(a)} + 4 * {mid} + {density.format(b)}))"

    def upper(points: str, keys: str) -> str:
        """The tail at q of every row of points."""
        end = "least(z + q * t, 9.0)"
        return f"""SELECT {keys}, 1 - sum(wt * below) / sum(wt) AS tail FROM (
            SELECT {keys}, t, wt, k * sum(wz * pow(area + {panel('x', end)} - az, k - 1)) AS below
            FROM ({points}) CROSS JOIN scales CROSS JOIN places JOIN normal ON i = CAST(floor({end} * 64) AS BIGINT)
            GROUP BY {keys}, t, wt, k) GROUP BY {keys}"""

    return f"""WITH RECURSIVE {_TUKEY_PAIRS},
        normal AS (SELECT i, i / 64.0 AS x, sum(CASE WHEN i = -576 THEN 0 ELSE {panel('(i - 1) / 64.0', 'i / 64.0')} END)
          OVER (ORDER BY i) AS area FROM range(-576, 577) r(i)),
        places AS (SELECT i / 64.0 AS z, area AS az,
            (CASE WHEN abs(i) = 512 THEN 1 WHEN i % 8 = 0 AND (i // 8) % 2 <> 0 THEN 4 ELSE 2 END) / 24.0 * {density.format('i / 64.0')} AS wz
          FROM normal WHERE i % 8 = 0 AND abs(i) <= 512),
        scales AS (SELECT t, w * exp((df - 1) * ln(t) - df * (t - 1) * (t + 1) / 2) AS wt FROM (
            SELECT df, 1 + (j - 32) / 32.0 * 8 / sqrt(2 * df) AS t, CASE WHEN j IN (0, 64) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END AS w
            FROM s CROSS JOIN range(0, 65) r(j)) WHERE t > 0),
        halving AS (SELECT 0 AS it, 0::DOUBLE AS lo, 16::DOUBLE AS hi UNION ALL
          SELECT it + 1, CASE WHEN tail > {1 - level} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN tail > {1 - level} THEN hi ELSE (lo + hi) / 2 END
          FROM ({upper('SELECT it, lo, hi, (lo + hi) / 2 AS q, k FROM halving CROSS JOIN s WHERE it < 40', 'it, lo, hi')})),
        tails AS ({upper('SELECT comparison, abs(diff) / se AS q, k FROM d', 'comparison')})
        SELECT d.comparison, {_r('diff')} AS diff, {_r('se')} AS se, k, df, {_r('abs(diff) / se')} AS q, {_r('tail')} AS p_adjusted,
          {_r('diff - (lo + hi) / 2 * se')} AS lower, {_r('diff + (lo + hi) / 2 * se')} AS upper
        FROM d JOIN tails ON d.comparison = tails.comparison CROSS JOIN halving WHERE it = 40"""


def _ranked(partition: str = "") -> str:
    """Row-level average ranks of event values."""
    p = f"PARTITION BY {partition}" if partition else ""
    same = f"PARTITION BY {partition + ', ' if partition else ''}value"
    return f"""SELECT event_type, value, CAST(rank() OVER ({p} ORDER BY value) AS BIGINT) AS first_rank,
        count(*) OVER ({same}) AS ties FROM events"""


def _midrank(partition: str, group: str) -> str:
    return f"""SELECT {group}, count(*) AS n, max(ties) AS ties, max(first_rank) AS first_rank,
        {_r('max(first_rank) + (max(ties) - 1) / 2')} AS midrank
        FROM ({_ranked(partition)}) GROUP BY {group}"""


def _rank_groups(source: str, value: str, group: str) -> str:
    return f"""ranked AS (SELECT {group} AS g, rank() OVER (ORDER BY {value})
          + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS r,
          CAST(count(*) OVER (PARTITION BY {value}) AS DOUBLE) AS ties FROM {source}
          WHERE {value} IS NOT NULL AND {group} IS NOT NULL),
        sums AS (SELECT g, count(*) AS n, sum(CAST(r AS DOUBLE)) AS rs, sum(ties * ties - 1) AS tt
          FROM ranked GROUP BY g),
        total AS (SELECT CAST(sum(n) AS DOUBLE) AS nn, sum(tt) AS tt, count(*) AS k FROM sums)"""


def _dunn_pairs(source: str, value: str, group: str, needs: tuple[str, ...] = ()) -> str:
    head = _with(needs, "").rstrip() + ", " if needs else "WITH "
    return f"""{head}{_rank_groups(source, value, group)},
        z AS (SELECT a.g AS ga, b.g AS gb, k, (a.rs / a.n - b.rs / b.n) / sqrt((nn * (nn + 1) / 12
          - total.tt / (12 * (nn - 1))) * (1.0 / a.n + 1.0 / b.n)) AS z
          FROM sums a JOIN sums b ON a.g < b.g CROSS JOIN total),
        p AS (SELECT *, {_normal_p('z')} AS p FROM z),
        q AS (SELECT *, least(1, p * k * (k - 1) / 2) AS adj FROM p)"""


def _dunn(source: str, value: str, group: str, needs: tuple[str, ...] = ()) -> str:
    return f"""{_dunn_pairs(source, value, group, needs)}
        SELECT ga || ' - ' || gb AS comparison, {_r('z')} AS z, {_r('p')} AS p, {_r('adj')} AS p_adjusted,
        adj < 0.05 AS significant, {_KEY} AS comparison_key FROM q"""


def _dunn_letters(source: str, value: str, group: str, name: str) -> str:
    """All subsets of the groups as bit masks: those without a significant pair that no such set contains."""
    return f"""{_dunn_pairs(source, value, group)},
        numbered AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS bit FROM sums),
        bad AS (SELECT (1 << x.bit) + (1 << y.bit) AS pair FROM q JOIN numbered x ON ga = x.g JOIN numbered y ON gb = y.g
          WHERE adj < 0.05),
        free AS (SELECT mask FROM (SELECT unnest(range(1, CAST(pow(2, (SELECT count(*) FROM sums)) AS BIGINT))) AS mask)
          WHERE NOT EXISTS (SELECT 1 FROM bad WHERE (mask & pair) = pair)),
        top AS (SELECT mask FROM free f WHERE NOT EXISTS (SELECT 1 FROM free o WHERE o.mask <> f.mask AND (o.mask & f.mask) = f.mask)),
        members AS (SELECT mask, g FROM top JOIN numbered ON (mask >> bit) & 1 = 1),
        lettered AS (SELECT mask, chr(CAST(96 + row_number() OVER (ORDER BY list(g ORDER BY g)) AS INTEGER)) AS letter
          FROM members GROUP BY mask)
        SELECT g AS {name}, string_agg(letter, '' ORDER BY letter) AS letters FROM members JOIN lettered USING (mask) GROUP BY g"""


def _kruskal(source: str, value: str, group: str, needs: tuple[str, ...] = ()) -> str:
    head = _with(needs, "").rstrip() + ", " if needs else "WITH "
    return f"""{head}{_rank_groups(source, value, group)}
        SELECT CAST(nn AS BIGINT) AS n, k, {_r('h')} AS h, CAST(k - 1 AS DOUBLE) AS df,
        {_r(_chi2_p('h', '(k - 1)'))} AS p FROM (
        SELECT nn, k, (12 / (nn * (nn + 1)) * (SELECT sum(rs * rs / n) FROM sums) - 3 * (nn + 1))
          / (1 - tt / (nn * nn * nn - nn)) AS h FROM total)"""


def _signed_rank(source: str, value: str, mu: str, needs: tuple[str, ...] = ()) -> str:
    head = _with(needs, "").rstrip() + ", " if needs else "WITH "
    return f"""{head} d AS (SELECT {value} - {mu} AS d FROM {source} WHERE {value} IS NOT NULL),
        ranked AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r,
          CAST(count(*) OVER (PARTITION BY abs(d)) AS DOUBLE) AS ties FROM d WHERE d <> 0),
        s AS (SELECT count(*) AS m, sum(CASE WHEN d > 0 THEN CAST(r AS DOUBLE) ELSE 0 END) AS v,
          sum(ties * ties - 1) AS tt FROM ranked),
        z AS (SELECT *, (v - m * (m + 1) / 4.0 - sign(v - m * (m + 1) / 4.0) * 0.5)
          / sqrt(CAST(m AS DOUBLE) * (m + 1) * (2 * m + 1) / 24 - tt / 48) AS z FROM s)
        SELECT (SELECT count(*) FROM d) AS n, m AS n_used, {_r('v')} AS v, {_r('z')} AS z,
        {_r(_normal_p('z'))} AS p FROM z"""


def _shapiro(source: str, value: str, group: str, needs: tuple[str, ...] = ()) -> str:
    """W by the approximation with two corrected outer weights; p by its normalising transform."""
    head = _with(needs, "").rstrip() + ", " if needs else "WITH "
    rn = "(1 / sqrt(n))"
    a1 = f"CASE WHEN n = 3 THEN sqrt(0.5) ELSE {_poly(ROYSTON_C1, rn)} + m1 / sqrt(mm) END"
    a2 = f"({_poly(ROYSTON_C2, rn)} + m2 / sqrt(mm))"
    mean = (
        f"CASE WHEN n <= 11 THEN {_poly(ROYSTON_SMALL_MEAN, 'n')} "
        f"ELSE {_poly(ROYSTON_LARGE_MEAN, 'ln(n)')} END"
    )
    sd = (
        f"CASE WHEN n <= 11 THEN exp({_poly(ROYSTON_SMALL_SD, 'n')}) "
        f"ELSE exp({_poly(ROYSTON_LARGE_SD, 'ln(n)')}) END"
    )
    y = "CASE WHEN n <= 11 THEN -ln(-2.273 + 0.459 * n - ln(1 - w)) ELSE ln(1 - w) END"
    upper = f"CASE WHEN zz > 0 THEN {_normal_p('zz')} / 2 ELSE 1 - {_normal_p('zz')} / 2 END"
    return f"""{head} ordered AS (SELECT {group} AS g, CAST({value} AS DOUBLE) AS x,
          row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS i,
          CAST(count(*) OVER (PARTITION BY {group}) AS DOUBLE) AS n FROM {source}
          WHERE {value} IS NOT NULL),
        scored AS (SELECT *, (i - 0.375) / (n + 0.25) AS u FROM ordered),
        scores AS (SELECT *, {normal_quantile_sql('u')} AS m FROM scored),
        top AS (SELECT g, n, sum(m * m) AS mm, max(CASE WHEN i = n THEN m END) AS m1,
          max(CASE WHEN i = n - 1 THEN m END) AS m2 FROM scores GROUP BY g, n),
        weights AS (SELECT *, {a1} AS a1, {a2} AS a2 FROM top),
        factor AS (SELECT *, CASE WHEN n = 3 THEN 1 WHEN n <= 5
            THEN sqrt((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1))
            ELSE sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS fac
          FROM weights),
        w AS (SELECT s.g, max(s.n) AS n, least(1, pow(sum((CASE WHEN i = s.n THEN a1 WHEN i = 1 THEN -a1
              WHEN s.n > 5 AND i = s.n - 1 THEN a2 WHEN s.n > 5 AND i = 2 THEN -a2
              WHEN s.n = 3 THEN 0 ELSE m / fac END) * (x - mean)), 2) / max(sst)) AS w
          FROM scores s JOIN factor f ON s.g = f.g
          JOIN (SELECT g, avg(x) AS mean, var_pop(x) * count(*) AS sst FROM ordered GROUP BY g) c
          ON s.g = c.g GROUP BY s.g),
        zed AS (SELECT *, ({y} - ({mean})) / ({sd}) AS zz FROM w)
        SELECT g AS {group}, CAST(n AS BIGINT) AS n,
          CASE WHEN n >= 3 THEN {_r('w')} END AS w, CASE WHEN n >= 3 THEN {_r(upper)} END AS p,
          n BETWEEN 3 AND 5000 AS p_published FROM zed"""


def _t_test(by: str = "") -> str:
    k = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {k}n, {_r('mean')} AS mean, {_r('sd')} AS sd, {_r('se')} AS se, {_r('t')} AS t, df,
        {_r(_t_p('t', 'df'))} AS p, {_r(f"mean - {_t_critical('df')} * se")} AS lower,
        {_r(f"mean + {_t_critical('df')} * se")} AS upper
        FROM (SELECT *, (mean - 49.5) / se AS t FROM (SELECT {k}count(value) AS n, avg(value) AS mean,
          stddev_samp(value) AS sd, stddev_samp(value) / sqrt(count(value)) AS se,
          CAST(count(value) - 1 AS DOUBLE) AS df FROM events {group}))"""


def _anova(source: str, value: str) -> str:
    return f"""WITH v AS (SELECT event_type AS g, {value} AS x FROM {source}),
        m AS (SELECT g, avg(x) AS mean FROM v GROUP BY g),
        s AS (SELECT count(DISTINCT v.g) AS k, count(*) AS n,
          sum((mean - grand) * (mean - grand)) AS ssb, sum((x - mean) * (x - mean)) AS ssw
          FROM v JOIN m ON v.g = m.g CROSS JOIN (SELECT avg(x) AS grand FROM v)),
        f AS (SELECT *, CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k AS DOUBLE) AS df2,
          (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM s)
        SELECT k, n, {_r('ssb', 5)} AS ss_between, {_r('ssw', 5)} AS ss_within, df1, df2,
        {_r('f', 5)} AS f, {_r(_f4_p('f', 'df2'), 5)} AS p FROM f"""


_DEVIATIONS = """(SELECT e.event_type, abs(value - med) AS deviation FROM events e JOIN
    (SELECT event_type, median(value) AS med FROM events GROUP BY 1) m ON e.event_type = m.event_type)"""

_PRETTY = """ends AS (SELECT min(v) AS lo, max(v) AS hi, ceil(log2(count(*)) + 1) AS cells FROM x),
    base AS (SELECT *, (hi - lo) / cells AS cell, pow(10, floor(log10((hi - lo) / cells))) AS p FROM ends),
    step AS (SELECT *, CASE WHEN cell > 7 * p THEN 10 * p WHEN cell > (5 + 2.75 * 2) / 3.75 * p THEN 5 * p
      WHEN cell > 1.4 * p THEN 2 * p ELSE p END AS step FROM base),
    cuts AS (SELECT step, floor(lo / step + 1e-7) AS a, ceil(hi / step - 1e-7) AS b FROM step),
    bins AS (SELECT step, a, unnest(generate_series(CAST(a AS BIGINT) + 1, CAST(b AS BIGINT))) AS i FROM cuts)"""


def _hist(needs: tuple[str, ...], source: str) -> str:
    head = _with(needs, "").rstrip() + ", " if needs else "WITH "
    return f"""{head} x AS ({source}), {_PRETTY}
        SELECT {_r('(i - 1) * max(step)')} AS low, {_r('i * max(step)')} AS high, count(v) AS n
        FROM bins LEFT JOIN x ON (v > (i - 1) * step OR (i = a + 1 AND v >= (i - 1) * step))
        AND v <= i * step GROUP BY i"""


_BOX = """q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
    f AS (SELECT e.event_type, value, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1)
      AND q3 + 1.5 * (q3 - q1) AS inside FROM events e JOIN q ON e.event_type = q.event_type)"""


def _cjs(body: str, groups: str = "SELECT DISTINCT id, 0 AS g FROM measured") -> str:
    """Constant-survival estimates of each group by Newton steps on the gradient, its slope taken by differences."""
    h = "1e-5"
    chi = "(1 - p * phi * s)"
    # Away from the top, where the slopes are no hill's, a step goes up the gradient.
    hill = "k11 < 0 AND k11 * k22 > k12 * k12"
    head = _with(("measured", "histories"), "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{head},
        groups AS ({groups}),
        freq AS (SELECT g, ch, count(*) AS n FROM histories JOIN groups ON groups.id = histories.id GROUP BY g, ch),
        ends AS (SELECT min(season) AS lo, max(season) AS hi FROM measured),
        steps AS (SELECT g, season, lead(season) OVER (PARTITION BY id ORDER BY season) AS next
          FROM (SELECT DISTINCT m.id, g, season FROM measured m JOIN groups ON groups.id = m.id)),
        gaps AS (SELECT g, sum(next - season)::DOUBLE AS years, count(*)::DOUBLE AS n FROM steps
          WHERE next IS NOT NULL GROUP BY g),
        lost AS (SELECT g, (hi - season)::DOUBLE AS l, count(*)::DOUBLE AS m FROM steps CROSS JOIN ends
          WHERE next IS NULL AND season < hi GROUP BY 1, 2),
        newton AS (
          SELECT g, 0 AS it, 0::DOUBLE AS b1, 0::DOUBLE AS b2, -1::DOUBLE AS h11, 0::DOUBLE AS h12,
            -1::DOUBLE AS h22 FROM gaps
          UNION ALL
          SELECT g, it + 1, b1 - greatest(-0.5, least(0.5, CASE WHEN {hill} THEN (g1 * k22 - g2 * k12) / (k11 * k22 - k12 * k12) ELSE -g1 END)),
            b2 - greatest(-0.5, least(0.5, CASE WHEN {hill} THEN (g2 * k11 - g1 * k12) / (k11 * k22 - k12 * k12) ELSE -g2 END)), k11, k12, k22
          FROM (SELECT g, it, b1, b2, max(CASE WHEN d = 0 THEN u END) AS g1,
              max(CASE WHEN d = 0 THEN v END) AS g2,
              (max(CASE WHEN d = 1 THEN u END) - max(CASE WHEN d = 2 THEN u END)) / (2 * {h}) AS k11,
              (max(CASE WHEN d = 3 THEN u END) - max(CASE WHEN d = 4 THEN u END)) / (2 * {h}) AS k12,
              (max(CASE WHEN d = 3 THEN v END) - max(CASE WHEN d = 4 THEN v END)) / (2 * {h}) AS k22
            FROM (SELECT g, it, b1, b2, d,
                phi * (1 - phi) * (max(years) / phi + sum(m * (-p * s - p * phi * ds * (1 - p)) / {chi})) AS u,
                p * (1 - p) * (max(n) / p - (max(years) - max(n)) / (1 - p)
                  + sum(m * (-phi * s + p * phi * phi * ds) / {chi})) AS v
              FROM (SELECT *, (1 - pow(a, l)) / (1 - a) AS s,
                  ((1 - pow(a, l)) - l * pow(a, l - 1) * (1 - a)) / ((1 - a) * (1 - a)) AS ds
                FROM (SELECT *, phi * (1 - p) AS a FROM (
                  SELECT newton.g, it, b1, b2, d,
                    1 / (1 + exp(-(b1 + CASE d WHEN 1 THEN {h} WHEN 2 THEN -{h} ELSE 0 END))) AS phi,
                    1 / (1 + exp(-(b2 + CASE d WHEN 3 THEN {h} WHEN 4 THEN -{h} ELSE 0 END))) AS p
                  FROM newton CROSS JOIN (VALUES (0), (1), (2), (3), (4)) points(d) WHERE it < 60)
                ) points JOIN lost USING (g) JOIN gaps USING (g))
              GROUP BY g, it, b1, b2, d, phi, p)
            GROUP BY g, it, b1, b2)),
        fit AS (SELECT *, 1 / (1 + exp(-b1)) AS phi, 1 / (1 + exp(-b2)) AS p,
            sqrt(h22 / (h12 * h12 - h11 * h22)) AS s1,
            sqrt(h11 / (h12 * h12 - h11 * h22)) AS s2
          FROM newton WHERE it = 60),
        parts AS (SELECT g, ch, n, length(ch) AS t, instr(ch, '1') AS f,
            length(ch) - instr(reverse(ch), '1') + 1 AS l, length(replace(ch, '0', '')) - 1 AS k FROM freq),
        cohorts AS (SELECT g, f, sum(n) AS r FROM parts GROUP BY g, f),
        counted AS (SELECT parts.g, ch, n AS observed, r * pow(phi, l - parts.f) * pow(p, k)
            * pow(1 - p, l - parts.f - k) * (1 - p * phi * (1 - pow(phi * (1 - p), t - l))
            / (1 - phi * (1 - p))) AS expected
          FROM parts JOIN cohorts ON parts.f = cohorts.f AND parts.g = cohorts.g JOIN fit ON fit.g = parts.g)
        {body}"""


def _cjs_oracles() -> dict[str, str]:
    def back(b: str) -> str:
        return f"1 / (1 + exp(-({b})))"

    def estimate(name: str, b: str, s: str) -> str:
        e = back(b)
        cols = (
            (b, "beta"), (s, "beta_se"), (f"{b} - 1.96 * {s}", "beta_lower"),
            (f"{b} + 1.96 * {s}", "beta_upper"), (e, "estimate"), (f"{s} * {e} * (1 - {e})", "se"),
            (back(f"{b} - 1.96 * {s}"), "lower"), (back(f"{b} + 1.96 * {s}"), "upper"),
        )
        return f"SELECT '{name}' AS parameter, {', '.join(f'{_r(x)} AS {n}' for x, n in cols)} FROM fit"

    stats = """SELECT histories, cohorts, ess AS effective_sample_size, round(m2, 4) AS m2_log_likelihood,
        round(sat, 4) AS saturated, round(m2 - sat, 4) AS deviance, histories - cohorts - 2 AS df,
        round((m2 - sat) / (histories - cohorts - 2), 4) AS c_hat, round(m2 + 4, 4) AS aic,
        round(m2 + 4 + 12 / (ess - 3), 4) AS aicc, round(m2 + 2 * ln(ess), 4) AS bic,
        round(pearson, 4) AS pearson
        FROM (SELECT (SELECT count(*) FROM freq) AS histories, (SELECT count(*) FROM cohorts) AS cohorts,
          (SELECT count(*)::DOUBLE FROM steps CROSS JOIN ends WHERE season < hi) AS ess,
          (SELECT -2 * sum(n * ln(n / r)) FROM parts JOIN cohorts ON parts.f = cohorts.f) AS sat,
          (SELECT sum(pow(observed - expected, 2) / expected) FROM counted) AS pearson,
          (SELECT -2 * sum(observed * ln(expected / r)) FROM counted JOIN parts ON counted.ch = parts.ch
            JOIN cohorts ON parts.f = cohorts.f) AS m2)"""
    grouped_stats = f"""SELECT a.g AS balance, histories, cohorts, ess AS effective_sample_size, round(m2, 4) AS m2_log_likelihood,
        round(sat, 4) AS saturated, round(m2 - sat, 4) AS deviance, histories - cohorts - 2 AS df,
        round((m2 - sat) / (histories - cohorts - 2), 4) AS c_hat, round(m2 + 4, 4) AS aic,
        round(m2 + 4 + 12 / (ess - 3), 4) AS aicc, round(m2 + 2 * ln(ess), 4) AS bic, round(pearson, 4) AS pearson
        FROM (SELECT counted.g, count(*) AS histories, count(DISTINCT parts.f) AS cohorts,
            -2 * sum(n * ln(n / r)) AS sat, sum(pow(observed - expected, 2) / expected) AS pearson,
            -2 * sum(observed * ln(expected / r)) AS m2
          FROM counted JOIN parts ON counted.g = parts.g AND counted.ch = parts.ch
          JOIN cohorts ON parts.g = cohorts.g AND parts.f = cohorts.f GROUP BY counted.g) a
        JOIN (SELECT g, count(*)::DOUBLE AS ess FROM steps CROSS JOIN ends WHERE season < hi GROUP BY g) b ON a.g = b.g"""

    def by_balance(select: str) -> str:
        return select.replace("SELECT ", "SELECT g AS balance, ", 1)

    return {
        "q_cjs_by_balance": _cjs(
            f"{by_balance(estimate('phi', 'b1', 's1'))} UNION ALL {by_balance(estimate('p', 'b2', 's2'))}", LEVELS
        ),
        "q_cjs_fit_by_balance": _cjs(grouped_stats, LEVELS),
        "q_expected_counts_by_balance": _cjs(f"SELECT g AS balance, ch, observed, {_r('expected')} AS expected FROM counted", LEVELS),
        "q_expected_longevity_by_balance": _cjs(
            f"""SELECT g AS balance, {_r('phi', 4)} AS phi, {_r('1 / (1 - phi)', 4)} AS longevity,
            {_r(f"1 / (1 - {back('b1 - 1.96 * s1')})", 4)} AS lower, {_r(f"1 / (1 - {back('b1 + 1.96 * s1')})", 4)} AS upper FROM fit""",
            LEVELS,
        ),
        "q_cjs": _cjs(f"{estimate('phi', 'b1', 's1')} UNION ALL {estimate('p', 'b2', 's2')}"),
        "q_cjs_fit": _cjs(stats),
        "q_expected_counts": _cjs(f"SELECT ch, observed, {_r('expected')} AS expected FROM counted"),
        "q_expected_longevity_by_year": _cjs(
            f"""SELECT CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS season, {_r('phi', 4)} AS phi,
            {_r('1 / (1 - phi)', 4)} AS longevity,
            {_r(f"1 / (1 - {back('b1 - 1.96 * s1')})", 4)} AS lower,
            {_r(f"1 / (1 - {back('b1 + 1.96 * s1')})", 4)} AS upper FROM fit CROSS JOIN ends"""
        ),
    }


LEVELS = "SELECT c_custkey AS id, CASE WHEN c_acctbal >= 4500 THEN 'high' ELSE 'low' END AS g FROM customer"


def _mixed(body: str, groups: str = "SELECT DISTINCT id, 0 AS g FROM scaled_growth") -> str:
    """Random intercept of each group by REML: golden section on the root of the variance ratio over sums per id."""
    shrink = "(s * s / (1 + s * s * n))"
    golden = "0.6180339887498949::DOUBLE"

    def criterion(points: str, keys: str) -> str:
        return f"""SELECT *, logs + ln(det) + (rows - 2) * (1 + ln(2 * pi() * rss / (rows - 2))) AS score
          FROM (SELECT *, (a22 * c1 - a12 * c2) / det AS beta0, (a11 * c2 - a12 * c1) / det AS beta1,
            yy - ((a22 * c1 - a12 * c2) * c1 + (a11 * c2 - a12 * c1) * c2) / det AS rss
          FROM (SELECT *, a11 * a22 - a12 * a12 AS det FROM (SELECT {keys}, s, sum(n) AS rows,
            sum(ln(1 + s * s * n)) AS logs, sum(n - {shrink} * n * n) AS a11,
            sum(sx - {shrink} * n * sx) AS a12, sum(sxx - {shrink} * sx * sx) AS a22,
            sum(sy - {shrink} * n * sy) AS c1, sum(sxy - {shrink} * sx * sy) AS c2,
            sum(syy - {shrink} * sy * sy) AS yy
          FROM ({points}) JOIN sums USING (g) GROUP BY {keys}, s)))"""

    points = f"""SELECT g, it, lo, hi, side, CASE side WHEN 0 THEN hi - {golden} * (hi - lo)
        ELSE lo + {golden} * (hi - lo) END AS s FROM search CROSS JOIN (VALUES (0), (1)) v(side)
        WHERE it < 100"""
    last = "SELECT DISTINCT g, 0 AS k, 0::DOUBLE AS s FROM sums UNION ALL SELECT g, 1, (lo + hi) / 2 FROM search WHERE it = 100"
    head = _with(("scaled_growth",), "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{head},
        groups AS ({groups}),
        sums AS (SELECT g, id, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(y) AS sy,
          sum(x * x)::DOUBLE AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM scaled_growth JOIN groups USING (id)
          WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY g, id),
        search AS (SELECT DISTINCT g, 0 AS it, 0::DOUBLE AS lo, 4::DOUBLE AS hi FROM sums UNION ALL
          SELECT g, it + 1, CASE WHEN s0 <= s1 THEN lo ELSE hi - {golden} * (hi - lo) END,
            CASE WHEN s0 <= s1 THEN lo + {golden} * (hi - lo) ELSE hi END
          FROM (SELECT g, it, lo, hi, max(CASE WHEN side = 0 THEN score END) AS s0,
            max(CASE WHEN side = 1 THEN score END) AS s1
          FROM ({criterion(points, 'g, it, lo, hi, side')}) GROUP BY g, it, lo, hi)),
        tried AS ({criterion(last, 'g, k')}),
        fit AS (SELECT *, sqrt(rss / (rows - 2)) AS sigma, s * sqrt(rss / (rows - 2)) AS tau
          FROM tried QUALIFY row_number() OVER (PARTITION BY g ORDER BY score, k) = 1)
        {body}"""


def _mixed_oracles() -> dict[str, str]:
    def term(name: str, est: str, diagonal: str, keys: str = "") -> str:
        se = f"sigma * sqrt({diagonal} / det)"
        return f"""SELECT {keys}'{name}' AS term, {_r(est, 5)} AS estimate, {_r(se, 5)} AS se,
            {_r(f'{est} / ({se})', 5)} AS t, {_r('sigma', 5)} AS sigma, {_r('tau', 5)} AS tau,
            {_r('score', 5)} AS reml, CAST(rows AS BIGINT) AS n, (SELECT count(*) FROM sums WHERE sums.g = fit.g) AS groups,
            tau <= 1e-4 * sigma AS singular FROM fit"""

    effect = "(s * s / (1 + s * s * n)) * (sy - beta0 * n - beta1 * sx)"
    offset = "(s * s / (1 + s * s * n)) * (sums.sy - beta0 * n - beta1 * sums.sx)"
    line = f"(beta0 + beta1 * g.x + {offset})"
    return {
        "q_lmm_conditional": _mixed(
            f"""SELECT g.id, season, {_r(line, 5)} AS fitted, {_r(f'g.y - {line}', 5)} AS residual
            FROM scaled_growth g JOIN sums ON g.id = sums.id JOIN fit ON sums.g = fit.g WHERE g.x IS NOT NULL AND g.y IS NOT NULL"""
        ),
        "q_lmm": _mixed(f"{term('intercept', 'beta0', 'a22')} UNION ALL {term('slope', 'beta1', 'a11')}"),
        "q_lmm_effects": _mixed(
            f"SELECT id, CAST(n AS BIGINT) AS n, {_r(effect, 5)} AS effect FROM sums JOIN fit USING (g)"
        ),
        "q_lmm_by_balance": _mixed(
            f"{term('intercept', 'beta0', 'a22', 'g AS balance, ')} UNION ALL {term('slope', 'beta1', 'a11', 'g AS balance, ')}", LEVELS
        ),
        "q_lmm_effects_by_balance": _mixed(
            f"SELECT g AS balance, id, CAST(n AS BIGINT) AS n, {_r(effect, 5)} AS effect FROM sums JOIN fit USING (g)", LEVELS
        ),
    }


def oracles() -> dict[str, str]:
    out: dict[str, str] = {**_cjs_oracles(), **_mixed_oracles()}
    out["q_successful_nests"] = _with(("nests",), "SELECT id, event_id, dt, result, size FROM nests")
    out["q_date_parts"] = _with(
        ("sightings",),
        """SELECT id, event_id, dt, CAST(year(dt) AS INTEGER) AS season,
        CAST(month(dt) AS INTEGER) AS month, CAST(day(dt) AS INTEGER) AS day FROM sightings""",
    )
    out["q_season_consistent"] = _with(
        ("measured",), "SELECT id, event_id, dt, season, size, first_size FROM measured"
    )
    out["q_long_lived"] = _with(("lasting",), "SELECT id, event_id, season, size FROM lasting")
    out["q_size_at_maturity_all"] = _sizes("maiden")
    out["q_size_at_maturity_first"] = _sizes("maiden_one")
    out["q_size_first_rows"] = _with(
        ("maiden_one",), "SELECT id, event_id, dt, season, size FROM maiden_one"
    )
    out["q_span"] = _with(("span",), "SELECT * FROM span")
    out["q_longevity_summary_all"] = _longevity("true")
    out["q_longevity_summary_gt0"] = _longevity("longevity > 0")
    out["q_longevity_summary_ge3"] = _longevity("longevity >= 3")
    out["q_longevity_summary_cohort"] = _longevity("longevity >= 3 AND first_year >= 1996")
    out["q_report_longevity"] = _longevity("longevity > 0", 2)
    out["q_interval_growth"] = _with(
        ("measured",),
        f"""SELECT id, event_id, dt, prev_dt, days_elapsed, growth, growth_rate,
        years_since_first FROM ({_interval('measured')})""",
    )
    out["q_interval_growth_unfiltered"] = _with(
        ("nests",),
        f"""SELECT id, event_id, days_elapsed, growth, growth_rate FROM ({_interval('nests')})""",
    )
    for name, where in (("all", "true"), ("pos", "growth_rate > 0"), ("realistic", "growth_rate > -1")):
        out[f"q_growth_summary_{name}"] = _with(("lasting",), _summary(_interval("lasting"), where, 3))
    out["q_season_growth"] = _with(
        ("season_growth",),
        f"""SELECT id, season, {_r('mean_size')} AS mean_size, n_meas, prev_season,
        {_r('prev_size')} AS prev_size, interval, {_r('growth')} AS growth,
        {_r('growth_rate')} AS growth_rate FROM season_growth""",
    )
    out["q_growth_sample_sizes"] = _with(
        ("measured",), f"SELECT id, count(*) AS n FROM ({_interval('measured')}) GROUP BY id"
    )
    y = "years_since_first"
    out["q_growth_by_phase"] = _with(
        ("lasting",),
        _by_label(
            f"""(SELECT growth_rate, CASE WHEN {y} BETWEEN 1 AND 2 THEN '1-2' WHEN {y} BETWEEN 3 AND 4
            THEN '3-4' WHEN {y} BETWEEN 5 AND 6 THEN '5-6' END AS phase,
            CASE WHEN {y} <= 2 THEN 1 WHEN {y} <= 4 THEN 2 ELSE 3 END AS level
            FROM ({_interval('lasting')})) WHERE phase IS NOT NULL""",
            "phase",
            "level",
        ),
    )
    out["q_report_growth"] = out["q_growth_by_phase"].replace(
        "WHERE phase IS NOT NULL", "WHERE phase IS NOT NULL AND growth_rate > -1"
    )
    out["q_report_size"] = _with(
        ("maiden", "width"),
        f"""SELECT count(*) AS n, {', '.join(f"{_r(f'{g}({c})', 2)} AS {m}_{c}" for c in ('size', 'width')
          for m, g in (('min', 'min'), ('mean', 'avg'), ('sd', 'stddev_samp'), ('max', 'max')))}
        FROM maiden LEFT JOIN width USING (event_id)""",
    )
    out["q_growth_by_group_v1"] = _with(
        ("grouped_inclusive",), _by_label("grouped_inclusive", "longevity_group", "level")
    )
    out["q_growth_by_group_v2"] = _with(("grouped",), _by_label("grouped", "longevity_group", "level"))
    out["q_individual_growth"] = _with(
        ("individual",), f"SELECT id, longevity_group, {_r('mean_rate')} AS mean_rate FROM individual"
    )
    out["q_years_reproducing"] = _with(("years",), "SELECT * FROM years")
    out["q_growth_with_years"] = _with(
        ("growth_years",),
        f"SELECT id, season, {_r('growth_rate')} AS growth_rate, years_reproducing FROM growth_years",
    )
    out["q_clutch_full_join"] = _with(
        ("excavations",),
        f"""SELECT coalesce(e.event_id, o_orderkey) AS event_id, unhatched, eggs AS eggs_x,
        {_r('hatch')} AS hatch, o_totalprice AS eggs_y, o_custkey AS id
        FROM (SELECT * FROM excavations WHERE shipped >= TIMESTAMP '{t.NEW_TABLE_FROM}') e
        FULL JOIN orders ON e.event_id = o_orderkey""",
    )
    clutch = "event_id, unhatched, eggs, {} AS hatch, id, dt, year, month, day"
    out["q_clutch_unify"] = _with(("clutches",), f"SELECT {clutch.format(_r('hatch'))} FROM clutches")
    out["q_export"] = out["q_clutch_unify"]
    out["q_clutch_with_size"] = _with(
        ("sized",), f"SELECT {clutch.format(_r('hatch', 8))}, {_r('size', 8)} AS size FROM sized"
    )
    out["q_clutch_interval"] = _with(
        ("returned",),
        f"SELECT id, event_id, year, prev_year, return_interval, {_r('size', 8)} AS size FROM returned",
    )
    out["q_grid_complete"] = _with(("grid",), "SELECT * FROM grid")
    out["q_histories"] = _with(("histories",), "SELECT * FROM histories")
    freq = "SELECT ch, count(*) AS n FROM histories GROUP BY ch"
    out["q_history_freq"] = _with(("histories",), freq)
    out["q_history_lines"] = _with(("histories",), freq)
    out["q_history_file"] = _with(("histories",), freq)
    out["q_expected_lines"] = _cjs(
        f"SELECT ch, CAST(observed AS DOUBLE) AS observed, {_r('expected')} AS expected FROM counted"
    )
    out["q_history_to_span"] = _with(("span",), "SELECT * FROM span")
    out["q_m_array"] = _with(
        ("measured",),
        """SELECT CAST(season - lo + 1 AS INTEGER) AS release, CAST(next - lo + 1 AS INTEGER) AS recapture,
        count(*) AS n FROM (SELECT season, lead(season) OVER (PARTITION BY id ORDER BY season) AS next
          FROM (SELECT DISTINCT id, season FROM measured))
        CROSS JOIN (SELECT min(season) AS lo, max(season) AS hi FROM measured)
        WHERE season < hi GROUP BY 1, 2""",
    )
    out["q_survival_input"] = _with(("survival_rows",), "SELECT * FROM survival_rows")
    out["q_km"] = _km("survival_rows")
    out["q_km_summary"] = _km_summary("survival_rows")
    out["q_km_repeat"] = _km(_REPEAT)
    out["q_km_repeat_summary"] = _km_summary(_REPEAT)
    out["q_km_by_first_year"] = _km("survival_rows", "first_year")
    out["q_midrank"] = _midrank("", "event_type, value")
    out["q_midrank_within_group"] = _midrank("event_type", "event_type, value")
    out["q_kruskal"] = _kruskal("events", "value", "event_type")
    out["q_kruskal_growth"] = _kruskal("individual", "mean_rate", "longevity_group", ("individual",))
    lengths = "(SELECT length(text)::DOUBLE AS length, CAST(least(turn, 6) AS VARCHAR) AS place FROM conversations)"
    out["q_dunn_letters"] = _dunn_letters(lengths, "length", "place", "place")
    out["q_dunn"] = _dunn("events", "value", "event_type")
    out["q_dunn_growth"] = _dunn("individual", "mean_rate", "longevity_group", ("individual",))
    out["q_signed_rank"] = _signed_rank("events", "value", "40.0::DOUBLE")
    out["q_signed_rank_longevity"] = _signed_rank(
        "(SELECT * FROM span WHERE longevity >= 3)", "longevity", "5", ("span",)
    )
    out["q_shapiro"] = _shapiro("events", "value", "event_type")
    out["q_shapiro_growth"] = _shapiro("individual", "mean_rate", "longevity_group", ("individual",))
    out["q_t_test"] = _t_test()
    out["q_t_test_by_group"] = _t_test("event_type")
    out["q_anova"] = _anova("events", "value")
    out["q_levene"] = _anova(_DEVIATIONS, "deviation")
    out["q_tukey_pairs"] = f"""WITH {_TUKEY_PAIRS}
        SELECT comparison, {_r('diff')} AS diff, {_r('se')} AS se, k, df, {_r('abs(diff) / se')} AS q FROM d"""
    out["q_tukey"] = _tukey()
    out["q_ols_hatch_size"] = _with(("sized",), _ols("sized", "hatch", "size"))
    out["q_ols_hatch_interval"] = _with(("returned",), _ols("returned", "hatch", "return_interval"))
    out["q_ols_eggs_size"] = _with(("sized",), _ols("sized", "eggs", "size", 5))
    out["q_ols_eggs_interval"] = _with(
        ("returned",), _ols("returned", "eggs", "return_interval", 5)
    )
    maiden = f"(SELECT id, season, size / {t.UNIT} AS size FROM maiden_one)"
    out["q_ols_season_size"] = _with(("maiden_one",), _ols(maiden, "season", "size", 5))
    out["q_ols_growth_years"] = _with(("scaled_growth",), _ols("scaled_growth", "y", "x"))
    out["q_ols_by_group"] = _with(
        ("sized",),
        _ols(
            "(SELECT *, CAST(quarter(dt) AS INTEGER) AS quarter FROM sized)", "hatch", "size", 6, "quarter"
        ),
    )
    shown = (
        ("fitted", "fitted"), ("hatch - fitted", "residual"),
        ("h", "leverage"), ("s", "std_residual"), ("sqrt(abs(s))", "root_std_residual"),
        ("s * s * h / (2 * (1 - h))", "cooks_distance"),
    )
    out["q_ols_diagnostics"] = _with(
        ("sized",),
        f"""SELECT id, event_id, {', '.join(f'{_r(e)} AS {n}' for e, n in shown)}
        FROM (SELECT *, (hatch - fitted) / (sigma * sqrt(1 - h)) AS s FROM (
          SELECT c.*, f.sigma, f.intercept + f.slope * c.size AS fitted,
          1.0 / f.n + (c.size - f.mean_x) * (c.size - f.mean_x) / f.sxx AS h
          FROM sized c CROSS JOIN ({_ols_core('sized', 'hatch', 'size')}) f
          WHERE c.size IS NOT NULL AND c.hatch IS NOT NULL))""",
    )
    out["q_ols_residual_qq"] = _with(
        ("sized",),
        f"""SELECT {_r('y', 8)} AS hatch, {_r('x', 8)} AS size, count(*) AS n, {_r('max(s)', 4)} AS std_residual,
        {_r(normal_quantile_sql('(avg(rank) - 0.5) / max(rows)'), 4)} AS normal_quantile FROM (
        SELECT *, hatch AS y, size AS x, count(*) OVER () AS rows, rank() OVER (ORDER BY s)
          + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rank FROM (
        SELECT hatch, size, round((hatch - fitted) / (sigma * sqrt(1 - h)), 10) AS s FROM (
          SELECT c.*, f.sigma, f.intercept + f.slope * c.size AS fitted,
          1.0 / f.n + (c.size - f.mean_x) * (c.size - f.mean_x) / f.sxx AS h
          FROM sized c CROSS JOIN ({_ols_core('sized', 'hatch', 'size')}) f
          WHERE c.size IS NOT NULL AND c.hatch IS NOT NULL))) GROUP BY y, x""",
    )
    out["q_breusch_pagan"] = _with(
        ("sized",),
        f"""SELECT {_r('bp')} AS bp, CAST(1 AS DOUBLE) AS df, {_r(_normal_p('sqrt(bp)'))} AS p FROM (
        SELECT n * r2 AS bp FROM ({_ols_core(f'''(SELECT c.size, pow(c.hatch - f.intercept - f.slope * c.size, 2)
          AS e2 FROM sized c CROSS JOIN ({_ols_core('sized', 'hatch', 'size')}) f)''', 'e2', 'size')}))""",
    )
    out["q_aic"] = _with(
        ("scaled_growth",),
        f"""SELECT CAST(3 AS DOUBLE) AS df, {_r('n * (ln(2 * pi() * rss / n) + 1) + 6', 4)} AS aic
        FROM ({_ols_core('scaled_growth', 'y', 'x')})""",
    )
    out["q_hist"] = _hist((), "SELECT value AS v FROM events WHERE value IS NOT NULL")
    out["q_hist_longevity"] = _hist(("span",), "SELECT CAST(longevity AS DOUBLE) AS v FROM span")
    out["q_box"] = f"""WITH {_BOX} SELECT event_type, count(*) AS n, {_r('max(q1)')} AS q1,
        {_r('max(median)')} AS median, {_r('max(q3)')} AS q3,
        min(CASE WHEN inside THEN value END) AS whisker_low,
        max(CASE WHEN inside THEN value END) AS whisker_high,
        count(*) FILTER (WHERE NOT inside) AS outliers FROM f GROUP BY event_type"""
    out["q_box_outliers"] = f"WITH {_BOX} SELECT event_type, value FROM f WHERE NOT inside"
    out["q_density"] = f"""WITH s AS (SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi,
          0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34)
          * pow(count(*), -0.2) AS bw FROM events GROUP BY 1),
        g AS (SELECT s.*, i, lo - 3 * bw + i * ((hi - lo + 6 * bw) / 511) AS x
          FROM s CROSS JOIN (SELECT unnest(range(0, 512)) AS i))
        SELECT g.event_type, {_r('max(x)')} AS x, {_r("sum(exp(-pow((x - value) / bw, 2) / 2)) / (max(n) * max(bw) * sqrt(2 * pi()))")} AS density
        FROM g JOIN events e ON g.event_type = e.event_type GROUP BY g.event_type, i"""
    out["q_qq"] = f"""SELECT value, n, {_r('midrank')} AS midrank,
        {_r(normal_quantile_sql('u'))} AS theoretical FROM (
        SELECT *, (midrank - 0.5) / (SELECT count(value) FROM events) AS u FROM (
        SELECT value, count(*) AS n, max(first_rank) + (max(ties) - 1) / 2 AS midrank
        FROM ({_ranked()}) GROUP BY value))"""
    q1, q3 = "quantile_cont(value, 0.25)", "quantile_cont(value, 0.75)"
    out["q_qq_line"] = f"""SELECT {_r(f'({q3} - {q1}) / (2 * 0.6744897501960817)')} AS slope,
        {_r(f'({q1} + {q3}) / 2')} AS intercept FROM events"""
    out["q_mean_sd_bar"] = f"""SELECT event_type, {_r('avg(value)')} AS mean,
        {_r('avg(value) - stddev_samp(value)')} AS lower, {_r('avg(value) + stddev_samp(value)')} AS upper
        FROM events GROUP BY 1"""
    out["q_group_points"] = f"""SELECT event_type, {_r('avg(value)')} AS mean,
        {_r('median(value)')} AS median FROM events GROUP BY 1"""
    out["q_label_heights"] = f"""SELECT DISTINCT event_type,
        {_r('(SELECT max(value) FROM events) * 1.1::DOUBLE')} AS height FROM events"""
    out["q_mean_line"] = _with(("maiden_one",), f"SELECT {_r('avg(size)', 4)} AS mean FROM {maiden}")
    out["q_ols_band"] = _with(
        ("sized",),
        f"""SELECT {_r('x')} AS x, {_r('fit')} AS fit, {_r('se')} AS se,
        {_r(f"fit - {_t_critical('df')} * se")} AS lower, {_r(f"fit + {_t_critical('df')} * se")} AS upper
        FROM (SELECT x, df, intercept + slope * x AS fit,
          sigma * sqrt(1.0 / n + (x - mean_x) * (x - mean_x) / sxx) AS se
          FROM ({_ols_core('sized', 'hatch', 'size')}) CROSS JOIN
          (SELECT lo + (hi - lo) * i / 79 AS x FROM (SELECT min(size) AS lo, max(size) AS hi FROM sized
            WHERE hatch IS NOT NULL) CROSS JOIN (SELECT unnest(range(0, 80)) AS i)))""",
    )
    out["q_scatter"] = _with(("maiden_one",), f"SELECT season, {_r('size', 8)} AS size FROM {maiden}")
    out["q_distinct_ids"] = _with(("measured",), "SELECT count(DISTINCT id) AS n FROM measured")
    out["q_csv_sightings"] = _with(
        ("sightings",),
        "SELECT id, event_id, dt, result, size, CAST(year(dt) AS INTEGER) AS season FROM sightings",
    )
    out["q_clutch_files"] = out["q_csv_clutches"] = _with(
        ("excavations",),
        f"""SELECT e.event_id, unhatched, eggs, {_r('hatch')} AS hatch, CAST(o_custkey AS VARCHAR) AS id,
        strftime(o_orderdate, '%-m/%-d/%Y') AS dt FROM excavations e JOIN orders ON e.event_id = o_orderkey
        WHERE shipped < TIMESTAMP '{t.NEW_TABLE_FROM}'""",
    )
    types = {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    }
    out["q_profile"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{k}' AS type, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls,
        count(DISTINCT {c}) AS "distinct" FROM orders"""
        for c, k in types.items()
    )
    out["q_rejects"] = """SELECT o_custkey, o_orderkey, o_orderpriority, CAST(NULL AS DOUBLE) AS o_totalprice
        FROM orders WHERE o_orderpriority = '1-URGENT'"""
    return out
