"""Scalar column expressions: text clean-up, date parsing, labels, normal quantile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_text(c: Column) -> Column:
    """Strip every kind of white space at both ends (``trim`` only strips blanks) and lower-case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def parse_mdy(c: Column) -> Column:
    """Month/day/year text to DATE; bad text gives null; two-digit years 69-99 mean 1969-1999.

    The two patterns do not overlap: each gives null on the other's input.
    """
    text = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"[-.]", "/")
    long_year = F.try_to_date(text, "M/d/yyyy")
    short_year = F.try_to_date(text, "M/d/yy")
    century = F.when(F.year(short_year) % 100 >= 69, F.add_months(short_year, -1200)).otherwise(
        short_year
    )
    return F.coalesce(long_year, century)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("double")


def label_ranges(c: Column, ranges: Sequence[tuple[str, float, float]]) -> Column:
    """First label whose closed range ``[low, high]`` holds the value; gaps give null."""
    out = F.lit(None).cast("string")
    for label, low, high in reversed(list(ranges)):
        out = F.when((c >= low) & (c <= high), F.lit(label)).otherwise(out)
    return out


def label_upto(c: Column, steps: Sequence[tuple[str, float | None]]) -> Column:
    """First label whose upper edge is not exceeded; an edge of ``None`` takes all the rest."""
    out = F.lit(None).cast("string")
    for label, high in reversed(list(steps)):
        hit = c.isNotNull() if high is None else c <= high
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def level_order(c: Column, levels: Sequence[str]) -> Column:
    """Ordinal of a label in its level list (1-based), so that labels sort by level."""
    out = F.lit(None).cast("int")
    for i, level in enumerate(levels, 1):
        out = F.when(c == level, F.lit(i)).otherwise(out)
    return out


# Coefficients of the published algorithm AS 241 (PPND16) for the normal quantile.
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3),
)
_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9),
)
_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15),
)


def _ratio(x: str, pair) -> str:
    def poly(coefs):
        text = repr(coefs[-1])
        for c in reversed(coefs[:-1]):
            text = f"({text} * ({x}) + {c!r})"
        return text

    return f"({poly(pair[0])} / {poly(pair[1])})"


def normal_quantile_sql(p: str) -> str:
    """Inverse normal distribution function as a plain SQL expression of ``p``."""
    q = f"(({p}) - 0.5e0)"
    tail = f"sqrt(-ln(least({p}, 1e0 - ({p}))))"
    far = f"CASE WHEN {tail} <= 5e0 THEN {_ratio(f'{tail} - 1.6e0', _MIDDLE)} ELSE {_ratio(f'{tail} - 5e0', _TAIL)} END"
    return (
        f"CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {_ratio(f'0.180625e0 - {q} * {q}', _CENTRE)} "
        f"ELSE sign({q}) * ({far}) END"
    )


def normal_quantile(name: str) -> Column:
    """Inverse normal distribution function of the named probability column, in the JVM."""
    return F.expr(normal_quantile_sql(f"`{name}`"))
