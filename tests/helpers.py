"""Small helpers for comparing results."""


def rows(df, *columns):
    out = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in out.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


def counted(spark, counts, name):
    """A table of ``name`` with each value repeated as often as its count says."""
    return spark.createDataFrame([(v,) for v, n in counts.items() for _ in range(n)], f"{name} int")
