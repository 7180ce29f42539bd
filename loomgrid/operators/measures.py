"""Measures along an axis: aggregates with partial combination before the shuffle, and none gathers a line but the median."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgrid.core.exists import bin_index, finite, or_nan
from loomgrid.core.grid import Axis, Grid

MODE_BINS = 1024


def _line(v: Column, p: Column) -> dict[str, Column]:
    n = F.count(v)
    slope = F.when(n < 2, 0.0).otherwise(F.coalesce(F.regr_slope(v, p), F.lit(0.0)))
    return {
        "line-slope": slope,
        "line-intercept": F.avg(v) - slope * F.avg(p),
        "line-error": F.greatest(F.lit(0.0), F.regr_syy(v, p) - slope * F.coalesce(F.regr_sxy(v, p), F.lit(0.0))),
    }


#: name -> aggregate of (value that exists, raw value, position)
MEASURES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "min": lambda v, r, p: F.min(v),
    "max": lambda v, r, p: F.max(v),
    "mean": lambda v, r, p: F.avg(v),
    "median": lambda v, r, p: F.percentile(v, F.lit(0.5)),
    "product": lambda v, r, p: F.product(v),
    "sum": lambda v, r, p: F.sum(v),
    "L1": lambda v, r, p: F.sum(F.abs(v)),
    "L2": lambda v, r, p: F.sqrt(F.sum(v * v)),
    "L4": lambda v, r, p: F.sqrt(F.sqrt(F.sum(v * v * v * v))),
    "normalizedL2": lambda v, r, p: F.sqrt(F.sum(v * v)) / F.count(v),
    "RMS": lambda v, r, p: F.sqrt(F.avg(v * v)),
    "Linf": lambda v, r, p: F.max(F.abs(v)),
    "variance": lambda v, r, p: F.var_pop(v),
    "stdv": lambda v, r, p: F.stddev_pop(v),
    "CoV": lambda v, r, p: F.when(F.avg(v) == 0, 0.0).otherwise(F.try_divide(F.stddev_pop(v), F.avg(v))),
    "skew": lambda v, r, p: F.when(F.var_pop(v) == 0, 0.0).otherwise(F.skewness(v)),
    "line-slope": lambda v, r, p: _line(r, p)["line-slope"],
    "line-intercept": lambda v, r, p: _line(r, p)["line-intercept"],
    "line-error": lambda v, r, p: _line(r, p)["line-error"],
}

#: Measures that read a line as a histogram: (count, position).
HISTO_MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "histo-min": lambda h, p: F.min(F.when(h > 0, p)),
    "histo-max": lambda h, p: F.max(F.when(h > 0, p)),
    "histo-mean": lambda h, p: F.try_divide(F.sum(h * p), F.sum(h)),
    "histo-product": lambda h, p: F.product(F.pow(p, h)),
    "histo-sum": lambda h, p: F.sum(h * p),
    "histo-L2": lambda h, p: F.sum(h * p * p),
    "histo-variance": lambda h, p: F.greatest(F.lit(0.0), F.try_divide(F.sum(h * p * p), F.sum(h)) - F.pow(F.try_divide(F.sum(h * p), F.sum(h)), F.lit(2.0))),
    "histo-SD": lambda h, p: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum(h * p * p), F.sum(h)) - F.pow(F.try_divide(F.sum(h * p), F.sum(h)), F.lit(2.0)))),
}


def group_measure(df: DataFrame, by: list[str], measure: str, value: str = "v", position: str | None = None) -> DataFrame:
    """A measure of each group of an unordered table: (by..., v)."""
    v = F.col(value).cast("double")
    p = F.col(position).cast("double") if position else F.lit(0.0)
    if measure in MEASURES:
        return df.groupBy(*by).agg(or_nan(MEASURES[measure](finite(v), v, p)).alias("v"))
    if measure == "mode":
        return group_mode(df, by, value)
    h = F.greatest(F.coalesce(finite(v), F.lit(0.0)), F.lit(0.0))
    if measure in HISTO_MEASURES:
        return df.groupBy(*by).agg(or_nan(HISTO_MEASURES[measure](h, p)).alias("v"))
    rows = df.select(*by, h.alias("h"), p.alias("p"))
    if measure == "histo-mode":
        top = rows.withColumn("top", F.max("h").over(Window.partitionBy(*by)))
        return top.filter("h = top").groupBy(*by).agg(F.avg("p").alias("v"))
    if measure == "histo-median":
        w = Window.partitionBy(*by)
        run = rows.withColumn("all", F.sum("h").over(w)).withColumn("cum", F.sum("h").over(w.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
        return run.filter("cum >= all / 2").groupBy(*by).agg(F.min("p").alias("v"))
    raise ValueError(f"no measure {measure!r}")


def group_mode(df: DataFrame, by: list[str], value: str = "v", bins: int = MODE_BINS) -> DataFrame:
    """Center of the fullest of ``bins`` bins over each group's range; ties are averaged.  Three aggregations, no line is gathered."""
    rows = df.select(*by, finite(F.col(value).cast("double")).alias("x")).filter("x IS NOT NULL")
    bounds = rows.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    binned = rows.alias("r").join(bounds.alias("b"), on).select(*(F.col(f"r.{c}").alias(c) for c in by), "lo", "hi", bin_index(F.col("x"), F.col("lo"), F.when(F.col("hi") == F.col("lo"), F.col("hi") + 1).otherwise(F.col("hi")), bins).alias("b"))
    counts = binned.groupBy(*by, "lo", "hi", "b").agg(F.count("*").alias("n"))
    top = counts.withColumn("top", F.max("n").over(Window.partitionBy(*by))).filter("n = top")
    hi = F.when(F.first("hi") == F.first("lo"), F.first("hi") + 1).otherwise(F.first("hi"))
    return top.groupBy(*by).agg((F.first("lo") + (hi - F.first("lo")) * (F.avg("b") + 0.5) / bins).alias("v"))


def project(g: Grid, axis: int, measure: str) -> Grid:
    """A measure of every line along ``axis``; the axis goes."""
    g.check_axis(axis)
    keep = [n for k, n in enumerate(g.names) if k != axis]
    a = g.axes[axis]
    low, high = (a.low, a.high) if a.low is not None else ((-0.5, a.size - 0.5) if measure.startswith("histo") else (0, a.size - 1))
    place = Axis(a.size, low, high, "cell" if measure.startswith("histo") else "node")
    rows = g.df.withColumn("__p", place.position(F.col(f"i{axis}")))
    out = group_measure(rows, keep, measure, "v", "__p")
    names = {n: f"i{k}" for k, n in enumerate(keep)}
    axes = tuple(x for k, x in enumerate(g.axes) if k != axis)
    return Grid(out.withColumnsRenamed(names), axes, "float", f"project({g.content},{axis},{measure})")
