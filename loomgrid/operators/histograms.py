"""Histograms and what is read from them; empty bins come from a spine of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgrid.core.exists import bin_index, exists
from loomgrid.core.grid import Axis, Grid, spine
from loomgrid.operators.elementwise import value_range


def histogram(g: Grid, bins: int, bounds: tuple[float, float] | None = None, weight: Grid | None = None) -> Grid:
    """Counts (or sums of weights) over the range; what is outside, or doesn't exist, is dropped."""
    low, high = bounds or value_range(g)
    high = high + 1 if low == high else high
    df = g.df.select(*g.names, "v")
    if weight is not None:
        df = df.join(weight.df.select(*g.names, F.col("v").alias("w")), g.names)
    v = F.col("v")
    amount = F.sum("w") if weight is not None else F.count("*").cast("double")
    got = df.filter(exists(v) & v.between(low, high)).groupBy(bin_index(v, F.lit(low), F.lit(high), bins).alias("i0")).agg(amount.alias("n"))
    return _filled(got, (Axis(bins, low, high),), ["i0"])


def _filled(got: DataFrame, axes: tuple[Axis, ...], names: list[str]) -> Grid:
    all_bins = spine(got.sparkSession, axes)
    return Grid(all_bins.join(got, names, "left").select(*names, F.coalesce("n", F.lit(0.0)).alias("v")), axes, "uint")


def axis_histogram(g: Grid, axis: int, bins: int, bounds: tuple[float, float] | None = None) -> Grid:
    """A histogram of every line along ``axis``, which becomes the axis of bins."""
    low, high = bounds or value_range(g)
    v = F.col("v")
    keys = [bin_index(v, F.lit(low), F.lit(high), bins).alias(n) if k == axis else F.col(n) for k, n in enumerate(g.names)]
    got = g.df.filter(exists(v) & v.between(low, high)).groupBy(*keys).agg(F.count("*").cast("double").alias("n"))
    axes = tuple(Axis(bins, low, high) if k == axis else a for k, a in enumerate(g.axes))
    return _filled(got, axes, g.names)


def joint_histogram(grids: list[Grid], bins: list[int], bounds: list[tuple[float, float]], clamp: list[bool] | None = None) -> Grid:
    """One axis of bins per grid; a cell counts if all its values exist, and each is in range or clamped."""
    clamp = clamp or [False] * len(grids)
    first = grids[0]
    df = first.df.select(*first.names, F.col("v").alias("v0"))
    for k, g in enumerate(grids[1:], 1):
        df = df.join(g.df.select(*first.names, F.col("v").alias(f"v{k}")), first.names)
    keys: list[Column] = []
    for k, ((low, high), n, c) in enumerate(zip(bounds, bins, clamp, strict=True)):
        v = F.col(f"v{k}")
        df = df.filter(exists(v))
        if c:
            v = F.least(F.greatest(v, F.lit(low)), F.lit(high))
        else:
            df = df.filter(v.between(low, high))
        keys.append(bin_index(v, F.lit(low), F.lit(high), n).alias(f"i{k}"))
    got = df.groupBy(*keys).agg(F.count("*").cast("double").alias("n"))
    return _filled(got, tuple(Axis(n, *b) for n, b in zip(bins, bounds, strict=True)), [f"i{k}" for k in range(len(grids))])


def otsu(h: Grid, exponent: float = 2.0) -> float:
    """Threshold position that parts the histogram best: n0 n1 sgn |m1 - m0| ^ exponent."""
    a = h.axes[0]
    run = Window.partitionBy(F.lit(0)).orderBy("i0")  # a histogram: its bins, not the data
    before, after = run.rowsBetween(Window.unboundedPreceding, -1), run.rowsBetween(0, Window.unboundedFollowing)
    rows = h.df.select("i0", "v", (F.col("v") * F.col("i0")).alias("x"))
    s = rows.select("i0", *(F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(f"{c}{k}") for k, w in enumerate((before, after)) for c in ("v", "x")))
    gap = F.try_divide(F.col("x1"), F.col("v1")) - F.try_divide(F.col("x0"), F.col("v0"))
    best = s.select("i0", (F.col("v0") * F.col("v1") * F.signum(gap) * F.pow(F.abs(gap), F.lit(exponent))).alias("d")).orderBy(F.desc_nulls_last("d"), "i0").first()
    return float(a.low + (a.high - a.low) * (best["i0"] + 0.5) / a.size)


def equalize(g: Grid, bins: int, amount: float = 1.0) -> Grid:
    """Values through the cumulative histogram, rescaled to the range, blended with the identity."""
    if bins <= 4:
        raise ValueError("more than 4 bins are needed")
    low, high = value_range(g)
    h = histogram(g, bins, (low, high))
    top = high + 1 if low == high else high
    cum = F.sum("v").over(Window.partitionBy(F.lit(0)).orderBy("i0"))
    table = h.df.select((F.col("i0") + 1).alias("k"), cum.alias("c")).union(h.df.sparkSession.createDataFrame([(0, 0.0)], "k long, c double"))
    rows = {r["k"]: r["c"] for r in table.collect()}  # bins + 1 rows
    total = rows[bins] or 1.0
    knots = F.array(*(F.lit(low + (top - low) * rows[k] / total) for k in range(bins + 1)))
    x = (F.col("v") - low) / (top - low) * bins
    k = F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(bins - 1)).cast("int")
    mapped = F.get(knots, k) + (x - k) * (F.get(knots, k + 1) - F.get(knots, k))
    return g.with_value(F.when(exists(F.col("v")), (1 - amount) * F.col("v") + amount * mapped).otherwise(F.col("v")))


def percentile_range(g: Grid, low_percent: float, high_percent: float, bins: int = 1024) -> tuple[float, float]:
    """The range without the given percents at either end, read from a histogram."""
    low, high = value_range(g)
    h = histogram(g, bins, (low, high))
    total = h.df.agg(F.sum("v")).first()[0]
    cum = h.df.withColumn("c", F.sum("v").over(Window.partitionBy(F.lit(0)).orderBy("i0")))
    r = cum.agg(
        F.min(F.when(F.col("c") > total * low_percent / 100, F.col("i0"))), F.max(F.when(total - F.col("c") + F.col("v") > total * high_percent / 100, F.col("i0")))
    ).first()
    width = (high - low) / bins
    return low + width * r[0], low + width * (r[1] + 1)
