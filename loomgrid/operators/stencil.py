"""Neighbourhood operators: resampling by weight tables, blur, median, distance, labels of equal neighbours, FFT."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgrid.core import lineage
from loomgrid.core.exists import exists
from loomgrid.core.grid import Axis, Grid
from loomgrid.functions.kernels import Kernel, parse
from loomgrid.operators.shape import border


def border_index(i: np.ndarray, n: int, rule: str) -> np.ndarray:
    if rule == "wrap":
        return i % n
    if rule == "mirror":
        m = i % (2 * n)
        return np.where(m >= n, 2 * n - 1 - m, m)
    if rule == "bleed":
        return np.clip(i, 0, n - 1)
    return i


def weights(kernel: Kernel, size: int, samples: int, rule: str = "bleed", renormalize: bool = True, center: str = "cell") -> list[tuple[int, int, float]]:
    """(output sample, input sample, weight) of one axis resampled over its whole range; an input beyond a padded border is -1."""
    scale = size / samples if center == "cell" else (size - 1) / max(1, samples - 1)
    at = (np.arange(samples) + 0.5) * scale - 0.5 if center == "cell" else np.arange(samples) * scale
    stretch = max(1.0, scale)  # a kernel covers the samples that an output stands for
    reach = kernel.support * stretch
    out: dict[tuple[int, int], float] = {}
    for o, x in enumerate(at):
        i = np.arange(int(np.ceil(x - reach)), int(np.floor(x + reach)) + 1)
        w = kernel.f((x - i) / stretch) / stretch
        if renormalize and kernel.integral and w.sum():
            w = w * kernel.integral / w.sum()
        j = border_index(i, size, rule)
        for a, b in zip(j.tolist(), w.tolist(), strict=True):
            if b:
                a = a if 0 <= a < size else -1
                out[o, a] = out.get((o, a), 0.0) + b
    return [(o, a, w) for (o, a), w in out.items()]


def _weight_table(spark: SparkSession, rows: list[tuple[int, int, float]]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(rows, columns=["o", "s", "w"]), "o long, s long, w double")


def resample(g: Grid, axis: int, samples: int, kernel: str = "tent", rule: str = "bleed", pad_value: float = 0.0, renormalize: bool = True) -> Grid:
    """One axis to ``samples`` samples.  The axis's weights (a table of its size times the support) meet the cells in a
    join, and a sum, combined before its shuffle, makes each output cell."""
    g.check_axis(axis)
    a = g.axes[axis]
    rows = weights(parse(kernel), a.size, samples, rule, renormalize, a.center)
    name = f"i{axis}"
    table = _weight_table(g.df.sparkSession, [r for r in rows if r[1] >= 0])
    met = g.df.join(table, F.col(name) == F.col("s"))
    keys = [F.col("o").alias(n) if n == name else F.col(n) for n in g.names]
    out = met.groupBy(*keys).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    padded = [(o, 0, w) for o, s, w in rows if s < 0]
    if padded:
        extra = _weight_table(g.df.sparkSession, padded).select(F.col("o").alias(name), F.col("w").alias("__w"))
        out = out.join(extra, name, "left").select(*g.names, (F.col("v") + F.coalesce("__w", F.lit(0.0)) * pad_value).alias("v"))
    axes = tuple(replace(x, size=samples) if k == axis else x for k, x in enumerate(g.axes))
    return Grid(out.select(*g.names, "v"), axes, g.kind, f"resample({axis},{samples},{kernel})")


def gaussian_blur(g: Grid, axis: int, sigma: float, cut: float = 3.0, rule: str = "bleed") -> Grid:
    return resample(g, axis, g.axes[axis].size, f"gauss:{sigma},{cut}", rule)


def cheap_median(g: Grid, axis: int, radius: int, bins: int, mode: bool = False) -> Grid:
    """Median (or mode) of each window of one axis, as the node position of its bin over the range of the grid."""
    from loomgrid.operators.elementwise import value_range

    low, high = value_range(g)
    high = high + 1 if low == high else high
    n = g.axes[axis].size
    name = f"i{axis}"
    step = F.sequence(F.col(name) - radius, F.col(name) + radius)
    bin_ = F.least(F.greatest(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    spread = g.df.filter(exists(F.col("v"))).select(*(c for c in g.names if c != name), bin_.alias("b"), F.explode(step).alias(name))
    counts = spread.filter(F.col(name).between(0, n - 1)).groupBy(*g.names, "b").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*g.names)
    if mode:
        at = counts.withColumn("top", F.max("c").over(w)).filter("c = top").groupBy(*g.names).agg(F.min("b").alias("b"))
    else:
        run = counts.withColumn("cum", F.sum("c").over(w.orderBy("b"))).withColumn("all", F.sum("c").over(w))
        at = run.filter("cum * 2 > all").groupBy(*g.names).agg(F.min("b").alias("b"))
    return Grid(at.select(*g.names, (low + (high - low) * F.col("b") / (bins - 1)).alias("v")), g.axes, g.kind, "cmedian")


def distance(g: Grid, axis: int, threshold: float, above: bool = True) -> Grid:
    """Distance along one axis to the nearest sample on the side asked for: two running windows per line."""
    name = f"i{axis}"
    others = [c for c in g.names if c != name]
    hit = F.col("v") >= threshold if above else F.col("v") < threshold
    w = Window.partitionBy(*others).orderBy(name) if others else Window.partitionBy(F.lit(0)).orderBy(name)
    rows = g.df.withColumn("__h", F.when(hit, F.col(name)))
    back = F.last("__h", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("__h", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = F.least(F.col(name) - back, ahead - F.col(name)).cast("double")
    return Grid(rows.select(*g.names, F.coalesce(d, F.lit(float("inf"))).alias("v")), g.axes, "double", "distance")


def _nearest(at: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each place of ``at`` (rising) the least of d + (place - at) ** 2: the lower envelope of the parabolas over the
    places with a finite d, one walk forth and one back, so the cost is that of the line's length."""
    held = np.flatnonzero(np.isfinite(d))
    if not len(held):
        return np.full(len(at), np.inf)
    feet, tops = at[held].tolist(), d[held].tolist()
    stack, since = [0], [-np.inf]  # parabolas of the envelope, and the place from which each is the lowest
    for q in range(1, len(feet)):
        while True:
            p = stack[-1]
            cut = (tops[q] - tops[p] + (feet[q] - feet[p]) * (feet[q] + feet[p])) / (2 * (feet[q] - feet[p]))
            if cut > since[-1]:
                break
            stack.pop()
            since.pop()
        stack.append(q)
        since.append(cut)
    low = held[np.asarray(stack)[np.searchsorted(np.asarray(since), at, side="right") - 1]]
    return (at - at[low]) ** 2 + d[low]


def _least_along(name: str) -> Callable[[pa.Table], pa.Table]:
    """Of one line along ``name``: the least of squared distance so far (v) plus that along the line."""

    def least(table: pa.Table) -> pa.Table:
        table = table.sort_by(name)
        out = _nearest(table.column(name).to_numpy(), table.column("v").to_numpy())
        return table.set_column(table.column_names.index("v"), "v", pa.array(out))

    return least


def distance_transform(g: Grid, threshold: float, above: bool = True) -> Grid:
    """Euclidean distance over all axes to the nearest sample on the side asked for.

    The first axis is two running windows; each other axis takes, a line at a time, the least of squared distances so
    far and along it, at a cost of its length.  Without such a sample every distance is infinite.
    """
    squares = distance(g, 0, threshold, above)
    squares = squares.with_value(F.col("v") * F.col("v"))
    for axis in range(1, g.dim):
        name = f"i{axis}"
        others = [n for n in g.names if n != name]

        schema = ", ".join(f"{n} long" for n in g.names) + ", v double"
        squares = Grid(squares.df.select(*g.names, "v").groupBy(*others).applyInArrow(_least_along(name), schema), g.axes)
    return Grid(squares.df.select(*g.names, F.sqrt("v").alias("v")), g.axes, "double", "distance")


def components(g: Grid, connectivity: int | None = None) -> Grid:
    """Labels of connected equal values, numbered from 0 by least linear index; neighbours differ by one in at most
    ``connectivity`` coordinates."""
    from itertools import product

    most = g.dim if connectivity is None else connectivity
    nodes = g.df.select(*g.names, "v", g.linear().alias("id"))
    steps = [d for d in product((-1, 0, 1), repeat=g.dim) if 0 < sum(map(abs, d)) <= most and d > (0,) * g.dim]
    edges = None
    for d in steps:
        moved = nodes.select(*((F.col(n) - s).alias(n) for n, s in zip(g.names, d, strict=True)), F.col("v").alias("v2"), F.col("id").alias("b"))
        e = nodes.join(moved, g.names).filter("v = v2").select(F.col("id").alias("a"), "b")
        edges = e if edges is None else edges.union(e)
    joined = lineage.components(edges)
    labels = nodes.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("l", F.coalesce("component", "id"))
    labels = lineage.cut(labels.select(*g.names, "l"))
    numbers = lineage.numbered(labels.select("l").distinct(), "l", "n")
    out = labels.join(numbers, "l").select(*g.names, F.col("n").cast("double").alias("v"))
    return Grid(out, g.axes, "uint", "ccfind")


def component_sizes(labels: Grid) -> Grid:
    return Grid(labels.df.groupBy(F.col("v").cast("long").alias("i0")).agg(F.count("*").cast("double").alias("v")), (Axis(labels.df.select("v").distinct().count()),), "uint")


def adjacency(labels: Grid) -> DataFrame:
    """(a, b) of labels that touch along an axis, a < b."""
    out = None
    for n in labels.names:
        moved = labels.df.select(*((F.col(c) - 1).alias(c) if c == n else F.col(c) for c in labels.names), F.col("v").alias("w"))
        e = labels.df.join(moved, labels.names).filter("v <> w").select(F.least("v", "w").cast("long").alias("a"), F.greatest("v", "w").cast("long").alias("b"))
        out = e if out is None else out.union(e)
    return out.distinct()


def settle(labels: Grid) -> Grid:
    """Labels renumbered without gaps, in order."""
    ids = labels.df.select(F.col("v").alias("old")).distinct()
    numbers = lineage.numbered(ids, "old", "at").select("old", F.col("at").cast("double").alias("new"))
    met = labels.df.join(numbers, F.col("v") == F.col("old"))
    return Grid(met.select(*labels.names, F.col("new").alias("v")), labels.axes, labels.kind)


def fft(g: Grid, axis: int, inverse: bool = False, rescale: bool = True) -> Grid:
    """Fourier transform along ``axis`` (not 0): axis 0 holds real and imaginary parts.  One line a group."""
    if axis == 0 or g.axes[0].size != 2:
        raise ValueError("axis 0 must hold real and imaginary parts, and is not transformed")
    n = g.axes[axis].size
    names, name = g.names, f"i{axis}"
    others = [c for k, c in enumerate(names) if k not in (0, axis)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros(n, complex)
        line[pdf[name]] = pdf["re"] + 1j * pdf["im"]
        out = np.fft.ifft(line) * n if inverse else np.fft.fft(line)
        out = out / np.sqrt(n) if rescale else out
        made = pd.DataFrame({name: np.tile(np.arange(n), 2), "i0": np.repeat([0, 1], n), "v": np.concatenate([out.real, out.imag])})
        for c in others:
            made[c] = pdf[c].iloc[0]
        return made[[*names, "v"]]

    pairs = g.df.groupBy(*others, name).agg(F.max(F.when(F.col("i0") == 0, F.col("v"))).alias("re"), F.max(F.when(F.col("i0") == 1, F.col("v"))).alias("im"))
    schema = ", ".join(f"{c} long" for c in g.names) + ", v double"
    grouped = pairs.groupBy(*others) if others else pairs.groupBy(F.lit(0).alias("__all"))
    return Grid(grouped.applyInPandas(run, schema), g.axes, "double", "fft")


def probe(g: Grid, points: DataFrame, kernel: str = "tent", derivative: str | None = None, rule: str = "bleed") -> DataFrame:
    """Values (and gradients) of a grid at points (p, x0, x1, ...) in index space: each point's neighbourhood is
    gathered by a join on coordinates and summed with separable weights."""
    k = parse(kernel)
    d = parse(derivative) if derivative else None
    reach = int(np.ceil(max(k.support, d.support if d else 0)))
    dim, sizes = g.dim, [a.size for a in g.axes]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[[f"x{j}" for j in range(dim)]].to_numpy()
            base = np.floor(x).astype(int)
            offs = np.stack(np.meshgrid(*[np.arange(1 - reach, reach + 1)] * dim, indexing="ij"), -1).reshape(-1, dim)
            at = base[:, None] + offs[None]
            w = k.f(x[:, None] - at)
            cols = {"p": np.repeat(pdf["p"].to_numpy(), len(offs))}
            for j in range(dim):
                cols[f"i{j}"] = border_index(at[:, :, j], sizes[j], rule).ravel()
            cols["w"] = w.prod(2).ravel()
            for j in range(dim):
                wj = d.f(x[:, None, j] - at[:, :, j]) * np.delete(w, j, 2).prod(2) if d else np.zeros(at.shape[:2])
                cols[f"w{j}"] = wj.ravel()
            yield pd.DataFrame(cols)

    schema = "p long, " + ", ".join(f"i{j} long" for j in range(dim)) + ", w double, " + ", ".join(f"w{j} double" for j in range(dim))
    need = points.select("p", *(F.col(f"x{j}").cast("double") for j in range(dim))).mapInPandas(spread, schema)
    met = need.join(g.cells(), g.names)
    return met.groupBy("p").agg(F.sum(F.col("v") * F.col("w")).alias("value"), *(F.sum(F.col("v") * F.col(f"w{j}")).alias(f"g{j}") for j in range(dim) if d))


__all__ = ["adjacency", "border", "cheap_median", "component_sizes", "components", "distance", "distance_transform", "fft", "gaussian_blur", "probe", "resample", "settle", "weights"]
