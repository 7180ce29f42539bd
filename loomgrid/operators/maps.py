"""Maps through tables: tables are small arrays on the driver and become literal arrays in the plan, so no join is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.core.exists import NAN, bin_clamp, exists
from loomgrid.core.grid import Grid

#: Entries of a table that go into a plan as a literal.
LARGEST = 65_536


def _array(values: list[float]) -> Column:
    if not 0 < len(values) <= LARGEST:
        raise ValueError(f"a table has 1 to {LARGEST} entries")
    return F.lit([float(x) for x in values])


def lut(g: Grid, table: list[float], low: float, high: float) -> Grid:
    """The entry of the cell that a value falls into, clamped; what doesn't exist passes."""
    v = F.col("v")
    return g.with_value(F.when(exists(v), F.get(_array(table), bin_clamp(v, F.lit(low), F.lit(high), len(table)).cast("int"))).otherwise(v))


def _between(table: list[float], x: Column) -> Column:
    """Linear interpolation at ``x`` in [0, len - 1]."""
    t = _array(table)
    k = F.least(F.floor(x), F.lit(max(0, len(table) - 2))).cast("int")
    return F.get(t, k) + (x - k) * (F.get(t, F.least(k + 1, F.lit(len(table) - 1))) - F.get(t, k))


def regular_map(g: Grid, table: list[float], low: float, high: float) -> Grid:
    """Interpolates between entries at even positions from ``low`` to ``high``."""
    v = F.col("v")
    x = (F.least(F.greatest(v, F.lit(low)), F.lit(high)) - low) / (high - low) * (len(table) - 1)
    return g.with_value(F.when(exists(v), _between(table, x)).otherwise(v))


def irregular_map(g: Grid, points: list[tuple[float, float]], below: float | None = None, missing: float = NAN, above: float | None = None) -> Grid:
    """Interpolates between (position, value) points; optional outputs for -inf, NaN and +inf."""
    pos, val = [p for p, _ in points], [y for _, y in points]
    if any(a >= b for a, b in zip(pos, pos[1:], strict=False)):
        raise ValueError("positions must rise")
    v = F.least(F.greatest(F.col("v"), F.lit(pos[0])), F.lit(pos[-1]))
    at = F.least(F.greatest(F.size(F.filter(_array(pos), lambda p: p <= v)) - 1, F.lit(0)), F.lit(len(pos) - 2)).cast("int")
    x0, x1, y0, y1 = (F.get(_array(a), at + k) for a in (pos, val) for k in (0, 1))
    out = y0 + (v - x0) / (x1 - x0) * (y1 - y0)
    odd = F.when(F.isnan(F.col("v")), F.lit(missing)).when(F.col("v") < 0, F.lit(NAN if below is None else below)).otherwise(F.lit(NAN if above is None else above))
    return g.with_value(F.when(exists(F.col("v")), out).otherwise(odd))


def substitute(g: Grid, pairs: list[tuple[float, float]]) -> Grid:
    """Each pair applies to the running value in order, so chains follow through."""
    v = F.col("v")
    for old, new in pairs:
        v = F.when(~F.isnan(v) & (v == old), F.lit(float(new))).otherwise(v)
    return g.with_value(v)


def lut2(a: Grid, b: Grid, table: list[list[float]], bounds_a: tuple[float, float], bounds_b: tuple[float, float]) -> Grid:
    """table[bin of b][bin of a]; the grids meet by their coordinates."""
    both = a.df.select(*a.names, F.col("v").alias("va")).join(b.df.select(*a.names, F.col("v").alias("vb")), a.names)
    n, m = len(table[0]), len(table)
    flat = _array([x for row in table for x in row])
    at = bin_clamp(F.col("va"), *map(F.lit, bounds_a), n) + n * bin_clamp(F.col("vb"), *map(F.lit, bounds_b), m)
    return Grid(both.select(*a.names, F.when(exists(F.col("va")) & exists(F.col("vb")), F.get(flat, at.cast("int"))).otherwise(F.lit(NAN)).alias("v")), a.axes)


def _each(g: Grid, tables: Grid, at: Column) -> DataFrame:
    """The cells of ``g`` with their own table's entry at ``at`` (v2); axis 0 of ``tables`` runs over the entries."""
    entries = tables.df.select(F.col("i0").alias("__entry"), *(F.col(f"i{k + 1}").alias(n) for k, n in enumerate(g.names)), F.col("v").alias("v2"))
    return g.df.withColumn("__entry", at.cast("long")).join(entries, [*g.names, "__entry"], "left")


def _check_tables(g: Grid, tables: Grid) -> int:
    if [a.size for a in tables.axes[1:]] != [a.size for a in g.axes]:
        raise ValueError("there must be a table for each element")
    return tables.axes[0].size


def lut_each(g: Grid, tables: Grid, low: float, high: float) -> Grid:
    """:func:`lut` with a table of its own for each element: one join on coordinates and bin."""
    n = _check_tables(g, tables)
    v = F.col("v")
    met = _each(g, tables, F.when(exists(v), bin_clamp(v, F.lit(low), F.lit(high), n)))
    return Grid(met.select(*g.names, F.when(exists(v), F.col("v2")).otherwise(v).alias("v")), g.axes)


def map_each(g: Grid, tables: Grid, low: float, high: float) -> Grid:
    """:func:`regular_map` with a table of its own for each element; both entries around a value come in one join."""
    n = _check_tables(g, tables)
    x = (F.least(F.greatest(F.col("v"), F.lit(low)), F.lit(high)) - low) / (high - low) * (n - 1)
    at = F.least(F.floor(x), F.lit(max(0, n - 2))).cast("long")
    cells = g.df.withColumn("x", x).withColumn("k", at).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    entries = tables.df.select(F.col("i0").alias("e"), *(F.col(f"i{k + 1}").alias(c) for k, c in enumerate(g.names)), F.col("v").alias("y"))
    met = cells.withColumn("e", F.least(F.col("k") + F.col("side"), F.lit(n - 1))).join(entries, [*g.names, "e"], "left")
    weight = F.when(F.col("side") == 1, F.col("x") - F.col("k")).otherwise(1 - F.col("x") + F.col("k"))
    out = met.groupBy(*g.names).agg(F.first("v").alias("v0"), F.sum(weight * F.col("y")).alias("y"))
    return Grid(out.select(*g.names, F.when(exists(F.col("v0")), F.col("y")).otherwise(F.col("v0")).alias("v")), g.axes)
