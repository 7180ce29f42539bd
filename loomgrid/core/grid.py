"""A grid: axis metadata on the driver, cells in a DataFrame (i0, i1, ... bigint; v double). Axis 0 is the fastest."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    size: int
    low: float | None = None
    high: float | None = None
    center: str = "cell"
    kind: str | None = None
    label: str | None = None

    def position(self, i: Column) -> Column:
        """World position of an index, by centering; without a range the index itself."""
        if self.low is None or self.high is None:
            return i.cast("double")
        if self.center == "node":
            return self.low + (self.high - self.low) * i / max(1, self.size - 1)
        return self.low + (self.high - self.low) * (i + 0.5) / self.size


@dataclass(frozen=True)
class Grid:
    df: DataFrame
    axes: tuple[Axis, ...]
    kind: str = "double"
    content: str = ""
    notes: dict[str, str] = field(default_factory=dict)

    @property
    def dim(self) -> int:
        return len(self.axes)

    @property
    def names(self) -> list[str]:
        return [f"i{k}" for k in range(self.dim)]

    @property
    def size(self) -> int:
        n = 1
        for a in self.axes:
            n *= a.size
        return n

    def cells(self) -> DataFrame:
        return self.df.select(*self.names, "v")

    def with_value(self, v: Column, kind: str | None = None) -> Grid:
        """Same cells, another value: a projection, fused by Catalyst with its neighbours."""
        return replace(self, df=self.df.select(*self.names, v.cast("double").alias("v")), kind=kind or self.kind)

    def linear(self) -> Column:
        """Linear index, axis 0 fastest."""
        at, step = F.lit(0).cast("long"), 1
        for name, a in zip(self.names, self.axes, strict=True):
            at = at + F.col(name) * step
            step *= a.size
        return at

    def check_axis(self, axis: int) -> None:
        if not 0 <= axis < self.dim:
            raise ValueError(f"axis {axis} of a grid with {self.dim} axes")


def from_table(df: DataFrame, index: list[str], value: Column | str, axes: tuple[Axis, ...], kind: str = "double") -> Grid:
    """A table whose ``index`` columns are dense from 0 as a grid."""
    v = F.col(value) if isinstance(value, str) else value
    return Grid(df.select(*(F.col(c).cast("long").alias(f"i{k}") for k, c in enumerate(index)), v.cast("double").alias("v")), axes, kind)


def from_vectors(df: DataFrame, row: str, vector: str, size: int, rows: int) -> Grid:
    """A table of arrays as a grid of 2 axes: place in the array (fastest), then row."""
    cells = df.select(F.posexplode(vector).alias("i0", "v"), F.col(row).cast("long").alias("i1"))
    return Grid(cells.select(F.col("i0").cast("long"), "i1", F.col("v").cast("double")), (Axis(size), Axis(rows)))


def from_linear(g: DataFrame, sizes: list[int]) -> Grid:
    """(at, v) with a linear index as a grid."""
    out, step = [], 1
    for k, n in enumerate(sizes):
        out.append((F.floor(F.col("at") / step) % n).cast("long").alias(f"i{k}"))
        step *= n
    return Grid(g.select(*out, "v"), tuple(Axis(n) for n in sizes))


def spine(spark: SparkSession, axes: tuple[Axis, ...]) -> DataFrame:
    """Every cell's indices, made by a distributed range."""
    total = 1
    for a in axes:
        total *= a.size
    out, step = [], 1
    for k, a in enumerate(axes):
        out.append((F.floor(F.col("id") / step) % a.size).cast("long").alias(f"i{k}"))
        step *= a.size
    return spark.range(total).select(*out)
