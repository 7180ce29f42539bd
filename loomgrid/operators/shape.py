"""Reordering, subsets and unions of grids: arithmetic on coordinates, filters and unions; only gathers by a list join."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgrid.core.grid import Axis, Grid, from_linear, spine
from loomgrid.operators.measures import project


def _rename(g: Grid, index: list[Column], axes: tuple[Axis, ...], content: str = "") -> Grid:
    return Grid(g.df.select(*(c.cast("long").alias(f"i{k}") for k, c in enumerate(index)), "v"), axes, g.kind, content, g.notes)


def _with(items: tuple | list, at: int, new: object) -> list:
    out = list(items)
    out[at] = new
    return out


def _cols(g: Grid) -> list[Column]:
    return [F.col(n) for n in g.names]


# -- subsets ---------------------------------------------------------------------------------------------------


def slice_at(g: Grid, axis: int, at: int) -> Grid:
    """One hyperplane; the axis goes."""
    g.check_axis(axis)
    if not 0 <= at < g.axes[axis].size:
        raise ValueError(f"position {at} outside the axis")
    keep = [k for k in range(g.dim) if k != axis]
    cut = replace(g, df=g.df.filter(F.col(f"i{axis}") == at))
    return _rename(cut, [F.col(f"i{k}") for k in keep], tuple(g.axes[k] for k in keep), f"slice({axis},{at})")


def crop(g: Grid, low: list[int], high: list[int]) -> Grid:
    """The box from ``low`` to ``high``, both inside, with indices from 0."""
    if any(not 0 <= a <= b < x.size for a, b, x in zip(low, high, g.axes, strict=True)):
        raise ValueError("the box must lie inside the grid")
    df, axes = g.df, []
    for k, (a, b, x) in enumerate(zip(low, high, g.axes, strict=True)):
        if a > 0 or b < x.size - 1:
            df = df.filter(F.col(f"i{k}").between(a, b))
        ends = (None, None)
        if x.low is not None:
            step = (x.high - x.low) / (x.size if x.center == "cell" else max(1, x.size - 1))
            ends = (x.low + a * step, x.low + (b + (x.center == "cell")) * step)
        axes.append(replace(x, size=b - a + 1, low=ends[0], high=ends[1]))
    return _rename(replace(g, df=df), [F.col(f"i{k}") - a for k, a in enumerate(low)], tuple(axes), "crop")


def simple_crop(g: Grid, margin: int) -> Grid:
    return crop(g, [margin] * g.dim, [a.size - 1 - margin for a in g.axes])


def auto_crop(g: Grid, measure: str, share: float, offset: int = 0) -> Grid:
    """Trims each end of each axis while the lines trimmed hold no more than ``share`` of the axis's total."""
    low, high = [], []
    for k in range(g.dim):
        line = g
        for j in range(g.dim - 1, -1, -1):
            if j != k:
                line = project(line, j, measure)
        up = Window.partitionBy(F.lit(0)).orderBy("i0")  # one value per index of one axis
        total = line.df.agg(F.sum("v")).first()[0]
        run = line.df.withColumn("up", F.sum("v").over(up)).withColumn("down", total - F.col("up") + F.col("v"))
        r = run.agg(F.min(F.when(F.col("up") > share * total, F.col("i0"))), F.max(F.when(F.col("down") > share * total, F.col("i0")))).first()
        low.append(max(0, (r[0] or 0) - offset))
        high.append(min(g.axes[k].size - 1, (r[1] if r[1] is not None else g.axes[k].size - 1) + offset))
    return crop(g, low, high)


def slice_select(g: Grid, axis: int, line: Grid, threshold: float, above: bool = True, strict: bool = False) -> Grid:
    """Slices whose value in ``line`` is at least (or below) the threshold, numbered anew in order; ``strict`` leaves those at the threshold to the side below."""
    g.check_axis(axis)
    over = F.col("v") > threshold if strict else F.col("v") >= threshold
    want = line.df.filter(over if above else ~over)
    ordered = want.select(F.col("i0").alias("__old"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("i0")) - 1).alias("__new"))
    n = want.count()
    if n == 0:
        raise ValueError("no slice is on the side asked for")
    met = g.df.join(ordered, F.col(f"i{axis}") == F.col("__old"))
    return _rename(replace(g, df=met), _with(_cols(g), axis, F.col("__new")), tuple(_with(g.axes, axis, replace(g.axes[axis], size=n))), "sselect")


def sample(g: Grid, at: list[int]) -> float | None:
    cond = F.lit(True)
    for k, i in enumerate(at):
        cond = cond & (F.col(f"i{k}") == i)
    r = g.df.filter(cond).select("v").first()
    return r and r[0]


# -- order -----------------------------------------------------------------------------------------------------


def permute(g: Grid, order: list[int]) -> Grid:
    """Axis k of the result is axis ``order[k]``."""
    if sorted(order) != list(range(g.dim)):
        raise ValueError("not a permutation of the axes")
    return _rename(g, [F.col(f"i{k}") for k in order], tuple(g.axes[k] for k in order), "permute")


def swap(g: Grid, a: int, b: int) -> Grid:
    order = list(range(g.dim))
    order[a], order[b] = b, a
    return permute(g, order)


def invert_permutation(order: list[int]) -> list[int]:
    if sorted(order) != list(range(len(order))):
        raise ValueError("not a permutation")
    return sorted(range(len(order)), key=order.__getitem__)


def shuffle(g: Grid, axis: int, order: list[int]) -> Grid:
    """Slice k of the result is slice ``order[k]``; slices may repeat."""
    g.check_axis(axis)
    spark = g.df.sparkSession
    if any(not 0 <= o < g.axes[axis].size for o in order):
        raise ValueError("a slice to take lies outside the axis")
    pairs = spark.createDataFrame([(k, o) for k, o in enumerate(order)], "`__new` long, `__old` long")
    met = g.df.join(pairs, F.col(f"i{axis}") == F.col("__old"))
    return _rename(replace(g, df=met), _with(_cols(g), axis, F.col("__new")), tuple(_with(g.axes, axis, replace(g.axes[axis], size=len(order)))), "shuffle")


def flip(g: Grid, axis: int) -> Grid:
    g.check_axis(axis)
    x = g.axes[axis]
    return _rename(g, _with(_cols(g), axis, x.size - 1 - F.col(f"i{axis}")), tuple(_with(g.axes, axis, replace(x, low=x.high, high=x.low))), "flip")


def insert_axis(g: Grid, axis: int) -> Grid:
    cols, axes = _cols(g), list(g.axes)
    cols.insert(axis, F.lit(0))
    axes.insert(axis, Axis(1))
    return _rename(g, cols, tuple(axes), "axinsert")


def delete_axis(g: Grid, axis: int) -> Grid:
    if g.axes[axis].size != 1:
        raise ValueError("only an axis of one sample can be deleted")
    keep = [k for k in range(g.dim) if k != axis]
    return _rename(g, [F.col(f"i{k}") for k in keep], tuple(g.axes[k] for k in keep), "axdelete")


def split_axis(g: Grid, axis: int, fast: int, slow: int) -> Grid:
    if fast * slow != g.axes[axis].size:
        raise ValueError("fast x slow must be the size of the axis")
    i, cols, axes = F.col(f"i{axis}"), _cols(g), list(g.axes)
    cols[axis : axis + 1] = [i % fast, F.floor(i / fast)]
    axes[axis : axis + 1] = [Axis(fast), Axis(slow)]
    return _rename(g, cols, tuple(axes), "axsplit")


def merge_axes(g: Grid, axis: int) -> Grid:
    """The axis and the next one as one."""
    cols, axes = _cols(g), list(g.axes)
    n = axes[axis].size
    cols[axis : axis + 2] = [cols[axis] + n * cols[axis + 1]]
    axes[axis : axis + 2] = [Axis(n * axes[axis + 1].size)]
    return _rename(g, cols, tuple(axes), "axmerge")


def reshape(g: Grid, sizes: list[int]) -> Grid:
    n = 1
    for s in sizes:
        n *= s
    if n != g.size:
        raise ValueError("a reshaped grid must have as many cells")
    return replace(from_linear(g.df.select(g.linear().alias("at"), "v"), sizes), kind=g.kind)


def tile(g: Grid, ax0: int, ax1: int, axis: int, fast: int, slow: int) -> Grid:
    """Lays the slices along ``axis`` out as fast x slow tiles over ``ax0`` and ``ax1``; the axis goes."""
    if len({ax0, ax1, axis}) < 3:
        raise ValueError("three different axes are needed")
    s = F.col(f"i{axis}")
    n0, n1 = g.axes[ax0].size, g.axes[ax1].size
    cols = _with(_with(_cols(g), ax0, F.col(f"i{ax0}") + n0 * (s % fast)), ax1, F.col(f"i{ax1}") + n1 * F.floor(s / fast))
    axes = _with(_with(g.axes, ax0, Axis(n0 * fast)), ax1, Axis(n1 * slow))
    if fast * slow != g.axes[axis].size:
        raise ValueError("fast x slow must be the size of the axis")
    del cols[axis], axes[axis]
    return _rename(g, cols, tuple(axes), "tile")


def untile(g: Grid, ax0: int, ax1: int, axis: int, fast: int, slow: int) -> Grid:
    """Undoes :func:`tile`; the new axis comes at ``axis``."""
    n0, n1 = g.axes[ax0].size // fast, g.axes[ax1].size // slow
    if n0 * fast != g.axes[ax0].size or n1 * slow != g.axes[ax1].size:
        raise ValueError("tiles must divide the axes")
    a, b = F.col(f"i{ax0}"), F.col(f"i{ax1}")
    cols = _with(_with(_cols(g), ax0, a % n0), ax1, b % n1)
    axes = _with(_with(g.axes, ax0, Axis(n0)), ax1, Axis(n1))
    cols.insert(axis, F.floor(a / n0) + fast * F.floor(b / n1))
    axes.insert(axis, Axis(fast * slow))
    return _rename(g, cols, tuple(axes), "untile")


# -- unions ----------------------------------------------------------------------------------------------------


def join(grids: list[Grid], axis: int, stack: bool = False) -> Grid:
    """Concatenates along ``axis``, or stacks on a new axis inserted there."""
    if stack:
        grids = [insert_axis(g, axis) for g in grids]
    first, at, df = grids[0], 0, None
    for g in grids:
        if any(x.size != y.size for k, (x, y) in enumerate(zip(g.axes, first.axes, strict=True)) if k != axis):
            raise ValueError("other axes must have the same sizes")
        part = g.df.select(*_with([F.col(n).alias(n) for n in g.names], axis, (F.col(f"i{axis}") + at).alias(f"i{axis}")), "v")
        df = part if df is None else df.unionByName(part)
        at += g.axes[axis].size
    return Grid(df, tuple(_with(first.axes, axis, Axis(at))), first.kind, "join")


def splice(g: Grid, axis: int, at: int, new: Grid) -> Grid:
    """Replaces the hyperplane at ``at``."""
    put = insert_axis(new, axis)
    kept = g.df.filter(F.col(f"i{axis}") != at).select(*g.names, "v")
    return replace(g, df=kept.unionByName(put.df.withColumn(f"i{axis}", F.lit(at).cast("long"))), content="splice")


def inset(g: Grid, low: list[int], sub: Grid) -> Grid:
    """Replaces the box of ``sub``'s size that begins at ``low``."""
    if any(a < 0 or a + s.size > x.size for a, s, x in zip(low, sub.axes, g.axes, strict=True)):
        raise ValueError("the box must fit")
    outside = F.lit(False)
    for k, (a, s) in enumerate(zip(low, sub.axes, strict=True)):
        outside = outside | ~F.col(f"i{k}").between(a, a + s.size - 1)
    moved = sub.df.select(*((F.col(f"i{k}") + a).alias(f"i{k}") for k, a in enumerate(low)), "v")
    return replace(g, df=g.df.filter(outside).select(*g.names, "v").unionByName(moved), content="inset")


def border(i: Column, n: int, rule: str) -> Column:
    """The sample that an index outside [0, n) reads, by boundary rule; NULL where it reads the pad value."""
    if rule == "bleed":
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    if rule == "wrap":
        return F.pmod(i, F.lit(n))
    if rule == "mirror":
        m = F.pmod(i, F.lit(2 * n))
        return F.when(m >= n, 2 * n - 1 - m).otherwise(m)
    if rule == "pad":
        return F.when(i.between(0, n - 1), i)
    raise ValueError(f"no boundary rule {rule!r}")


def pad(g: Grid, low: list[int], high: list[int], rule: str = "bleed", value: float = float("nan")) -> Grid:
    """The box from ``low`` (<= 0) to ``high`` (>= size - 1): a spine of new cells that looks its values up."""
    if any(a > 0 or b < x.size - 1 for a, b, x in zip(low, high, g.axes, strict=True)):
        raise ValueError("a pad must hold the whole grid")
    axes = tuple(Axis(b - a + 1) for a, b in zip(low, high, strict=True))
    new = spine(g.df.sparkSession, axes)
    source = [border(F.col(f"i{k}") + a, x.size, rule).alias(f"s{k}") for k, (a, x) in enumerate(zip(low, g.axes, strict=True))]
    old = g.df.select(*(F.col(n).alias(f"s{k}") for k, n in enumerate(g.names)), "v")
    met = new.select(*new.columns, *source).join(old, [f"s{k}" for k in range(g.dim)], "left")
    return Grid(met.select(*(f"i{k}" for k in range(g.dim)), F.coalesce("v", F.lit(value)).alias("v")), axes, g.kind, "pad")
