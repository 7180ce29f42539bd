"""Unary, binary and ternary operators on values, and scalar maps; all of them projections or coordinate joins."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomgrid.core.exists import (
    NAN, bin_index, clamp_cast, divide, eq, exists, flag, log_guard, lt, lte, pick_max, pick_min, truthy, whole, wrap_cast,
)
from loomgrid.core.grid import Grid

#: Fixed value: the truncated constant that the log2 operator divides by.
LOG2 = 0.69314718


@F.pandas_udf(DoubleType())
def _erf(v: pd.Series) -> pd.Series:
    return v.map(math.erf)


def erf(v: Column) -> Column:
    """NaN stays NaN, which the function itself would return as NULL."""
    return F.when(F.isnan(v), NAN).otherwise(_erf(v))


def _sgn(v: Column) -> Column:
    return F.when(lt(v, F.lit(0.0)), -1.0).when(lt(F.lit(0.0), v), 1.0).otherwise(0.0)


UNARY: dict[str, Callable[[Column], Column]] = {
    "-": lambda v: -v,
    "r": lambda v: divide(F.lit(1.0), v),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "exp": F.exp,
    "log": lambda v: log_guard(v, F.log(v)),
    "log2": lambda v: log_guard(v, F.log(v) / LOG2),
    "log10": lambda v: log_guard(v, F.log10(v)),
    "log1p": lambda v: log_guard(v, F.log1p(v), -1.0),
    "expm1": F.expm1,
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
    "erf": erf,
    "nerf": lambda v: (1 + erf(v)) / 2,
    "ceil": lambda v: whole(v, F.ceil),
    "floor": lambda v: whole(v, F.floor),
    "roundup": lambda v: whole(v + 0.5, F.floor),
    "rounddown": lambda v: whole(v - 0.5, F.ceil),
    "abs": F.abs,
    "sgn": _sgn,
    "exists": lambda v: flag(exists(v)),
    "rand": lambda v: F.rand(42),
    "normrand": lambda v: F.randn(42),
    "if": lambda v: flag(truthy(v)),
    "zero": lambda v: F.lit(0.0),
    "one": lambda v: F.lit(1.0),
}


def _wrap_int(v: Column) -> Column:
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")


def _fpow(a: Column, b: Column) -> Column:
    return F.when(b == 1, a).otherwise(_sgn(a) * (1 - F.pow(1 - F.least(F.lit(1.0), F.abs(a)), b)))


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "x": lambda a, b: a * b,
    "/": divide,
    "^": F.pow,
    "spow": lambda a, b: _sgn(a) * F.pow(F.abs(a), b),
    "fpow": _fpow,
    "%": lambda a, b: F.pmod(_wrap_int(a), _wrap_int(b)).cast("double"),
    "fmod": lambda a, b: F.when(b == 0, F.lit(NAN)).otherwise(F.try_mod(a, b)),
    "atan2": F.atan2,
    "min": pick_min,
    "max": pick_max,
    "lt": lambda a, b: flag(lt(a, b)),
    "lte": lambda a, b: flag(lte(a, b)),
    "gt": lambda a, b: flag(lt(b, a)),
    "gte": lambda a, b: flag(lte(b, a)),
    "comp": lambda a, b: F.when(lt(a, b), -1.0).when(lt(b, a), 1.0).otherwise(0.0),
    "eq": lambda a, b: flag(eq(a, b)),
    "neq": lambda a, b: flag(~eq(a, b)),
    "exists": lambda a, b: F.when(exists(a), a).otherwise(b),
    "if": lambda a, b: F.when(truthy(a), a).otherwise(b),
    "nrand": lambda a, b: a + b * F.randn(42),
    "rrand": lambda a, b: F.hypot(a + b * F.randn(42), b * F.randn(43)),
}


@F.pandas_udf(DoubleType())
def rician(m: pd.Series, t: pd.Series, s: pd.Series) -> pd.Series:
    """Density of a Rician at m, of true value t and noise s."""
    m, t, s = (x.to_numpy(float) for x in (m, t, s))
    with np.errstate(all="ignore"):
        z, scale = m * t / (s * s), m / (s * s)
        near = scale * np.exp(-(m * m + t * t) / (2 * s * s)) * np.i0(np.minimum(z, 600))
        # the Bessel function by its asymptote, with the exponents taken together
        far = scale * np.exp(-((m - t) ** 2) / (2 * s * s)) / np.sqrt(2 * np.pi * np.where(z > 0, z, 1))
    return pd.Series(np.where(z > 600, far, near))


def _lerp(w: Column, a: Column, b: Column) -> Column:
    return F.when(w == 0, a).when(w == 1, b).otherwise(w * (b - a) + a)


def _eased(x: Column, start: Column, width: Column) -> Column:
    """From ``start`` on at slope 1, towards ``start + width`` and never past it."""
    return start + width * erf(divide((x - start) * F.lit(math.sqrt(math.pi) / 2), width))  # erf runs on every row, those without a width too


TERNARY: dict[str, Callable[[Column, Column, Column], Column]] = {
    "add": lambda a, b, c: a + b + c,
    "multiply": lambda a, b, c: a * b * c,
    "min": lambda a, b, c: pick_min(a, pick_min(b, c)),
    "max": lambda a, b, c: pick_max(a, pick_max(b, c)),
    "min_sm": lambda x, w, m: F.when(lt(m - w, m), F.when(lt(x, m - w), x).otherwise(_eased(x, m - w, w))).otherwise(pick_min(x, m)),
    "max_sm": lambda m, w, x: F.when(lt(m, m + w), F.when(lt(m + w, x), x).otherwise(_eased(x, m + w, -w))).otherwise(pick_max(x, m)),
    "lt_sm": lambda a, w, b: (1 + erf(divide(b - a, w))) / 2,
    "gt_sm": lambda a, w, b: (1 + erf(divide(a - b, w))) / 2,
    "clamp": lambda lo, v, hi: F.when(lt(v, lo), lo).when(lt(hi, v), hi).otherwise(v),
    "ifelse": lambda a, b, c: F.when(truthy(a), b).otherwise(c),
    "lerp": _lerp,
    "exists": lambda a, b, c: F.when(exists(a), b).otherwise(c),
    "in_op": lambda lo, v, hi: flag(lt(lo, v) & lt(v, hi)),
    "in_cl": lambda lo, v, hi: flag(lte(lo, v) & lte(v, hi)),
    "gauss": lambda x, m, s: F.exp(-F.pow(divide(x - m, s), F.lit(2.0)) / 2) / (s * math.sqrt(2 * math.pi)),
    "rician": rician,
}


def unary(g: Grid, op: str) -> Grid:
    return g.with_value(UNARY[op](F.col("v")))


def _joined(grids: list[Grid | float]) -> tuple[Grid, list[Column]]:
    """Grids meet by their coordinates, constants need no join."""
    real = [g for g in grids if isinstance(g, Grid)]
    if not real:
        raise ValueError("at least one operand must be a grid")
    if any([a.size for a in g.axes] != [a.size for a in real[0].axes] for g in real):
        raise ValueError("grids differ in size")
    df, cols = real[0].df.select(*real[0].names, F.col("v").alias("v0")), []
    for k, g in enumerate(real[1:], 1):
        df = df.join(g.df.select(*g.names, F.col("v").alias(f"v{k}")), g.names)
    n = 0
    for g in grids:
        if isinstance(g, Grid):
            cols.append(F.col(f"v{n}"))
            n += 1
        else:
            cols.append(F.lit(float(g)))
    return Grid(df, real[0].axes, real[0].kind), cols


def binary(op: str, a: Grid | float, b: Grid | float) -> Grid:
    g, cols = _joined([a, b])
    return g.with_value(BINARY[op](*cols))


def ternary(op: str, a: Grid | float, b: Grid | float, c: Grid | float) -> Grid:
    g, cols = _joined([a, b, c])
    return g.with_value(TERNARY[op](*cols))


def affine(g: Grid, low: float, high: float, out_low: float, out_high: float, clamp: bool = False) -> Grid:
    """Linear map of [low, high] to [out_low, out_high], optionally clamped."""
    v = F.lit(out_low) if low == high else (F.col("v") - low) * ((out_high - out_low) / (high - low)) + out_low
    if clamp:
        lo, hi = min(out_low, out_high), max(out_low, out_high)
        v = F.when(lt(v, F.lit(lo)), lo).when(lt(F.lit(hi), v), hi).otherwise(v)
    return g.with_value(v)


def affine_of(low: Grid | float, of: Grid | float, high: Grid | float, out_low: Grid | float, out_high: Grid | float, clamp: bool = False) -> Grid:
    """:func:`affine` whose bounds may be grids as well; grids meet by their coordinates."""
    g, (a, v, b, c, d) = _joined([low, of, high, out_low, out_high])
    out = F.when(a == b, c).otherwise((v - a) * (d - c) / F.nullif(b - a, F.lit(0.0)) + c)
    return g.with_value(F.least(F.greatest(out, F.least(c, d)), F.greatest(c, d)) if clamp else out)


def cast_clamp_round(g: Grid, kind: str, clamp: bool = True, round_dir: int = 0) -> Grid:
    """To another type: rounded up at halves (1), down at halves (-1) or not (0), clamped to the type's range or not, then cast."""
    v = F.col("v")
    if kind not in ("float", "double"):
        v = F.floor(v + 0.5) if round_dir > 0 else F.ceil(v - 0.5) if round_dir < 0 else v
    made = g.with_value(v)
    return clamp_convert(made, kind) if clamp and kind not in ("float", "double") else convert(made, kind)


def value_range(g: Grid) -> tuple[float, float]:
    """Least and greatest existing value: one small aggregate on the driver."""
    from loomgrid.core.exists import finite

    r = g.df.agg(F.min(finite(F.col("v"))), F.max(finite(F.col("v")))).first()
    return (NAN, NAN) if r[0] is None else (r[0], r[1])


def gamma(g: Grid, exponent: float, bounds: tuple[float, float] | None = None) -> Grid:
    low, high = bounds or value_range(g)
    high = high + 1 if low == high else high
    unit = (F.col("v") - low) / (high - low)
    unit = 1 - F.pow(unit, F.lit(-1 / exponent)) if exponent < 0 else F.pow(unit, F.lit(1 / exponent))
    return g.with_value(unit * (high - low) + low)


def convert(g: Grid, kind: str) -> Grid:
    return g.with_value(F.col("v").cast(kind) if kind in ("float", "double") else wrap_cast(F.col("v"), kind), kind)


def clamp_convert(g: Grid, kind: str) -> Grid:
    return g.with_value(clamp_cast(F.col("v"), kind), kind)


def quantize(g: Grid, bits: int, bounds: tuple[float, float] | None = None) -> Grid:
    """Unsigned integers of 8, 16 or 32 bits over the range."""
    if bits not in (8, 16, 32):
        raise ValueError("bits must be 8, 16 or 32")
    low, high = bounds or value_range(g)
    high = low + 1 if low == high else high
    c = F.least(F.greatest(F.col("v"), F.lit(low)), F.lit(high))
    out = g.with_value(bin_index(c, F.lit(low), F.lit(high), 2**bits), {8: "uchar", 16: "ushort", 32: "uint"}[bits])
    return Grid(out.df, out.axes, out.kind, out.content, out.notes | {"old min": repr(low), "old max": repr(high)})


def unquantize(g: Grid) -> Grid:
    """Centers of the cells that quantize made."""
    bits = {"uchar": 8, "ushort": 16, "uint": 32}[g.kind]
    low, high = float(g.notes["old min"]), float(g.notes["old max"])
    return g.with_value(low + (high - low) * (F.col("v") + 0.5) / 2**bits, "double")
