"""Edits of tensors through their eigenvalues, and the measures that eigenvalues give.

Tensors are arrays of seven numbers (confidence, xx, xy, xz, yy, yz, zz) in a column; measures are Column expressions over
eigenvalues in falling order, edits are numpy over whole batches.  Confidence is kept by every edit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.probing import PAIRS, _eigen
from loomgrid.operators.tensor_probing import PLACES

#: What stands for the logarithm of an eigenvalue that has none (a fixed value).
NO_LOG = -1_000_000.0

Edit = Callable[[np.ndarray], np.ndarray]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def measures(e: Column) -> dict[str, Column]:
    """Every measure of three eigenvalues, largest first."""
    a, b, c = (F.get(e, F.lit(k)) for k in range(3))
    total, low = F.greatest(a + b + c, F.lit(0.0)), F.greatest(a, F.lit(0.0))
    mean = (a + b + c) / 3
    x, y, z = a - mean, b - mean, c - mean
    spread, square, minors = x * x + y * y + z * z, a * a + b * b + c * c, a * b + a * c + b * c
    q = F.greatest(((a + b + c) * (a + b + c) - 3 * minors) / 9, F.lit(0.0))
    t = a + b + c
    r = (2 * t * t * t - 9 * t * minors + 27 * a * b * c) / 54
    apart = F.pow(spread / 6, F.lit(1.5))  # Q of the deviation to 3/2
    skew = F.least(F.greatest(_ratio(x * y * z / 2, apart * math.sqrt(2)), F.lit(-math.sqrt(0.5))), F.lit(math.sqrt(0.5)))
    mode = F.least(F.greatest(_ratio(x * y * z / 2, apart), F.lit(-1.0)), F.lit(1.0))
    fa = F.when(square != 0, F.sqrt(1.5 * spread / square)).otherwise(0.0)
    cl1, cp1, cl2, cp2 = _ratio(a - b, total), _ratio(2 * (b - c), total), _ratio(a - b, low), _ratio(b - c, low)
    return {
        "cl1": cl1, "cp1": cp1, "ca1": cl1 + cp1, "clpmin1": F.least(cl1, cp1), "cs1": _ratio(3 * c, total), "ct1": _ratio(2 * (b - c), a + b - 2 * c),
        "cl2": cl2, "cp2": cp2, "ca2": _ratio(a - c, low), "clpmin2": F.least(cl2, cp2), "cs2": _ratio(c, low), "ct2": _ratio(b - c, a - c),
        "ra": _ratio(F.sqrt(spread), mean * math.sqrt(6)), "fa": fa, "vf": 1 - _ratio(a * b * c, mean * mean * mean), "b": minors, "q": q, "r": r, "s": square,
        "skew": skew, "mode": mode, "th": F.acos(F.least(F.greatest(skew * math.sqrt(2), F.lit(-1.0)), F.lit(1.0))) / 3, "omega": fa * (1 + mode) / 2,
        "det": a * b * c, "tr": t, "eval0": a, "eval1": b, "eval2": c,
    }


MEASURES = (
    "cl1", "cp1", "ca1", "clpmin1", "cs1", "ct1", "cl2", "cp2", "ca2", "clpmin2", "cs2", "ct2", "ra", "fa", "vf", "b", "q", "r", "s", "skew", "mode", "th", "omega", "det", "tr", "eval0", "eval1", "eval2", "conf",
)


def anisotropies(df: DataFrame, names: dict[str, str], column: str = "t", threshold: float = 0.5) -> DataFrame:
    """``df`` with measures (new column: measure), 0 where the confidence is under the threshold; eigenvalues are solved for once."""
    solved = eigen(df, column, "__values", "__vectors")
    known = measures(F.col("__values")) | {"conf": F.get(column, F.lit(0))}
    return solved.select(*df.columns, *(F.when(F.get(column, F.lit(0)) >= threshold, known[m]).otherwise(0.0).alias(c) for c, m in names.items()))


def matrices(t: np.ndarray) -> np.ndarray:
    return t[..., 1:][..., PLACES]


def packed(conf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.stack([conf, *(m[..., i, j] for i, j in PAIRS)], -1)


def spectral(t: np.ndarray, edit: Edit) -> np.ndarray:
    """Tensors with the same eigenvectors and other eigenvalues."""
    values, vectors = _eigen(matrices(t))
    return packed(t[..., 0], np.einsum("nk,nki,nkj->nij", edit(values), vectors, vectors))


def power(p: float) -> Edit:
    return lambda e: np.power(e, p)


def clamp(low: float = math.nan, high: float = math.nan) -> Edit:
    return lambda e: np.fmin(np.fmax(e, low), high)


def logarithm(e: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        out = np.log(e)
    return np.where(np.isfinite(out), out, NO_LOG)


def exponential(e: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        out = np.exp(e)
    return np.where(np.isfinite(out), out, 0.0)


def size_normalize(weights: tuple[float, float, float], amount: float = 1.0, target: float = 1.0) -> Edit:
    """Towards the eigenvalues scaled so that their weighted mean is ``target``."""
    w = np.array(weights) / sum(weights)

    def edit(e: np.ndarray) -> np.ndarray:
        size = np.abs(e * w).sum(-1, keepdims=True)
        return e + amount * (np.divide(target * e, size, out=np.zeros_like(e), where=size != 0) - e)

    return edit


def aniso_scale(scale: float, keep_determinant: bool = False, positive: bool = False) -> Edit:
    """Eigenvalues (or their logarithms) moved from or to their mean."""
    def edit(e: np.ndarray) -> np.ndarray:
        x = np.log(np.maximum(e, 1e-5)) if keep_determinant else e
        x = x.mean(-1, keepdims=True) * (1 - scale) + scale * x
        x = np.exp(x) if keep_determinant else x
        return np.where(x[..., 2:] < 0, np.maximum(x, 0.0), x) if positive else x

    return edit


EDITS: dict[str, Edit] = {"log": logarithm, "exp": exponential, "sqrt": lambda e: np.sqrt(np.maximum(e, 0)), "inverse": lambda e: np.divide(1, e, out=np.zeros_like(e), where=e != 0)}


def _batches(column: str, kind: str, work: Callable[[np.ndarray], np.ndarray], df: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out`` made from the tensors in ``column``; null tensors stay null."""
    at = df.columns.index(column)
    keep = [c for c in df.columns if c != out]
    places = [df.columns.index(c) for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.array([x if x is not None else [0.0] * 7 for x in batch.column(at).to_pylist()], float).reshape(-1, 7)
            made = work(t)
            some = batch.column(at).is_valid().to_pylist()
            column_out = pa.array([x.tolist() if ok else None for x, ok in zip(made, some, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in places), column_out], names=[*keep, out])

    return df.mapInArrow(run, f"{schema}, `{out}` {kind}")


def edit(df: DataFrame, how: Edit, column: str = "t") -> DataFrame:
    """``column`` replaced by the edited tensors."""
    return _batches(column, "array<double>", lambda t: spectral(t, how), df, column)


def eigen(df: DataFrame, column: str = "t", values: str = "eval", vectors: str = "evec") -> DataFrame:
    """Eigenvalues (falling) and eigenvectors (a row each, nine numbers)."""
    both = _batches(column, "array<double>", lambda t: np.concatenate([x.reshape(len(t), -1) for x in _eigen(matrices(t))], 1), df, "__both")
    return both.select(*df.columns, F.slice("__both", 1, 3).alias(values), F.slice("__both", 4, 9).alias(vectors))


def make(conf: Column, values: Column, vectors: Column) -> Column:
    """A tensor from its confidence, eigenvalues and eigenvectors."""
    term = lambda i, j: sum(F.get(values, F.lit(k)) * F.get(vectors, F.lit(3 * k + i)) * F.get(vectors, F.lit(3 * k + j)) for k in range(3))
    return F.array(conf, *(term(i, j) for i, j in PAIRS))


def expand(t: Column, scale: float = 1.0, threshold: float = 0.5) -> Column:
    """The nine numbers of the matrix, 0 where the confidence is under the threshold."""
    on = F.get(t, F.lit(0)) >= threshold
    return F.array(*(F.when(on, F.get(t, F.lit(int(PLACES[i, j]) + 1)) * scale).otherwise(0.0) for i in range(3) for j in range(3)))


def shrink(m: Column) -> Column:
    """Seven numbers, with confidence 1, of the symmetric part of nine."""
    return F.array(F.lit(1.0), *((F.get(m, F.lit(3 * i + j)) + F.get(m, F.lit(3 * j + i))) / 2 for i, j in PAIRS))


def contraction(a: Column, b: Column) -> Column:
    """Double contraction of two tensors."""
    return sum((1 if i == j else 2) * F.get(a, F.lit(int(PLACES[i, j]) + 1)) * F.get(b, F.lit(int(PLACES[i, j]) + 1)) for i, j in PAIRS)


def vector_colors(vector: Column, measure: Column, gamma: float = 1.0) -> Column:
    """Red, green and blue by the directions' absolute components, paler where the measure is small."""
    return F.transform(vector, lambda x: F.abs(x) * F.pow(measure, F.lit(1 / gamma)))


def average(df: DataFrame, by: list[str], column: str = "t", log: bool = False) -> DataFrame:
    """The mean tensor of each group, weighted by confidence; of logarithms, if asked for, which keeps sizes like a geometric mean."""
    work = edit(df, logarithm, column) if log else df
    conf = F.get(column, F.lit(0))
    mean = F.array(F.avg(conf), *(F.sum(conf * F.get(column, F.lit(k))) / F.sum(conf) for k in range(1, 7)))
    out = work.groupBy(*by).agg(mean.alias(column))
    return edit(out, exponential, column) if log else out
