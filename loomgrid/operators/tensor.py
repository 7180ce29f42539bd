"""Measures of symmetric 3 x 3 tensors, kept as seven numbers (confidence, xx, xy, xz, yy, yz, zz): Column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(t: Column) -> list[Column]:
    """xx, xy, xz, yy, yz, zz."""
    return [F.get(t, F.lit(k)) for k in range(1, 7)]


def trace(t: Column) -> Column:
    a, _, _, d, _, f = parts(t)
    return a + d + f


def squared_norm(t: Column) -> Column:
    a, b, c, d, e, f = parts(t)
    return a * a + d * d + f * f + 2 * (b * b + c * c + e * e)


def frobenius(t: Column) -> Column:
    return F.sqrt(squared_norm(t))


def determinant(t: Column) -> Column:
    a, b, c, d, e, f = parts(t)
    return a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)


def second_invariant(t: Column) -> Column:
    """Sum of the principal 2 x 2 minors."""
    a, b, c, d, e, f = parts(t)
    return a * d + a * f + d * f - b * b - c * c - e * e


def deviation(t: Column) -> Column:
    """Squared norm of the tensor without its isotropic part."""
    return F.greatest(F.lit(0.0), squared_norm(t) - trace(t) * trace(t) / 3)


def fractional_anisotropy(t: Column) -> Column:
    n = squared_norm(t)
    return F.when(n == 0, 0.0).otherwise(F.sqrt(1.5 * F.try_divide(deviation(t), n)))


def mode(t: Column) -> Column:
    """3 sqrt(6) det of the deviation over its norm, from -1 (planar) to 1 (linear)."""
    d, m = deviation(t), trace(t) / 3
    det = determinant(t) - m * second_invariant(t) + m * m * trace(t) - m * m * m
    return F.when(d < 1e-300, 0.0).otherwise(F.least(F.greatest(3 * math.sqrt(6) * F.try_divide(det, F.pow(d, F.lit(1.5))), F.lit(-1.0)), F.lit(1.0)))


def eigenvalues(t: Column) -> Column:
    """Largest first, by the angle of the deviation's mode."""
    m, r = trace(t) / 3, F.sqrt(deviation(t) / 6)
    angle = F.acos(mode(t)) / 3
    return F.array(*(m + 2 * r * F.cos(angle - 2 * math.pi * k / 3) for k in (0, 1, 2)))


MEASURES = {
    "trace": trace,
    "norm": frobenius,
    "det": determinant,
    "fa": fractional_anisotropy,
    "mode": mode,
    "first-eigenvalue": lambda t: F.get(F.reverse(F.sort_array(eigenvalues(t))), F.lit(0)),
}


def masked(t: Column, measure: str, threshold: float = 0.5) -> Column:
    """A measure where the confidence reaches the threshold, else 0."""
    return F.when(F.get(t, F.lit(0)) >= threshold, MEASURES[measure](t)).otherwise(0.0)
