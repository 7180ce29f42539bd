"""The rule that only finite numbers exist, as Column helpers.

Spark's own NaN order, NULL-giving logarithms and ANSI errors differ from IEEE arithmetic; every operator
goes through these helpers, so plans stay inside generated code and never meet an ANSI exception.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: From here on every double is whole.
WHOLE = 2.0**52


def nan() -> Column:
    return F.lit(NAN)


def exists(v: Column) -> Column:
    """True for finite values; false for NaN, infinities and NULL."""
    return F.coalesce(~F.isnan(v) & (F.abs(v) < INF), F.lit(False))


def finite(v: Column) -> Column:
    """The value where it exists, else NULL: what aggregates skip."""
    return F.when(exists(v), v)


def or_nan(v: Column) -> Column:
    """NULL (no value existed) back to NaN."""
    return F.coalesce(v, nan())


def divide(a: Column, b: Column) -> Column:
    """IEEE division; a zero divisor counts as +0."""
    return F.when(b == 0, F.when(F.isnan(a) | (a == 0), nan()).otherwise(F.signum(a) * INF)).otherwise(F.try_divide(a, b))


def log_guard(v: Column, log: Column, pole: float = 0.0) -> Column:
    """``log`` with -inf at ``pole`` and NaN below it."""
    return F.when(v == pole, F.lit(-INF)).when(F.isnan(v) | (v < pole), nan()).otherwise(log)


def lt(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def lte(a: Column, b: Column) -> Column:
    return (a <= b) & ~F.isnan(a) & ~F.isnan(b)


def eq(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a)


def flag(c: Column) -> Column:
    """0 or 1 in the value type."""
    return F.when(c, 1.0).otherwise(0.0)


def truthy(v: Column) -> Column:
    return (v != 0) | F.isnan(v)


def whole(v: Column, how) -> Column:
    """floor or ceil that leaves NaN and infinities alone, keeps the sign of 0, and goes beyond what a long holds."""
    made = how(v).cast("double")
    return F.when(F.abs(v) < WHOLE, F.when(made == 0, v * 0.0).otherwise(made)).otherwise(v)


def round_binary(v: Column, digits: int) -> Column:
    """Rounding of SQL engines that scale, round at halves away from 0, and scale back: ties as the scaled double has them."""
    scaled = v * 10.0**digits
    made = F.when(F.abs(scaled) < WHOLE, F.round(scaled, 0)).otherwise(scaled) / 10.0**digits
    return F.when(exists(scaled), F.when(made == 0, v * 0.0).otherwise(made)).otherwise(v)


def pick_min(a: Column, b: Column) -> Column:
    """a < b ? a : b, so a NaN on either side gives b."""
    return F.when(lt(a, b), a).otherwise(b)


def pick_max(a: Column, b: Column) -> Column:
    return F.when(lt(b, a), a).otherwise(b)


def bin_index(v: Column, low: Column, high: Column, n: int) -> Column:
    """Bin of a value in [low, high]: the top value falls into the last bin; an empty range gives 0."""
    width = high - low
    at = F.floor(F.try_divide(n * (v - low), width))
    return F.when(width == 0, F.lit(0).cast("long")).otherwise(F.when(at == n, n - 1).otherwise(at)).cast("long")


def bin_clamp(v: Column, low: Column, high: Column, n: int) -> Column:
    return F.least(F.greatest(bin_index(F.least(F.greatest(v, low), high), low, high, n), F.lit(0)), F.lit(n - 1)).cast("long")


#: name -> (lowest, highest) of the integer types, stored widened where Spark has no unsigned type
INTEGER_TYPES = {
    "char": (-128, 127),
    "uchar": (0, 255),
    "short": (-32768, 32767),
    "ushort": (0, 65535),
    "int": (-2147483648, 2147483647),
    "uint": (0, 4294967295),
}


def wrap_cast(v: Column, kind: str) -> Column:
    """C conversion to an integer type: truncate, then wrap."""
    low, high = INTEGER_TYPES[kind]
    span = high - low + 1
    whole_part = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    return (F.pmod(whole_part - low, F.lit(span)) + low).cast("double")


def clamp_cast(v: Column, kind: str) -> Column:
    """Clamp to the type's range, then truncate."""
    low, high = INTEGER_TYPES[kind]
    c = F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")
