"""Kernels evaluated over the events, a family a query, and their SQL in other forms where there are any."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.kernels import parse

#: A point of -5.5 to 5.5 for each event; none is on a knot.
POINT = "(event_id % 997) / 997.0D * 11 - 5.5"
_X = f"(SELECT event_id, x, abs(x) AS a, sign(x) AS s FROM (SELECT event_id, CAST({POINT.replace('.0D', '.0::DOUBLE')} AS DOUBLE) AS x FROM events))"
DIGITS = 7


def _query(names: dict[str, str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        points = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.expr(POINT).alias("x"))
        return points.select("event_id", *(F.round(parse(k).at(F.col("x")), DIGITS).alias(c) for c, k in names.items()))

    return run


def _sql(columns: dict[str, str]) -> str:
    return f"SELECT event_id, {', '.join(f'round(CAST({e} AS DOUBLE), {DIGITS}) + 0.0 AS {c}' for c, e in columns.items())} FROM {_X}"


def _spline(n: int, d: int) -> str:
    """The B-spline of degree n, d times derived, as truncated powers; the sum is taken from the left, for -|x|."""
    half = (n + 1) / 2
    terms = " + ".join(f"({(-1) ** k * math.comb(n + 1, k)}) * pow(greatest(-a - ({k - half}), 0.0), {n - d})" if n > d else f"({(-1) ** k * math.comb(n + 1, k)}) * CASE WHEN -a > {k - half} THEN 1 ELSE 0 END" for k in range(n + 2))
    return f"CASE WHEN a < {half} THEN {'-s * ' if d % 2 else ''}({terms}) / {math.factorial(n - d)}.0 ELSE 0.0 END"


def _pieces(*pieces: tuple[float, str], sign: bool = False) -> str:
    return f"{'s * ' if sign else ''}CASE {' '.join(f'WHEN a < {h} THEN {e}' for h, e in pieces)} ELSE 0.0 END"


def _window(radius: float, w: str, dw: str, ddw: str, times: int) -> str:
    sinc, d = "(sin(pi() * x) / (pi() * x))", "((cos(pi() * x) - sin(pi() * x) / (pi() * x)) / x)"
    dd = f"(-pi() * pi() * {sinc} - 2 * {d} / x)"
    return f"CASE WHEN a <= {radius} THEN {(f'{w} * {sinc}', f'{dw} * {sinc} + {w} * {d}', f'{ddw} * {sinc} + 2 * {dw} * {d} + {w} * {dd}')[times]} ELSE 0.0 END"


def _septic(d: int) -> str:
    """By the values of its pieces and of their derivatives at the knots (Taylor's formula)."""
    rows = (
        (0.9379776601998824, 0, -1.654320987654321, 0, 1.073045267489712, 0, -0.44997427983539096, 0.13978909465020575),
        (0.04651675485008818, -0.7377829218106996, 0.9699074074074074, 0.18531378600823045, -0.7839506172839507, 0.2357253086419753, 0.12021604938271604, -0.054552469135802466),
        (-0.01860670194003527, 0.14022633744855967, -0.16296296296296298, -0.09825102880658436, 0.28858024691358025, -0.18858024691358025, 0.04405864197530864, -0.0013631687242798354),
        (0.003101116990005879, -0.014223251028806585, 0.02021604938271605, 0.003729423868312757, -0.0411522633744856, 0.04714506172839506, -0.023199588477366254, 0.004383450911228689),
    )
    taylor = lambda knot, row: " + ".join(f"({c * math.perm(k, d)!r})::DOUBLE * pow(a - {knot}, {k - d})" for k, c in enumerate(row) if k >= d)
    return _pieces(*((knot + 1, taylor(knot, row)) for knot, row in enumerate(rows)), sign=d % 2 == 1)


_HANN = ("(1 + cos(pi() * x / 3)) / 2", "(-pi() / 6 * sin(pi() * x / 3))", "(-pi() * pi() / 18 * cos(pi() * x / 3))")
_BLACK = (
    "(0.42 + 0.5 * cos(pi() * x / 4) + 0.08 * cos(pi() * x / 2))", "(-pi() / 8 * sin(pi() * x / 4) - 0.04 * pi() * sin(pi() * x / 2))",
    "(-pi() * pi() / 32 * cos(pi() * x / 4) - 0.02 * pi() * pi() * cos(pi() * x / 2))",
)
_G = "exp(-x * x / 4.5) / (1.5 * sqrt(2 * pi()))"
_C4 = "pow(cos(pi() * a), {}) * pow(sin(pi() * a), {})"

#: (column: kernel, SQL) by family; the SQL of cubics and quartics is worked out by hand, that of splines is by truncated powers.
FAMILIES: dict[str, dict[str, tuple[str, str | None]]] = {
    "simple": {
        "zero": ("zero", "0.0"), "box": ("box", "CASE WHEN a < 0.5 THEN 1.0 ELSE 0.0 END"), "box_wide": ("box:3", "CASE WHEN a < 1.5 THEN 1 / 3.0 ELSE 0.0 END"),
        "boxsup": ("boxsup:2", "CASE WHEN a < 0.5 THEN 1.0 ELSE 0.0 END"), "cheap": ("cheap:2", "a / 2"), "tent": ("tent", "greatest(1 - a, 0)"),
        "tent_wide": ("tent:2", "greatest(1 - a / 2, 0) / 2"), "hermite": ("hermiteflag", "greatest(1 - a, 0)"),
        "forwdiff": ("forwdiff", "CASE WHEN x >= -1 AND x < 0 THEN 1.0 WHEN x >= 0 AND x < 1 THEN -1.0 ELSE 0.0 END"),
        "centdiff": ("centdiff", "CASE WHEN a <= 1 THEN -x / 2 WHEN a <= 2 THEN x / 2 - s ELSE 0.0 END"),
    },
    "cos4": {
        "cos4sup": ("cos4sup:2", f"CASE WHEN a < 0.5 THEN {_C4.format(4, 0)} ELSE 0.0 END"),
        "cos4supd": ("cos4supd:2", f"CASE WHEN a < 0.5 THEN -4 * pi() * s * {_C4.format(3, 1)} ELSE 0.0 END"),
        "cos4supdd": ("cos4supdd:2", f"CASE WHEN a < 0.5 THEN pi() * pi() * (12 * {_C4.format(2, 2)} - 4 * {_C4.format(4, 0)}) ELSE 0.0 END"),
        "cos4supddd": ("cos4supddd:2", f"CASE WHEN a < 0.5 THEN pow(pi(), 3) * s * (40 * {_C4.format(3, 1)} - 24 * {_C4.format(1, 3)}) ELSE 0.0 END"),
    },
    "cubic": {
        "ctmr": ("ctmr", _pieces((1, "1 - 2.5 * a * a + 1.5 * a * a * a"), (2, "2 - 4 * a + 2.5 * a * a - 0.5 * a * a * a"))),
        "ctmrd": ("ctmrd", _pieces((1, "-5 * a + 4.5 * a * a"), (2, "-4 + 5 * a - 1.5 * a * a"), sign=True)),
        "ctmrdd": ("ctmrdd", _pieces((1, "-5 + 9 * a"), (2, "5 - 3 * a"))),
        "ctmrsup": ("ctmrsup:3", _pieces((1, "1 - 2.5 * a * a + 1.5 * a * a * a"), (2, "2 - 4 * a + 2.5 * a * a - 0.5 * a * a * a"))),
        "ctmrsupd": ("ctmrsupd:3", _pieces((1, "-5 * a + 4.5 * a * a"), (2, "-4 + 5 * a - 1.5 * a * a"), sign=True)),
        "ctmrsupdd": ("ctmrsupdd:3", _pieces((1, "-5 + 9 * a"), (2, "5 - 3 * a"))),
        "cubic": ("cubic:1,0", _spline(3, 0)), "cubicd": ("cubicd:1,0", _spline(3, 1)), "cubicdd": ("cubicdd:1,0", _spline(3, 2)),
    },
    "quartic": {
        "quartic": ("quartic:0.1", _pieces((1, "1 - 2.4 * a ** 2 + 1.5 * a ** 3 - 0.1 * a ** 4"), (2, "3.4 - 7.5 * a + 5.7 * a ** 2 - 1.8 * a ** 3 + 0.2 * a ** 4"), (3, "-0.1 * (a - 2) * (a - 3) ** 3"))),
        "quarticd": ("quarticd:0.1", _pieces((1, "-4.8 * a + 4.5 * a ** 2 - 0.4 * a ** 3"), (2, "-7.5 + 11.4 * a - 5.4 * a ** 2 + 0.8 * a ** 3"), (3, "-0.1 * ((a - 3) ** 3 + 3 * (a - 2) * (a - 3) ** 2)"), sign=True)),
        "quarticdd": ("quarticdd:0.1", _pieces((1, "-4.8 + 9 * a - 1.2 * a ** 2"), (2, "11.4 - 10.8 * a + 2.4 * a ** 2"), (3, "-0.1 * (6 * (a - 3) ** 2 + 6 * (a - 2) * (a - 3))"))),
    },
    "quintic": {
        "c3q": ("c3quintic", _pieces((1, "0.7 - a ** 2 + 0.75 * a ** 4 - 0.3 * a ** 5"), (2, "(2 - a) ** 4 * (0.1 * a + 0.05)"))),
        "c3qd": ("c3quinticd", _pieces((1, "-2 * a + 3 * a ** 3 - 1.5 * a ** 4"), (2, "0.1 * (2 - a) ** 4 - 4 * (2 - a) ** 3 * (0.1 * a + 0.05)"), sign=True)),
        "c3qdd": ("c3quinticdd", _pieces((1, "-2 + 9 * a ** 2 - 6 * a ** 3"), (2, "-0.8 * (2 - a) ** 3 + 12 * (2 - a) ** 2 * (0.1 * a + 0.05)"))),
    },
    "hexic": {
        "c4h": ("c4hexic", _pieces((1, "0.8625 - 1.4375 * a ** 2 + 1.1875 * a ** 4 - 7 * a ** 5 / 12.0 + a ** 6 / 16.0"), (2, "0.01875 + 4.375 * a - 10.65625 * a ** 2 + 10 * a ** 3 - 4.59375 * a ** 4 + 25 * a ** 5 / 24.0 - 3 * a ** 6 / 32.0"), (3, "9.61875 - 23.625 * a + 23.34375 * a ** 2 - 12 * a ** 3 + 3.40625 * a ** 4 - 61 * a ** 5 / 120.0 + a ** 6 / 32.0"))),
        "c4hd": ("c4hexicd", _pieces((1, "-2.875 * a + 4.75 * a ** 3 - 35 * a ** 4 / 12.0 + 3 * a ** 5 / 8.0"), (2, "4.375 - 21.3125 * a + 30 * a ** 2 - 18.375 * a ** 3 + 125 * a ** 4 / 24.0 - 9 * a ** 5 / 16.0"), (3, "-23.625 + 46.6875 * a - 36 * a ** 2 + 13.625 * a ** 3 - 61 * a ** 4 / 24.0 + 3 * a ** 5 / 16.0"), sign=True)),
        "c4hdd": ("c4hexicdd", _pieces((1, "-2.875 + 14.25 * a ** 2 - 35 * a ** 3 / 3.0 + 15 * a ** 4 / 8.0"), (2, "-21.3125 + 60 * a - 55.125 * a ** 2 + 125 * a ** 3 / 6.0 - 45 * a ** 4 / 16.0"), (3, "46.6875 - 72 * a + 40.875 * a ** 2 - 61 * a ** 3 / 6.0 + 15 * a ** 4 / 16.0"))),
        "c4hddd": ("c4hexicddd", _pieces((1, "28.5 * a - 35 * a ** 2 + 7.5 * a ** 3"), (2, "60 - 110.25 * a + 62.5 * a ** 2 - 11.25 * a ** 3"), (3, "-72 + 81.75 * a - 30.5 * a ** 2 + 3.75 * a ** 3"), sign=True)),
    },
    "septic": {f"c5septic{'d' * t}": (f"c5septic{'d' * t}", _septic(t)) for t in range(4)},
    "inverse": {n: (n, None) for n in ("bspl3ai", "bspl5ai", "bspl7ai", "c4hai", "c5septicai")},
    "gauss": {
        "gauss": ("gauss:1.5,3", f"CASE WHEN a < 4.5 THEN {_G} ELSE 0.0 END"),
        "gaussd": ("gaussd:1.5,3", f"CASE WHEN a < 4.5 THEN -x / 2.25 * {_G} ELSE 0.0 END"),
        "gaussdd": ("gaussdd:1.5,3", f"CASE WHEN a < 4.5 THEN (x * x / 2.25 - 1) / 2.25 * {_G} ELSE 0.0 END"),
    },
    # exp(-1) I_n(1) by the series of I_n
    "discrete_gauss": {"dgauss": ("dgauss:1,4", f"CASE WHEN a <= 4.5 THEN exp(-1) * ({' + '.join(f'pow(0.5, {2 * m} + floor(a + 0.5)) / ({math.factorial(m)} * gamma({m + 1} + floor(a + 0.5)))' for m in range(12))}) ELSE 0.0 END")},
    "hann": {f"hann{'d' * t}": (f"hann{'d' * t}:3", _window(3, *_HANN, t)) for t in range(3)},
    "blackman": {f"blackman{'d' * t}": (f"blackman{'d' * t}:4", _window(4, *_BLACK, t)) for t in range(3)},
} | {f"bspline{n}": {f"bspl{n}{'d' * t}": (f"bspl{n}{'d' * t}", _spline(n, t)) for t in range(min(n, 3) + 1)} for n in range(1, 8)}

QUERIES = {f"kernel_{family}": _query({c: k for c, (k, _) in columns.items()}) for family, columns in FAMILIES.items()}
ORACLES = {f"kernel_{family}": _sql({c: e for c, (_, e) in columns.items()}) for family, columns in FAMILIES.items() if all(e for _, e in columns.values())}
