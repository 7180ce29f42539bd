"""Items of probed volumes at a point for each event, and their SQL.

The volumes sample polynomials of second degree, which the kernels used reproduce exactly, so the SQL works out each item
from the polynomial itself: curvatures by the formulas of implicit surfaces, not by the operator's tensors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.core.grid import Axis, Grid, spine
from loomgrid.operators import probing

SIZE = 10
KERNELS = ("ctmr", "ctmrd", "ctmrdd")
#: Constant, x, y, z, xx, xy, xz, yy, yz, zz of the scalar volume and of the components of the vector volume.
SCALAR = (1.0, 0.5, -0.3, 0.2, 0.1, 0.04, 0.02, -0.05, -0.03, 0.07)
VECTOR = ((1.0, 0.3, -0.2, 0.1, 0.02, 0.05, 0.0, -0.03, 0.01, 0.0), (-0.5, 0.1, 0.2, -0.4, 0.0, 0.02, 0.03, 0.04, 0.0, 0.01), (0.2, -0.3, 0.15, 0.25, 0.01, 0.0, 0.02, 0.0, -0.05, 0.03))
DIGITS = 6
AT = ("event_id % 7 * 5 / 7.0 + 2.103719317", "event_id % 11 * 5 / 11.0 + 2.207106781", "event_id % 13 * 5 / 13.0 + 2.309401077")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _value(c: tuple[float, ...], x: str, y: str, z: str) -> str:
    return f"({c[0]} + {c[1]} * {x} + {c[2]} * {y} + {c[3]} * {z} + {c[4]} * {x} * {x} + {c[5]} * {x} * {y} + {c[6]} * {x} * {z} + {c[7]} * {y} * {y} + {c[8]} * {y} * {z} + {c[9]} * {z} * {z})"


def _slopes(c: tuple[float, ...]) -> tuple[str, str, str]:
    return (
        f"({c[1]} + {2 * c[4]} * x + {c[5]} * y + {c[6]} * z)", f"({c[2]} + {c[5]} * x + {2 * c[7]} * y + {c[8]} * z)", f"({c[3]} + {c[6]} * x + {c[8]} * y + {2 * c[9]} * z)"
    )


def _bends(c: tuple[float, ...]) -> np.ndarray:
    return np.array([[2 * c[4], c[5], c[6]], [c[5], 2 * c[7], c[8]], [c[6], c[8], 2 * c[9]]])


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("p"), *(F.expr(e.replace(".0 +", ".0D +")).cast("double").alias(f"x{k}") for k, e in enumerate(AT)))


def _volume(spark: SparkSession) -> Grid:
    axes = (Axis(SIZE),) * 3
    return Grid(spine(spark, axes).withColumn("v", F.expr(_value(SCALAR, "i0", "i1", "i2")).cast("double")), axes)


def _field(spark: SparkSession) -> Grid:
    axes = (Axis(3), *(Axis(SIZE),) * 3)
    case = " ".join(f"WHEN {k} THEN {_value(c, 'i1', 'i2', 'i3')}" for k, c in enumerate(VECTOR))
    return Grid(spine(spark, axes).withColumn("v", F.expr(f"CASE i0 {case} END").cast("double")), axes)


def _rounded(df: DataFrame) -> DataFrame:
    def one(c: str) -> F.Column:
        return F.round(c, DIGITS).alias(c) if dict(df.dtypes)[c] == "double" else F.transform(c, lambda x: F.round(x, DIGITS) + 0.0).alias(c)

    return df.select("p", *(one(c) for c in df.columns if c != "p"))


def _number(e: object) -> str:
    return f"round(CAST({e} AS DOUBLE), {DIGITS}) + 0.0"


def _sql(steps: str, items: dict[str, object]) -> str:
    cols = ", ".join(f"[{', '.join(map(_number, e))}] AS {k}" if isinstance(e, (list, tuple)) else f"{_number(e)} AS {k}" for k, e in items.items())
    return f"WITH q AS (SELECT event_id AS p, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for e, n in zip(AT, 'xyz', strict=True))} FROM events), {steps} SELECT p, {cols} FROM s"


def _scalar(name: str, items: dict[str, object]) -> None:
    QUERIES[f"probe_{name}"] = lambda s, sf: _rounded(probing.probe_scalar(_volume(s), _points(s, sf), list(items), KERNELS))
    if all(e is not None for e in items.values()):
        ORACLES[f"probe_{name}"] = _sql(_STEPS, items)


_H = _bends(SCALAR)
_ADJ = np.linalg.det(_H) * np.linalg.inv(_H)
_G = ("gx", "gy", "gz")


def _form(m: np.ndarray, v: tuple[str, ...] = _G) -> str:
    return "(" + " + ".join(f"({m[i, j]!r}) * {v[i]} * {v[j]}" for i in range(3) for j in range(3)).replace("np.float64(", "(") + ")"


def _times(m: np.ndarray, i: int) -> str:
    return "(" + " + ".join(f"({float(m[i, j])}) * {_G[j]}" for j in range(3)) + ")"


_STEPS = (
    f"g AS (SELECT *, {', '.join(f'{e} AS {n}' for e, n in zip(_slopes(SCALAR), _G, strict=True))} FROM q), "
    f"m AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS gm, {_form(_H)} AS ghg, {_form(_ADJ)} AS gag, {', '.join(f'{_times(_H, i)} AS h{i}' for i in range(3))} FROM g), "
    f"k AS (SELECT *, (ghg / (gm * gm) - ({float(np.trace(_H))})) / (2 * gm) AS mean, gag / gm ** 4 AS gauss FROM m), "
    "s AS (SELECT *, mean + sqrt(greatest(mean * mean - gauss, 0)) AS ka, mean - sqrt(greatest(mean * mean - gauss, 0)) AS kb FROM k)"
)
_E, _V = probing._eigen(_H)
_OUT = [f"{a} * {b} / (gm * gm)" for a in _G for b in _G]
_DEV = _E - _E.mean()

_scalar("gradients", {
    "value": _value(SCALAR, "x", "y", "z"), "gradient": list(_G), "gradmag": "gm", "normal": [f"{a} / gm" for a in _G],
    "nproj": _OUT, "nperp": [f"{int(k % 4 == 0)} - {e}" for k, e in enumerate(_OUT)],
})
_scalar("hessians", {
    "hessian": _H.ravel().tolist(), "hessianten": [1.0, *(float(_H[i, j]) for i, j in probing.PAIRS)], "laplacian": float(np.trace(_H)), "hessfrob": float(np.sqrt((_H * _H).sum())),
    "hesseval": _E.tolist(), "hesseval0": float(_E[0]), "hesseval1": float(_E[1]), "hesseval2": float(_E[2]), "hessevec": _V.ravel().tolist(),
    "hessevec0": _V[0].tolist(), "hessevec1": _V[1].tolist(), "hessevec2": _V[2].tolist(), "seconddd": "ghg / (gm * gm)",
    "hessmode": float(3 * np.sqrt(6) * _DEV.prod() / (_DEV**2).sum() ** 1.5), "hessdotpeakness": float((1 - _E.sum() / np.sqrt(3 * (_E**2).sum())) / 2),
    "hessridgeness": 0.0, "hessvalleyness": float((1 - np.exp(-2 * (_E[1] / _E[0]) ** 2)) * np.exp(-2 * _E[2] ** 2 / (_E[0] * _E[1])) * (1 - np.exp(-(_E**2).sum() / 50))) if _E[1] > 0 else 0.0,
})
_scalar("curvatures", {
    "k1": "ka", "k2": "kb", "totalcurv": "sqrt(ka * ka + kb * kb)", "shapetrace": "(ka + kb) / sqrt(ka * ka + kb * kb)", "shapeindex": "-2 / pi() * atan2(ka + kb, ka - kb)",
    "meancurv": "mean", "gausscurv": "gauss", "flowlinecurv": "sqrt(greatest(h0 * h0 + h1 * h1 + h2 * h2 - ghg * ghg / (gm * gm), 0)) / (gm * gm)",
})
_scalar("directions", {"geomtens": None, "geomtensten": None, "curvdir1": None, "curvdir2": None, "median": None})

# -- vectors ----------------------------------------------------------------------------------------------------------
_J = [_slopes(c) for c in VECTOR]
_T = np.stack([_bends(c) for c in VECTOR])
_VS = ", ".join(f"{_value(c, 'x', 'y', 'z')} AS v{k}" for k, c in enumerate(VECTOR)) + ", " + ", ".join(f"{_J[i][j]} AS j{i}{j}" for i in range(3) for j in range(3))
_FIELD_STEPS = (
    f"f AS (SELECT *, {_VS} FROM q), c AS (SELECT *, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS vm, j21 - j12 AS c0, j02 - j20 AS c1, j10 - j01 AS c2 FROM f), "
    "s AS (SELECT *, sqrt(c0 * c0 + c1 * c1 + c2 * c2) AS cm, v0 * c0 + v1 * c1 + v2 * c2 AS hel FROM c)"
)
_CG = [[float(_T[2, 1, k] - _T[1, 2, k]) for k in range(3)], [float(_T[0, 2, k] - _T[2, 0, k]) for k in range(3)], [float(_T[1, 0, k] - _T[0, 1, k]) for k in range(3)]]
_NG = [" + ".join(f"c{i} * ({_CG[i][k]})" for i in range(3)) for k in range(3)]
_HG = [" + ".join(f"c{i} * j{i}{k} + v{i} * ({_CG[i][k]})" for i in range(3)) for k in range(3)]
_ALONG = "(" + " + ".join(f"v{k} / vm * ({_HG[k]})" for k in range(3)) + ")"
_MG = [f"{int(a == b)} + " + " + ".join(f"j{k}{a} * j{k}{b}" for k in range(3)) for a in range(3) for b in range(3)]
#: S S + W W of the strain S and the spin W is (J J + J' J') / 2.
_SO = ["0.5 * (" + " + ".join(f"j{a}{k} * j{k}{b} + j{k}{a} * j{b}{k}" for k in range(3)) + ")" for a in range(3) for b in range(3)]


def _vector(name: str, items: dict[str, object]) -> None:
    QUERIES[f"probe_{name}"] = lambda s, sf: _rounded(probing.probe_vector(_field(s), _points(s, sf), list(items), KERNELS))
    if all(e is not None for e in items.values()):
        ORACLES[f"probe_{name}"] = _sql(_FIELD_STEPS, items)


_vector("vectors", {
    "vector": ["v0", "v1", "v2"], "vector0": "v0", "vector1": "v1", "vector2": "v2", "length": "vm", "normalized": ["v0 / vm", "v1 / vm", "v2 / vm"],
    "jacobian": [f"j{i}{j}" for i in range(3) for j in range(3)], "gradient0": ["j00", "j01", "j02"], "gradient1": ["j10", "j11", "j12"], "gradient2": ["j20", "j21", "j22"],
    "strain": [f"(j{i}{j} + j{j}{i}) / 2" for i in range(3) for j in range(3)], "divergence": "j00 + j11 + j22", "curl": ["c0", "c1", "c2"], "curlnorm": "cm",
    "helicity": "hel", "normhelicity": "hel / (vm * cm)", "somega": _SO, "multigrad": _MG, "mgfrob": "sqrt(" + " + ".join(f"pow({e}, 2)" for e in _MG) + ")",
})
_vector("vector_hessians", {
    "hessian": _T.ravel().tolist(), "divgradient": [float(sum(_T[i, i, k] for i in range(3))) for k in range(3)], "curlgradient": [x for row in _CG for x in row],
    "curlnormgrad": [f"({e}) / cm" for e in _NG], "ncurlnormgrad": [f"({e}) / sqrt({' + '.join(f'pow({n}, 2)' for n in _NG)})" for e in _NG],
    "helgradient": _HG, "dirhelderiv": _ALONG, "projhelgradient": [f"{_HG[k]} - {_ALONG} * v{k} / vm" for k in range(3)],
})
_vector("vector_eigen", {"lambda2": None, "imaginarypart": None, "mgeval": None, "mgevec": None})

# -- tensors: each number a polynomial; gradients by the chain rule over the six numbers ------------------------------------
TENSOR = (
    (0.8, 0.01, 0.02, -0.01, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (5.0, 0.3, -0.1, 0.2, 0.02, 0.0, 0.01, 0.0, 0.0, -0.02), (0.4, 0.1, 0.05, 0.0, 0.0, 0.02, 0.0, -0.01, 0.0, 0.0),
    (-0.3, 0.0, 0.1, 0.05, 0.01, 0.0, 0.0, 0.0, 0.02, 0.0), (3.0, -0.1, 0.2, 0.1, 0.0, 0.01, 0.0, 0.02, 0.0, 0.01), (0.2, 0.05, 0.0, -0.1, 0.0, 0.0, 0.02, 0.0, 0.0, 0.01), (2.0, 0.1, 0.1, -0.1, 0.01, 0.0, 0.0, -0.02, 0.0, 0.03),
)


def _tensors(spark: SparkSession) -> Grid:
    axes = (Axis(7), *(Axis(SIZE),) * 3)
    case = " ".join(f"WHEN {k} THEN {_value(c, 'i1', 'i2', 'i3')}" for k, c in enumerate(TENSOR))
    return Grid(spine(spark, axes).withColumn("v", F.expr(f"CASE i0 {case} END").cast("double")), axes)


_SIX = ("a", "b", "c", "d", "e", "f")
_DS = {"trace": ("1", "0", "0", "1", "0", "1"), "s": ("2 * a", "4 * b", "4 * c", "2 * d", "4 * e", "2 * f"), "b": ("d + f", "-2 * b", "-2 * c", "a + f", "-2 * e", "a + d"),
       "det": ("d * f - e * e", "2 * (c * e - b * f)", "2 * (b * e - c * d)", "a * f - c * c", "2 * (b * c - a * e)", "a * d - b * b")}
_NUMBERS = ", ".join(f"{_value(c, 'x', 'y', 'z')} AS {n}" for c, n in zip(TENSOR, ("w", *_SIX), strict=True)) + ", " + ", ".join(f"{_slopes(c)[k]} AS {n}{k}" for c, n in zip(TENSOR, ("w", *_SIX), strict=True) for k in range(3))
_CHAIN = ", ".join(f"{' + '.join(f'({d}) * {n}{k}' for d, n in zip(ds, _SIX, strict=True))} AS g_{name}{k}" for name, ds in _DS.items() for k in range(3))
_TENSOR_STEPS = (
    f"t AS (SELECT *, {_NUMBERS} FROM q), i AS (SELECT *, a + d + f AS tr, a * a + d * d + f * f + 2 * (b * b + c * c + e * e) AS sq, a * d + a * f + d * f - b * b - c * c - e * e AS mi, "
    f"a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS de, {_CHAIN} FROM t), "
    "u AS (SELECT *, (sq - mi) / 9 AS q, sqrt((sq - mi) / sq) AS fa, (27 * de - 5 * tr * mi + 2 * tr * sq) / 54 AS r FROM i), s AS (SELECT *, r / pow(q, 1.5) AS mo FROM u)"
)
_FA_SLOPE = [f"(sq * (g_s{k} - g_b{k}) - (sq - mi) * g_s{k}) / (2 * fa * sq * sq)" for k in range(3)]


def _ten(name: str, items: dict[str, object]) -> None:
    from loomgrid.operators.tensor_probing import probe_tensor

    QUERIES[f"probe_{name}"] = lambda s, sf: _rounded(probe_tensor(_tensors(s), _points(s, sf), list(items), KERNELS))
    if all(e is not None for e in items.values()):
        ORACLES[f"probe_{name}"] = _sql(_TENSOR_STEPS, items)


_ten("tensor_values", {
    "tensor": ["w", *_SIX], "confidence": "w", "trace": "tr", "norm": "sqrt(sq)", "b": "mi", "det": "de", "s": "sq", "q": "q", "fa": "fa", "r": "r", "mode": "mo",
    "theta": "acos(-mo) / pi()", "modewarp": "cos((1 - mo) * pi() / 2)", "omega": "fa * (1 + mo) / 2",
})
_ten("tensor_gradients", {
    "tensorgrad": [f"{n}{k}" for n in ("w", *_SIX) for k in range(3)], "tensorgradmag": [f"sqrt({' + '.join(f'{w} * {n}{k} * {n}{k}' for w, n in zip((1, 2, 2, 1, 2, 1), _SIX, strict=True))})" for k in range(3)],
    **{f"{n}gradvec": [f"g_{n}{k}" for k in range(3)] for n in _DS}, **{f"{n}gradmag": f"sqrt({' + '.join(f'g_{n}{k} * g_{n}{k}' for k in range(3))})" for n in _DS},
    "qgradvec": [f"(g_s{k} - g_b{k}) / 9" for k in range(3)], "normgradvec": [f"g_s{k} / (2 * sqrt(sq))" for k in range(3)], "fagradvec": _FA_SLOPE,
    "fagradmag": f"sqrt({' + '.join(f'pow({e}, 2)' for e in _FA_SLOPE)})", "rgradvec": [f"(27 * g_det{k} - 5 * (g_trace{k} * mi + tr * g_b{k}) + 2 * (g_trace{k} * sq + tr * g_s{k})) / 54" for k in range(3)],
})
_ten("tensor_derived", dict.fromkeys(["fahessian", "fahessianeval", "omegahessian", "modehessian", "cl1", "cp1", "ca1", "cl1hessian", "evalgrads", "evalhessian", "fadiffusionalign", "faridgesurfacestrength"]))
