"""Tensor commands over a tensor made from each event, and their SQL.

The tensors are diagonal in a frame turned by an angle about the third axis, so eigenvalues are known and an edit's result can
be said in SQL without solving for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators import tensor_edits
from loomgrid.plans import tensor_pipe

DIGITS = 6
#: Eigenvalues (falling) and the cosine and sine of the angle, for Spark and the oracle alike.
_E = ("(3.0171 + event_id % 10 * 1.01337)", "(1.5113 + event_id % 3 * 0.50171)", "(0.20119 + event_id % 7 * 0.100313)")
_C, _S = "cos(event_id % 12 * 0.25)", "sin(event_id % 12 * 0.25)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _numbers(a: str, b: str, c: str) -> list[str]:
    """The tensor's seven numbers from eigenvalues."""
    return ["1", f"{a} * {_C} * {_C} + {b} * {_S} * {_S}", f"({a} - {b}) * {_C} * {_S}", "0", f"{a} * {_S} * {_S} + {b} * {_C} * {_C}", "0", c]


def tensors(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", F.array(*(F.expr(e).cast("double") for e in _numbers(*_E))).alias("t"))


def add(name: str, pipe: str, columns: dict[str, list[str] | str] | None) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = tensor_pipe.run(tensors(spark, sf), pipe)
        kinds = dict(out.dtypes)
        return out.select("event_id", *(F.round(c, DIGITS).alias(c) if kinds[c] == "double" else F.transform(c, lambda x: F.round(x, DIGITS) + 0.0).alias(c) for c in (columns or {"t": ""})))

    QUERIES[f"tend_{name}"] = query
    if columns:
        one = lambda e: f"round(CAST({e} AS DOUBLE), {DIGITS}) + 0.0"
        ORACLES[f"tend_{name}"] = "SELECT event_id, " + ", ".join(f"[{', '.join(map(one, e))}] AS {c}" if isinstance(e, list) else f"{one(e)} AS {c}" for c, e in columns.items()) + " FROM events"


def _edited(form: str) -> dict[str, list[str]]:
    return {"t": _numbers(*(form.format(e) for e in _E))}


_MEAN = f"(({_E[0]} + {_E[1]} + {_E[2]}) / 3)"
add("evalpow", "evalpow -p 1.5", _edited("pow({}, 1.5)"))
add("evaladd", "evaladd -v 2", _edited("({} + 2)"))
add("evalmult", "evalmult -v 3", _edited("({} * 3)"))
add("evalclamp", "evalclamp -min 1 -max 5", _edited("least(greatest({}, 1), 5)"))
add("log", "log", _edited("ln({})"))
add("exp", "exp", _edited("exp({})"))
add("sqrt", "sqrt", _edited("sqrt({})"))
add("inverse", "inverse", _edited("(1.0 / {})"))
add("norm", "norm -w 1 1 1 -a 0.5 -t 4", _edited(f"(0.5 * {{}} + 2 * {{}} / {_MEAN})".replace("{}", "{0}")))
add("anscale", "anscale -s 0.5", _edited(f"(0.5 * {{}} + 0.5 * {_MEAN})"))
add("eval", "eval", {"eval": list(_E)})
add("evec", "evec", None)
add("make", "solve | make", {"t": _numbers(*_E)})
add("expand", "expand", {"m": [_numbers(*_E)[k] for k in (1, 2, 3, 2, 4, 5, 3, 5, 6)]})
add("shrink", "expand | shrink", {"t": _numbers(*_E)})
add("evecrgb", "evecrgb -c 0 -a cl1", {"rgb": [f"abs({x}) * ({_E[0]} - {_E[1]}) / (3 * {_MEAN})" for x in (_C, _S, "0")]})

_A, _B, _D = _E
_SQ, _SP = f"({_A} * {_A} + {_B} * {_B} + {_D} * {_D})", " + ".join(f"pow({e} - {_MEAN}, 2)" for e in _E)
_PRODUCT = " * ".join(f"({e} - {_MEAN})" for e in _E)
_MODE = f"(3 * sqrt(6) * {_PRODUCT} / pow({_SP}, 1.5))"
_FA = f"sqrt(1.5 * ({_SP}) / {_SQ})"
_MI = f"({_A} * {_B} + {_A} * {_D} + {_B} * {_D})"
_T = f"({_A} + {_B} + {_D})"
_DET = f"({_A} * {_B} * {_D})"
ANISOTROPY = {
    "cl1": f"({_A} - {_B}) / {_T}", "cp1": f"2 * ({_B} - {_D}) / {_T}", "ca1": f"({_A} + {_B} - 2 * {_D}) / {_T}", "clpmin1": f"least({_A} - {_B}, 2 * ({_B} - {_D})) / {_T}", "cs1": f"3 * {_D} / {_T}",
    "ct1": f"2 * ({_B} - {_D}) / ({_A} + {_B} - 2 * {_D})", "cl2": f"({_A} - {_B}) / {_A}", "cp2": f"({_B} - {_D}) / {_A}", "ca2": f"({_A} - {_D}) / {_A}", "clpmin2": f"least({_A} - {_B}, {_B} - {_D}) / {_A}",
    "cs2": f"{_D} / {_A}", "ct2": f"({_B} - {_D}) / ({_A} - {_D})", "ra": f"sqrt({_SP}) / (sqrt(6) * {_MEAN})", "fa": _FA, "vf": f"1 - {_DET} / pow({_MEAN}, 3)", "b": _MI, "q": f"({_SQ} - {_MI}) / 9",
    "r": f"(27 * {_DET} - 5 * {_T} * {_MI} + 2 * {_T} * {_SQ}) / 54", "s": _SQ, "skew": f"{_MODE} / sqrt(2)", "mode": _MODE, "th": f"acos(least(greatest({_MODE}, -1), 1)) / 3", "omega": f"{_FA} * (1 + {_MODE}) / 2",
    "det": _DET, "tr": _T, "eval0": _A, "eval1": _B, "eval2": _D, "conf": "1",
}


def _all(spark: SparkSession, sf: str) -> DataFrame:
    out = tensor_edits.anisotropies(tensors(spark, sf), {m: m for m in tensor_edits.MEASURES})
    return out.select("event_id", *(F.round(m, DIGITS).alias(m) for m in tensor_edits.MEASURES))


QUERIES["tend_anvol"] = _all
ORACLES["tend_anvol"] = "SELECT event_id, " + ", ".join(f"round(CAST({ANISOTROPY[m]} AS DOUBLE), {DIGITS}) AS {m}" for m in tensor_edits.MEASURES) + " FROM events"


def _average(log: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = tensor_pipe.run(tensors(spark, sf).withColumn("k", F.col("event_id") % 12), f"avg -by k {log}")
        return out.select("k", F.transform("t", lambda x: F.round(x, DIGITS) + 0.0).alias("t"))

    return query


def _mean(form: str, back: str) -> str:
    a, b, c = (back.format(f"avg({form.format(e)})") for e in _E)
    cos, sin = (f"any_value({x})" for x in (_C, _S))
    cells = [f"round(CAST({e.replace(_C, cos).replace(_S, sin)} AS DOUBLE), {DIGITS}) + 0.0" for e in _numbers(a, b, c)]
    return f"SELECT event_id % 12 AS k, [{', '.join(cells)}] AS t FROM events GROUP BY event_id % 12"


QUERIES["tend_avg"], ORACLES["tend_avg"] = _average(""), _mean("{}", "{}")
QUERIES["tend_avg_log"], ORACLES["tend_avg_log"] = _average("-log"), _mean("ln({})", "exp({})")
