"""A pipe of tensor commands over a table with a tensor column: ``"evalpow -p 2 | anvol -a fa"``."""

from __future__ import annotations

import math
import shlex
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import tensor_edits as T
from loomgrid.plans.pipe import _options

Command = Callable[[DataFrame, Callable[..., float]], DataFrame]


def _edited(make: Callable[[Callable[..., float]], T.Edit]) -> Command:
    return lambda df, o: T.edit(df, make(o))


#: ``o(key, default, place)`` is a number given after an option.
COMMANDS: dict[str, Command] = {
    "evalpow": _edited(lambda o: T.power(o("p"))),
    "evaladd": _edited(lambda o: (lambda v: lambda e: e + v)(o("v"))),
    "evalmult": _edited(lambda o: (lambda v: lambda e: e * v)(o("v"))),
    "evalclamp": _edited(lambda o: T.clamp(o("min", math.nan), o("max", math.nan))),
    "log": _edited(lambda o: T.logarithm),
    "exp": _edited(lambda o: T.exponential),
    "sqrt": _edited(lambda o: T.EDITS["sqrt"]),
    "inverse": _edited(lambda o: T.EDITS["inverse"]),
    "norm": _edited(lambda o: T.size_normalize((o("w", 1.0, 0), o("w", 1.0, 1), o("w", 1.0, 2)), o("a", 1.0), o("t", 1.0))),
    "anscale": _edited(lambda o: T.aniso_scale(o("s"), bool(o("fd", 0.0)), bool(o("mp", 0.0)))),
    "eval": lambda df, o: T.eigen(df).drop("evec"),
    "evec": lambda df, o: T.eigen(df).drop("eval"),
    "expand": lambda df, o: df.withColumn("m", T.expand(F.col("t"), o("s", 1.0), o("t", 0.5))),
    "make": lambda df, o: df.withColumn("t", T.make(F.get("t", F.lit(0)), F.col("eval"), F.col("evec"))),
    "solve": lambda df, o: T.eigen(df),
    "shrink": lambda df, o: df.withColumn("t", T.shrink(F.col("m"))),
}


def run(df: DataFrame, pipe: str) -> DataFrame:
    """``df`` has the tensors in a column ``t``; measures come in a column ``v``, averages take the place of the rows."""
    for part in pipe.split("|"):
        name, *words = shlex.split(part.strip())
        opts, _ = _options(words)

        def number(key: str, default: float | None = None, place: int = 0, opts: dict[str, list[str]] = opts) -> float:
            if key not in opts:
                if default is None:
                    raise ValueError(f"option -{key} is missing")
                return default
            return float(opts[key][place]) if opts[key] else 1.0

        if name == "anvol":
            df = T.anisotropies(df, {"v": opts["a"][0]}, "t", number("t", 0.5))
        elif name == "avg":
            df = T.average(df, opts.get("by", []), "t", "log" in opts)
        elif name == "evecrgb":
            which = int(number("c", 0.0))
            both = T.eigen(T.anisotropies(df, {"__measure": opts.get("a", ["fa"])[0]}))
            df = both.withColumn("rgb", T.vector_colors(F.slice("evec", 3 * which + 1, 3), F.col("__measure"), number("g", 1.0))).drop("eval", "evec", "__measure")
        elif name in COMMANDS:
            df = COMMANDS[name](df, number)
        else:
            raise ValueError(f"no command {name!r}")
    return df
