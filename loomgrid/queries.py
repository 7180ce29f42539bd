"""Queries over the driver's tables, one per operator, each with the SQL that says the same (where SQL can)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid import kernel_queries, pipe_queries, probe_queries, tensor_queries
from loomgrid.core.exists import round_binary
from loomgrid.core.grid import Axis, Grid, from_table
from loomgrid.functions.kernels import parse
from loomgrid.operators import elementwise as E
from loomgrid.operators import histograms, maps, measures, shape, stencil, tensor
from loomgrid.plans import pipe
from loomgrid.sources import arrays
from loomgrid.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: What makes a signed value with missing ones from an event, on both sides.
VALUE_SQL = "CASE WHEN event_id % 97 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 89 = 0 THEN CAST('infinity' AS DOUBLE) ELSE value - 40 END"
WIDTH = 25


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _missing(df: DataFrame) -> Column:
    return F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 89 == 0, F.lit(float("inf"))).otherwise(F.col("value") - 40)


def events_line(spark: SparkSession, sf: str, value: Column | None = None) -> Grid:
    df = table(spark, sf, "events")
    n = df.count()
    return from_table(df, ["event_id"], F.col("value") if value is None else value, (Axis(n),))


def events_plane(spark: SparkSession, sf: str, value: Column | None = None) -> Grid:
    return _plane(events_line(spark, sf, value))


def _plane(g: Grid) -> Grid:
    return shape.split_axis(g, 0, WIDTH, g.axes[0].size // WIDTH)


def _out(g: Grid, digits: int | None = None) -> DataFrame:
    return g.df.select(*g.names, (F.col("v") if digits is None else F.round("v", digits)).alias("v"))


def _scaled(sql: str) -> str:
    return f"SELECT event_id AS i0, {sql} AS v FROM (SELECT event_id, {VALUE_SQL} AS x FROM events)"


# -- unary -----------------------------------------------------------------------------------------------------
_FINITE = "isfinite(x)"
UNARY_SQL = {
    "-": "-x", "r": "1 / x", "sin": f"CASE WHEN {_FINITE} THEN sin(x) ELSE CAST('nan' AS DOUBLE) END", "cos": f"CASE WHEN {_FINITE} THEN cos(x) ELSE CAST('nan' AS DOUBLE) END",
    "tan": f"CASE WHEN {_FINITE} THEN tan(x) ELSE CAST('nan' AS DOUBLE) END", "asin": "CASE WHEN abs(x) <= 1 THEN asin(x) ELSE CAST('nan' AS DOUBLE) END",
    "acos": "CASE WHEN abs(x) <= 1 THEN acos(x) ELSE CAST('nan' AS DOUBLE) END", "atan": "atan(x)", "exp": "exp(x / 10)",
    "log": "CASE WHEN x = 0 THEN CAST('-infinity' AS DOUBLE) WHEN isnan(x) OR x < 0 THEN CAST('nan' AS DOUBLE) ELSE ln(x) END",
    "log2": "CASE WHEN x = 0 THEN CAST('-infinity' AS DOUBLE) WHEN isnan(x) OR x < 0 THEN CAST('nan' AS DOUBLE) ELSE ln(x) / 0.69314718 END",
    "log10": "CASE WHEN x = 0 THEN CAST('-infinity' AS DOUBLE) WHEN isnan(x) OR x < 0 THEN CAST('nan' AS DOUBLE) ELSE log10(x) END",
    "log1p": "CASE WHEN x = -1 THEN CAST('-infinity' AS DOUBLE) WHEN isnan(x) OR x < -1 THEN CAST('nan' AS DOUBLE) ELSE ln(1 + x) END",
    "expm1": "exp(x / 10) - 1", "sqrt": "CASE WHEN isnan(x) OR x < 0 THEN CAST('nan' AS DOUBLE) ELSE sqrt(x) END", "cbrt": "cbrt(x)", "ceil": "ceil(x)", "floor": "floor(x)",
    "roundup": "floor(x + 0.5)", "rounddown": "ceil(x - 0.5)", "abs": "abs(x)", "sgn": "CASE WHEN isnan(x) THEN 0.0 WHEN x < 0 THEN -1.0 WHEN x > 0 THEN 1.0 ELSE 0.0 END",
    "exists": f"CASE WHEN {_FINITE} THEN 1.0 ELSE 0.0 END", "if": "CASE WHEN x <> 0 OR isnan(x) THEN 1.0 ELSE 0.0 END", "zero": "0.0", "one": "1.0",
}
_NAMES = {"-": "minus", "r": "reciprocal", "+": "plus", "x": "times", "/": "divide", "^": "power", "%": "remainder"}


def _round_sql(sql: str) -> str:
    return f"CAST(CASE WHEN isfinite({sql}) THEN round({sql}, 6) ELSE {sql} END AS DOUBLE)"


def _rounded(g: Grid) -> DataFrame:
    return g.df.select(*g.names, round_binary(F.col("v"), 6).alias("v"))


def _unary(op: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, "events")
        v = _missing(df)
        g = events_line(spark, sf, v / 10 if op in ("exp", "expm1") else v)
        return _rounded(E.unary(g, op))

    return query


for _op in E.UNARY:
    if _op in UNARY_SQL:
        add(f"unary_{_NAMES.get(_op, _op)}", _unary(_op), _scaled(_round_sql(f"({UNARY_SQL[_op]})")))
    else:
        add(f"unary_{_NAMES.get(_op, _op)}", _unary(_op))

# -- binary: a value with missing ones, and the value of the mirrored event ------------------------------------------
_INT = "CAST(trunc({}) AS BIGINT)"
BINARY_SQL = {
    "+": "a + b", "-": "a - b", "x": "a * b", "/": "a / b", "^": "pow(abs(a) / 100, b / 100)", "spow": "(CASE WHEN isnan(a) THEN 0.0 ELSE sign(a) END) * pow(abs(a), b / 100)",
    "%": "CAST(((trunc(a) % trunc(b)) + trunc(b)) % trunc(b) AS DOUBLE)", "fmod": "CASE WHEN b = 0 THEN CAST('nan' AS DOUBLE) ELSE a - b * trunc(a / b) END", "atan2": "atan2(a, b)",
    "min": "CASE WHEN a < b AND NOT isnan(a) AND NOT isnan(b) THEN a ELSE b END", "max": "CASE WHEN a > b AND NOT isnan(a) AND NOT isnan(b) THEN a ELSE b END",
    "lt": "CASE WHEN a < b AND NOT isnan(a) AND NOT isnan(b) THEN 1.0 ELSE 0.0 END", "lte": "CASE WHEN a <= b AND NOT isnan(a) AND NOT isnan(b) THEN 1.0 ELSE 0.0 END",
    "gt": "CASE WHEN a > b AND NOT isnan(a) AND NOT isnan(b) THEN 1.0 ELSE 0.0 END", "gte": "CASE WHEN a >= b AND NOT isnan(a) AND NOT isnan(b) THEN 1.0 ELSE 0.0 END",
    "comp": "CASE WHEN isnan(a) OR isnan(b) OR a = b THEN 0.0 WHEN a < b THEN -1.0 ELSE 1.0 END", "eq": "CASE WHEN a = b AND NOT isnan(a) THEN 1.0 ELSE 0.0 END",
    "neq": "CASE WHEN a = b AND NOT isnan(a) THEN 0.0 ELSE 1.0 END", "exists": "CASE WHEN isfinite(a) THEN a ELSE b END", "if": "CASE WHEN a <> 0 OR isnan(a) THEN a ELSE b END",
    "fpow": "CASE WHEN b / 100 = 1 THEN a / 100 ELSE (CASE WHEN isnan(a) THEN 0.0 ELSE sign(a) END) * (1 - pow(1 - least(1.0, abs(a / 100)), b / 100)) END",
}


def _binary(op: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, "events")
        n = df.count()
        clean = F.col("value") if op in ("%", "^", "spow", "fpow", "fmod") else None
        a, b = (F.col("value") - 40 if clean is not None else _missing(df)), F.col("value") + 1
        if op == "^":
            a, b = F.abs(a) / 100, b / 100
        if op == "spow":
            b = b / 100
        if op == "fpow":
            a, b = a / 100, b / 100
        left = from_table(df, ["event_id"], a, (Axis(n),))
        right = shape.flip(from_table(df, ["event_id"], b, (Axis(n),)), 0)
        return _rounded(E.binary(op, left, right))

    return query


for _op in E.BINARY:
    _a = "e.value - 40" if _op in ("%", "^", "spow", "fpow", "fmod") else VALUE_SQL.replace("event_id", "e.event_id").replace("value", "e.value")
    _sql = f"SELECT i0, {_round_sql('(' + BINARY_SQL[_op] + ')')} AS v FROM (SELECT e.event_id AS i0, {_a} AS a, m.value + 1 AS b FROM events e JOIN events m ON m.event_id = (SELECT max(event_id) FROM events) - e.event_id)" if _op in BINARY_SQL else None
    add(f"binary_{_NAMES.get(_op, _op)}", _binary(_op), _sql)

# -- ternary -----------------------------------------------------------------------------------------------------
TERNARY_SQL = {
    "add": "a + b + c", "multiply": "a * b * c",
    "min": "CASE WHEN a < (CASE WHEN b < c THEN b ELSE c END) AND NOT isnan(a) THEN a ELSE (CASE WHEN b < c THEN b ELSE c END) END",
    "max": "CASE WHEN a > (CASE WHEN b > c THEN b ELSE c END) AND NOT isnan(a) THEN a ELSE (CASE WHEN b > c THEN b ELSE c END) END",
    "clamp": "CASE WHEN b < a AND NOT isnan(a) THEN a WHEN c < b THEN c ELSE b END", "ifelse": "CASE WHEN a <> 0 OR isnan(a) THEN b ELSE c END",
    "lerp": "CASE WHEN a = 0 THEN b WHEN a = 1 THEN c ELSE a * (c - b) + b END", "exists": "CASE WHEN isfinite(a) THEN b ELSE c END",
    "in_op": "CASE WHEN a < b AND b < c AND NOT isnan(a) THEN 1.0 ELSE 0.0 END", "in_cl": "CASE WHEN a <= b AND b <= c AND NOT isnan(a) THEN 1.0 ELSE 0.0 END",
    "gauss": "exp(-pow((a - b) / c, 2) / 2) / (c * sqrt(2 * pi()))",
}


def _ternary(op: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, "events")
        n = df.count()
        a = F.col("value") - 40 if op in ("lt_sm", "gt_sm", "gauss") else F.abs(F.col("value") - 40) if op == "rician" else _missing(df)
        axes = (Axis(n),)
        return _rounded(E.ternary(op, from_table(df, ["event_id"], a, axes), from_table(df, ["event_id"], F.col("value"), axes), from_table(df, ["event_id"], F.col("value") + 5, axes)))

    return query


for _op in E.TERNARY:
    _a = "value - 40" if _op == "gauss" else VALUE_SQL
    _sql = f"SELECT i0, {_round_sql('(' + TERNARY_SQL[_op] + ')')} AS v FROM (SELECT event_id AS i0, {_a} AS a, value AS b, value + 5 AS c FROM events)" if _op in TERNARY_SQL else None
    add(f"ternary_{_op}", _ternary(_op), _sql)

# -- measures by group ---------------------------------------------------------------------------------------------
_V = "CASE WHEN l_linenumber = 7 THEN CAST('nan' AS DOUBLE) ELSE l_quantity END"
_X = "CASE WHEN isfinite(v) THEN v END"
MEASURE_SQL = {
    "min": f"min({_X})", "max": f"max({_X})", "mean": f"avg({_X})", "median": f"quantile_cont({_X}, 0.5)", "sum": f"sum({_X})", "L1": f"sum(abs({_X}))", "L2": f"sqrt(sum(v * v) FILTER (isfinite(v)))",
    "L4": "sqrt(sqrt(sum(v * v * v * v) FILTER (isfinite(v))))", "normalizedL2": f"sqrt(sum(v * v) FILTER (isfinite(v))) / count({_X})", "RMS": "sqrt(avg(v * v) FILTER (isfinite(v)))",
    "Linf": f"max(abs({_X}))", "variance": f"var_pop({_X})", "stdv": f"stddev_pop({_X})", "CoV": f"stddev_pop({_X}) / avg({_X})",
    "skew": f"avg(pow(v - m, 3)) FILTER (isfinite(v)) / pow(var_pop({_X}), 1.5)",
}


def _measure(name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        v = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
        df = table(spark, sf, "lineitem").select("l_returnflag", v.alias("v"))
        return measures.group_measure(df, ["l_returnflag"], name).select("l_returnflag", F.round("v", 6).alias("v"))

    return query


for _m, _sql in MEASURE_SQL.items():
    add(
        f"measure_{_m}", _measure(_m),
        f"WITH t AS (SELECT l_returnflag, {_V} AS v FROM lineitem), a AS (SELECT l_returnflag, avg({_X}) AS m FROM t GROUP BY l_returnflag) SELECT l_returnflag, round({_sql}, 6) AS v FROM t JOIN a USING (l_returnflag) GROUP BY l_returnflag",
    )
add(
    "measure_product",
    lambda s, sf: measures.group_measure(table(s, sf, "supplier").filter("s_suppkey < 40").withColumn("x", F.col("s_acctbal") / 1000), ["s_nationkey"], "product", "x").select("s_nationkey", F.round("v", 6).alias("v")),
    "SELECT s_nationkey, round(product(s_acctbal / 1000), 6) AS v FROM supplier WHERE s_suppkey < 40 GROUP BY s_nationkey",
)
#: Factors near 1, so that the product over all suppliers of a nation stays finite at any scale.
add(
    "measure_product_whole",
    lambda s, sf: measures.group_measure(table(s, sf, "supplier").withColumn("x", 1 + F.col("s_acctbal") / 1e6), ["s_nationkey"], "product", "x").select("s_nationkey", F.round("v", 6).alias("v")),
    "SELECT s_nationkey, round(product(1 + s_acctbal / 1e6), 6) AS v FROM supplier GROUP BY s_nationkey",
)
add(
    "measure_mode",
    lambda s, sf: measures.group_measure(table(s, sf, "part"), ["p_brand"], "mode", "p_size").select("p_brand", F.round("v", 6).alias("v")),
    """WITH r AS (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand),
    b AS (SELECT p_brand, lo, hi, least(floor(1024 * (p_size - lo) / (hi - lo)::DOUBLE), 1023) AS b, count(*) AS n FROM part JOIN r USING (p_brand) GROUP BY ALL),
    t AS (SELECT *, max(n) OVER (PARTITION BY p_brand) AS top FROM b)
    SELECT p_brand, round(any_value(lo) + (any_value(hi) - any_value(lo)) * (avg(b) + 0.5) / 1024, 6) AS v FROM t WHERE n = top GROUP BY p_brand""",
)
_PLANE = f"(SELECT event_id % {WIDTH} AS i0, event_id // {WIDTH} AS i1, value AS v FROM events)"
for _m, _sql in {"line-slope": "regr_slope(v, i0)", "line-intercept": "regr_intercept(v, i0)", "line-error": "regr_syy(v, i0) - regr_slope(v, i0) * regr_sxy(v, i0)"}.items():
    add(
        f"project_{_m.replace('-', '_')}", lambda s, sf, m=_m: _out(measures.project(_plane(events_line(s, sf)), 0, m), 6),
        f"SELECT i1 AS i0, round({_sql}, 6) AS v FROM {_PLANE} GROUP BY i1",
    )
_H = {
    "histo-min": "min(i0) FILTER (v > 0)", "histo-max": "max(i0) FILTER (v > 0)", "histo-mean": "sum(v * i0) / sum(v)", "histo-sum": "sum(v * i0)", "histo-L2": "sum(v * i0 * i0)",
    "histo-variance": "greatest(0, sum(v * i0 * i0) / sum(v) - pow(sum(v * i0) / sum(v), 2))", "histo-SD": "sqrt(greatest(0, sum(v * i0 * i0) / sum(v) - pow(sum(v * i0) / sum(v), 2)))",
    "histo-mode": "avg(i0) FILTER (v = top)", "histo-median": "min(i0) FILTER (cum >= total / 2)",
}
for _m, _sql in _H.items():
    add(
        f"project_{_m.replace('-', '_')}", lambda s, sf, m=_m: _out(measures.project(_plane(events_line(s, sf)), 0, m), 6),
        f"SELECT i1 AS i0, round(CAST({_sql} AS DOUBLE), 6) AS v FROM (SELECT *, max(v) OVER (PARTITION BY i1) AS top, sum(v) OVER (PARTITION BY i1) AS total, sum(v) OVER (PARTITION BY i1 ORDER BY i0) AS cum FROM {_PLANE}) GROUP BY i1",
    )
add("project_histo_product", lambda s, sf: _out(measures.project(_plane(events_line(s, sf, F.col("value") / 1000)), 0, "histo-product"), 6), f"SELECT i1 AS i0, round(product(pow(i0, v / 1000)), 6) AS v FROM {_PLANE} GROUP BY i1")


def embedding_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of each dimension over all vectors."""
    cells = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("i0", "v"))
    return measures.group_measure(cells.select(F.col("i0").cast("long"), F.col("v").cast("double")), ["i0"], "mean").select("i0", F.round("v", 6).alias("v"))


add("project_embedding_mean", embedding_means, "SELECT i0, round(avg(v), 6) AS v FROM (SELECT unnest(generate_series(0, len(embedding) - 1)) AS i0, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY i0")

# -- scalar maps -----------------------------------------------------------------------------------------------------
_LINE = "(SELECT event_id AS i0, value AS v FROM events)"
_R = "(SELECT min(value) AS lo, max(value) AS hi FROM events)"
add("affine", lambda s, sf: _out(E.affine(events_line(s, sf), 0, 100, 0, 1, True), 6), f"SELECT i0, round(least(greatest(v / 100, 0), 1), 6) AS v FROM {_LINE}")
add("gamma", lambda s, sf: _out(E.gamma(events_line(s, sf), 2.2), 6), f"SELECT i0, round(pow((v - lo) / (hi - lo), 1 / 2.2) * (hi - lo) + lo, 6) AS v FROM {_LINE}, {_R}")
add("convert_uchar", lambda s, sf: _out(E.convert(events_line(s, sf), "uchar")), f"SELECT i0, CAST(((trunc(v) % 256) + 256) % 256 AS DOUBLE) AS v FROM {_LINE}")
add("clamp_convert_uchar", lambda s, sf: _out(E.clamp_convert(events_line(s, sf), "uchar")), f"SELECT i0, trunc(least(greatest(v, 0), 255)) AS v FROM {_LINE}")
add("quantize", lambda s, sf: _out(E.quantize(events_line(s, sf), 8)), f"SELECT i0, CAST(least(floor(256 * (v - lo) / (hi - lo)), 255) AS DOUBLE) AS v FROM {_LINE}, {_R}")
add("unquantize", lambda s, sf: _out(E.unquantize(E.quantize(events_line(s, sf), 16)), 6), f"SELECT i0, round(lo + (hi - lo) * (least(floor(65536 * (v - lo) / (hi - lo)), 65535) + 0.5) / 65536, 6) AS v FROM {_LINE}, {_R}")

# -- shape -----------------------------------------------------------------------------------------------------------
_N = f"(SELECT count(*) // {WIDTH} AS n FROM events)"
add("slice", lambda s, sf: _out(shape.slice_at(_plane(events_line(s, sf)), 0, 3)), f"SELECT i1 AS i0, v FROM {_PLANE} WHERE i0 = 3")
add("crop", lambda s, sf: _out(shape.crop(_plane(events_line(s, sf)), [2, 1], [9, 6])), f"SELECT i0 - 2 AS i0, i1 - 1 AS i1, v FROM {_PLANE} WHERE i0 BETWEEN 2 AND 9 AND i1 BETWEEN 1 AND 6")
add("simple_crop", lambda s, sf: _out(shape.simple_crop(_plane(events_line(s, sf)), 2)), f"SELECT i0 - 2 AS i0, i1 - 2 AS i1, v FROM {_PLANE}, {_N} WHERE i0 BETWEEN 2 AND {WIDTH - 3} AND i1 BETWEEN 2 AND n - 3")
add("slice_select", lambda s, sf: _out(shape.slice_select(g := _plane(events_line(s, sf)), 1, measures.project(g, 0, "mean"), 50.0)), f"WITH m AS (SELECT i1, row_number() OVER (ORDER BY i1) - 1 AS k FROM (SELECT i1, avg(v) AS m FROM {_PLANE} GROUP BY i1) WHERE m >= 50) SELECT i0, k AS i1, v FROM {_PLANE} JOIN m USING (i1)")
add("permute", lambda s, sf: _out(shape.permute(_plane(events_line(s, sf)), [1, 0])), f"SELECT i1 AS i0, i0 AS i1, v FROM {_PLANE}")
add("swap", lambda s, sf: _out(shape.swap(_plane(events_line(s, sf)), 0, 1)), f"SELECT i1 AS i0, i0 AS i1, v FROM {_PLANE}")
add("shuffle", lambda s, sf: _out(shape.shuffle(_plane(events_line(s, sf)), 0, [4, 4, 0, 2])), f"SELECT k AS i0, i1, v FROM {_PLANE} JOIN (VALUES (0, 4), (1, 4), (2, 0), (3, 2)) AS t(k, o) ON i0 = o")
add("flip", lambda s, sf: _out(shape.flip(_plane(events_line(s, sf)), 0)), f"SELECT {WIDTH - 1} - i0 AS i0, i1, v FROM {_PLANE}")
add("axinsert_axdelete", lambda s, sf: _out(shape.delete_axis(shape.insert_axis(_plane(events_line(s, sf)), 1), 1)), f"SELECT * FROM {_PLANE}")
add("axsplit", lambda s, sf: _out(_plane(events_line(s, sf))), f"SELECT * FROM {_PLANE}")
add("axmerge", lambda s, sf: _out(shape.merge_axes(_plane(events_line(s, sf)), 0)), f"SELECT * FROM {_LINE}")
add("reshape", lambda s, sf: _out(shape.reshape(g := events_line(s, sf), [5, g.size // 5])), "SELECT event_id % 5 AS i0, event_id // 5 AS i1, value AS v FROM events")


def _cube(s: SparkSession, sf: str) -> Grid:
    g = events_line(s, sf)
    return shape.reshape(g, [5, 5, g.size // 25])


def _tiled(s: SparkSession, sf: str) -> Grid:
    c = _cube(s, sf)
    return shape.tile(shape.crop(c, [0, 0, 0], [4, 4, 11]), 0, 1, 2, 4, 3)


_TILE = "SELECT event_id % 5 + 5 * ((event_id // 25) % 4) AS i0, (event_id // 5) % 5 + 5 * ((event_id // 25) // 4) AS i1, value AS v FROM events WHERE event_id < 300"
add("tile", lambda s, sf: _out(_tiled(s, sf)), _TILE)
add("untile", lambda s, sf: _out(shape.untile(_tiled(s, sf), 0, 1, 2, 4, 3)), "SELECT event_id % 5 AS i0, (event_id // 5) % 5 AS i1, event_id // 25 AS i2, value AS v FROM events WHERE event_id < 300")


def _tiles(n: int) -> tuple[int, int]:
    """The most nearly square fast x slow grid of exactly ``n`` tiles."""
    fast = next(f for f in range(math.isqrt(n), 0, -1) if n % f == 0)
    return fast, n // fast


def _tiled_whole(s: SparkSession, sf: str) -> tuple[Grid, int, int]:
    c = _cube(s, sf)
    fast, slow = _tiles(c.axes[2].size)
    return shape.tile(c, 0, 1, 2, fast, slow), fast, slow


def _untiled_whole(s: SparkSession, sf: str) -> DataFrame:
    g, fast, slow = _tiled_whole(s, sf)
    return _out(shape.untile(g, 0, 1, 2, fast, slow))


_FAST = f"(SELECT max(f) AS f FROM (SELECT unnest(generate_series(1, n)) AS f, n FROM {_N}) WHERE n % f = 0 AND f * f <= n)"
add("tile_whole", lambda s, sf: _out(_tiled_whole(s, sf)[0]), f"SELECT event_id % 5 + 5 * ((event_id // 25) % f) AS i0, (event_id // 5) % 5 + 5 * ((event_id // 25) // f) AS i1, value AS v FROM events, {_FAST}")
add("untile_whole", _untiled_whole, "SELECT event_id % 5 AS i0, (event_id // 5) % 5 AS i1, event_id // 25 AS i2, value AS v FROM events")
add("join_concat", lambda s, sf: _out(shape.join([(g := _plane(events_line(s, sf))), shape.flip(g, 0)], 0)), f"SELECT i0, i1, v FROM {_PLANE} UNION ALL SELECT {2 * WIDTH - 1} - i0, i1, v FROM {_PLANE}")
add("join_stack", lambda s, sf: _out(shape.join([(g := _plane(events_line(s, sf))), shape.flip(g, 0)], 1, True)), f"SELECT i0, 0 AS i1, i1 AS i2, v FROM {_PLANE} UNION ALL SELECT {WIDTH - 1} - i0, 1, i1, v FROM {_PLANE}")
add("splice", lambda s, sf: _out(shape.splice(g := _plane(events_line(s, sf)), 0, 2, shape.slice_at(g, 0, 5))), f"SELECT i0, i1, v FROM {_PLANE} WHERE i0 <> 2 UNION ALL SELECT 2, i1, v FROM {_PLANE} WHERE i0 = 5")
add("inset", lambda s, sf: _out(shape.inset(g := _plane(events_line(s, sf)), [3, 2], shape.crop(g, [0, 0], [4, 3]))), f"SELECT i0, i1, v FROM {_PLANE} WHERE NOT (i0 BETWEEN 3 AND 7 AND i1 BETWEEN 2 AND 5) UNION ALL SELECT i0 + 3, i1 + 2, v FROM {_PLANE} WHERE i0 <= 4 AND i1 <= 3")
_SRC = {"bleed": "least(greatest(i - 4, 0), {n} - 1)", "wrap": "((i - 4) % {n} + {n}) % {n}", "mirror": "CASE WHEN ((i - 4) % (2 * {n}) + 2 * {n}) % (2 * {n}) >= {n} THEN 2 * {n} - 1 - ((i - 4) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE ((i - 4) % (2 * {n}) + 2 * {n}) % (2 * {n}) END", "pad": "CASE WHEN i - 4 BETWEEN 0 AND {n} - 1 THEN i - 4 END"}
for _rule, _sql in _SRC.items():
    add(
        f"pad_{_rule}", lambda s, sf, r=_rule: _out(shape.pad(g := events_line(s, sf), [-4], [g.size + 2], r, 42.0)),
        f"WITH n AS (SELECT count(*) AS n FROM events), s AS (SELECT i, {_sql.format(n='n')} AS src FROM (SELECT unnest(generate_series(0, n + 6)) AS i, n FROM n)) SELECT i AS i0, coalesce(value, 42) AS v FROM s LEFT JOIN events ON event_id = src",
    )

# -- histograms -------------------------------------------------------------------------------------------------------
_HIST = f"SELECT k AS i0, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM (SELECT unnest(generate_series(0, 49)) AS k) LEFT JOIN (SELECT least(floor(50 * (v - lo) / (hi - lo)), 49) AS k, count(*) AS n FROM {_LINE}, {_R} GROUP BY 1) USING (k)"
add("histogram", lambda s, sf: _out(histograms.histogram(events_line(s, sf, F.col("value")), 50)), _HIST)
add("histogram_weighted", lambda s, sf: _out(histograms.histogram(g := events_line(s, sf), 50, weight=g), 6), _HIST.replace("count(*)", "sum(v)").replace("CAST(coalesce(n, 0) AS DOUBLE)", "round(coalesce(n, 0), 6)"))
add("axis_histogram", lambda s, sf: _out(histograms.axis_histogram(_plane(events_line(s, sf)), 1, 8)), f"SELECT i0, k AS i1, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM (SELECT unnest(generate_series(0, 7)) AS k) CROSS JOIN (SELECT unnest(generate_series(0, {WIDTH - 1})) AS i0) LEFT JOIN (SELECT i0, least(floor(8 * (v - lo) / (hi - lo)), 7) AS k, count(*) AS n FROM {_PLANE}, {_R} GROUP BY ALL) USING (i0, k)")
add(
    "joint_histogram",
    lambda s, sf: _out(histograms.joint_histogram([(g := events_line(s, sf)), shape.flip(g, 0)], [10, 12], [(0.0, 100.0), (0.0, 120.0)], [True, False])),
    "WITH p AS (SELECT a.value AS x, b.value AS y FROM events a JOIN events b ON b.event_id = (SELECT max(event_id) FROM events) - a.event_id), c AS (SELECT least(floor(10 * least(greatest(x, 0), 100) / 100), 9) AS i0, least(floor(12 * y / 120), 11) AS i1, count(*) AS n FROM p WHERE y BETWEEN 0 AND 120 GROUP BY ALL) SELECT i0, i1, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM (SELECT unnest(generate_series(0, 9)) AS i0) CROSS JOIN (SELECT unnest(generate_series(0, 11)) AS i1) LEFT JOIN c USING (i0, i1)",
)
add("otsu", lambda s, sf: s.createDataFrame([(round(histograms.otsu(histograms.histogram(events_line(s, sf), 64)), 6),)], "v double"))
add("equalize", lambda s, sf: _out(histograms.equalize(events_line(s, sf), 100), 6))
add("minmax", lambda s, sf: s.createDataFrame([E.value_range(events_line(s, sf, _missing(None)))], "lo double, hi double"), f"SELECT min(x) FILTER (isfinite(x)) AS lo, max(x) FILTER (isfinite(x)) AS hi FROM (SELECT {VALUE_SQL} AS x FROM events)")

# -- maps ---------------------------------------------------------------------------------------------------------------
_TABLE = [0.0, 10.0, 5.0, 7.5, 30.0]


def _sizes(s: SparkSession, sf: str) -> Grid:
    df = table(s, sf, "part")
    return from_table(df, ["p_partkey"], "p_size", (Axis(df.count()),))


_P = "(SELECT p_partkey AS i0, CAST(p_size AS DOUBLE) AS x FROM part)"
add("lut", lambda s, sf: _out(maps.lut(_sizes(s, sf), _TABLE, 0, 50)), f"SELECT i0, [0.0, 10.0, 5.0, 7.5, 30.0][CAST(least(floor(5 * x / 50), 4) AS INT) + 1]::DOUBLE AS v FROM {_P}")
add("regular_map", lambda s, sf: _out(maps.regular_map(_sizes(s, sf), _TABLE, 0, 50), 6), f"SELECT i0, round(CAST(a + (p - floor(least(p, 3))) * (b - a) AS DOUBLE), 6) AS v FROM (SELECT i0, p, [0.0, 10.0, 5.0, 7.5, 30.0][CAST(floor(least(p, 3)) AS INT) + 1] AS a, [0.0, 10.0, 5.0, 7.5, 30.0][CAST(floor(least(p, 3)) AS INT) + 2] AS b FROM (SELECT i0, x / 50 * 4 AS p FROM {_P}))")
add("irregular_map", lambda s, sf: _out(maps.irregular_map(_sizes(s, sf), [(0, 0), (10, 5), (12, -3), (40, 8), (60, 1)]), 6), f"WITH k AS (SELECT * FROM (VALUES (0, 10, 0, 5), (10, 12, 5, -3), (12, 40, -3, 8), (40, 60, 8, 1)) AS t(x0, x1, y0, y1)) SELECT i0, round(CAST(y0 + (x - x0) / (x1 - x0) * (y1 - y0) AS DOUBLE), 6) AS v FROM {_P} JOIN k ON x >= x0 AND x < x1")
add("substitute", lambda s, sf: _out(maps.substitute(_sizes(s, sf), [(1, 2), (2, 3), (50, 1)])), f"SELECT i0, CASE WHEN x IN (1, 2) THEN 3.0::DOUBLE WHEN x = 50 THEN 1.0 ELSE x END AS v FROM {_P}")
add("lut2", lambda s, sf: _out(maps.lut2(g := _sizes(s, sf), E.affine(g, 0, 50, 0, 1), [[1, 2, 3], [4, 5, 6]], (0, 50), (0, 1))), f"SELECT i0, [1, 2, 3, 4, 5, 6][CAST(least(floor(3 * x / 50), 2) + 3 * least(floor(2 * (x * 0.02) / 1), 1) AS INT) + 1]::DOUBLE AS v FROM {_P}")

# -- stencils -----------------------------------------------------------------------------------------------------------


def _resampled(kernel: str, samples: int, rule: str) -> Query:
    return lambda s, sf: _out(stencil.resample(_plane(events_line(s, sf)), 0, samples, kernel, rule), 6)


def _resample_sql(kernel: str, samples: int, rule: str) -> str:
    w = ", ".join(f"({o}, {i}, CAST({x!r} AS DOUBLE))" for o, i, x in stencil.weights(parse(kernel), WIDTH, samples, rule))
    return f"SELECT o AS i0, i1, round(sum(v * w), 6) AS v FROM {_PLANE} JOIN (VALUES {w}) AS t(o, s, w) ON i0 = s GROUP BY o, i1"


for _k, _n, _rule in (("box", 10, "bleed"), ("tent", 10, "bleed"), ("tent", 40, "mirror"), ("ctmr", 40, "wrap"), ("ctmr", 12, "bleed"), ("bspl3", 40, "bleed"), ("gauss:1.5,3", 25, "mirror"), ("hann:3", 30, "bleed")):
    add(f"resample_{_k.split(':')[0]}_{_n}_{_rule}", _resampled(_k, _n, _rule), _resample_sql(_k, _n, _rule))
add(
    "gaussian_blur", lambda s, sf: _out(stencil.gaussian_blur(_plane(events_line(s, sf)), 1, 1.0), 6),
    f"""WITH g AS {_PLANE}, w AS (SELECT d, exp(-d * d / 2.0) AS w FROM (SELECT unnest(range(-2, 3)) AS d))
    SELECT o.i0, o.i1, round(sum(g.v * w) / sum(w), 6) AS v FROM g o CROSS JOIN w JOIN g ON g.i0 = o.i0 AND g.i1 = least(greatest(o.i1 + d, 0), (SELECT n FROM {_N}) - 1) GROUP BY o.i0, o.i1""",
)
add(
    "cheap_median", lambda s, sf: _out(stencil.cheap_median(_plane(events_line(s, sf)), 0, 2, 256), 6),
    f"""WITH b AS (SELECT i0, i1, least(floor((v - lo) / (hi - lo) * 256), 255) AS b, lo, hi FROM {_PLANE}, {_R}),
    s AS (SELECT b.i0 + d AS i0, i1, b, lo, hi FROM b, (SELECT unnest(generate_series(-2, 2)) AS d)), c AS (SELECT i0, i1, b, lo, hi, count(*) AS c FROM s WHERE i0 BETWEEN 0 AND {WIDTH - 1} GROUP BY ALL),
    r AS (SELECT *, sum(c) OVER (PARTITION BY i0, i1 ORDER BY b) AS cum, sum(c) OVER (PARTITION BY i0, i1) AS al FROM c)
    SELECT i0, i1, round(any_value(lo) + (any_value(hi) - any_value(lo)) * min(b) / 255, 6) AS v FROM r WHERE cum * 2 > al GROUP BY i0, i1""",
)
add(
    "distance", lambda s, sf: _out(stencil.distance(_plane(events_line(s, sf)), 0, 100.0)),
    f"SELECT a.i0, a.i1, coalesce(min(abs(a.i0 - b.i0))::DOUBLE, CAST('infinity' AS DOUBLE)) AS v FROM {_PLANE} a LEFT JOIN (SELECT i0, i1 FROM {_PLANE} WHERE v >= 100) b USING (i1) GROUP BY a.i0, a.i1",
)


def _marks(s: SparkSession, sf: str) -> Grid:
    return events_line(s, sf, F.when(F.col("value") >= 40, 1.0).otherwise(0.0))


_CC = "(SELECT event_id AS i0, sum(o) OVER (ORDER BY event_id) - 1 AS l FROM (SELECT event_id, CASE WHEN (value >= 40) = lag(value >= 40) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS o FROM events))"
add("components", lambda s, sf: _out(stencil.components(_marks(s, sf))), f"SELECT i0, CAST(l AS DOUBLE) AS v FROM {_CC}")
add("component_sizes", lambda s, sf: _out(stencil.component_sizes(stencil.components(_marks(s, sf)))), f"SELECT CAST(l AS BIGINT) AS i0, CAST(count(*) AS DOUBLE) AS v FROM {_CC} GROUP BY l")
add("adjacency", lambda s, sf: stencil.adjacency(from_table(table(s, sf, "events"), ["event_id"], F.floor(F.col("value") / 50), (Axis(1),))), "SELECT DISTINCT CAST(least(a, b) AS BIGINT) AS a, CAST(greatest(a, b) AS BIGINT) AS b FROM (SELECT floor(value / 50) AS a, lag(floor(value / 50)) OVER (ORDER BY event_id) AS b FROM events) WHERE a <> b")
add("settle", lambda s, sf: _out(stencil.settle(events_line(s, sf, F.floor(F.col("value") / 50) * 3))), "SELECT event_id AS i0, CAST(dense_rank() OVER (ORDER BY floor(value / 50)) - 1 AS DOUBLE) AS v FROM events")


def _fft(s: SparkSession, sf: str) -> DataFrame:
    g = _plane(events_line(s, sf))
    pair = shape.join([g, g.with_value(F.lit(0.0))], 0, True)
    back = stencil.fft(stencil.fft(pair, 1), 1, inverse=True)
    return _out(shape.slice_at(back, 0, 0), 6)


add("fft_round_trip", _fft, f"SELECT i0, i1, round(v, 6) AS v FROM {_PLANE}")


def _probe(s: SparkSession, sf: str) -> DataFrame:
    points = table(s, sf, "events").filter("event_id < 200").select(F.col("event_id").alias("p"), (F.col("event_id") % 20 + 0.25).alias("x0"), (F.floor(F.col("event_id") / 20) + 0.5).alias("x1"))
    return stencil.probe(_plane(events_line(s, sf)), points).select("p", F.round("value", 6).alias("value"))


add(
    "probe_tent", _probe,
    f"SELECT p, round(0.75 * 0.5 * a.v + 0.25 * 0.5 * b.v + 0.75 * 0.5 * c.v + 0.25 * 0.5 * d.v, 6) AS value FROM (SELECT event_id AS p, event_id % 20 AS x, event_id // 20 AS y FROM events WHERE event_id < 200) JOIN {_PLANE} a ON a.i0 = x AND a.i1 = y JOIN {_PLANE} b ON b.i0 = x + 1 AND b.i1 = y JOIN {_PLANE} c ON c.i0 = x AND c.i1 = y + 1 JOIN {_PLANE} d ON d.i0 = x + 1 AND d.i1 = y + 1",
)


def _probe_whole(s: SparkSession, sf: str) -> DataFrame:
    """At one point an event, between its cell and the next ones; the last cells bleed."""
    e = F.col("event_id")
    points = table(s, sf, "events").select(e.alias("p"), (e % WIDTH + 0.25).alias("x0"), (F.floor(e / WIDTH) + 0.5).alias("x1"))
    return stencil.probe(_plane(events_line(s, sf)), points).select("p", F.round("value", 6).alias("value"))


add(
    "probe_tent_whole", _probe_whole,
    f"WITH g AS {_PLANE}, q AS (SELECT i0 + {WIDTH} * i1 AS p, i0 AS x, i1 AS y, least(i0 + 1, {WIDTH - 1}) AS x2, least(i1 + 1, n - 1) AS y2 FROM g, {_N}) SELECT p, round(0.75 * 0.5 * a.v + 0.25 * 0.5 * b.v + 0.75 * 0.5 * c.v + 0.25 * 0.5 * d.v, 6) AS value FROM q JOIN g a ON a.i0 = x AND a.i1 = y JOIN g b ON b.i0 = x2 AND b.i1 = y JOIN g c ON c.i0 = x AND c.i1 = y2 JOIN g d ON d.i0 = x2 AND d.i1 = y2",
)
add("pipe", lambda s, sf: _out(pipe.run(_plane(events_line(s, sf)), "crop -min 0 0 -max M-1 M | flip -a 0 | project -a 1 -m mean"), 6), f"SELECT {WIDTH - 2} - i0 AS i0, round(avg(v), 6) AS v FROM {_PLANE} WHERE i0 < {WIDTH - 1} GROUP BY i0")
add("compare", lambda s, sf: arrays.compare(g := events_line(s, sf), E.affine(g, 0, 100, 0, 100, True), 1e-9), "SELECT event_id AS i0, value AS a, 100.0::DOUBLE AS b FROM events WHERE value > 100.000000001")
add("windowed_measures", lambda s, sf: windows.windowed(table(s, sf, "events"), ["event_type"], ["min", "max", "sum"]).select("start", "event_type", "min", "max", F.round("sum", 4).alias("sum")), "SELECT CAST(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS start, event_type, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum FROM events GROUP BY ALL")

# -- tensors: one made from each event ------------------------------------------------------------------------------------
_TENSOR = "SELECT event_id, value AS a, user_id / 10.0 AS b, 3.0 AS c, value / 2 AS d, 1.0 AS e, 7.0 AS f FROM events"
_DET = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
_SQ = "(a * a + d * d + f * f + 2 * (b * b + c * c + e * e))"
_DEV = f"({_SQ} - (a + d + f) * (a + d + f) / 3)"
TENSOR_SQL = {"trace": "a + d + f", "norm": f"sqrt({_SQ})", "det": _DET, "fa": f"sqrt(1.5 * {_DEV} / {_SQ})", "mode": f"3 * sqrt(6) * ({_DET} - (a + d + f) / 3 * (a * d + a * f + d * f - b * b - c * c - e * e) + 2 * pow((a + d + f) / 3, 3)) / pow({_DEV}, 1.5)"}

TENSOR_SQL["first-eigenvalue"] = f"(a + d + f) / 3 + 2 * sqrt({_DEV} / 6) * cos(acos(least(greatest({TENSOR_SQL['mode']}, -1), 1)) / 3)"


def _tensor(name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        v = F.col("value")
        t = F.array(F.lit(1.0), v, F.col("user_id") / 10, F.lit(3.0), v / 2, F.lit(1.0), F.lit(7.0))
        return table(spark, sf, "events").select("event_id", F.round(tensor.masked(t, name), 5).alias("v"))

    return query


for _t in tensor.MEASURES:
    add(f"tensor_{_t.replace('-', '_')}", _tensor(_t), f"SELECT event_id, round({TENSOR_SQL[_t]}, 5) AS v FROM ({_TENSOR})" if _t in TENSOR_SQL else None)

# -- kernels by family, commands of the pipe, items of probed volumes ----------------------------------------------------
for _more in (kernel_queries, pipe_queries, probe_queries, tensor_queries):
    QUERIES.update(_more.QUERIES)
    ORACLES.update(_more.ORACLES)
