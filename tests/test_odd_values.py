"""Queries of single values against their SQL, to the last bit, on values that the given tables don't have."""

import struct

import duckdb
import pytest

from loomgrid import pipe_queries, queries
from loomgrid.operators import shape

VALUE = """CASE WHEN event_id % 13 = 0 THEN value * 1e17 WHEN event_id % 17 = 0 THEN -value * 1e200 WHEN event_id % 19 = 0 THEN value * 1e-9 WHEN event_id % 23 = 0 THEN -0.0
WHEN event_id % 29 = 0 THEN 1.7e308 WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 2 = 0 THEN round(value * 1.00001 + (event_id % 10) * 1e-7 + 5e-7, 7) ELSE value END"""
NAMES = ("ternary_clamp", "unary_rounddown", "ternary_add", "ternary_multiply", "unary_log", "unary_log2", "unary_reciprocal", "unary_sqrt", "ternary_lerp", "unary_floor", "unary_ceil", "unary_roundup")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    duckdb.sql(f"COPY (SELECT event_id, ts, user_id, event_type, CAST({VALUE} AS DOUBLE) AS value, props FROM '/root/testdata/sf0.01/events.parquet') TO '{path}/events.parquet'")
    return str(path)


def bits(v):
    return v if v is None else "nan" if v != v else struct.pack("<d", v)


@pytest.mark.parametrize("name", NAMES)
def test_odd_values(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{odd}/events.parquet'")
    want = {i: v for i, v in con.execute(f"SELECT i0, v FROM ({queries.ORACLES[name]})").fetchall()}
    got = {r.i0: r.v for r in queries.QUERIES[name](spark, odd).collect()}
    assert got.keys() == want.keys()
    assert [(i, got[i], want[i]) for i in want if bits(got[i]) != bits(want[i])] == []


def test_a_line_with_a_mean_at_the_threshold(spark, tmp_path):
    """Lines of 25 with means of 49, 50, 51, exactly: the SQL of pipe_sselect takes the last, that of slice_select the last two."""
    duckdb.sql(f"COPY (SELECT k AS event_id, CAST(49 + k // 25 + CASE WHEN k % 25 = 12 THEN 0 ELSE k % 25 - 12 END AS DOUBLE) AS value FROM range(75) t(k)) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(f"SELECT i0, i1, v FROM ({pipe_queries.ORACLES['pipe_sselect']}) ORDER BY ALL").fetchall()
    assert len(want) == 25
    assert sorted(map(tuple, pipe_queries.QUERIES["pipe_sselect"](spark, str(tmp_path)).collect())) == want
    g = pipe_queries.plane(spark, str(tmp_path))
    line = pipe_queries.other("line", spark, g)
    rows = {(side, strict): shape.slice_select(g, 1, line, 50.0, side == "above", strict).df.count() for side in ("above", "below") for strict in (False, True)}
    assert rows == {("above", False): 50, ("below", False): 25, ("above", True): 25, ("below", True): 50}
