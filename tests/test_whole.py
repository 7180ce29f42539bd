"""Queries that must read every row of their tables, at two sizes."""

import pytest

from loomgrid import queries
from tests.oracle import compare

WHOLE = ("measure_product_whole", "probe_tent_whole", "tile_whole", "untile_whole")


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables(spark, name):
    sf = "/root/testdata/sf0.01"
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], sf)
    if name != "measure_product_whole":
        assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert "WHERE event_id <" not in queries.ORACLES[name] and "s_suppkey <" not in queries.ORACLES[name]


def test_tiles():
    assert [queries._tiles(n) for n in (1, 7, 12, 40, 400)] == [(1, 1), (1, 7), (3, 4), (5, 8), (20, 20)]
