import random

import pytest
from pyspark.sql import functions as F

from loomgrid.core import lineage


@pytest.mark.parametrize("block", [0, 1 << 20])
def test_components(spark, block):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(300, 200 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in lineage.components(spark.createDataFrame(edges, "a long, b long"), block=block).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_components_of_none(spark):
    assert lineage.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cut_and_numbered(spark):
    odd = spark.range(3).select("id", F.lit(None).alias("Id"))
    table = lineage.cut(odd)
    assert table.columns == ["id", "Id"] and sorted(r[0] for r in table.collect()) == [0, 1, 2]
    lineage.discard(table)
    values = spark.range(50).select((F.col("id") * 7 % 53).alias("k"))
    got = {r["k"]: r["n"] for r in lineage.numbered(values, "k", "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted(i * 7 % 53 for i in range(50)))}
