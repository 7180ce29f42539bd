"""Cutting lineage, connected components and numbering in order, on shared storage only."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Edges whose components one task finds.
EDGES = 1_000_000

#: Seconds from one collection of the driver's garbage to the next.
FREE_EVERY = 3.0

_freed = -FREE_EVERY
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset and all runs on this machine is one made."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = context.getCheckpointDir()
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read from there, so a lost executor costs no more than its tasks.

    The table stays until :func:`discard`; columns are stored by position, whatever their names.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    void = [isinstance(f.dataType, T.NullType) for f in df.schema]
    stored = df.toDF(*(f"c{i}" for i in range(len(void))))
    kept = [f"c{i}" for i, v in enumerate(void) if not v]
    stored.select(*kept, F.lit(None).cast("int").alias("none")).write.option("compression", "zstd").parquet(path)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, (f, v) in enumerate(zip(df.schema, void, strict=True)) if not v] + [T.StructField("none", T.IntegerType())])
    back = spark.read.schema(schema).parquet(path)
    out = back.select(*(F.lit(None).alias(f.name) if v else F.col(f"c{i}").alias(f.name) for i, (f, v) in enumerate(zip(df.schema, void, strict=True))))
    _written[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`cut` wrote and nothing reads any more, and has the driver drop what it can of old shuffles."""
    spark = None
    for df in tables:
        path = _written.pop(df, None)
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    global _freed
    if spark is not None and time.monotonic() > _freed + FREE_EVERY:
        spark._jvm.System.gc()  # shuffle files go once their plans are garbage on the driver
        _freed = time.monotonic()


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of these edges and the smallest node that each reaches: minima along edges, then pointer jumps."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, a: str = "a", b: str = "b", block: int = EDGES) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    More than ``block`` edges go through alternating large and small stars: each round is an aggregation of minima
    (combined before the shuffle) and a join back, so a node with very many edges is never gathered anywhere, and
    rounds grow with the logarithm of the longest path.  No more than that are one task's work.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    n, stamp = e.count(), None
    if n > block:
        e = cut(e.filter("u <> v").distinct())
    while n > block:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e, n = new, now[0]
        if now == stamp:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out = cut(roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
            discard(e)
            return out
        stamp = now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if parts:
            nodes, least = _forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for i in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(least[i : i + (1 << 16)])], names=["node", "component"])

    out = cut(e.filter("u <> v").repartition(1).mapInArrow(run, "node long, component long"))
    discard(e)
    return out


def numbered(values: DataFrame, by: str, name: str) -> DataFrame:
    """``values`` (distinct in ``by``) and the place of each in the order of ``by``, from 0.

    Rows are dealt by ranges of ``by``; places are counted within a range, and only one count a range is ordered
    in one task.
    """
    dealt = cut(values.repartitionByRange(by).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    within = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(by)))
    return within.join(sizes, "__range").select(*values.columns, (F.col("__base") + F.col("__at") - 1).alias(name))
