"""Written tables and joins whose heavy keys are dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.core.lineage import components, cut, discard

#: Ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 400_000
#: Rows of one key that one task should join.
FAN = 1000


def small(ids: DataFrame) -> DataFrame:
    """Broadcast if it has no more than ``BROADCAST_IDS`` rows (of a few longs), else left to a shuffle join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def shares(pairs: DataFrame) -> DataFrame | None:
    """(side, id, shares), written: how many tasks join the rows of an id that ``pairs`` (a, b, written) has over ``FAN`` times on a side."""
    if pairs.count() <= FAN:
        return None
    ends = pairs.select(F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("id")) for s in ("a", "b")))).alias("e")).select("e.*")
    heavy = cut(ends.groupBy("side", "id").count().filter(F.col("count") > FAN).select("side", "id", F.ceil(F.col("count") / FAN).alias("shares")))
    if heavy.isEmpty():
        discard(heavy)
        return None
    return heavy


def dealt_join(pairs: DataFrame, side: str, right: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """``pairs`` with the columns of ``right`` whose id, of the same name, is that on ``side``; heavy ids are dealt.

    Their rows in ``pairs`` are dealt by a hash, and those in ``right`` (few an id) go to each share.
    """
    if heavy is None:
        return pairs.join(right, side)
    own = small(heavy.filter(F.col("side") == side).select(F.col("id").alias(side), "shares"))
    left = pairs.join(own, side, "left").withColumn("__share", F.expr("pmod(xxhash64(a, b), coalesce(shares, 1L))")).drop("shares")
    fanned = right.join(own, side, "left").withColumn("__share", F.expr("explode(sequence(0L, coalesce(shares, 1L) - 1L))")).drop("shares")
    return left.join(fanned, [side, "__share"]).drop("__share")


__all__ = ["BROADCAST_IDS", "components", "cut", "dealt_join", "discard", "shares", "small"]
