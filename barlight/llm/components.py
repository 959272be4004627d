"""Connected components by contraction in random order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.session import written


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for each end of an edge; component is the smallest node reachable.

    Every round each node moves to the neighbour (or itself) that a hash puts
    first, edges follow and loops vanish; the hash order keeps chains short, so
    the number of rounds is about the logarithm of the longest path. All steps
    are joins and minima, which combine before the shuffle, so a hub with any
    number of links is no hot spot. Null ends and loops are ignored; an empty
    input gives an empty result. The number of rounds is all that the driver sees.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    now = written(edges.where((a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    hops: list[DataFrame] = []
    while not now.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("to"))
        both = now.select("u", F.col("v").alias("w")).unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("w")))
        first = both.groupBy("u").agg(F.min(order(F.col("w"))).alias("m"))
        hop = written(first.select(F.col("u").alias("at"), F.least(F.col("m"), order(F.col("u")))["to"].alias("to")))
        hops.append(hop)
        p, q = hop.toDF("u", "pu"), hop.toDF("v", "qv")
        moved = now.join(p, "u").join(q, "v").where(F.col("pu") != F.col("qv"))
        now = written(moved.select(F.greatest("pu", "qv").alias("u"), F.least("pu", "qv").alias("v")).distinct())
    if not hops:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    at = hops[0].select(F.col("at").alias("node"), F.col("to").alias("root"))
    for hop in hops[1:]:
        at = at.join(hop.withColumnRenamed("at", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    at = written(at)
    least = at.groupBy("root").agg(F.min(F.least("node", "root")).alias("component"))
    return at.join(least, "root").select("node", "component")
