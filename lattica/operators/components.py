"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stage


def _forced(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on u; the second key makes both sides shuffles, so AQE can split a hot node."""
    check = F.hash("u")
    return left.withColumn("_c", check).join(right.withColumn("_c", check), ["u", "_c"]).drop("_c")


def _mark(edges: DataFrame) -> tuple:
    """Row count and order-free hashes; two rounds with one mark have the same edges. No sum can overflow."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Nodes are of any type that has an order. Each round links every node's larger neighbours
    to its smallest one, and then every node and its smaller neighbours to the smallest of
    them. Minima are combined map-side and no node's neighbours are ever gathered, so hubs
    cost no more than their edges. The number of rounds grows with the logarithm of the
    longest path, and a round's tables go when the next one is written. Edges with a null
    end are ignored; loops give a node of its own.
    """
    pair = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    first = now = stage(pair.distinct(), "components")
    now = now.filter("u != v")
    nodes = first.select("u").union(first.select("v")).distinct()
    seen = last = None
    while True:
        mark = _mark(now)
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = _forced(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _forced(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        now = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large, *([last] if last else []))
        last = now
    return nodes.select(F.col("u").alias("node")).join(now.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
