"""Queries on communities: parts that are bought one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..operators import graph, modularity
from .registry import query


def _bought_together(s, d) -> DataFrame:
    """Edges (source, target) between the parts of neighbouring lines of an order; as many nodes as parts."""
    lines = catalog.table(s, d, "lineitem")
    here = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source"))
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("target"))
    return here.join(after, ["l_orderkey", "l_linenumber"]).select("source", "target")


@query()
def modularity_communities(s, d):
    """(id, community, number, members) of every part."""
    parts = catalog.table(s, d, "part").select(F.col("p_partkey").alias("id"))
    found = modularity.communities(parts, _bought_together(s, d))
    return found.join(modularity.numbered(found), "community").select("id", "community", "number", "members")


@query(
    """WITH e AS (SELECT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
    x AS (SELECT p.p_brand AS ca, q.p_brand AS cb FROM e JOIN part p ON p.p_partkey = a JOIN part q ON q.p_partkey = b),
    k AS (SELECT c, count(*) AS k FROM (SELECT ca AS c FROM x UNION ALL SELECT cb FROM x) GROUP BY c)
    SELECT round(count(*) FILTER (ca = cb) / count(*) - (SELECT sum(k * k) FROM k) / (4.0 * count(*) * count(*)), 9) AS q FROM x"""
)
def modularity_of_brands(s, d):
    """The modularity of parts labelled by their brand."""
    brands = catalog.table(s, d, "part").select(F.lit(0).cast("long").alias("part"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return modularity.modularity(modularity.weighted(_bought_together(s, d)), brands).select(F.round("q", 9).alias("q"))


@query(
    """WITH x AS (SELECT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
    e AS (SELECT a, b FROM x UNION SELECT b, a FROM x), p AS (SELECT p_partkey AS s, p_partkey + 1 AS t FROM part),
    one AS (SELECT s, t, [s, t] AS path FROM p JOIN e ON e.a = s AND e.b = t),
    two AS (SELECT s, t, min([s, f.a, t]) AS path FROM p JOIN e ON e.a = s JOIN e f ON f.a = e.b AND f.b = t WHERE (s, t) NOT IN (SELECT (s, t) FROM one) GROUP BY s, t),
    three AS (SELECT s, t, min([s, e.b, f.b, t]) AS path FROM p JOIN e ON e.a = s JOIN e f ON f.a = e.b JOIN e g ON g.a = f.b AND g.b = t
        WHERE (s, t) NOT IN (SELECT (s, t) FROM one UNION ALL SELECT (s, t) FROM two) GROUP BY s, t),
    w AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)
    SELECT s AS start, t AS "end", CAST(len(path) - 1 AS INT) AS depth, array_to_string(path, ' ') AS path FROM p LEFT JOIN w USING (s, t)"""
)
def shortest_path_between(s, d):
    """A shortest walk of three hops at most from every part to the next."""
    pairs = catalog.table(s, d, "part").select(F.col("p_partkey").alias("start"), (F.col("p_partkey") + 1).alias("end"))
    return graph.paths_between(_bought_together(s, d), pairs, 3).withColumn("path", F.array_join("path", " "))
