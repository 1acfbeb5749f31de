"""Queries on what a change reaches: every supplier is a seed, the parts that it delivers are hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..operators import graph, symbols
from .registry import query

_HITS = """hits AS (SELECT l_suppkey AS seed, CAST(min(1 + l_linenumber % 3) AS INT) AS hop, CAST(l_suppkey % 5 AS INT) AS project, l_partkey AS id, min(l_returnflag) AS relation, CASE l_partkey % 4 WHEN 0 THEN 'api/' WHEN 1 THEN 'conf/' WHEN 2 THEN 'src/' END || l_partkey AS file_path, l_partkey % 7 = 0 AS test FROM lineitem GROUP BY l_suppkey, l_partkey)"""


def _hits(s, d):
    lines = catalog.table(s, d, "lineitem")
    rows = lines.groupBy(F.col("l_suppkey").alias("seed"), F.col("l_partkey").alias("id")).agg(F.min(1 + F.col("l_linenumber") % 3).cast("int").alias("hop"), F.min("l_returnflag").alias("relation"))
    k = F.col("id")
    path = F.concat(F.when(k % 4 == 0, "api/").when(k % 4 == 1, "conf/").when(k % 4 == 2, "src/"), k.cast("string"))
    return rows.select("seed", "hop", (F.col("seed") % 5).cast("int").alias("project"), "id", "relation", path.alias("file_path"), (k % 7 == 0).alias("test"))


@query(
    f"""WITH {_HITS}, provided AS (SELECT p_partkey AS id, p_brand AS kind, p_partkey // 3 AS name FROM part WHERE p_size < 10), taken AS (SELECT CAST(o_custkey % 5 AS INT) AS taker, p_brand AS kind, p_partkey // 3 AS name, min(o_orderkey) AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40 GROUP BY ALL),
    across AS (SELECT seed, 'cross_project' AS bucket, CAST(NULL AS INT) AS hop, taker AS project, min(first) AS id, kind, name FROM hits JOIN provided USING (id) JOIN taken USING (kind, name) WHERE taker <> project GROUP BY seed, taker, kind, name),
    rows AS (SELECT seed, CASE WHEN hop <= 1 THEN 'direct' ELSE 'indirect' END AS bucket, hop, project, id, '' AS kind, '' AS name FROM hits UNION ALL SELECT seed, 'tests', hop, project, id, '', '' FROM hits WHERE test
        UNION ALL SELECT seed, 'public_api', hop, project, id, '', '' FROM hits WHERE NOT test AND file_path LIKE 'api/%' UNION ALL SELECT seed, 'configuration', hop, project, id, '', '' FROM hits WHERE NOT test AND (relation = 'R' OR file_path LIKE 'conf/%')
        UNION ALL SELECT seed, bucket, hop, project, id, kind, CAST(name AS VARCHAR) FROM across),
    placed AS (SELECT seed, bucket, count(*) OVER (PARTITION BY seed, bucket) AS total, CAST(row_number() OVER (PARTITION BY seed, bucket ORDER BY hop NULLS FIRST, project, kind, name, id) AS INT) AS place, hop, project, id FROM rows)
    SELECT * FROM placed WHERE place <= 25"""
)
def impact_lists(s, d):
    """Buckets of all suppliers, takers of other projects among them, 25 hits each."""
    part, lines, orders = (catalog.table(s, d, t) for t in ("part", "lineitem", "orders"))
    name = [F.col("p_brand").alias("kind"), F.expr("p_partkey div 3").alias("name")]
    hits = _hits(s, d)
    provided = part.filter("p_size < 10").select(F.explode(F.expr("sequence(0, 4)")).alias("project"), *name, F.col("p_partkey").alias("id"))
    bought = lines.filter("l_quantity > 40").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    taken = bought.select((F.col("o_custkey") % 5).cast("int").alias("project"), *name, F.col("o_orderkey").alias("id"))
    return symbols.impact_lists(hits, symbols.crossings(hits, provided, taken), "^api/", "^conf/", ["R"])


@query(
    """WITH e AS (SELECT DISTINCT CAST(l_suppkey % 5 AS INT) AS project, 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_returnflag AS relation FROM lineitem),
    n AS (SELECT project, source AS of, 'outgoing' AS direction, relation, target AS id FROM e UNION ALL SELECT project, target, 'incoming', relation, source FROM e),
    placed AS (SELECT *, row_number() OVER (PARTITION BY project, of, direction, relation ORDER BY id) AS place, count(*) OVER (PARTITION BY project, of, direction, relation) AS total FROM n),
    turned AS (SELECT *, row_number() OVER (PARTITION BY project, of ORDER BY place, direction, relation, id) AS turn FROM placed)
    SELECT project, of, direction, relation, CAST(place AS INT) AS place, total, id FROM turned WHERE turn <= 30"""
)
def neighbour_lists(s, d):
    """Thirty neighbours of every part and supplier, relations in turn."""
    a, b = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    edges = catalog.table(s, d, "lineitem").select((F.col("l_suppkey") % 5).cast("int").alias("project"), a.alias("source"), b.alias("target"), F.col("l_returnflag").alias("relation"))
    asked = edges.select("project", F.col("source").alias("of")).union(edges.select("project", "target"))
    return graph.listed(edges, asked, 30)
