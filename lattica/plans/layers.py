"""Queries on layered data: a region is a space, its customers data files, its suppliers files of modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..operators import layers
from .registry import query

_DATA = """c AS (SELECT n_regionkey AS space, c_custkey AS k, 's' || c_nationkey AS site, c_mktsegment AS tier, 's' || (c_nationkey + 1) AS other FROM customer JOIN nation ON n_nationkey = c_nationkey),
    d AS (SELECT *, 'data/' || CASE k % 4 WHEN 0 THEN 'nodes/c' || k || '.yaml' WHEN 1 THEN 'tier/' || tier || '/' || site || '.yaml' WHEN 2 THEN site || '/' || tier || '-' || site || '.yaml' ELSE site || '/' || tier || '-' || other || '.yaml' END AS path FROM c),
    m AS (SELECT n_regionkey AS space, 'm' || s_suppkey % 20 AS module, s_suppkey % 3 AS j FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    mods AS (SELECT space, module, 'modules/' || module || '/' || CASE min(j) WHEN 0 THEN 'requires.yaml' WHEN 1 THEN 'code/main.py' ELSE '' END AS entry FROM m GROUP BY space, module),
    said AS (SELECT space, path, 'node' AS variable, 'c' || k AS value FROM d WHERE k % 4 = 0 UNION ALL SELECT space, path, 'tier', tier FROM d WHERE k % 4 IN (1, 2) UNION ALL SELECT space, path, 'site', site FROM d WHERE k % 4 IN (1, 2)),
    filled AS (SELECT space, variable, value, min(path) AS path FROM said GROUP BY ALL)"""


def _tables(s, d):
    """Patterns, files and entries of three layers a space, the last with a repeated variable."""
    nation = catalog.table(s, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("space"))
    patterns = [(0, "nodes/{node}.yaml"), (1, "tier/{tier}/{site}.yaml"), (2, "{site}/{tier}-{site}.yaml")]
    patterns = nation.select("space").distinct().select("space", F.lit("data/").alias("data_dir"), F.inline(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(p).alias("pattern")) for i, p in patterns))))
    customer = catalog.table(s, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    customer = customer.select("space", F.col("c_custkey").alias("k"), F.expr("'s' || c_nationkey AS site"), F.col("c_mktsegment").alias("tier"), F.expr("'s' || (c_nationkey + 1) AS other"))
    path = """'data/' || CASE k % 4 WHEN 0 THEN 'nodes/c' || k WHEN 1 THEN 'tier/' || tier || '/' || site WHEN 2 THEN site || '/' || tier || '-' || site ELSE site || '/' || tier || '-' || other END || '.yaml'"""
    data = customer.withColumn("path", F.expr(path))
    supplier = catalog.table(s, d, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    code = supplier.select("space", F.expr("'modules/m' || s_suppkey % 20 || element_at(array('/requires.yaml', '/code/main.py', '/notes.txt'), cast(s_suppkey % 3 + 1 as int)) AS path"))
    rows = ("'tier', tier || '', false", "'site', if(k % 5 = 0, other, site), false", "'node', 'c' || (k + 4), false", "'m' || k % 25, cast(null as string), false", "'modules', 'm' || k % 23, true")
    entries = F.expr(f"array({', '.join(f'struct({r})' for r in rows)})")
    return patterns, data.select("space", "path").union(code), data.select("space", "path", F.inline(entries).alias("key", "value", "listed"))


@query(
    f"""WITH {_DATA} SELECT d.space, d.path AS source, entry AS target, 'configures' AS relation FROM d JOIN mods ON mods.space = d.space AND module = 'm' || k % 25
    UNION SELECT d.space, d.path, entry, 'includes_module' FROM d JOIN mods ON mods.space = d.space AND module = 'm' || k % 23
    UNION SELECT d.space, d.path, f.path, 'selects' FROM d JOIN filled f ON f.space = d.space AND ((variable = 'tier' AND value = tier) OR (variable = 'site' AND value = CASE WHEN k % 5 = 0 THEN other ELSE site END) OR (variable = 'node' AND value = 'c' || (k + 4))) WHERE f.path <> d.path"""
)
def layered_edges(s, d):
    return layers.followed(*_tables(s, d))


@query(
    f"""WITH {_DATA} SELECT space, 'provided' AS way, 'deploy-module' AS kind, module AS name, 'modules/' || module || '/' AS path FROM mods
    UNION SELECT space, 'provided', 'deploy-role', value, path FROM filled
    UNION SELECT space, 'taken', 'deploy-module', 'm' || k % 23, path FROM d WHERE (space, 'm' || k % 23) NOT IN (SELECT (space, module) FROM mods)"""
)
def layered_names(s, d):
    return layers.names(*_tables(s, d))
