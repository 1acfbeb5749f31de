"""Queries on packets from hits to links: a brand asks, its dearest parts are the hits, deliveries are the edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import catalog
from ..operators import expansion
from .registry import query

_GRAPH = """hits AS (SELECT packet, CAST(n - 1 AS INT) AS seed, project, id FROM (SELECT p_brand AS packet, CAST(p_partkey % 5 AS INT) AS project, 'p' || p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 8),
    e AS (SELECT DISTINCT CAST(l_partkey % 5 AS INT) AS project, 'p' || l_partkey AS p, 's' || l_suppkey AS s, ['contains', 'imports', 'calls', 'extends', 'uses'][CAST(l_orderkey % 5 + 1 AS INT)] AS relation, l_linenumber % 2 = 0 AS forth FROM lineitem),
    edges AS (SELECT project, CASE WHEN forth THEN p ELSE s END AS source, CASE WHEN forth THEN s ELSE p END AS target, relation FROM e),
    nodes AS (SELECT CAST(p_partkey % 5 AS INT) AS project, 'p' || p_partkey AS id, 'part' AS type, 'src/p' || p_size || '.py' AS file_path, p_partkey % 23 = 0 AS test, p_partkey % 3 > 0 AS described, p_partkey AS n FROM part
        UNION ALL SELECT project, 's' || s_suppkey, CASE WHEN s_suppkey % 17 = 0 THEN 'external_maker' WHEN s_suppkey % 5 = 0 THEN 'directory' ELSE 'maker' END, CASE WHEN s_suppkey % 11 = 0 THEN 'tests/s' ELSE 'src/s' END || s_suppkey % 29 || '.py', s_suppkey % 13 = 0, s_suppkey % 4 > 0, s_suppkey FROM supplier, (SELECT unnest(range(5))::INT AS project))"""


def graph(s, d):
    """Hits, edges and nodes."""
    t = lambda name: catalog.table(s, d, name)
    part, supplier = t("part"), t("supplier")
    own = [(F.col("p_partkey") % 5).cast("int").alias("project"), F.concat(F.lit("p"), "p_partkey").alias("id")]
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    hits = part.select(F.col("p_brand").alias("packet"), (place - 1).alias("seed"), *own).filter("seed < 8")
    relation = F.element_at(F.array(*map(F.lit, ("contains", "imports", "calls", "extends", "uses"))), (F.col("l_orderkey") % 5 + 1).cast("int"))
    a, b = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    forth = F.col("l_linenumber") % 2 == 0
    edges = t("lineitem").select((F.col("l_partkey") % 5).cast("int").alias("project"), F.when(forth, a).otherwise(b).alias("source"), F.when(forth, b).otherwise(a).alias("target"), relation.alias("relation")).distinct()
    k, m = F.col("p_partkey"), F.col("s_suppkey")
    parts = part.select(*own, F.lit("part").alias("type"), F.concat(F.lit("src/p"), "p_size", F.lit(".py")).alias("file_path"), (k % 23 == 0).alias("test"), (k % 3 > 0).alias("described"), k.alias("n"))
    path = F.concat(F.when(m % 11 == 0, "tests/s").otherwise("src/s"), (m % 29).cast("string"), F.lit(".py"))
    kind = F.when(m % 17 == 0, "external_maker").when(m % 5 == 0, "directory").otherwise("maker")
    makers = supplier.select(F.explode(F.expr("sequence(0, 4)")).alias("project"), F.concat(F.lit("s"), m).alias("id"), kind.alias("type"), path.alias("file_path"), (m % 13 == 0).alias("test"), (m % 4 > 0).alias("described"), m.alias("n"))
    n = F.col("n")
    lines = {"start_line": (n % 60 * 5).cast("int"), "end_line": (n % 60 * 5 + n % 9).cast("int"), "cost": (10 + n % 40).cast("int"), "chunk_cost": F.when(n % 3 > 0, 20 + n % 80).cast("int")}
    return hits, edges, parts.unionByName(makers).withColumns(lines)


@query(
    f"""WITH RECURSIVE {_GRAPH}, near AS (SELECT h.*, target AS node, relation, 'out' AS direction FROM hits h JOIN edges e ON e.project = h.project AND source = h.id UNION SELECT h.*, source, relation, 'in' FROM hits h JOIN edges e ON e.project = h.project AND target = h.id),
    ranked AS (SELECT packet, seed, project, near.id AS of, node, relation, direction, type, file_path, test, row_number() OVER (PARTITION BY packet, project, near.id ORDER BY described DESC, relation, node, direction DESC) AS rank FROM near JOIN nodes USING (project) WHERE nodes.id = node AND type <> 'external_maker'),
    tiered AS (SELECT *, CASE WHEN relation = 'contains' THEN CASE direction WHEN 'in' THEN 'container' ELSE 'defines' END WHEN test OR starts_with(file_path, 'tests/') THEN 'test' WHEN direction = 'in' THEN 'caller' WHEN relation IN ('imports', 'extends') THEN 'import' ELSE 'callee' END AS tier FROM ranked WHERE rank <= 40),
    marked AS (SELECT *, tier = 'caller' AND relation IN ('imports', 'extends') AS importer FROM tiered WHERE tier <> 'container' OR type <> 'directory'),
    lined AS (SELECT *, project || ':' || node AS key, project || ':' || of || ':' || tier || importer AS pot, greatest(CASE WHEN importer THEN 3 - seed WHEN tier = 'defines' THEN 8 - 2 * seed WHEN tier = 'import' THEN 3 - seed WHEN tier = 'test' THEN 4 WHEN tier = 'container' THEN 2 ELSE 8 END, 0) AS most,
        row_number() OVER (PARTITION BY packet ORDER BY project, of, rank) AS q FROM marked),
    walk AS (SELECT packet, CAST(0 AS BIGINT) AS q, list(project || ':' || id) AS taken, CAST([] AS VARCHAR[]) AS spent, false AS got, CAST(0 AS BIGINT) AS place, CAST(0 AS INT) AS seed, '' AS tier, CAST(0 AS INT) AS project, '' AS node FROM hits GROUP BY packet
        UNION ALL SELECT packet, q, CASE WHEN got THEN list_append(taken, key) ELSE taken END, CASE WHEN got THEN list_append(spent, pot) ELSE spent END, got, place, seed, tier, project, node FROM (
            SELECT *, place < most AND NOT list_contains(taken, key) AS got FROM (
                SELECT l.packet, l.q, w.taken, w.spent, l.seed, l.tier, l.project, l.node, l.key, l.pot, l.most, CAST(len(list_filter(w.spent, lambda x: x = l.pot)) AS BIGINT) AS place FROM walk w JOIN lined l ON l.packet = w.packet AND l.q = w.q + 1)))
    SELECT packet, CAST(1 AS INT) AS hop, seed, tier, place, project, node AS id FROM walk WHERE got"""
)
def packet_surroundings(s, d):
    """What the tiers of each packet keep around its hits."""
    return expansion.around(*graph(s, d))[0]


@query()
def packets_of_hits(s, d):
    """Whole packets of 1,200 tokens, callers and callees over two hops; tests compare them with a plain loop."""
    entries, links = expansion.packet(*graph(s, d), 1200, expansion.ONE_HOP | {"caller": 2, "callee": 2})
    none = lambda kind: F.lit(None).cast(kind)
    rows = entries.select("packet", "project", "id", "turn", "tier", "chunk", "cut", *(none("string").alias(c) for c in ("of", "relation", "direction")))
    return rows.unionByName(links.select("packet", "project", "id", none("long").alias("turn"), *(none(t).alias(c) for c, t in (("tier", "string"), ("chunk", "boolean"), ("cut", "boolean"))), "of", "relation", "direction"))
