"""Queries over state: what is owed, cached, renamed, resolved, scheduled, linked."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import shapes
from ..functions import text as tx
from ..operators import links, resolution, state, symbols
from .registry import query

NOW = "2024-02-01 00:00:00"


def _t(s, d, name):
    return catalog.table(s, d, name)


def _now():
    return F.lit(NOW).cast("timestamp")


def _pick(key, *values):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


# --- owed work ----------------------------------------------------------------


@query(
    """WITH n AS (SELECT p_size AS project, 'f' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '@L' || p_partkey % 90 ELSE '' END AS id, CASE WHEN p_partkey % 9 = 0 THEN 'external_import' ELSE 'function' END AS type, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS summary, p_partkey FROM part),
    v AS (SELECT project, id, md5(CASE WHEN p_partkey % 4 = 0 THEN summary || '!' ELSE summary END) AS hash, CASE WHEN p_partkey % 6 = 0 THEN 'old' ELSE 'new' END AS model FROM n WHERE p_partkey % 3 > 0)
    SELECT project, id, coalesce(CAST(nullif(regexp_extract(id, '@L([0-9]+)$', 1), '') AS INT), 0) AS line FROM n WHERE summary <> '' AND type <> 'external_import'
    AND NOT EXISTS (SELECT 1 FROM v WHERE v.project = n.project AND v.id = n.id AND v.hash = md5(n.summary) AND model = 'new')"""
)
def summaries_owed(s, d):
    k = F.col("p_partkey")
    id_ = F.concat(F.lit("f"), k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit("@L"), (k % 90).cast("string"))).otherwise(""))
    nodes = _t(s, d, "part").select(F.col("p_size").alias("project"), id_.alias("id"), F.when(k % 9 == 0, "external_import").otherwise("function").alias("type"), F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("summary"), k)
    text = F.when(k % 4 == 0, F.concat("summary", F.lit("!"))).otherwise(F.col("summary"))
    vectors = nodes.filter(k % 3 > 0).select("project", "id", F.md5(text.cast("binary")).alias("hash"), F.when(k % 6 == 0, "old").otherwise("new").alias("model"))
    return state.summaries_owed(nodes, vectors, "new")


@query(
    """WITH dirs AS (SELECT 'region/' || r_regionkey || '/' AS id, r_regionkey AS k FROM region UNION ALL SELECT 'region/' || n_regionkey || '/nation/', 100 + n_regionkey FROM nation GROUP BY n_regionkey
        UNION ALL SELECT 'region/' || n_regionkey || '/nation/' || n_nationkey || '/', 200 + n_nationkey FROM nation),
    x AS (SELECT *, CASE WHEN k % 7 = 3 THEN 'manual' WHEN k % 7 = 4 THEN 'auto' ELSE 'llm' END AS source, k % 11 = 0 AS stale, k % 5 = 1 AS skipped FROM dirs),
    own AS (SELECT id FROM x WHERE source <> 'manual' AND NOT skipped AND (source = 'auto' OR stale)),
    moving AS (SELECT id FROM own UNION SELECT 'region/' || n_regionkey || '/nation/' || n_nationkey || '/customer/1' FROM nation WHERE n_nationkey % 6 = 0)
    SELECT DISTINCT x.id FROM x WHERE x.id IN (SELECT id FROM own) OR (source <> 'manual' AND NOT skipped AND EXISTS (SELECT 1 FROM moving m WHERE m.id <> x.id AND starts_with(m.id, x.id)))"""
)
def owed_directories(s, d):
    nation, region = _t(s, d, "nation"), _t(s, d, "region")
    text = lambda c: F.col(c).cast("string")
    one = F.concat(F.lit("region/"), text("n_regionkey"), F.lit("/nation/"))
    dirs = region.select(F.concat(F.lit("region/"), text("r_regionkey"), F.lit("/")).alias("id"), F.col("r_regionkey").cast("long").alias("k"))
    dirs = dirs.union(nation.select(one.alias("id"), (100 + F.col("n_regionkey")).cast("long")).distinct())
    dirs = dirs.union(nation.select(F.concat(one, text("n_nationkey"), F.lit("/")), (200 + F.col("n_nationkey")).cast("long")))
    k = F.col("k")
    rows = dirs.select(
        "id", F.when(k % 7 == 3, "manual").when(k % 7 == 4, "auto").otherwise("llm").alias("source"), F.lit("a").alias("described"), F.when(k % 11 == 0, "b").otherwise("a").alias("wanted"), F.when(k % 5 == 1, 6).otherwise(4).alias("skip")
    )
    changing = nation.filter("n_nationkey % 6 = 0").select(F.concat(one, text("n_nationkey"), F.lit("/customer/1")).alias("id"))
    return state.owed_directories(rows, changing)


@query(
    """SELECT id, kind, CAST(rank AS INT) AS rank FROM (SELECT 'region/' || n_regionkey || '/nation/' || n_nationkey || '/' AS id, 'directory' AS kind, 996 AS rank FROM nation
    UNION ALL SELECT 'region/' || r_regionkey || '/', 'directory', 998 FROM region UNION ALL SELECT 'c' || c_custkey, 'file', 0 FROM customer UNION ALL SELECT 's' || s_suppkey, 'entity', 2000 FROM supplier)"""
)
def work_order(s, d):
    text = lambda c: F.col(c).cast("string")
    dirs = _t(s, d, "nation").select(F.concat(F.lit("region/"), text("n_regionkey"), F.lit("/nation/"), text("n_nationkey"), F.lit("/")).alias("id"))
    dirs = dirs.union(_t(s, d, "region").select(F.concat(F.lit("region/"), text("r_regionkey"), F.lit("/"))))
    files = _t(s, d, "customer").select(F.concat(F.lit("c"), text("c_custkey")).alias("id"))
    return state.work_order(files, dirs, _t(s, d, "supplier").select(F.concat(F.lit("s"), text("s_suppkey")).alias("id")))


@query("SELECT d.doc_id, m.summary FROM documents d LEFT JOIN (SELECT sha256(text) AS key, min('s' || doc_id) AS summary FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL GROUP BY 1) m ON sha256(d.text) = m.key")
def memoised_summaries(s, d):
    docs = _t(s, d, "documents").select("doc_id", "text")
    cache = docs.filter("doc_id % 2 = 0 and text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("summary"))
    return state.memoised(docs, cache).select("doc_id", "summary")


@query(
    """WITH o AS (SELECT o_custkey % 50 AS project, o_orderstatus AS a, o_orderpriority AS b FROM orders), a AS (SELECT project, a AS v, count(*) AS n FROM o GROUP BY 1, 2), b AS (SELECT project, b AS v, count(*) AS n FROM o GROUP BY 1, 2)
    SELECT project, total, statuses, priorities FROM (SELECT project, count(*) AS total FROM o GROUP BY 1) JOIN (SELECT project, string_agg(v || '=' || n, ',' ORDER BY v) AS statuses FROM a GROUP BY 1) USING (project)
    JOIN (SELECT project, string_agg(v || '=' || n, ',' ORDER BY v) AS priorities FROM b GROUP BY 1) USING (project)"""
)
def listing_cache(s, d):
    rows = _t(s, d, "orders").select((F.col("o_custkey") % 50).alias("project"), "o_orderstatus", "o_orderpriority")
    out = state.listing(rows, ["o_orderstatus", "o_orderpriority"])
    shown = lambda c: shapes.entries_text(F.transform_values(f"by_{c}", lambda k, v: v.cast("string")))
    return out.select("project", "total", shown("o_orderstatus").alias("statuses"), shown("o_orderpriority").alias("priorities"))


@query(
    """SELECT 'customer' AS "table", CASE WHEN c_nationkey = 3 THEN 99 ELSE c_nationkey END AS project, count(*) AS n FROM customer WHERE c_nationkey <> 5 GROUP BY ALL UNION ALL
    SELECT 'supplier', CASE WHEN s_nationkey = 3 THEN 99 ELSE s_nationkey END, count(*) FROM supplier WHERE s_nationkey <> 5 GROUP BY ALL"""
)
def project_renamed(s, d):
    """One project renamed and another dropped in every table."""
    tables = {"customer": _t(s, d, "customer").select(F.col("c_nationkey").alias("project")), "supplier": _t(s, d, "supplier").select(F.col("s_nationkey").alias("project"))}
    columns = {t: ["project"] for t in tables}
    left, _ = state.dropped(state.renamed(tables, columns, 3, 99), columns, 5)
    out = [df.groupBy(F.lit(t).alias("table"), "project").agg(F.count(F.lit(1)).alias("n")) for t, df in left.items()]
    return out[0].union(out[1])


@query("""SELECT 'customer' AS "table", count(*) AS rows FROM customer WHERE c_nationkey = 5 UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey = 5 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey = 5""")
def drop_report(s, d):
    tables = {t: _t(s, d, t) for t in ("customer", "nation", "supplier")}
    return state.dropped(tables, {t: [f"{t[0]}_nationkey"] for t in tables}, 5)[1]


@query(
    """WITH gone AS (SELECT o_orderkey % 50 AS project, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'), e AS (SELECT o_orderkey % 50 AS project, o_orderkey AS source, o_orderkey + 50 AS target FROM orders)
    SELECT 'edges' AS kind, count(*) AS n FROM e WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone) UNION ALL SELECT 'chunks', count(*) FROM orders WHERE o_orderstatus <> 'P'"""
)
def dependents_dropped(s, d):
    o = _t(s, d, "orders")
    key = (F.col("o_orderkey") % 50).alias("project")
    edges = o.select(key, F.col("o_orderkey").alias("source"), (F.col("o_orderkey") + 50).alias("target"))
    left, chunks = state.without_dependents(o.filter("o_orderstatus = 'P'").select(key, F.col("o_orderkey").alias("id")), edges, o.select(key, F.col("o_orderkey").alias("id")))
    count = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count("edges", left).union(count("chunks", chunks))


# --- settings -----------------------------------------------------------------


@query(
    """SELECT n_nationkey AS project, n_nationkey % 4 <> 1 AS allowed, CASE WHEN n_nationkey % 4 <> 1 THEN CASE WHEN n_nationkey % 3 = 0 THEN 5 ELSE 7 END END AS batch,
    CASE WHEN n_nationkey % 4 = 1 THEN 'global' WHEN n_nationkey % 3 = 0 THEN 'project' ELSE 'default' END AS batch_origin FROM nation"""
)
def feature_gate(s, d):
    from ..operators import relational

    n, key = _t(s, d, "nation"), F.col("n_nationkey").alias("project")
    levels = n.select(key, F.lit(0).alias("rank"), F.lit("project").alias("origin"), F.when(F.col("n_nationkey") % 3 == 0, 5).alias("batch"), F.lit(True).alias("allowed"))
    levels = levels.union(n.select(key, F.lit(1), F.lit("global"), F.lit(None).cast("int"), F.col("n_nationkey") % 4 != 1))
    levels = levels.union(n.select(key, F.lit(2), F.lit("default"), F.lit(7), F.lit(True)))
    return state.gated(levels, relational.nearest_level(levels, ["project"], ["batch"]), "project", ["batch"])


@query(
    """SELECT n_nationkey AS project, 'global.log' || CASE WHEN n_regionkey % 2 = 0 THEN chr(10) || 'org' || n_regionkey ELSE '' END || CASE WHEN n_nationkey % 3 > 0 THEN chr(10) || 'own' || n_nationkey ELSE '' END AS document FROM nation"""
)
def ignore_documents(s, d):
    n, key = _t(s, d, "nation"), F.col("n_nationkey").alias("project")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    levels = n.select(key, F.lit(0).alias("rank"), F.when(F.col("n_nationkey") % 3 > 0, text("own", "n_nationkey")).otherwise(" ").alias("document"))
    levels = levels.union(n.select(key, F.lit(1), F.when(F.col("n_regionkey") % 2 == 0, text("org", "n_regionkey")))).union(n.select(key, F.lit(2), F.lit("global.log")))
    return state.summed_documents(levels, "project")


@query(
    """WITH k AS (SELECT n_nationkey AS project, n_regionkey AS org, s.id, s.name, s.owner, s.rank, s.standard FROM nation, (SELECT unnest([1, 2, 3, 4, 5]) AS id, unnest(['core', 'plan', 'plan', 'trace', 'core']) AS name, unnest(['global', 'global', 'org', 'own', 'own']) AS owner, unnest([2, 2, 1, 0, 0]) AS rank,
        unnest([true, false, true, true, true]) AS standard) s WHERE s.rank < 2 OR n_nationkey >= 0),
    x AS (SELECT *, CASE WHEN id = 1 THEN true WHEN id = 5 THEN coalesce(CASE WHEN project % 2 = 0 THEN false END, standard) WHEN id = 2 THEN coalesce(CASE WHEN project % 5 = 0 THEN false END, CASE WHEN org = 1 THEN true END, standard)
        WHEN id = 3 THEN coalesce(CASE WHEN org = 2 THEN false END, standard) ELSE standard END AS enabled FROM k)
    SELECT project, name, arg_min(owner, rank) AS owner FROM x WHERE enabled GROUP BY ALL"""
)
def effective_skills(s, d):
    n, key = _t(s, d, "nation"), F.col("n_nationkey").alias("project")
    skills = s.createDataFrame([(1, "core", "global", 2, True), (2, "plan", "global", 2, False), (3, "plan", "org", 1, True), (4, "trace", "own", 0, True), (5, "core", "own", 0, True)], "id int, name string, owner string, rank int, standard boolean")
    candidates = n.select(key).crossJoin(F.broadcast(skills))  # five entries
    switch = lambda where, id_, rank, on: n.filter(where).select(key, F.lit(id_).alias("id"), F.lit(rank).alias("rank"), F.lit(on).alias("enabled"))
    switches = switch("n_nationkey % 2 = 0", 5, 0, False).union(switch("n_nationkey % 5 = 0", 2, 0, False)).union(switch("n_regionkey = 1", 2, 1, True)).union(switch("n_regionkey = 2", 3, 1, False))
    return state.effective(candidates, switches, F.col("id") == 1)


@query("SELECT count(*) AS n FROM part WHERE p_size & 4 <> 0")
def bitmask_skips(s, d):
    return _t(s, d, "part").filter(F.col("p_size").bitwiseAND(F.lit(4).cast("int")) != 0).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH l AS (SELECT DISTINCT c_nationkey AS source, s_nationkey AS target, 'c' || min(o_custkey) AS source_node, 's' || min(l_suppkey) AS target_node FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
    SELECT source, target, CASE WHEN source % 5 = 2 THEN source_node END AS source_node, CASE WHEN target % 5 = 2 THEN target_node END AS target_node FROM l WHERE source % 5 = 2 OR target % 5 = 2"""
)
def access_masked(s, d):
    lines = _t(s, d, "lineitem").join(_t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(_t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    node = lambda p, c: F.concat(F.lit(p), F.min(c).cast("string"))
    rows = lines.groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target")).agg(node("c", "o_custkey").alias("source_node"), node("s", "l_suppkey").alias("target_node"))
    held = _t(s, d, "nation").filter("n_nationkey % 5 = 2").select(F.col("n_nationkey").alias("project"))
    return state.masked(rows, held, ["source", "target"], ["source_node", "target_node"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def constant_project_hidden(s, d):
    """The listing of one project leaves its column out."""
    return state.without_constant(_t(s, d, "customer").filter("c_nationkey = 3").select("c_nationkey", "c_custkey", "c_name"), "c_nationkey")


@query("SELECT i AS place, n_nationkey, n_name FROM (SELECT unnest([7, 3, 19, 3]) AS k, unnest([0, 1, 2, 3]) AS i) JOIN nation ON n_nationkey = k")
def ordinal_join(s, d):
    asked = s.range(1).select(F.posexplode(F.array(*map(F.lit, (7, 3, 19, 3)))).alias("place", "k"))
    return _t(s, d, "nation").join(F.broadcast(asked), F.col("n_nationkey") == F.col("k")).select("place", "n_nationkey", "n_name")


# --- queue and feeds ----------------------------------------------------------

_QUEUE = """q AS (SELECT c_custkey AS task, 'h' || c_custkey % 7 AS hash, ['waiting', 'leased', 'done', 'leased'][CAST(c_custkey % 4 + 1 AS INT)] AS state, c_custkey % 3 AS tries,
    CASE WHEN c_custkey % 4 = 1 THEN TIMESTAMP '2024-01-31' WHEN c_custkey % 4 = 3 THEN TIMESTAMP '2024-02-02' END AS until FROM customer)"""


def _queue(s, d):
    k = F.col("c_custkey")
    until = F.when(k % 4 == 1, "2024-01-31 00:00:00").when(k % 4 == 3, "2024-02-02 00:00:00").cast("timestamp")
    return _t(s, d, "customer").select(k.alias("task"), F.concat(F.lit("h"), (k % 7).cast("string")).alias("hash"), _pick(k, "waiting", "leased", "done", "leased").alias("state"), (k % 3).alias("tries"), until.alias("until"))


_LEASES = """q AS (SELECT c_custkey AS task, 'h' || c_custkey % 7 AS hash,
    CASE WHEN c_custkey % 4 = 0 OR c_custkey % 8 = 1 THEN TIMESTAMP '2024-01-30' + INTERVAL 1 SECOND * (c_custkey % 11) END AS since,
    CASE WHEN c_custkey % 4 = 1 THEN TIMESTAMP '2024-01-31' WHEN c_custkey % 4 = 3 THEN TIMESTAMP '2024-02-02' END AS until, c_custkey % 3 AS tries,
    CASE WHEN c_custkey % 4 = 2 THEN 'h' || c_custkey % 7 || '|v1|' || (c_custkey % 2 + c_custkey % 3 % 2) END AS done, CASE WHEN c_custkey % 12 = 6 THEN 'broken' END AS error FROM customer)"""
_LEASE_COLUMNS = "task, hash, strftime(since, '%Y-%m-%d %H:%M:%S.%f') AS since, strftime(until, '%Y-%m-%d %H:%M:%S.%f') AS until, tries, done, error"


def _shown(rows):
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("since", "until")})


def _leases(s, d):
    k = F.col("c_custkey")
    own = F.concat(F.lit("h"), (k % 7).cast("string"))
    return _t(s, d, "customer").select(
        k.alias("task"), own.alias("hash"),
        F.when((k % 4 == 0) | (k % 8 == 1), F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-30").cast("timestamp")) + k % 11)).alias("since"),
        F.when(k % 4 == 1, "2024-01-31 00:00:00").when(k % 4 == 3, "2024-02-02 00:00:00").cast("timestamp").alias("until"), (k % 3).alias("tries"),
        F.when(k % 4 == 2, F.concat_ws("|", own, F.lit("v1"), (k % 2 + k % 3 % 2).cast("string"))).alias("done"), F.when(k % 12 == 6, "broken").alias("error"),
    )


@query(
    f"""WITH {_LEASES}, n AS (SELECT c_custkey AS task, 'h' || c_custkey % 7 AS hash, c_custkey AS place FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'h' || c_custkey % 5, c_custkey + 7 FROM customer WHERE c_custkey % 9 = 0
        UNION ALL SELECT -c_custkey - 1, 'new' || c_custkey % 2, c_custkey FROM customer WHERE c_custkey % 10 < 2 UNION ALL SELECT -c_custkey - 1, 'newer', c_custkey + 3 FROM customer WHERE c_custkey % 20 = 0),
    g AS (SELECT task, max_by(hash, place) AS h, min(place) AS place FROM n GROUP BY task),
    j AS (SELECT coalesce(q.task, g.task) AS task, q.hash, since, until, tries, done, error, h, place, place IS NOT NULL AND NOT coalesce(h = q.hash AND (since IS NOT NULL OR until IS NOT NULL), false) AND NOT coalesce(done = h || '|v1|1', false) AS put FROM q FULL JOIN g ON q.task = g.task),
    r AS (SELECT task, CASE WHEN put THEN h ELSE hash END AS hash, CASE WHEN put THEN coalesce(since, TIMESTAMP '2024-02-01' + INTERVAL 1 MICROSECOND * place) ELSE since END AS since, until, CASE WHEN put THEN 0 ELSE tries END AS tries,
        CASE WHEN NOT put THEN done END AS done, CASE WHEN NOT put THEN error END AS error FROM j)
    SELECT {_LEASE_COLUMNS} FROM r"""
)
def queue_enqueued(s, d):
    k = F.col("c_custkey")
    rows = _t(s, d, "customer")
    name = lambda n: F.concat(F.lit("h"), (k % n).cast("string"))
    new = rows.filter(k % 3 > 0).select(k.alias("task"), name(7).alias("hash"), k.alias("place")).union(rows.filter(k % 9 == 0).select(k, name(5), k + 7))
    new = new.union(rows.filter(k % 10 < 2).select(-k - 1, F.concat(F.lit("new"), (k % 2).cast("string")), k)).union(rows.filter(k % 20 == 0).select(-k - 1, F.lit("newer"), k + 3))
    return _shown(state.enqueued(_leases(s, d), new, _now(), "v1"))


@query(
    f"""WITH {_LEASES}, r AS (SELECT task, hash, CASE WHEN until <= TIMESTAMP '2024-02-01' THEN coalesce(since, TIMESTAMP '2024-02-01') ELSE since END AS since, CASE WHEN until > TIMESTAMP '2024-02-01' THEN until END AS until, tries, done, error FROM q),
    p AS (SELECT task FROM r WHERE since IS NOT NULL ORDER BY since, task LIMIT 100),
    x AS (SELECT task, hash, CASE WHEN task NOT IN (SELECT task FROM p) THEN since END AS since, CASE WHEN task IN (SELECT task FROM p) THEN TIMESTAMP '2024-02-01 00:10:00' ELSE until END AS until, tries + (task IN (SELECT task FROM p))::INT AS tries, done, error FROM r)
    SELECT {_LEASE_COLUMNS} FROM x"""
)
def queue_claimed(s, d):
    return _shown(state.claimed(_leases(s, d), _now(), 600, 100))


@query(
    f"""WITH {_LEASES}, o AS (SELECT c_custkey AS task, ['finish', 'release', 'fail'][CAST(c_custkey % 3 + 1 AS INT)] AS outcome, 'h' || (c_custkey % 2 * 3 + c_custkey % 7) AS h, c_custkey % 2 AS empty, 'E' || c_custkey % 4 AS e FROM customer WHERE c_custkey % 5 > 0),
    x AS (SELECT q.task, hash, CASE WHEN outcome = 'release' AND until IS NOT NULL OR outcome = 'fail' AND tries < 2 THEN coalesce(since, TIMESTAMP '2024-02-01') WHEN outcome = 'fail' THEN NULL ELSE since END AS since, CASE WHEN outcome IS NULL THEN until END AS until,
        CASE WHEN outcome = 'finish' THEN 0 WHEN outcome = 'release' AND until IS NOT NULL THEN greatest(tries - 1, 0) ELSE tries END AS tries, CASE WHEN outcome = 'finish' AND hash = h THEN h || '|v1|' || empty ELSE done END AS done,
        CASE WHEN outcome = 'fail' AND tries >= 2 THEN e WHEN outcome = 'finish' THEN NULL ELSE error END AS error FROM q LEFT JOIN o ON q.task = o.task)
    SELECT {_LEASE_COLUMNS} FROM x"""
)
def queue_settled(s, d):
    k = F.col("c_custkey")
    outcomes = _t(s, d, "customer").filter(k % 5 > 0).select(
        k.alias("task"), _pick(k, "finish", "release", "fail").alias("outcome"), F.concat(F.lit("h"), (k % 2 * 3 + k % 7).cast("string")).alias("hash"), (k % 2).alias("empty"), F.concat(F.lit("E"), (k % 4).cast("string")).alias("error")
    )
    return _shown(state.settled(_leases(s, d), outcomes, _now(), 2, "v1"))


@query(f"WITH {_QUEUE} SELECT state, count(*) AS n FROM q GROUP BY state")
def queue_depths(s, d):
    return _queue(s, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH p AS (SELECT user_id AS project, max(ts) + INTERVAL 1 DAY AS due, user_id % 7 = 0 AS busy FROM events GROUP BY user_id), r AS (SELECT project, CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) - CAST(floor(epoch(due)) AS BIGINT) AS late FROM p WHERE NOT busy), l AS (SELECT * FROM r WHERE late >= 0)
    SELECT project, late, project IN (SELECT project FROM l ORDER BY late DESC, project LIMIT 4) AS start FROM l"""
)
def overdue_first(s, d):
    rows = _t(s, d, "events").groupBy(F.col("user_id").alias("project")).agg((F.max("ts") + F.expr("interval 1 day")).alias("due")).withColumn("busy", F.col("project") % 7 == 0)
    return state.overdue_first(rows, _now(), 2, 6)


@query(
    """SELECT DISTINCT time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS at, user_id AS project FROM events UNION ALL SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY, NULL FROM events"""
)
def coalesced_recounts(s, d):
    return state.recounts(_t(s, d, "events").select("ts", F.col("user_id").alias("project")), "1 hour", "1 day")


@query(
    """WITH c AS (SELECT user_id AS project, ts, CASE event_type WHEN 'signup' THEN 'resync' WHEN 'error' THEN 'removed' ELSE 'changed' END AS kind, 'f' || event_id % 40 AS path FROM events),
    r AS (SELECT project, max(ts) AS since FROM c WHERE kind = 'resync' GROUP BY 1), o AS (SELECT project, path, arg_max(kind, ts) AS action FROM c LEFT JOIN r USING (project) WHERE kind <> 'resync' AND (since IS NULL OR ts > since) GROUP BY 1, 2),
    l AS (SELECT DISTINCT user_id AS project, 'f' || event_id % 15 AS path FROM events)
    SELECT * FROM o UNION ALL SELECT project, path, 'changed' FROM l SEMI JOIN r USING (project) WHERE (project, path) NOT IN (SELECT project, path FROM o)"""
)
def change_feed(s, d):
    path = lambda n: F.concat(F.lit("f"), (F.col("event_id") % n).cast("string")).alias("path")
    kind = F.when(F.col("event_type") == "signup", "resync").when(F.col("event_type") == "error", "removed").otherwise("changed")
    changes = _t(s, d, "events").select(F.col("user_id").alias("project"), "ts", kind.alias("kind"), path(40))
    return state.after_resync(changes, _t(s, d, "events").select(F.col("user_id").alias("project"), path(15)).distinct())


@query("SELECT p_brand AS name, round(avg(p_size), 6) AS value, 25.0::DOUBLE AS base, round(avg(p_size), 6) < 25 - 0.02 AS regressed FROM part GROUP BY p_brand")
def regression_gate(s, d):
    now = _t(s, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round(F.avg("p_size"), 6).alias("value"))
    return state.regressed(now, now.select("name", F.lit(25.0).alias("value")))


@query(
    """WITH g AS (SELECT p_type AS community, count(*) AS members, min(p_partkey) AS first FROM part GROUP BY 1) SELECT community, CAST(row_number() OVER (ORDER BY members DESC, first) AS INT) AS number, members FROM g"""
)
def numbered_communities(s, d):
    return state.numbered_groups(_t(s, d, "part").select(F.col("p_type").alias("community"), F.col("p_partkey").alias("id")), "community")


# --- resolution ---------------------------------------------------------------

_FILES = "files AS (SELECT p_partkey AS k, 'src/' || lower(p_type) || '/m' || p_size || '/' || replace(p_name, ' ', '_') || ['.py', '.c', '.h', '.ts'][CAST(p_partkey % 4 + 1 AS INT)] AS path FROM part)"


def _files(s, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/m"), F.col("p_size").cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), _pick(k, ".py", ".c", ".h", ".ts"))
    return _t(s, d, "part").select(k.alias("k"), path.alias("path"))


@query(
    f"""WITH {_FILES}, c AS (SELECT DISTINCT a.k AS reference, b.path AS target, CASE WHEN split_part(a.path, '/', 2) <> split_part(b.path, '/', 2) THEN 1 WHEN split_part(a.path, '/', 3) <> split_part(b.path, '/', 3) THEN 2 ELSE 3 END AS shared FROM files a JOIN files b ON b.k = a.k + 3 OR b.k = a.k + 7 OR b.k = a.k + 11),
    n AS (SELECT reference, shared, count(*) AS n, min(target) AS target FROM c GROUP BY 1, 2)
    SELECT reference, target FROM n WHERE shared = (SELECT max(shared) FROM n m WHERE m.reference = n.reference) AND n = 1"""
)
def nearest_by_path(s, d):
    files = _files(s, d)
    asks = files.select(F.col("k").alias("reference"), "path", F.explode(F.array(F.col("k") + 3, F.col("k") + 7, F.col("k") + 11)).alias("t"))
    return resolution.nearest(asks.join(files.select(F.col("k").alias("t"), F.col("path").alias("target")), "t"))


@query(
    f"""WITH {_FILES}, f AS (SELECT DISTINCT path FROM files), e AS (SELECT path, unnest([path, regexp_replace(path, '^src/', ''), regexp_replace(path, '^src/[^/]*/', ''), regexp_replace(path, '^.*/', '')]) AS suffix FROM f),
    u AS (SELECT suffix, min(path) AS path FROM e GROUP BY 1 HAVING count(*) = 1) SELECT k AS reference, u.path FROM files JOIN u ON u.suffix = regexp_replace(files.path, '^src/[^/]*/', '')"""
)
def imports_by_suffix(s, d):
    files = _files(s, d)
    return resolution.by_suffix(files.select(F.col("k").alias("reference"), F.regexp_replace("path", "^src/[^/]*/", "").alias("suffix")), files.select("path").distinct())


@query(
    """SELECT p_partkey AS reference, CASE WHEN p_partkey % 2 = 0 THEN 't' || p_size ELSE 'external::' || p_name END AS target FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 < 2"""
)
def placeholders(s, d):
    k = F.col("p_partkey")
    rows = _t(s, d, "part").select(k.alias("reference"), _pick(k, "import", "base", "call").alias("kind"), F.col("p_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("t"), F.col("p_size").cast("string"))).alias("target"))
    return resolution.with_placeholders(rows)


@query(f"""WITH {_FILES} SELECT a.path, b.path AS target, count(*) AS n FROM files a JOIN files b ON b.k = a.k + 1 WHERE CASE WHEN regexp_matches(a.path, '[.][ch]$') THEN 'c' ELSE right(a.path, 3) END = CASE WHEN regexp_matches(b.path, '[.][ch]$') THEN 'c' ELSE right(b.path, 3) END GROUP BY ALL""")
def within_family(s, d):
    files = _files(s, d)
    pairs = files.select((F.col("k") + 1).alias("k"), "path").join(files.select("k", F.col("path").alias("target")), "k")
    return resolution.within_family(pairs).groupBy("path", "target").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_FILES}, f AS (SELECT DISTINCT path FROM files), c AS (SELECT path FROM files WHERE k % 50 = 0), i AS (SELECT a.path, b.path AS target FROM files a JOIN files b ON b.k = a.k + 1)
    SELECT path FROM f WHERE path IN (SELECT path FROM c) OR path IN (SELECT path FROM i WHERE target IN (SELECT path FROM c))"""
)
def to_relink(s, d):
    files = _files(s, d)
    imports = files.select((F.col("k") + 1).alias("k"), "path").join(files.select("k", F.col("path").alias("target")), "k")
    return resolution.to_relink(files, files, files.filter("k % 50 = 0"), imports)


# --- market, symbols ----------------------------------------------------------


@query(
    """WITH n AS (SELECT s_nationkey AS project, CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'host' WHEN 1 THEN 'image' ELSE 'npm' END AS kind, CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'web-0' || s_suppkey % 9 || '.example.com' WHEN 1 THEN 'shop/Web_0' || s_suppkey % 9 ELSE 'WEB0' || s_suppkey % 9 END AS name FROM supplier)
    SELECT project, kind, name, count(*) AS n FROM n WHERE regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') = 'web04' OR (kind = 'host' AND split_part(name, '.', 1) = 'web-04') OR (kind = 'image' AND lower(split_part(name, '/', 2)) = 'web_04') GROUP BY ALL"""
)
def find_name(s, d):
    k, n = F.col("s_suppkey"), (F.col("s_suppkey") % 9).cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("web-0"), n, F.lit(".example.com"))).when(k % 3 == 1, F.concat(F.lit("shop/Web_0"), n)).otherwise(F.concat(F.lit("WEB0"), n))
    rows = _t(s, d, "supplier").select(F.col("s_nationkey").alias("project"), _pick(k, "host", "image", "npm").alias("kind"), name.alias("name"))
    return links.name_matches(rows, F.lit("Web.04")).groupBy("project", "kind", "name").agg(F.count(F.lit(1)).alias("n"))


_NATIONS = "l AS (SELECT n_nationkey AS source, (n_nationkey * 3 + 1) % 25 AS target FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation)"


@query(
    f"""WITH RECURSIVE {_NATIONS}, w AS (SELECT 2 AS project, 0 AS hop UNION SELECT l.target, hop + 1 FROM w JOIN l ON w.project = l.source WHERE hop < 3), h AS (SELECT project, min(hop) AS hop FROM w GROUP BY 1)
    SELECT source, target, a.hop AS hop FROM l JOIN h a ON a.project = source JOIN h b ON b.project = target WHERE b.hop = a.hop + 1"""
)
def project_walk(s, d):
    n = F.col("n_nationkey").cast("long")
    nation = _t(s, d, "nation")
    edges = nation.select(n.alias("source"), ((n * 3 + 1) % 25).alias("target")).union(nation.select(n, (n + 5) % 25)).distinct()
    hops = links.project_walk(edges, s.range(1).select(F.lit(2).cast("long").alias("project")), "outgoing", 3)
    return links.along_walk(edges, hops, "outgoing").join(hops.withColumnRenamed("project", "source"), "source").select("source", "target", "hop")


@query(
    """SELECT c_nationkey AS project, c_custkey AS name, 'v' || c_custkey % 3 AS target, CASE WHEN c_custkey % 4 = 0 THEN 'manual' ELSE 'auto' END AS origin FROM customer"""
)
def manual_links_first(s, d):
    k = F.col("c_custkey")
    rows = _t(s, d, "customer").select(F.col("c_nationkey").alias("project"), k.alias("name"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("target"))
    return links.manual_first(rows, rows.filter("name % 4 = 0"), ["project", "name"])


@query("SELECT DISTINCT l_suppkey % 10 AS project, 'i' || l_partkey % 30 AS name, l_suppkey AS node FROM lineitem WHERE l_quantity > 45 AND (l_suppkey, l_partkey % 30) IN (SELECT l_suppkey, l_partkey % 30 FROM lineitem WHERE l_quantity < 5)")
def built_images(s, d):
    row = (F.col("l_suppkey") % 10).alias("project"), F.concat(F.lit("i"), (F.col("l_partkey") % 30).cast("string")).alias("name"), F.col("l_suppkey").alias("node")
    lines = _t(s, d, "lineitem")
    return links.built_images(lines.filter("l_quantity > 45").select(*row), lines.filter("l_quantity < 5").select(*row))


_CALLS = "e AS (SELECT o_orderkey AS source, o_orderkey // 3 AS target, ['calls', 'extends', 'contains'][CAST(o_orderkey % 3 + 1 AS INT)] AS relation, o_orderkey % 5 = 0 AS test FROM orders)"


@query(
    f"""WITH RECURSIVE {_CALLS}, starts AS (SELECT unnest([1, 7]) AS id), r AS (SELECT id, 0 AS hop FROM starts UNION SELECT e.source, hop + 1 FROM r JOIN e ON e.target = r.id AND relation = 'calls' WHERE hop < 2)
    SELECT 'callers' AS what, id, min(hop) AS hop FROM r GROUP BY 2 HAVING min(hop) > 0 UNION ALL SELECT 'callees', target, 1 FROM e WHERE source IN (1, 7) AND relation = 'calls' AND target NOT IN (1, 7)
    UNION ALL SELECT 'references', source, 1 FROM e WHERE target IN (1, 7) AND relation <> 'contains' AND source NOT IN (1, 7) UNION ALL SELECT 'implementations', source, 1 FROM e WHERE target IN (1, 7) AND relation = 'extends' AND source NOT IN (1, 7)
    UNION ALL SELECT 'tests', source, 1 FROM e WHERE target IN (1, 7) AND test AND source NOT IN (1, 7)"""
)
def find_symbol(s, d):
    k = F.col("o_orderkey")
    edges = _t(s, d, "orders").select(k.alias("source"), F.expr("o_orderkey div 3").alias("target"), _pick(k, "calls", "extends", "contains").alias("relation"), (k % 5 == 0).alias("test"))
    starts = s.range(1).select(F.explode(F.array(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("id"))
    out = None
    for what, hops in (("callers", 2), ("callees", 1), ("references", 1), ("implementations", 1), ("tests", 1)):
        found = symbols.related(edges, starts, what, hops).select(F.lit(what).alias("what"), "id", "hop")
        out = found if out is None else out.union(found)
    return out


@query(f"WITH {_CALLS} SELECT CAST(1 AS INT) AS project, target AS id, source AS owner FROM e WHERE relation = 'contains' AND source % 4 = 0")
def node_members(s, d):
    k = F.col("o_orderkey")
    edges = _t(s, d, "orders").select(F.lit(1).alias("project"), k.alias("source"), F.expr("o_orderkey div 3").alias("target"), _pick(k, "calls", "extends", "contains").alias("relation"))
    return symbols.members(edges, _t(s, d, "orders").filter("o_orderkey % 4 = 0").select(F.lit(1).alias("project"), k.alias("id")))


@query(
    """SELECT source, target, place FROM (SELECT c_nationkey AS source, o_orderkey AS target, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey) WHERE place <= 50"""
)
def edges_per_frontier(s, d):
    """At most 50 edges of each frontier node, in order."""
    from ..operators import relational

    rows = _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("source"), F.col("o_orderkey").alias("target"), "o_totalprice")
    return relational.top_per_group(rows, ["source"], [F.desc_nulls_last("o_totalprice"), F.col("target")], 50).select("source", "target", "place")


@query(
    """WITH t AS (SELECT coalesce(nullif(regexp_extract(split_part(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '::', 1), '^(.*/)', 1), ''), './') AS directory, page_id FROM pages)
    SELECT directory, n, array_to_string(ids, ',') AS first FROM (SELECT directory, count(*) AS n, list(page_id ORDER BY page_id)[1:3] AS ids FROM t GROUP BY 1)"""
)
def suggestions_by_directory(s, d):
    from ..functions.paths import owner_path
    from ..operators import relational

    rows = _t(s, d, "pages").select(tx.directory(owner_path(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1))).alias("directory"), "page_id")
    top = relational.top_per_group(rows, ["directory"], [F.col("page_id")], 3).groupBy("directory").agg(F.array_join(F.sort_array(F.collect_list("page_id")).cast("array<string>"), ",").alias("first"))
    return rows.groupBy("directory").agg(F.count(F.lit(1)).alias("n")).join(top, "directory")


@query("SELECT doc_id, CASE WHEN n_chars > 5000 THEN NULL WHEN doc_id % 9 = 0 THEN NULL ELSE left(text, 2000) END AS text, CASE WHEN doc_id % 9 = 0 THEN 'not readable' WHEN n_chars > 5000 THEN 'too large' END AS reason FROM documents")
def content_reads(s, d):
    from ..sources import text as files

    path = F.when(F.col("doc_id") % 9 == 0, "a/.env").otherwise("a/b.txt")
    rows = _t(s, d, "documents").select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), "text")
    return files.read_content(rows, 2000, 5000).select("doc_id", "text", "reason")


_IGNORED = """files AS (SELECT p_partkey AS id, ['build/a/', 'src/', 'src/keep/', 'docs/x/'][CAST(p_partkey % 4 + 1 AS INT)] || ['m', 'x_', 'im'][CAST(p_partkey % 3 + 1 AS INT)] || p_size || ['.log', '.py', '.tmp'][CAST(p_partkey // 12 % 3 + 1 AS INT)] AS path FROM part)"""


@query(
    f"""WITH {_IGNORED} SELECT id, path, CASE WHEN starts_with(path, 'build/') THEN true WHEN starts_with(path, 'src/keep/') THEN path LIKE '%.tmp' AND NOT starts_with(path, 'src/keep/im')
    WHEN path LIKE '%.log' THEN NOT starts_with(path, 'docs/') WHEN path LIKE '%.tmp' AND starts_with(path, 'src/') THEN true ELSE false END AS ignored FROM files"""
)
def ignored_paths(s, d):
    """Rules of several folders: the deepest folder with a rule that fits decides, the last of its rules; ! takes back."""
    from ..sources import text as files

    k = F.col("p_partkey")
    name = F.concat(_pick(k, "build/a/", "src/", "src/keep/", "docs/x/"), _pick(k, "m", "x_", "im"), F.col("p_size").cast("string"), _pick(F.expr("p_partkey div 12"), ".log", ".py", ".tmp"))
    rules = [("", "build/"), ("", "*.log"), ("src/", "*.tmp"), ("src/keep/", "!*.log"), ("src/keep/", "!im*"), ("docs/", "!*.log"), ("docs/x/", "# note")]
    return files.ignored(_t(s, d, "part").select(k.alias("id"), name.alias("path")), rules)


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 4 AS f, c_nationkey AS project FROM customer)
    SELECT project, k || '/pyproject.toml' AS path, 'pypi' AS kind, unnest(['web-app' || k % 5, 'left-pad', 'right', 'pytest', 'numpy']) AS name, unnest([true, false, false, false, false]) AS provided FROM c WHERE f = 0 UNION ALL
    SELECT project, k || '/setup.cfg', 'pypi', unnest(['tool' || k % 5, 'click', 'rich']), unnest([true, false, false]) FROM c WHERE f = 1 UNION ALL
    SELECT project, k || '/a.spec', 'package', unnest(['engine', 'engine-devel', 'libx' || k % 5, 'zlib', 'glibc']), unnest([true, true, true, false, false]) FROM c WHERE f = 2 UNION ALL
    SELECT project, k || '/hosts.ini', 'host', unnest(['web08.example.com', 'web09.example.com', 'web10.example.com', 'db-a' || k % 5, 'db-b' || k % 5]), false FROM c WHERE f = 3"""
)
def manifest_formats(s, d):
    """Python projects, setup files, package specs and inventories."""
    from ..sources import manifests

    k, n = F.col("c_custkey"), (F.col("c_custkey") % 5).cast("string")
    python = F.concat(
        F.lit('[project]\nname = "Web_App'), n, F.lit('"\ndependencies = [\n  "Left.Pad>=1",\n  "right[x]==2",\n]\n\n[project.optional-dependencies]\ntest = ["pytest"]\n\n[tool.poetry]\nname = "no"\n\n[tool.poetry.dependencies]\npython = "^3"\nnumpy = "*"\n'),
    )
    setup = F.concat(F.lit("[metadata]\nname = Tool"), n, F.lit("\n\n[options]\npackages = find:\ninstall_requires =\n    click>=8\n    rich\npython_requires = >=3\n"))
    spec = F.concat(F.lit("Name: engine\nRequires: zlib >= 1.2, glibc\nRequires(post): /sbin/ldconfig perl(x)\n%package devel\n%package -n libx"), n, F.lit("\n"))
    hosts = F.concat(F.lit("[web]\nweb[08:10].example.com port=22\n# none\n[db]\ndb-[a:b]"), n, F.lit("\n[db:vars]\nuser\n[all:children]\nweb\n"))
    pick = lambda *x: F.element_at(F.array(*x), (k % 4 + 1).cast("int"))
    path = F.concat(k.cast("string"), F.lit("/"), pick(*map(F.lit, ("pyproject.toml", "setup.cfg", "a.spec", "hosts.ini"))))
    return manifests.manifest_names(catalog.spread(_t(s, d, "customer").select("c_custkey", "c_nationkey")).select(F.col("c_nationkey").alias("project"), path.alias("path"), pick(python, setup, spec, hosts).alias("text")))
