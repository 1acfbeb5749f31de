"""Queries that answer a question: lists, their union and order, packets around hits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import catalog
from ..operators import names, packets, ranking, retrieval
from .registry import query

QUESTION = "find loadLimit7 in small_ring core widget"


def _t(s, d, name):
    return catalog.table(s, d, name)


# --- reranking ----------------------------------------------------------------

_POOL = r"""nodes AS (SELECT p_partkey AS k, 'p' || p_size % 5 AS project, CASE WHEN p_size % 5 = 4 THEN 'docs' ELSE 'service' END AS project_type,
        ['directory', 'heading', 'external_module', 'function', 'function', 'function', 'file'][CAST(p_partkey % 7 + 1 AS INT)] AS type,
        ['src/app/core', 'vendor/lib', 'src/tests', 'docs', 'a/node_modules/x', 'src/ringCore'][CAST(p_partkey % 6 + 1 AS INT)] AS dir, p_name, p_size FROM part),
    pool AS (SELECT project, project_type, type, CASE WHEN type = 'directory' THEN dir || '/x' || k ELSE 'n' || k END AS id, CASE WHEN k % 19 = 0 THEN 'Core' ELSE '.' || replace(p_name, ' ', '_') || '()' END AS name,
        CASE WHEN type <> 'directory' THEN dir || '/' || replace(p_name, ' ', '-') || k % 40 || '.py' END AS file_path, 1.0::DOUBLE / (61 + k % 100) AS rrf, k % 13 = 0 AS whole, CAST(p_size * k % 50 AS BIGINT) AS in_degree,
        k % 17 = 0 AS test FROM nodes)"""


def _pool(s, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (k % n + 1).cast("int"))
    kind = pick(7, "directory", "heading", "external_module", "function", "function", "function", "file")
    folder = pick(6, "src/app/core", "vendor/lib", "src/tests", "docs", "a/node_modules/x", "src/ringCore")
    name = lambda by: F.replace("p_name", F.lit(" "), F.lit(by))
    rows = catalog.spread(_t(s, d, "part")).select(
        F.concat(F.lit("p"), (size % 5).cast("string")).alias("project"), F.when(size % 5 == 4, "docs").otherwise("service").alias("project_type"), kind.alias("type"),
        F.when(kind == "directory", F.concat(folder, F.lit("/x"), k.cast("string"))).otherwise(F.concat(F.lit("n"), k.cast("string"))).alias("id"),
        F.when(k % 19 == 0, "Core").otherwise(F.concat(F.lit("."), name("_"), F.lit("()"))).alias("name"),
        F.when(kind != "directory", F.concat(folder, F.lit("/"), name("-"), (k % 40).cast("string"), F.lit(".py"))).alias("file_path"),
        (1.0 / (61 + k % 100)).alias("rrf"), (k % 13 == 0).alias("whole"), (size * k % 50).cast("long").alias("in_degree"), (k % 17 == 0).alias("test"),
    )
    return rows


_STOP = "('and','are','does','for','from','how','into','the','that','this','what','when','where','which','who','why','with')"
_RANKED = rf"""{_POOL}, weak AS (SELECT *, type LIKE 'external\_%' ESCAPE '\' AS ext, type IN ('heading', 'image') AND project_type NOT IN ('docs', 'memory', 'suggestions', 'issues') AS prose, coalesce(file_path, CASE WHEN type = 'directory' THEN id END) AS path FROM pool),
    linked AS (SELECT w.*, greatest(coalesce(n, 0) - CASE WHEN ext OR prose THEN 0 ELSE 1 END, 0) AS links FROM weak w LEFT JOIN (SELECT project, file_path, count(*) AS n FROM weak WHERE NOT ext AND NOT prose AND file_path IS NOT NULL GROUP BY ALL) USING (project, file_path)),
    parted AS (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(path, '\.[A-Za-z0-9]+$', ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) >= 3 AND w NOT IN {_STOP}) AS parts,
        string_split(path, '/') AS seg, lower(regexp_replace(regexp_replace(name, '\(\)$', ''), '^\.', '')) AS bare FROM linked),
    scored AS (SELECT *, rrf + (CASE WHEN bare IN ('loadlimit7', 'small_ring') THEN 0.75 WHEN bare IN ('find', 'core', 'widget') THEN 0.25 ELSE 0 END + CASE WHEN whole THEN 0.5 ELSE 0 END
        + least(len(list_filter(['find', 'load', 'limit7', 'small', 'ring', 'core', 'widget'], lambda w: CASE WHEN type = 'directory' THEN len(list_filter(parts, lambda p: starts_with(p, w) OR starts_with(w, p))) > 0 ELSE list_contains(parts, w) END)), 3) * 0.1
        + CASE WHEN len(list_intersect(seg, ['node_modules', 'vendor', '3rdparty', 'third_party', 'site-packages', '.venv'])) > 0 THEN -0.5
               WHEN test OR len(list_intersect(seg[:-2], ['test', 'tests'])) > 0 OR regexp_matches(seg[-1], '^test_|_test\.|\.(test|spec)\.[A-Za-z0-9]+$|^tests?\.rs$') THEN -0.15 ELSE 0 END
        + CASE WHEN ext THEN -0.5 WHEN prose THEN -0.25 ELSE 0 END + least(links, 3) * 0.05 + least(ln(1 + in_degree), 3) * 0.03) / 61 AS score FROM parted),
    turns AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY round(score, 12) DESC, id) AS turn FROM scored)"""


@query(f"WITH {_RANKED} SELECT id, project, links, round(score, 9) AS score FROM scored")
def rerank_features(s, d):
    rows = ranking.pool_links(_pool(s, d)).withColumn("score", F.col("rrf") + ranking.bonuses(F.lit(QUESTION)) * ranking.UNIT)
    return rows.select("id", "project", "links", F.round("score", 9).alias("score"))


@query(f"WITH {_RANKED} SELECT id, project, row_number() OVER (ORDER BY turn, round(score, 12) DESC, id) AS place FROM turns ORDER BY place LIMIT 60")
def rerank_round_robin(s, d):
    return ranking.reranked(_pool(s, d), F.lit(QUESTION), 60).select("id", "project", "place")


@query(
    """WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place, count(*) OVER (PARTITION BY source) AS total FROM documents),
    s AS (SELECT * FROM p ORDER BY place, source, doc_id LIMIT 100)
    SELECT source, (SELECT count(*) FROM s WHERE s.source = g.source) AS shown, total, (SELECT count(*) FROM s WHERE s.source = g.source) < total AS cut FROM (SELECT DISTINCT source, total FROM p) g"""
)
def share_out_limit(s, d):
    rows = retrieval.round_robin(_t(s, d, "documents").select("doc_id", "source", "n_chars"), "source", F.desc("n_chars"), F.col("doc_id"))
    return ranking.shared_out(rows, "source", ["doc_id"], 100)


@query(
    """WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), q AS (SELECT unnest([0.5, 0.95]) AS share)
    SELECT event_type, share::DOUBLE AS share, value FROM p, q WHERE i = least(CAST(floor(share::DOUBLE * n) AS BIGINT), n - 1)"""
)
def index_percentiles(s, d):
    rows = retrieval.round_robin(_t(s, d, "events").select("event_type", "value", "event_id"), "event_type", F.col("value"), F.col("event_id"))
    return ranking.at_share(rows, "event_type", "value", [0.5, 0.95])


@query(
    """WITH roots AS (SELECT 'region/' || r_regionkey || '/' AS root, 'r' || r_regionkey AS project FROM region UNION ALL SELECT 'region/' || n_regionkey || '/nation/' || n_nationkey || '/', 'n' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0),
    paths AS (SELECT 'region/' || n_regionkey || '/nation/' || n_nationkey || '/customer/' || c_custkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT path, arg_max(project, length(root)) AS project FROM paths JOIN roots ON starts_with(path, root) GROUP BY path"""
)
def longest_prefix_owner(s, d):
    nation, region = _t(s, d, "nation"), _t(s, d, "region")
    text = lambda c: F.col(c).cast("string")
    root = F.concat(F.lit("region/"), text("n_regionkey"), F.lit("/nation/"), text("n_nationkey"), F.lit("/"))
    roots = region.select(F.concat(F.lit("region/"), text("r_regionkey"), F.lit("/")).alias("root"), F.concat(F.lit("r"), text("r_regionkey")).alias("project"))
    roots = roots.union(nation.filter("n_nationkey % 2 = 0").select(root.alias("root"), F.concat(F.lit("n"), text("n_nationkey")).alias("project")))
    paths = _t(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(root, F.lit("customer/"), text("c_custkey")).alias("path"))
    return ranking.longest_prefix(paths, roots)


# --- lists of the lexical half ------------------------------------------------

_TRIGRAMS = """list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substring('  ' || w || ' ', i, 3)))))"""
_SIM = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))"


@query(
    f"""WITH p AS (SELECT p_partkey, p_name, {_TRIGRAMS.format('p_name')} AS t, {_TRIGRAMS.format("'small rings'")} AS q FROM part), c AS (SELECT *, {_SIM.format('t', 'q')} AS sim FROM p)
    SELECT p_partkey AS id, round(greatest(sim, CASE WHEN p_name ILIKE '%small ring%' THEN 0.5 ELSE 0 END, CASE WHEN p_name ILIKE '%small%' THEN 0.4 ELSE 0 END), 6) AS score FROM c
    WHERE sim >= 0.3 OR p_name ILIKE '%small ring%' OR p_name ILIKE '%small%' ORDER BY score DESC, id LIMIT 200"""
)
def lex_names(s, d):
    index = catalog.name_index(s, d, "part", "p_partkey", "p_name")
    return index.search("small rings", "small ring", ["%small%"], 200).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH p AS (SELECT page_id AS id, url, {_TRIGRAMS.format('url')} AS t, {_TRIGRAMS.format("'ththan example com casino'")} AS q FROM pages), c AS (SELECT *, {_SIM.format('t', 'q')} AS sim FROM p)
    SELECT id, round(greatest(sim, CASE WHEN url ILIKE '%casino-win%' THEN 0.5 ELSE 0 END, CASE WHEN url ILIKE 'http://m.%' OR url ILIKE '%.ht_l' OR url ILIKE '%?%' THEN 0.4 ELSE 0 END), 6) AS score FROM c
    WHERE sim >= 0.25 OR url ILIKE '%casino-win%' OR url ILIKE 'http://m.%' OR url ILIKE '%.ht_l' OR url ILIKE '%?%' ORDER BY score DESC, id LIMIT 500"""
)
def lex_urls(s, d):
    """Urls like a question, holding a part of it or fitting patterns, one of which has no gram and reads all names."""
    index = catalog.name_index(s, d, "pages", "page_id", "url")
    found = index.search("ththan example com casino", "casino-win", ["http://m.%", "%.ht_l", "%?%"], 500, 0.25)
    return found.select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH u AS (SELECT url, {_TRIGRAMS.format('url')} AS t FROM (SELECT DISTINCT url FROM pages)), p AS (SELECT a.url AS a, b.url AS b, {_SIM.format('a.t', 'b.t')} AS sim FROM u a JOIN u b ON a.url < b.url)
    SELECT a, b, round(sim, 6) AS score FROM p WHERE sim >= 0.75"""
)
def alike_urls(s, d):
    """All pairs of different urls of similarity 0.75 or more."""
    urls = _t(s, d, "pages").select(F.col("url").alias("name"))
    return names.alike(urls, urls, 0.75).filter("left < right").select(F.col("left").alias("a"), F.col("right").alias("b"), F.round("score", 6).alias("score"))


_SUMMARY_HITS = r"""hits AS (SELECT doc_id AS id, len(list_filter(w, lambda x: x IN ('the', 'in', 'erth'))) AS n, len(w) AS size, len(list_distinct(list_filter(w, lambda x: x IN ('the', 'in', 'erth')))) AS kinds
    FROM (SELECT doc_id, regexp_extract_all(lower(regexp_replace(regexp_replace(left(coalesce(text, ''), 300), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[a-z0-9]+') AS w FROM documents) WHERE len(w) > 0)"""


@query(f"WITH {_SUMMARY_HITS} SELECT id, round(kinds + n / (n + size), 6) AS score FROM hits WHERE n > 0 ORDER BY score DESC, id LIMIT 200")
def lex_summaries(s, d):
    rows = _t(s, d, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("summary"))
    return retrieval.summary_search(rows, "doc_id", "summary", ["the", "in", "erth"], 200).select("id", F.round("score", 6).alias("score"))


@query(
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z]+')) AS word FROM part), r AS (SELECT unnest(['smallest', 'red', 'widg', 'economy', 'bo', 'ste']) AS root)
    SELECT word, root FROM w JOIN r ON length(word) >= 3 AND length(root) >= 3 AND (starts_with(word, root) OR starts_with(root, word))"""
)
def lex_dirs(s, d):
    words = _t(s, d, "part").select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_type", "p_name")), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    roots = s.createDataFrame([(x,) for x in ("smallest", "red", "widg", "economy", "bo", "ste")], "root string")
    return ranking.prefix_pairs(words, roots)


@query(
    """WITH a AS (SELECT doc_id AS id, source AS project, n_chars % 97 / 97 AS score, 'source' AS matched FROM documents UNION ALL SELECT doc_id, d.source, (quality + toxic) / 3, 'summary' FROM labels JOIN documents d USING (doc_id)),
    b AS (SELECT project, id, arg_max(matched, (score, matched)) AS matched, max(score) AS score FROM a GROUP BY ALL)
    SELECT project, id, matched, round(score, 6) AS score, row_number() OVER (PARTITION BY project ORDER BY round(score, 9) DESC, id) AS place FROM b QUALIFY place <= 20"""
)
def lexical_union(s, d):
    docs = _t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"), "n_chars")
    source = docs.select("project", "id", (F.col("n_chars") % 97 / 97).alias("score"), F.lit("source").alias("matched"))
    summary = _t(s, d, "labels").join(docs, F.col("doc_id") == F.col("id")).select("project", "id", ((F.col("quality") + F.col("toxic")) / 3).alias("score"), F.lit("summary").alias("matched"))
    return retrieval.best_rows(source.unionByName(summary), 20).withColumn("score", F.round("score", 6))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN nullif(left(array_to_string(string_split(text, chr(10))[2:4], chr(10)), 400), '') ELSE nullif(left(text, 400), '') END AS snippet, CASE WHEN doc_id % 3 = 0 THEN 'written by hand' WHEN doc_id % 3 = 1 THEN 'from a model' END AS origin FROM documents""")
def snippets(s, d):
    matched = F.when(F.col("doc_id") % 2 == 0, "source").otherwise("summary")
    by = F.when(F.col("doc_id") % 3 == 0, "manual").when(F.col("doc_id") % 3 == 1, "llm").otherwise("auto")
    shown = retrieval.snippet(matched, F.col("text"), F.lit(2), F.lit(4), F.col("text"))
    return _t(s, d, "documents").select(F.col("doc_id").alias("id"), shown.alias("snippet"), retrieval.origin(by).alias("origin"))


# --- packets ------------------------------------------------------------------

_NEAR = r"""near AS (SELECT o_custkey % 40 AS packet, CAST(o_custkey % 3 AS INT) AS seed, o_custkey % 4 AS project, 'o' || o_orderkey AS id, ['contains', 'imports', 'calls', 'extends', 'uses'][CAST(o_orderkey % 5 + 1 AS INT)] AS relation,
    CASE WHEN o_orderkey // 5 % 2 = 0 THEN 'in' ELSE 'out' END AS direction, CASE WHEN o_orderkey % 11 = 0 THEN 'tests/a' ELSE 'src/f' END || o_orderkey % 29 || '.py' AS file_path, o_orderkey % 23 = 0 AS test FROM orders),
    tiered AS (SELECT *, CASE WHEN relation = 'contains' THEN CASE direction WHEN 'in' THEN 'container' ELSE 'defines' END WHEN test OR regexp_matches(file_path, '(^|/)(tests?|spec|specs)/') THEN 'test' WHEN direction = 'in' THEN 'caller'
        WHEN relation IN ('imports', 'extends') THEN 'import' ELSE 'callee' END AS tier FROM near),
    marked AS (SELECT *, direction = 'in' AND relation IN ('imports', 'extends') AND tier = 'caller' AS importer FROM tiered),
    placed AS (SELECT *, row_number() OVER (PARTITION BY packet, seed, tier, importer ORDER BY relation, id) AS place FROM marked)"""


def _near(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    relation = F.element_at(F.array(*map(F.lit, ("contains", "imports", "calls", "extends", "uses"))), (k % 5 + 1).cast("int"))
    path = F.concat(F.when(k % 11 == 0, "tests/a").otherwise("src/f"), (k % 29).cast("string"), F.lit(".py"))
    return _t(s, d, "orders").select(
        (c % 40).alias("packet"), (c % 3).cast("int").alias("seed"), (c % 4).alias("project"), F.concat(F.lit("o"), k.cast("string")).alias("id"), relation.alias("relation"),
        F.when(F.expr("o_orderkey div 5") % 2 == 0, "in").otherwise("out").alias("direction"), path.alias("file_path"), (k % 23 == 0).alias("test"),
    )


@query(
    f"""WITH {_NEAR} SELECT packet, seed, tier, importer, place, id FROM placed WHERE place <= greatest(CASE WHEN importer THEN 3 - seed WHEN tier = 'defines' THEN 8 - 2 * seed WHEN tier = 'import' THEN 3 - seed
    WHEN tier = 'test' THEN 4 WHEN tier = 'container' THEN 2 ELSE 8 END, 0)"""
)
def packet_tiers(s, d):
    return packets.capped(_near(s, d)).select("packet", "seed", "tier", "importer", "place", "id")


def packet_candidates(s, d):
    """Hits (the first orders of each packet) and their neighbours, with lines and costs."""
    n = F.substring("id", 2, 20).cast("long")
    lines = [(n % 60 * 5).cast("int").alias("start_line"), (n % 60 * 5 + n % 9).cast("int").alias("end_line"), (10 + n % 40).cast("int").alias("cost"), F.when(n % 3 > 0, 20 + n % 80).cast("int").alias("chunk_cost")]
    tiers = packets.capped(_near(s, d)).select("packet", "tier", "place", "seed", "project", "id", "file_path", *lines)
    first = F.row_number().over(Window.partitionBy("packet").orderBy(F.desc("id")))
    hits = _near(s, d).withColumn("place", first.cast("long")).filter("place <= 4")
    return tiers.unionByName(hits.select("packet", F.lit("seed").alias("tier"), "place", F.lit(0).alias("seed"), "project", "id", "file_path", *lines))


@query()
def context_packets(s, d):
    """Packets of 900 tokens; tests compare them with a plain loop."""
    return packets.assembled(packet_candidates(s, d), 900)


@query(
    r"""SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'full' WHEN p_size * 200 < 3000 THEN 'summary' WHEN p_partkey % 3 = 0 THEN 'source' WHEN p_partkey % 3 = 1 THEN 'source' ELSE 'summary' END AS detail FROM part"""
)
def packet_details(s, d):
    k = F.col("p_partkey")
    question = F.when(k % 3 == 0, F.concat(F.lit("where is "), F.replace("p_name", F.lit(" "), F.lit("_")))).when(k % 3 == 1, "what calls run()").otherwise("how are things sold")
    return _t(s, d, "part").select(k.alias("id"), packets.detail(question, F.col("p_size") * 200, F.when(k % 7 == 0, "full").otherwise("auto")).alias("detail"))


_HITS = "hits AS (SELECT 'region/' || n_regionkey || '/nation/' || n_nationkey || '/customer/' || c_custkey AS id, c_custkey % 20 AS packet, CAST(c_custkey % 3 AS INT) AS seed, n_regionkey, n_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _hits(s, d):
    text = lambda c: F.col(c).cast("string")
    id_ = F.concat(F.lit("region/"), text("n_regionkey"), F.lit("/nation/"), text("n_nationkey"), F.lit("/customer/"), text("c_custkey"))
    rows = _t(s, d, "customer").join(_t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(id_.alias("id"), (F.col("c_custkey") % 20).alias("packet"), (F.col("c_custkey") % 3).cast("int").alias("seed"), "n_regionkey")


@query(
    f"""WITH {_HITS} SELECT packet, seed, unnest(['region/' || n_regionkey || '/nation/' || n_nationkey || '/customer/', 'region/' || n_regionkey || '/nation/' || n_nationkey || '/', 'region/' || n_regionkey || '/nation/',
    'region/' || n_regionkey || '/', 'region/']) AS id, unnest([1, 2, 3, 4, 5]) AS place FROM hits"""
)
def ancestors_ladder(s, d):
    return packets.ladder(_hits(s, d))


@query(
    f"""WITH {_HITS}, ties AS (SELECT id, c_custkey % 10 AS record FROM hits WHERE c_custkey % 2 = 0 UNION ALL SELECT 'region/' || n_regionkey || '/nation/' || n_nationkey || '/', n_nationkey % 10 FROM nation UNION ALL SELECT 'region/' || r_regionkey || '/', r_regionkey FROM region)
    SELECT id, record, CAST(min(above) AS INT) AS above FROM (
        SELECT hits.id, record, 0 AS above FROM hits JOIN ties USING (id) UNION ALL SELECT h.id, record, CASE WHEN ties.id LIKE '%/nation/%' THEN 2 ELSE 4 END FROM hits h JOIN ties ON ties.id LIKE '%/' AND starts_with(h.id, ties.id)) GROUP BY 1, 2"""
)
def attached_records(s, d):
    hits, nation = _hits(s, d), _t(s, d, "nation")
    text = lambda c: F.col(c).cast("string")
    key = F.substring_index("id", "/", -1).cast("long")
    own = hits.filter(key % 2 == 0).select("id", (key % 10).alias("record"))
    of_nation = nation.select(F.concat(F.lit("region/"), text("n_regionkey"), F.lit("/nation/"), text("n_nationkey"), F.lit("/")).alias("id"), (F.col("n_nationkey") % 10).cast("long").alias("record"))
    of_region = _t(s, d, "region").select(F.concat(F.lit("region/"), text("r_regionkey"), F.lit("/")).alias("id"), F.col("r_regionkey").cast("long").alias("record"))
    return packets.attached(hits.select("id"), own.union(of_nation).union(of_region))


# --- modes --------------------------------------------------------------------


@query(
    """WITH m AS (SELECT unnest(['lexical', 'vector', 'hybrid']) AS mode), l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 50),
    v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings QUALIFY r <= 50)
    SELECT mode, id, round(CASE WHEN mode <> 'vector' THEN coalesce(1 / (60 + l.r), 0) ELSE 0 END + CASE WHEN mode <> 'lexical' THEN coalesce(1 / (60 + v.r), 0) ELSE 0 END, 9) AS rrf
    FROM m, l FULL JOIN v USING (id) WHERE (mode <> 'vector' AND l.r IS NOT NULL) OR (mode <> 'lexical' AND v.r IS NOT NULL)"""
)
def search_modes(s, d):
    depth, _ = retrieval.depths(10)
    lexical = _t(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(depth).select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.lit(0).alias("tf"))
    vector = _t(s, d, "embeddings").orderBy("vec_id").limit(depth).select(F.col("vec_id").alias("id"), (-F.col("vec_id")).cast("double").alias("score"))
    out = [retrieval.by_mode(m, lexical, vector).select(F.lit(m).alias("mode"), "id", F.round("rrf", 9).alias("rrf")) for m in ("lexical", "vector", "hybrid")]
    return out[0].union(out[1]).union(out[2])


@query("SELECT p_brand, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS kinds FROM part GROUP BY p_brand")
def listed_kinds(s, d):
    kinds = F.array_join(F.array_sort(F.collect_set("p_type")), " | ")  # a brand has as many kinds as there are types
    return _t(s, d, "part").groupBy("p_brand").agg(kinds.alias("kinds"))
