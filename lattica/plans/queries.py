"""Queries over the tables of a folder, by name, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import text as tx
from ..operators import graph, incremental, links, ranking, records, relational, retrieval, symbols
from ..operators.components import connected_components
from ..operators.words import Question
from ..sources import manifests
from ..sources import text as files
from ..streaming import events as ev
from .registry import query

TERMS = ["the", "in", "erth", "edsh"]


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return catalog.table(s, d, name)


# --- retrieval ----------------------------------------------------------------

_POSTINGS = r"""
    found AS (
        SELECT doc_id AS id, term, count(*) AS tf FROM (
            SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'),
                   '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[a-z0-9]+')) AS term FROM documents)
        WHERE term IN ('the', 'in', 'erth', 'edsh') GROUP BY ALL
    ), weights AS (
        SELECT term, least(count(*), 2000) AS df, ln(1 + 2000 / least(count(*), 2000)) AS idf, count(*) >= 2000 AS common
        FROM found GROUP BY term
    ), lexical AS (
        SELECT * FROM (
            SELECT id, sum(idf) / (SELECT sum(idf) FROM weights) AS score, CAST(sum(tf) AS BIGINT) AS tf
            FROM found JOIN weights USING (term) GROUP BY id
            HAVING bool_or(NOT common OR (SELECT bool_and(common) FROM weights)))
        ORDER BY round(score, 9) DESC, tf DESC, id LIMIT 200
    )"""
_VECTOR = """
    vector AS (
        SELECT * FROM (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]),
               (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))) AS score
        FROM embeddings) ORDER BY round(score, 9) DESC, id LIMIT 200
    )"""
_FUSED = """
    fused AS (
        SELECT id, coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0) AS rrf, a.r AS lexical_rank, b.r AS vector_rank
        FROM (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, tf DESC, id) AS r FROM lexical) a
        FULL JOIN (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM vector) b USING (id)
    )"""


def _lexical(s: SparkSession, d: str) -> DataFrame:
    return catalog.word_index(s, d).search(Question(tuple(TERMS)), 200)


def _vector(s: SparkSession, d: str) -> DataFrame:
    vectors = _t(s, d, "embeddings")
    asked = [float(x) for x in vectors.orderBy("vec_id").first()["embedding"]]  # the query: one vector
    return retrieval.vector_search(vectors, "vec_id", "embedding", asked, 200)


@query(f"WITH {_POSTINGS} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf, common FROM weights")
def df_capped_weights(s, d):
    found = catalog.word_index(s, d).found(tuple(TERMS))
    return retrieval.term_weights(found).select("term", "df", F.round("idf", 6).alias("idf"), "common")


@query(f"WITH {_POSTINGS} SELECT id, round(score, 6) AS score, tf FROM lexical")
def lexical_idf_topk(s, d):
    return _lexical(s, d).select("id", F.round("score", 6).alias("score"), "tf")


@query(f"WITH {_VECTOR} SELECT id, round(score, 6) AS score FROM vector")
def vector_cosine_topk(s, d):
    return _vector(s, d).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_POSTINGS}, {_VECTOR}, {_FUSED} SELECT id, round(rrf, 9) AS rrf, lexical_rank, vector_rank FROM fused ORDER BY round(rrf, 9) DESC, id LIMIT 50")
def hybrid_search_rrf(s, d):
    out = retrieval.fuse(_lexical(s, d), _vector(s, d)).select("id", F.round("rrf", 9).alias("rrf"), "lexical_rank", "vector_rank")
    return out.orderBy(F.desc("rrf"), "id").limit(50)


@query(
    f"""WITH {_POSTINGS}, {_VECTOR}, {_FUSED}
    SELECT id, round(rrf + (0.75 * (lang = 'en')::INT + 0.03 * least(ln(1 + n_chars), 3) - 0.25 * contains(source, '1')::INT) / 61, 9) AS score
    FROM fused JOIN documents ON id = doc_id ORDER BY score DESC, id LIMIT 50"""
)
def rerank_bonus(s, d):
    rows = retrieval.fuse(_lexical(s, d), _vector(s, d)).join(_t(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars"), "id")
    bonuses = {
        "language": (F.col("lang") == "en", 0.75),
        "degree": (F.least(F.log1p("n_chars"), F.lit(3.0)), 0.03),
        "prose": (F.col("source").contains("1"), -0.25),
    }
    rows = retrieval.rerank(rows, bonuses).select("id", F.round("score", 9).alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(50)


@query(
    r"""SELECT doc_id AS id, 2.0 AS score FROM documents
    WHERE contains(' ' || array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'),
          '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[a-z0-9]+'), ' ') || ' ', ' and the ')"""
)
def phrase_search(s, d):
    return retrieval.phrase_search(_t(s, d, "documents"), "doc_id", "text", ["and", "the"])


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place, count(*) OVER (PARTITION BY source) AS total FROM documents")
def round_robin_interleave(s, d):
    rows = retrieval.round_robin(_t(s, d, "documents").select("doc_id", "source", "n_chars"), "source", F.desc("n_chars"), F.col("doc_id"))
    return rows.select("doc_id", "source", "place", "total")


@query()
def context_packet(s, d):
    turns = _t(s, d, "conversations").select("conv_id", "turn", tx.token_estimate(F.col("text")).alias("tokens"))
    return retrieval.pack(turns, "conv_id", "turn", "tokens", 200)


@query()
def chunk_lines(s, d):
    return retrieval.chunk_lines(_t(s, d, "documents"), "doc_id", "text").select("id", "chunk", "start_line", "end_line", F.md5("text").alias("hash"))


# --- text functions -----------------------------------------------------------


@query(
    r"""SELECT p_partkey, array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(p_type || p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'),
    '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[a-z0-9]+'), ' ') AS words FROM part"""
)
def camel_split_tokens(s, d):
    return _t(s, d, "part").select("p_partkey", F.array_join(tx.lexical_words(F.concat("p_type", "p_name")), " ").alias("words"))


@query(
    """WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM benchmark), c AS (SELECT w FROM w WHERE regexp_matches(w, '^[a-z]+$'))
    SELECT w AS word, CASE WHEN w LIKE '%ing' AND length(w) >= 7 THEN CASE WHEN regexp_matches(left(w, length(w) - 3), '(bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|yy|zz)$') THEN left(w, length(w) - 4) ELSE left(w, length(w) - 3) END
        WHEN w LIKE '%ies' AND length(w) >= 7 THEN left(w, length(w) - 3) WHEN w LIKE '%ied' AND length(w) >= 7 THEN left(w, length(w) - 3)
        WHEN w LIKE '%es' AND length(w) >= 6 THEN left(w, length(w) - 2)
        WHEN w LIKE '%ed' AND length(w) >= 6 THEN CASE WHEN regexp_matches(left(w, length(w) - 2), '(bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|yy|zz)$') THEN left(w, length(w) - 3) ELSE left(w, length(w) - 2) END
        WHEN w LIKE '%s' AND length(w) >= 5 THEN left(w, length(w) - 1) ELSE w END AS stem FROM c"""
)
def stems(s, d):
    words = _t(s, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct().filter(F.col("word").rlike("^[a-z]+$"))
    return words.select("word", tx.stem(F.col("word")).alias("stem"))


@query(
    r"""WITH p AS (SELECT p_partkey, list_distinct(flatten(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w:
        list_transform(generate_series(1, length(w) + 1), lambda i: substring('  ' || w || ' ', i, 3))))) AS t FROM part),
    q AS (SELECT t FROM p WHERE p_partkey = (SELECT min(p_partkey) FROM part))
    SELECT p_partkey, round(len(list_intersect(p.t, q.t)) / len(list_distinct(list_concat(p.t, q.t))), 6) AS similarity FROM p, q"""
)
def trigram_similarity(s, d):
    part = _t(s, d, "part")
    asked = part.orderBy("p_partkey").first()["p_name"]
    return part.select("p_partkey", F.round(tx.similarity(F.col("p_name"), F.lit(asked)), 6).alias("similarity"))


@query(
    """SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key, regexp_replace(lower(trim(p_brand)), '[-_.#]+', '-', 'g') AS brand FROM part"""
)
def normalize_names(s, d):
    brand = tx.normalize_name(F.lit("pypi"), F.regexp_replace("p_brand", "#", "-"))
    return _t(s, d, "part").select("p_partkey", tx.name_key(F.col("p_name")).alias("key"), brand.alias("brand"))


@query("SELECT md5(regexp_replace(text, '\r\n?', chr(10), 'g')) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def md5_duplicates(s, d):
    rows = _t(s, d, "documents").groupBy(tx.text_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return rows.filter("n > 1")


@query("SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimates(s, d):
    return _t(s, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(
    """SELECT page_id, CASE WHEN contains(l, '.') THEN '.' || lower(string_split(l, '.')[-1]) ELSE l END AS extension,
    coalesce(nullif(regexp_extract(p, '^(.*/)', 1), ''), './') AS directory
    FROM (SELECT page_id, p, string_split(p, '/')[-1] AS l FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages))"""
)
def path_parts(s, d):
    path = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    return _t(s, d, "pages").select("page_id", tx.extension(path).alias("extension"), tx.directory(path).alias("directory"))


@query(
    """SELECT extension, count(*) AS n FROM (SELECT CASE WHEN contains(l, '.') THEN '.' || lower(string_split(l, '.')[-1]) ELSE l END AS extension
    FROM (SELECT string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/')[-1] AS l FROM pages)) GROUP BY 1"""
)
def extension_counts(s, d):
    return path_parts(s, d).groupBy("extension").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '^(.*/)', 1), ''), './') AS directory, count(*) AS n FROM pages GROUP BY 1")
def directory_rollup(s, d):
    return path_parts(s, d).groupBy("directory").agg(F.count(F.lit(1)).alias("n"))


# --- sources ------------------------------------------------------------------


@query(
    """SELECT doc_id AS id, CAST(line AS INT) AS line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE regexp_matches(text, '(?i)thth(er|in)') ORDER BY doc_id, line LIMIT 500"""
)
def grep_lines(s, d):
    return files.grep(_t(s, d, "documents"), "doc_id", "text", "thth(er|in)", 500)


@query(
    """SELECT doc_id AS id, 1 + doc_id % 3 AS "start", 2 + doc_id % 5 AS "end",
    array_to_string(string_split(text, chr(10))[1 + doc_id % 3:2 + doc_id % 5], chr(10)) AS text FROM documents"""
)
def range_read(s, d):
    docs = _t(s, d, "documents")
    wanted = docs.select(F.col("doc_id").alias("id"), (1 + F.col("doc_id") % 3).cast("int").alias("start"), (2 + F.col("doc_id") % 5).cast("int").alias("end"))
    return files.read_ranges(docs, wanted, "doc_id", "text")


@query("""SELECT doc_id AS id, 2 AS "start", 3 AS "end", array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS text FROM documents""")
def range_read_all(s, d):
    """A range of every document."""
    docs = _t(s, d, "documents")
    return files.read_ranges(docs, docs.select(F.col("doc_id").alias("id"), F.lit(2).alias("start"), F.lit(3).alias("end")), "doc_id", "text")


# --- listings -----------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) > (40, 100) ORDER BY o_custkey, o_orderkey LIMIT 100")
def keyset_page(s, d):
    return relational.keyset_page(_t(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], [40, 100], 100)


@query("SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def page_with_total(s, d):
    rows = _t(s, d, "customer").select("c_custkey", "c_acctbal")
    return relational.page_with_total(rows, [F.desc("c_acctbal"), F.col("c_custkey")], 25, 50)


@query("SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 3")
def top_k_per_group(s, d):
    return relational.top_per_group(_t(s, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "place")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def distinct_on_latest(s, d):
    rows = _t(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return relational.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS statuses, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities, count(*) AS n FROM orders")
def facets(s, d):
    facet = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return _t(s, d, "orders").agg(facet("o_orderstatus").alias("statuses"), facet("o_orderpriority").alias("priorities"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name FROM nation SEMI JOIN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')) r ON n_regionkey = r.r_regionkey")
def scope_semi_join(s, d):
    region = relational.optional_filter(_t(s, d, "region"), r_name=None).filter(F.col("r_name").isin("ASIA", "EUROPE"))
    rows = _t(s, d, "nation").withColumnRenamed("n_regionkey", "project")
    return relational.scoped(rows, region.withColumnRenamed("r_regionkey", "project")).select("n_nationkey", "n_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' AND (p_type ILIKE '%econ%' OR p_brand ILIKE '%#2%') AND p_size IS DISTINCT FROM 3")
def pattern_filters(s, d):
    rows = _t(s, d, "part").filter(F.col("p_name").ilike("%RING%") & (F.col("p_type").ilike("%econ%") | F.col("p_brand").ilike("%#2%")))
    return rows.filter(~F.col("p_size").eqNullSafe(3)).select("p_partkey", "p_name")


@query("SELECT p_brand, bool_or(p_size > 45) AS large, count(DISTINCT (p_type, p_size)) AS kinds FROM part GROUP BY p_brand HAVING bool_or(p_size > 45) AND count(*) > 3")
def bool_or_having(s, d):
    rows = _t(s, d, "part").groupBy("p_brand").agg(F.bool_or(F.col("p_size") > 45).alias("large"), F.count_distinct(F.struct("p_type", "p_size")).alias("kinds"), F.count(F.lit(1)).alias("n"))
    return rows.filter("large and n > 3").drop("n")


@query(
    """SELECT o_custkey, n, array_to_string(keys, ',') AS samples FROM (SELECT o_custkey, count(*) AS n, list(o_orderkey ORDER BY o_orderkey)[1:3] AS keys FROM orders GROUP BY o_custkey)"""
)
def ordered_array_samples(s, d):
    rows = _t(s, d, "orders").select("o_custkey", "o_orderkey")
    top = relational.top_per_group(rows, ["o_custkey"], [F.col("o_orderkey")], 3)
    top = top.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("samples"))
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).join(top, "o_custkey")


@query(
    """SELECT coalesce(a.id, b.id) AS id, a.n AS bought, b.n AS labelled FROM (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) a
    FULL JOIN (SELECT c_custkey AS id, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) b ON a.id = b.id"""
)
def full_outer_ranks(s, d):
    a = _t(s, d, "events").filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("bought"))
    b = _t(s, d, "customer").filter("c_acctbal < 0").groupBy(F.col("c_custkey").alias("id")).agg(F.count(F.lit(1)).alias("labelled"))
    return a.join(b, "id", "full")


@query(
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z]+')) AS w FROM part), r AS (SELECT DISTINCT p_type, lower(left(p_type, 3)) AS p FROM part)
    SELECT p_type, w AS word FROM r JOIN w ON length(w) >= 3 AND (starts_with(w, p) OR starts_with(p, w))"""
)
def theta_prefix_join(s, d):
    words = _t(s, d, "part").select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_type", "p_name")), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    roots = _t(s, d, "part").select("p_type", F.lower(F.substring("p_type", 1, 3)).alias("root")).distinct()
    return ranking.prefix_pairs(words, roots).join(roots, "root").select("p_type", "word").distinct()


# --- graph --------------------------------------------------------------------

_TRADES = """trades AS (SELECT DISTINCT c_nationkey AS source, s_nationkey AS target, o_orderpriority AS relation
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
_PURCHASES = "purchases AS (SELECT DISTINCT o_custkey AS source, -l_suppkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_TRADES} SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT target AS id, 1 AS i, 0 AS o FROM trades UNION ALL SELECT source, 0, 1 FROM trades) GROUP BY id")
def in_degree(s, d):
    return graph.degrees(catalog.trades(s, d))


@query(
    f"""WITH {_TRADES}, n AS (SELECT source AS id, target AS other, relation, 'out' AS direction FROM trades UNION SELECT target, source, relation, 'in' FROM trades)
    SELECT id, other, relation, direction FROM (SELECT *, row_number() OVER (PARTITION BY id, relation, direction ORDER BY other) AS r FROM n) WHERE r <= 4"""
)
def neighbors_share(s, d):
    return graph.neighbours(catalog.trades(s, d), 4)


@query(
    f"""WITH RECURSIVE {_PURCHASES}, e AS (SELECT source, target FROM purchases UNION SELECT target, source FROM purchases),
    w AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS hop UNION SELECT e.target, hop + 1 FROM w JOIN e ON w.id = e.source WHERE hop < 3)
    SELECT id, min(hop) AS hop FROM w GROUP BY id"""
)
def bfs_hops(s, d):
    start = s.range(1).select(F.lit(1).cast("long").alias("id"))
    return graph.walk(graph.doubled(catalog.purchases(s, d)), start, 3)


@query(
    f"""WITH RECURSIVE {_PURCHASES}, e AS (SELECT source, target FROM purchases UNION SELECT target, source FROM purchases),
    m(id, hop) USING KEY (id) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.target, min(hop) + 1 FROM m JOIN e ON m.id = e.source WHERE NOT EXISTS (FROM recurring.m AS r WHERE r.id = e.target) GROUP BY e.target)
    SELECT a.id, a.hop, min(b.id) AS parent FROM m a LEFT JOIN e ON e.target = a.id LEFT JOIN m b ON b.id = e.source AND b.hop = a.hop - 1 GROUP BY a.id, a.hop"""
)
def shortest_path_len(s, d):
    """Everyone who can be reached, however far."""
    start = s.range(1).select(F.lit(1).cast("long").alias("id"))
    return graph.shortest_paths(catalog.purchases(s, d), start)


@query(
    f"""WITH RECURSIVE {_PURCHASES}, w AS (SELECT CAST(-1 AS BIGINT) AS id, 0 AS hop UNION SELECT p.source, hop + 1 FROM w JOIN purchases p ON w.id = p.target WHERE hop < 3)
    SELECT CASE WHEN hop = 1 THEN 'direct' ELSE 'indirect' END AS bucket, count(*) AS n FROM (SELECT id, min(hop) AS hop FROM w GROUP BY id) WHERE hop > 0 GROUP BY 1"""
)
def impact_buckets(s, d):
    return graph.impact(catalog.purchases(s, d), s.range(1).select(F.lit(-1).cast("long").alias("id")))


_NODES = """n AS (SELECT 'region/' || n_regionkey || '/nation/' || n_nationkey || '/' AS p, n_nationkey FROM nation),
    ids AS (SELECT p || 'customer/' || c_custkey AS id FROM customer JOIN n ON c_nationkey = n_nationkey
            UNION ALL SELECT p || 'supplier/' || s_suppkey FROM supplier JOIN n ON s_nationkey = n_nationkey UNION ALL SELECT p FROM n)"""
_ABOVE = """parts AS (SELECT id, string_split(rtrim(id, '/'), '/') AS x FROM ids),
    above AS (SELECT id, i, array_to_string(x[1:i], '/') || '/' AS dir, len(x) AS n FROM (SELECT id, x, unnest(generate_series(1, len(x) - 1)) AS i FROM parts))"""


@query(f"WITH {_NODES}, {_ABOVE} SELECT id, CAST(n - i AS INT) AS distance, dir AS ancestor FROM above")
def ancestors(s, d):
    rows = catalog.nodes(s, d).select("id", F.posexplode(tx.ancestors(F.col("id"))).alias("distance", "ancestor"))
    return rows.withColumn("distance", F.col("distance") + 1)


@query(
    f"""WITH {_NODES}, {_ABOVE} SELECT dir AS id, CASE WHEN i > 1 THEN regexp_replace(dir, '[^/]*/$', '') END AS parent, CAST(i AS INT) AS depth, count(*) AS members FROM above GROUP BY ALL"""
)
def overview_tree(s, d):
    return graph.overview(catalog.nodes(s, d).select("id"))


@query("SELECT p_partkey FROM part ANTI JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1993-01-01') l ON p_partkey = l_partkey")
def unresolved_anti(s, d):
    used = _t(s, d, "lineitem").filter("l_shipdate < timestamp '1993-01-01'").select(F.col("l_partkey").alias("target"))
    return graph.orphans(_t(s, d, "part").select(F.col("p_partkey").alias("id")), used).select(F.col("id").alias("p_partkey"))


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 7 AS b FROM part WHERE p_size < 20), r AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e
    UNION SELECT r.x, z.y FROM r JOIN (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e) z ON r.y = z.x)
    SELECT x AS node, min(y) AS component FROM r GROUP BY x"""
)
def components(s, d):
    edges = _t(s, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 7).alias("b"))
    return connected_components(edges)


@query()
def communities(s, d):
    return graph.communities(catalog.trades(s, d), 5)


# --- market of names ----------------------------------------------------------

_MARKET = """provided AS (SELECT s_nationkey AS project, p_brand AS kind, p_partkey AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) >= 4),
    taken AS (SELECT DISTINCT c_nationkey AS project, p_brand AS kind, p_partkey AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
    providers AS (SELECT kind, name, count(*) AS n, min(project) AS provider FROM provided GROUP BY ALL),
    linked AS (SELECT t.project, kind, name, provider FROM taken t JOIN providers p USING (kind, name) WHERE n = 1 AND t.project <> provider)"""


def _linked(s, d):
    return links.unique_provider_links(catalog.offers(s, d), catalog.wants(s, d))


@query(f"WITH {_MARKET} SELECT * FROM linked")
def project_links_unique_provider(s, d):
    return _linked(s, d)


@query(
    f"""WITH {_MARKET} SELECT t.project, count(*) FILTER (WHERE n = 1 AND t.project <> provider) AS linked, count(*) FILTER (WHERE n > 1) AS ambiguous,
    count(*) FILTER (WHERE n IS NULL) AS unprovided FROM taken t LEFT JOIN providers USING (kind, name) GROUP BY 1"""
)
def links_market_counts(s, d):
    return links.market_counts(catalog.offers(s, d), catalog.wants(s, d))


@query(f"WITH {_MARKET} SELECT project, provider, count(*) AS n, array_to_string(list(name ORDER BY name)[1:3], ',') AS samples FROM linked GROUP BY 1, 2")
def link_samples(s, d):
    return links.link_samples(_linked(s, d), 3)


@query(f"WITH {_MARKET} SELECT project, count(*) AS n, 'uses' AS direction FROM linked GROUP BY 1 UNION ALL SELECT provider, count(*), 'used_by' FROM linked GROUP BY 1")
def link_summary(s, d):
    return links.link_summary(_linked(s, d))


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey AS reference, l_suppkey AS target, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS priority FROM lineitem),
    b AS (SELECT reference, priority, count(*) AS n, min(target) AS t FROM c GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY priority) AS r FROM b)
    SELECT o_orderkey AS reference, CASE WHEN n = 1 THEN t END AS target, coalesce(n > 1, false) AS ambiguous FROM orders LEFT JOIN f ON o_orderkey = reference AND r = 1"""
)
def resolve_priority(s, d):
    priority = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    found = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("reference"), F.col("l_suppkey").alias("target"), priority.alias("priority"))
    return links.resolved(_t(s, d, "orders").select(F.col("o_orderkey").alias("reference")), found)


# --- incremental --------------------------------------------------------------


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def owed_files(s, d):
    return incremental.owed(_t(s, d, "documents"), _t(s, d, "labels"), ["doc_id"]).select("doc_id")


@query("SELECT source, count(*) AS total, count(l.doc_id) AS done, round(count(l.doc_id) / count(*), 6) AS share FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def coverage_gauges(s, d):
    done = _t(s, d, "labels").select("doc_id", F.lit(True).alias("done"))
    rows = _t(s, d, "documents").select("doc_id", "source").join(done, "doc_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    return incremental.coverage(rows, ["source"], "done")


@query(
    """SELECT d.doc_id, CASE WHEN o.h IS NULL THEN 'new' WHEN o.h <> md5(d.text) THEN 'changed' ELSE 'current' END AS state
    FROM documents d LEFT JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0) o USING (doc_id)"""
)
def stale_hashes(s, d):
    docs = _t(s, d, "documents")
    old = docs.filter("doc_id % 3 != 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary")).alias("hash"))
    now = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    return incremental.stale(now, old, "doc_id", "hash").select("doc_id", "state")


@query(
    """WITH l AS (SELECT n_nationkey AS project, 0 AS rank, 'project' AS origin, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END AS depth, CASE WHEN n_nationkey % 4 = 0 THEN 'on' END AS mode FROM nation
        UNION ALL SELECT n_nationkey, 1, 'organization', CASE WHEN n_regionkey % 2 = 0 THEN 100 + n_regionkey END, NULL FROM nation UNION ALL SELECT n_nationkey, 2, 'default', 7, 'off' FROM nation)
    SELECT project, arg_min(depth, rank) FILTER (WHERE depth IS NOT NULL) AS depth, arg_min(origin, rank) FILTER (WHERE depth IS NOT NULL) AS depth_origin,
           arg_min(mode, rank) FILTER (WHERE mode IS NOT NULL) AS mode, arg_min(origin, rank) FILTER (WHERE mode IS NOT NULL) AS mode_origin FROM l GROUP BY project"""
)
def override_resolution(s, d):
    n, key = _t(s, d, "nation"), F.col("n_nationkey").alias("project")
    level = lambda rank, origin, depth, mode: n.select(key, F.lit(rank).alias("rank"), F.lit(origin).alias("origin"), depth.cast("int").alias("depth"), mode.cast("string").alias("mode"))
    levels = level(0, "project", F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey")), F.when(F.col("n_nationkey") % 4 == 0, "on"))
    levels = levels.union(level(1, "organization", F.when(F.col("n_regionkey") % 2 == 0, 100 + F.col("n_regionkey")), F.lit(None)))
    return relational.nearest_level(levels.union(level(2, "default", F.lit(7), F.lit("off"))), ["project"], ["depth", "mode"])


@query(
    """WITH h AS (SELECT user_id AS query, event_type AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events),
    t AS (SELECT * FROM h WHERE rank <= 5), g AS (SELECT DISTINCT user_id AS query, 'purchase' AS id FROM events),
    x AS (SELECT t.query, count(g.id) AS n, count(*) AS shown, min(rank) FILTER (WHERE g.id IS NOT NULL) AS first FROM t LEFT JOIN g USING (query, id) GROUP BY 1)
    SELECT query, round(n / 1, 6) AS recall, round(n / shown, 6) AS precision, round(coalesce(1 / first, 0), 6) AS reciprocal_rank FROM x"""
)
def ir_metrics(s, d):
    e = _t(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hits = e.select(F.col("user_id").alias("query"), F.col("event_type").alias("id"), F.row_number().over(w).alias("rank"))
    return incremental.retrieval_metrics(hits, e.select(F.col("user_id").alias("query"), F.lit("purchase").alias("id")).distinct(), 5)


# --- records and events -------------------------------------------------------


@query(
    """SELECT event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS tag, count(*) AS hits, min(ts) AS first_seen, max(ts) AS last_seen,
    arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1, 2"""
)
def suggestion_rollup(s, d):
    e = _t(s, d, "events").withColumn("tag", F.get_json_object("props", "$.k").cast("int") % 5)
    return e.groupBy(F.col("event_type").alias("kind"), "tag").agg(
        F.count(F.lit(1)).alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max(F.struct("ts", "event_id"))["event_id"].alias("last_id")
    )


@query(
    """SELECT c_custkey, array_to_string(CASE WHEN list_contains(q, x) THEN q WHEN len(q) >= 3 THEN list_append(q[2:3], x) ELSE list_append(q, x) END, ',') AS queue
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ['a', 'b', 'c'] ELSE ['a', 'b'] END AS q, chr(CAST(97 + c_custkey % 5 AS INT)) AS x FROM customer)"""
)
def ring_buffer_append(s, d):
    letters = lambda *x: F.array(*map(F.lit, x))
    queue = F.when(F.col("c_custkey") % 2 == 0, letters("a", "b", "c")).otherwise(letters("a", "b"))
    value = F.char(97 + F.col("c_custkey") % 5)
    return _t(s, d, "customer").select("c_custkey", F.array_join(relational.ring_append(queue, value, 3), ",").alias("queue"))


@query("SELECT user_id, CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) AS age FROM events GROUP BY user_id")
def staleness_seconds(s, d):
    last = F.max(F.unix_timestamp("ts"))
    return _t(s, d, "events").groupBy("user_id").agg((F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - last).alias("age"))


@query(
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
    SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM b GROUP BY user_id, burst"""
)
def session_windows(s, d):
    return ev.bursts(_t(s, d, "events"), "user_id", "ts", "1 hour")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS \"start\", event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_windows(s, d):
    return ev.windowed_counts(_t(s, d, "events"), "ts", "1 day", "event_type")


@query(
    """SELECT user_id, (max(ts) FILTER (WHERE event_type = 'view') IS NULL OR max(ts) > max(ts) FILTER (WHERE event_type = 'view'))
    AND CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) >= 86400 AND (max(ts) FILTER (WHERE event_type = 'view') IS NULL
    OR CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) - CAST(floor(epoch(max(ts) FILTER (WHERE event_type = 'view'))) AS BIGINT) >= 172800) AS due FROM events GROUP BY user_id"""
)
def settle_debounce(s, d):
    rows = _t(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("changed"), F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("ran"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return rows.select("user_id", ev.due(F.col("changed"), F.col("ran"), now, 86400, 172800).alias("due"))


@query(
    """WITH a AS (SELECT user_id AS task, ts, CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'enqueue' ELSE 'release' END AS action FROM events),
    r AS (SELECT task, max((ts, action)) AS last, count(*) FILTER (WHERE action = 'claim') AS tries FROM a GROUP BY task)
    SELECT task, tries, CASE WHEN last[2] = 'finish' THEN 'done' WHEN last[2] = 'claim' AND CAST(epoch(TIMESTAMP '2024-01-31') AS BIGINT) - CAST(floor(epoch(last[1])) AS BIGINT) <= 86400 THEN 'leased'
        WHEN tries >= 12 THEN 'failed' ELSE 'waiting' END AS state FROM (SELECT task, tries, [NULL] AS z, last FROM r)"""
)
def lease_state_replay(s, d):
    action = F.col("event_type")
    action = F.when(action == "view", "claim").when(action == "purchase", "finish").when(action == "error", "fail").when(action == "signup", "enqueue").otherwise("release")
    rows = _t(s, d, "events").select(F.col("user_id").alias("task"), "ts", action.alias("action"))
    return ev.replay_leases(rows, F.lit("2024-01-31 00:00:00").cast("timestamp"), 86400, 12)


@query(
    """SELECT event_id, row_number() OVER w AS n, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER w)) AS BIGINT) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def event_sequence(s, d):
    return ev.sequence(_t(s, d, "events"), "user_id", "ts", "event_id").select("event_id", "n", "gap")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 = 0")
def upsert_latest_wins(s, d):
    old = _t(s, d, "customer").select("c_custkey", "c_name")
    return relational.upsert(old, old.filter("c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


# --- symbols ------------------------------------------------------------------

_SYMBOLS = """nodes AS (SELECT c_nationkey AS project, c_custkey AS id, c_mktsegment || '#' || c_custkey // 2 AS name, CASE WHEN c_custkey % 11 = 0 THEN 'file' ELSE 'method' END AS type,
        c_nationkey || '/' || c_mktsegment AS path FROM customer),
    wanted AS (SELECT c_custkey AS ask, c_mktsegment || '#' || c_custkey // 2 AS name, CASE WHEN c_custkey % 2 = 0 THEN 'FURNITURE#' || c_custkey // 20 END AS owner,
        CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS ending FROM customer)"""


@query(
    f"""WITH {_SYMBOLS}, held AS (SELECT a.project, a.id, b.name AS holder FROM nodes a JOIN nodes b ON b.id = a.id // 10 AND b.project = a.project AND a.id <> b.id AND b.type <> 'file'),
    f AS (SELECT ask, owner AS asked, n.project, n.id FROM nodes n JOIN wanted w USING (name) WHERE type <> 'file' AND (ending IS NULL OR path = ending OR path LIKE '%/' || ending)),
    o AS (SELECT ask, f.project, f.id, holder AS owner, asked IS NOT NULL AND holder IS NOT DISTINCT FROM asked AS owned FROM f LEFT JOIN held USING (project, id))
    SELECT * FROM o WHERE owned OR ask NOT IN (SELECT ask FROM o WHERE owned)"""
)
def resolve_symbols(s, d):
    """Every customer asks for its name and every customer may hold others: n is held by n div 10 of its nation."""
    c = _t(s, d, "customer")
    kind = F.when(F.col("c_custkey") % 11 == 0, "file").otherwise("method").alias("type")
    name = F.concat("c_mktsegment", F.lit("#"), F.expr("c_custkey div 2"))
    nodes = c.select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("id"), F.concat(F.lit("."), name, F.lit("()")).alias("name"), kind, F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("file_path"))
    edges = nodes.select("project", F.expr("id div 10").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation")).filter("source != target")
    owner = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(".FURNITURE#"), F.expr("c_custkey div 20"), F.lit("()"))).alias("owner")
    wanted = c.select(F.col("c_custkey").alias("ask"), name.alias("name"), owner, F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("file_path"))
    return symbols.resolve_symbols(nodes, edges, wanted, lambda owner: F.regexp_replace(owner, r"^\.|\(\)$", ""))


@query()
def resolve_symbols_all(s, d):
    """Every part asks and every node may hold others: in its project, node n is held by node n div 7. Rows grow with the square of the parts, so SQL is compared in the tests only."""
    part = _t(s, d, "part")
    kind = F.when(F.col("p_partkey") % 11 == 0, "file").otherwise("method").alias("type")
    nodes = part.select((F.col("p_partkey") % 50).alias("project"), F.col("p_partkey").alias("id"), F.concat(F.lit("."), "p_name", F.lit("()")).alias("name"), kind, F.concat_ws("/", "p_brand", "p_type").alias("file_path"))
    edges = nodes.select("project", F.expr("id div 350 * 50 + id % 50").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation")).filter("source != target")
    names = F.when(F.col("p_partkey") % 2 == 0, ".red widget()").alias("owner"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("file_path")
    wanted = part.select(F.col("p_partkey").alias("ask"), F.col("p_name").alias("name"), *names)
    return symbols.resolve_symbols(nodes, edges, wanted, lambda owner: F.regexp_replace(owner, r"^\.|\(\)$", ""))


@query(
    """WITH g AS (SELECT project, id, h.file_path, h.line FROM (SELECT l_suppkey AS project, l_partkey AS id, min((l_orderkey, l_returnflag, l_linenumber)) AS m FROM lineitem WHERE l_quantity < 2 GROUP BY 1, 2),
        (SELECT NULL) z, LATERAL (SELECT m[2] AS file_path, m[3] AS line) h),
    t AS (SELECT DISTINCT l_suppkey AS project, -(l_partkey % 50) AS id, l_returnflag AS file_path, l_linenumber AS line FROM lineitem WHERE l_quantity > 40
          AND (l_suppkey, l_returnflag, l_linenumber) NOT IN (SELECT project, file_path, line FROM g))
    SELECT project, id, 'graph' AS evidence, file_path, line, CAST(line AS VARCHAR) AS lines FROM g
    UNION ALL SELECT project, id, 'text', min(file_path), min(line), array_to_string(list_sort(list(DISTINCT line)), ',') FROM t GROUP BY 1, 2"""
)
def merge_evidence(s, d):
    lines = _t(s, d, "lineitem")
    key = F.col("l_suppkey").alias("project"), F.col("l_returnflag").alias("file_path"), F.col("l_linenumber").alias("line")
    hits = lines.filter("l_quantity < 2").select(*key, F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("rank"))
    text = lines.filter("l_quantity > 40").select(*key, (-(F.col("l_partkey") % 50)).alias("id"))
    return symbols.merge_evidence(hits, text).withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@query(
    """SELECT count(*) FILTER (WHERE o_orderkey % 3 <= 1) AS direct, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS indirect, count(*) FILTER (WHERE o_custkey % 4 = 0) AS tests,
    count(*) FILTER (WHERE o_custkey % 4 <> 0 AND o_orderstatus = 'F') AS public_api, count(*) FILTER (WHERE o_custkey % 4 <> 0 AND (o_orderpriority LIKE '1%' OR o_orderstatus = 'P')) AS configuration,
    count(DISTINCT o_orderstatus || '/' || o_custkey) AS files FROM orders"""
)
def impact_counts(s, d):
    hits = _t(s, d, "orders").select(
        (F.col("o_orderkey") % 3).alias("hop"), F.substring("o_orderpriority", 1, 1).alias("relation"), F.concat_ws("/", "o_orderstatus", "o_custkey").alias("file_path"), (F.col("o_custkey") % 4 == 0).alias("test")
    )
    return symbols.impact_counts(hits, "^F/", "^P/", ["1"])


@query(
    f"""WITH {_PURCHASES}, one AS (SELECT DISTINCT target AS id FROM purchases WHERE source = 1),
    two AS (SELECT p.source AS id, min(p.target) AS parent FROM purchases p JOIN one ON p.target = one.id WHERE p.source <> 1 GROUP BY 1)
    SELECT CAST(1 AS BIGINT) AS id, 0 AS hop, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS VARCHAR) AS way, CAST(NULL AS VARCHAR) AS relation, '1' AS chain, (SELECT count(*) FROM one) = 0 AS last
    UNION ALL SELECT id, 1, 1, 'out', 'buys', '1 -[out buys]-> ' || id, id NOT IN (SELECT parent FROM two) FROM one
    UNION ALL SELECT id, 2, parent, 'in', 'buys', '1 -[out buys]-> ' || parent || ' -[in buys]-> ' || id, true FROM two"""
)
def trace_chains(s, d):
    start = s.range(1).select(F.lit(1).cast("long").alias("id"))
    return symbols.trace(catalog.purchases(s, d).withColumn("relation", F.lit("buys")), start, 2)


@query(
    f"""WITH {_TRADES}, n AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM trades UNION ALL SELECT target FROM trades) GROUP BY 1)
    SELECT id, degree, round(degree / (SELECT max(degree) FROM n), 6) AS size, degree / (SELECT max(degree) FROM n) >= 0.15 AS labelled FROM n"""
)
def relative_degrees(s, d):
    return graph.relative_degrees(catalog.trades(s, d), 0.15).withColumn("size", F.round("size", 6))


@query()
def community_hubs(s, d):
    trades = catalog.trades(s, d)
    return graph.hubs(trades, graph.communities(trades, 5))


# --- manifests and work records -----------------------------------------------


@query(
    """SELECT c_nationkey AS project, c_custkey || '/requirements.txt' AS path, 'pypi' AS kind, name, false AS provided FROM customer, LATERAL (SELECT unnest(['base-tools', 'lib-' || c_custkey % 10]) AS name)
    WHERE c_custkey % 2 = 0 UNION ALL
    SELECT c_nationkey, c_custkey || '/go.mod', 'go', unnest(['example.com/m' || c_custkey % 10, 'example.com/x' || c_custkey % 5]), unnest([true, false]) FROM customer WHERE c_custkey % 2 = 1"""
)
def manifest_names(s, d):
    n = lambda k: (F.col("c_custkey") % k).cast("string")
    pip = F.concat(F.lit("# tools\nBase_Tools>=1.0  # pinned\n-r other.txt\nhttps://example.com/a.zip\n\nlib."), n(10), F.lit("[fast]==2\n"))
    go = F.concat(F.lit("module example.com/m"), n(10), F.lit("\n\ngo 1.22\nrequire (\n\texample.com/x"), n(5), F.lit(" v1.2.0\n\texample.com/y v0.1.0 // indirect\n)\n"))
    even = F.col("c_custkey") % 2 == 0
    path = F.concat_ws("/", "c_custkey", F.when(even, "requirements.txt").otherwise("go.mod")).alias("path")
    return manifests.manifest_names(_t(s, d, "customer").select(F.col("c_nationkey").alias("project"), path, F.when(even, pip).otherwise(go).alias("text")))


@query(
    """WITH i AS (SELECT o_custkey AS roadmap, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderstatus AS status FROM orders),
    f AS (SELECT roadmap, min(item) AS item FROM i GROUP BY 1)
    SELECT roadmap, item, position + (roadmap % 3 = 0)::INT AS position, CASE WHEN roadmap % 3 = 1 AND item IN (SELECT item FROM f) THEN 'done' ELSE status END AS status FROM i
    UNION ALL SELECT roadmap, -roadmap - 1, 1, 'open' FROM f WHERE roadmap % 3 = 0"""
)
def roadmap_inserts(s, d):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    items = _t(s, d, "orders").select(F.col("o_custkey").alias("roadmap"), F.col("o_orderkey").alias("item"), place.alias("position"), F.col("o_orderstatus").alias("status"))
    first, ahead = items.groupBy("roadmap").agg(F.min("item").alias("item")).filter("roadmap % 3 < 2"), F.col("roadmap") % 3 == 0
    return records.write_items(
        items,
        first.select(
            "roadmap", F.when(ahead, -F.col("roadmap") - 1).otherwise(F.col("item")).alias("item"), F.when(ahead, F.lit(1)).cast("long").alias("position"), F.when(ahead, "open").otherwise("done").alias("status")
        ),
    )


@query(
    """WITH o AS (SELECT user_id AS id, count(*) AS hits, CASE WHEN user_id % 3 = 0 THEN 'fixed' ELSE 'planned' END AS status, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE event_type = 'view' GROUP BY 1),
    n AS (SELECT user_id AS id, (user_id % 2)::INT AS bump FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT id, coalesce(hits, 0) + coalesce(bump, 0) AS hits, CASE WHEN bump = 1 AND status = 'fixed' THEN 'open' ELSE coalesce(status, 'open') END AS status,
    coalesce(first_seen, TIMESTAMP '2024-02-01') AS first_seen, CASE WHEN bump = 1 OR last_seen IS NULL THEN TIMESTAMP '2024-02-01' ELSE last_seen END AS last_seen FROM o FULL JOIN n USING (id)"""
)
def suggestion_sightings(s, d):
    e = _t(s, d, "events").withColumnRenamed("user_id", "id")
    old = e.filter("event_type = 'view'").groupBy("id").agg(F.count(F.lit(1)).alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    old = old.withColumns({"status": F.when(F.col("id") % 3 == 0, "fixed").otherwise("planned"), "queries": F.array(F.lit("q"))})
    new = e.filter("event_type = 'purchase'").select("id").distinct().withColumns({"bump": (F.col("id") % 2).cast("int"), "status": F.lit(None).cast("string"), "query": F.lit("r")})
    return records.count_sightings(old, new, F.lit("2024-02-01 00:00:00").cast("timestamp")).drop("queries")


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'done' ELSE 'open' END ELSE CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END END AS status,
    CASE WHEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 = 0 ELSE o_orderstatus = 'F' END THEN strftime(CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE TIMESTAMP '2024-02-01' END, '%Y-%m-%d') END AS closed_at FROM orders"""
)
def issue_transitions(s, d):
    o = _t(s, d, "orders")
    done = F.col("o_orderstatus") == "F"
    issues = o.select(F.col("o_orderkey").alias("id"), F.when(done, "done").otherwise("open").alias("status"), F.when(done, F.col("o_orderdate")).alias("closed_at"))
    changes = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "done").otherwise("open").alias("status"))
    out = records.settle(issues, changes, F.lit("2024-02-01 00:00:00").cast("timestamp"), ["done"])
    return out.withColumn("closed_at", F.date_format("closed_at", "yyyy-MM-dd"))


@query("SELECT doc_id, NOT (doc_id IN (SELECT doc_id FROM labels)) AS missing FROM documents")
def missing_ties(s, d):
    key = F.lit(0).alias("project"), F.col("doc_id").alias("id")
    return records.flag_missing(_t(s, d, "documents").select(*key), _t(s, d, "labels").select(*key)).select(F.col("id").alias("doc_id"), "missing")
