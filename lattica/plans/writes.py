"""Queries over tables that are written again, records tied to plans, and the united lists of a search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import paths
from ..operators import incremental, records, relational, retrieval
from ..sources import manifests
from ..sources import text as files
from .answers import _SUMMARY_HITS
from .queries import _FUSED, _POSTINGS, _VECTOR, _lexical, _vector
from .registry import query


def _t(s, d, name):
    return catalog.table(s, d, name)


def _pick(key, *values):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


# --- writes -------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, lower(c_name) FROM customer WHERE c_custkey % 3 = 0")
def inserted_missing(s, d):
    """Every customer is inserted twice, in capitals and in small letters; those that are there stay as they are."""
    rows = _t(s, d, "customer").select("c_custkey", "c_name")
    new = rows.withColumn("c_name", F.upper("c_name")).union(rows.withColumn("c_name", F.lower("c_name")))
    return relational.insert_missing(rows.filter("c_custkey % 3 > 0"), new, ["c_custkey"])


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 4 > 0 UNION ALL SELECT o_custkey, -max(o_orderkey) FROM orders WHERE o_custkey % 4 = 0 GROUP BY 1")
def replaced_by_key(s, d):
    """All orders of every fourth customer give way to one row."""
    rows = _t(s, d, "orders").select("o_custkey", "o_orderkey")
    new = rows.filter("o_custkey % 4 = 0").groupBy("o_custkey").agg((-F.max("o_orderkey")).alias("o_orderkey"))
    return relational.replace_by_key(rows, new, ["o_custkey"])


@query("SELECT p_partkey FROM part ANTI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) l ON p_partkey = l_partkey")
def files_gone(s, d):
    found = _t(s, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return incremental.missing(_t(s, d, "part").select("p_partkey"), found, "p_partkey")


@query(
    """SELECT c_nationkey AS project, c_custkey AS id, CASE WHEN writes THEN 'new ' || c_custkey ELSE c_mktsegment END AS summary, CASE WHEN writes THEN CASE WHEN c_custkey % 5 = 0 THEN 'manual' ELSE 'llm' END ELSE old END AS summary_source
    FROM (SELECT *, c_custkey % 2 = 0 AND (c_custkey % 5 = 0 OR old IS DISTINCT FROM 'manual') AS writes FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'manual' WHEN c_custkey % 3 = 1 THEN 'llm' END AS old FROM customer))"""
)
def summaries_written(s, d):
    """A summary written by hand gives way only to another one."""
    k = F.col("id")
    nodes = _t(s, d, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("summary"))
    nodes = nodes.withColumn("summary_source", F.when(k % 3 == 0, "manual").when(k % 3 == 1, "llm"))
    written = nodes.filter(k % 2 == 0).select("project", "id", F.concat(F.lit("new "), k.cast("string")).alias("summary"), F.when(k % 5 == 0, "manual").otherwise("llm").alias("summary_source"))
    return records.write_summaries(nodes, written)


# --- records ------------------------------------------------------------------


@query(
    """SELECT 'plan' AS kind, n_nationkey AS id, n_nationkey AS plan_id FROM nation WHERE n_nationkey % 6 > 0 UNION ALL SELECT 'prompt', s_suppkey, s_nationkey FROM supplier WHERE s_nationkey % 6 > 0
    UNION ALL SELECT 'issue', c_custkey, CASE WHEN c_nationkey % 6 > 0 THEN c_nationkey END FROM customer"""
)
def plans_dropped(s, d):
    """Plans go with their prompts; issues stay, tied to none."""
    plans = _t(s, d, "nation").select(F.col("n_nationkey").alias("id"))
    prompts = _t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("plan_id"))
    issues = _t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("plan_id"))
    left = records.drop_plans(plans.filter("id % 6 = 0"), plans, prompts, issues)
    shown = [df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.col(tie).alias("plan_id")) for df, kind, tie in zip(left, ("plan", "prompt", "issue"), ("id", "plan_id", "plan_id"), strict=True)]
    return shown[0].union(shown[1]).union(shown[2])


@query("SELECT s_suppkey AS id, s_nationkey AS plan_id, n_regionkey AS project FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 1) n ON s_nationkey = n_nationkey")
def prompts_in_scope(s, d):
    """A prompt's project is its plan's; every fourth plan is missing."""
    plans = _t(s, d, "nation").filter("n_nationkey % 4 != 1").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("project"))
    return records.inherit_scope(_t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("plan_id")), plans)


_OWNED = "owned AS (SELECT CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS project, c_custkey AS id FROM customer)"


def _owned(s, d):
    return _t(s, d, "customer").select(F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey")).alias("project"), F.col("c_custkey").alias("id"))


@query(f"WITH {_OWNED} SELECT * FROM owned WHERE project IS NULL OR project IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def records_of_scope(s, d):
    """Records of an organization's projects, and those of none."""
    members = _t(s, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("project"))
    return relational.scoped(_owned(s, d), members, keep_global=True)


@query(f"WITH {_OWNED} SELECT * FROM owned WHERE project = 3 OR project IS NULL ORDER BY project IS NULL, id LIMIT 100")
def own_records_first(s, d):
    """A page of a project's records: its own, then those of none."""
    return records.own_then_global(_owned(s, d), 3, F.col("id")).limit(100)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def memories_by_tags(s, d):
    rows = _t(s, d, "orders").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("tags"))
    return records.tagged(rows, ["F", "1-URGENT"]).select("o_orderkey")


# --- sources ------------------------------------------------------------------


@query("SELECT doc_id, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '.py' WHEN 1 THEN '.sh' WHEN 2 THEN '.js' WHEN 3 THEN '.rb' END AS extension FROM documents")
def shebang_extensions(s, d):
    head = _pick(F.col("doc_id"), "#!/usr/bin/env python3\n", "#!/bin/bash -e\n", "#! /usr/local/bin/node\n", "#!/usr/bin/ruby2.7\n", "# no script\n")
    return _t(s, d, "documents").select("doc_id", files.shebang_extension(F.concat(head, F.coalesce("text", F.lit("")))).alias("extension"))


@query(
    """WITH f AS (SELECT p_size AS project, p_brand AS kind, p_type AS name, ['', 'x/', 'x/y/', 'tests/'][CAST(p_partkey % 4 + 1 AS INT)] || 'm' || p_partkey || '.json' AS path, p_partkey % 4 = 3 AS fixture FROM part)
    SELECT project, kind, name, arg_min(path, (len(string_split(path, '/')), path)) AS path FROM f WHERE NOT fixture GROUP BY 1, 2, 3"""
)
def providers_of_names(s, d):
    """Of the files that give a name the one nearest to the top; those among tests and examples give none."""
    k = F.col("p_partkey")
    path = F.concat(_pick(k, "", "x/", "x/y/", "tests/"), F.lit("m"), k.cast("string"), F.lit(".json"))
    rows = _t(s, d, "part").select(F.col("p_size").alias("project"), F.col("p_brand").alias("kind"), F.col("p_type").alias("name"), path.alias("path"), F.lit(True).alias("provided"))
    return manifests.shallowest(rows.filter(~paths.is_fixture(F.col("path"))))


# --- search over all lists ----------------------------------------------------

_LISTS = rf"""{_SUMMARY_HITS}, lists AS (SELECT id, score FROM lexical UNION ALL SELECT * FROM (SELECT id, (kinds + n / (n + size)) / 4 AS score FROM hits WHERE n > 0 ORDER BY round(kinds + n / (n + size), 6) DESC, id LIMIT 200)
        UNION ALL SELECT doc_id, 2.0::DOUBLE FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[a-z0-9]+'), ' ') || ' ', ' and the ')),
    best AS (SELECT id, max(score) AS score, 0 AS tf FROM lists GROUP BY id ORDER BY round(max(score), 9) DESC, id LIMIT 200)"""


@query(f"WITH {_POSTINGS}, {_VECTOR}, {_LISTS}, {_FUSED.replace('FROM lexical', 'FROM best')} SELECT id, round(rrf, 9) AS rrf, lexical_rank, vector_rank FROM fused ORDER BY round(rrf, 9) DESC, id LIMIT 50")
def hybrid_search_lists(s, d):
    """Words, summaries (scores below 1) and phrases (2) united, the best row of each id, then fused with the vectors."""
    docs, terms = _t(s, d, "documents"), ["the", "in", "erth"]
    summaries = docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("summary"))
    found = retrieval.summary_search(summaries, "doc_id", "summary", terms, 200).withColumn("score", F.col("score") / (len(terms) + 1))
    lists = _lexical(s, d).select("id", "score").union(found).union(retrieval.phrase_search(docs, "doc_id", "text", ["and", "the"]))
    best = lists.groupBy("id").agg(F.max("score").alias("score")).withColumn("tf", F.lit(0))
    best = best.orderBy(F.desc(F.round("score", 9)), "id").limit(200)
    out = retrieval.fuse(best, _vector(s, d)).select("id", F.round("rrf", 9).alias("rrf"), "lexical_rank", "vector_rank")
    return out.orderBy(F.desc("rrf"), "id").limit(50)
