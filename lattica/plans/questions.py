"""Queries over questions, names, paths and what is shown of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import paths, shapes
from ..functions import questions as ask
from .registry import query


def _t(s, d, name):
    return catalog.table(s, d, name)


def _sorted(column):
    return F.array_join(F.array_sort(column), ",")


# --- questions ----------------------------------------------------------------

_QUESTION = """asked AS (SELECT p_partkey AS id, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'how does ' || p_type || ' call load_' || p_size || ' of Parts.' || replace(p_name, ' ', '')
    WHEN 1 THEN '"' || p_name || '" -old_' || p_size || ' HTTPServer' || p_size WHEN 2 THEN p_name || ' OR readLimit' || ' with bindings' WHEN 3 THEN 'where are the cached ' || p_name || 's running in read_all::stoppedNow'
    ELSE p_type || ' parsing of ' || p_brand END AS q FROM part)"""
_STOP = "('and','are','does','for','from','how','into','the','that','this','what','when','where','which','who','why','with')"
_CAMEL = r"regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
_DOUBLE = "'(bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|yy|zz)$'"


def _cut(n: int, verb: bool) -> str:
    root = f"left(w, length(w) - {n})"
    return f"CASE WHEN regexp_matches({root}, {_DOUBLE}) THEN left(w, length(w) - {n + 1}) ELSE {root} END" if verb else root


_STEM = "CASE " + " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {len(e) + 4} THEN {_cut(len(e), e in ('ing', 'ed'))}" for e in ("ing", "ies", "ied", "es", "ed", "s")) + " ELSE w END"


def _questions(s, d):
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("how does "), "p_type", F.lit(" call load_"), size, F.lit(" of Parts."), F.replace("p_name", F.lit(" "), F.lit(""))))
        .when(kind == 1, F.concat(F.lit('"'), "p_name", F.lit('" -old_'), size, F.lit(" HTTPServer"), size))
        .when(kind == 2, F.concat("p_name", F.lit(" OR readLimit with bindings")))
        .when(kind == 3, F.concat(F.lit("where are the cached "), "p_name", F.lit("s running in read_all::stoppedNow")))
        .otherwise(F.concat("p_type", F.lit(" parsing of "), "p_brand"))
    )
    return catalog.spread(_t(s, d, "part")).select(F.col("p_partkey").alias("id"), text.alias("q"))


_ROOTS = f"""list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({_CAMEL.format('q')}, '[A-Za-z0-9]+'), lambda w: lower(w)),
    lambda w: length(w) >= 3 AND w NOT IN {_STOP}), lambda w: {_STEM}))"""
_OPERATORS = r"""regexp_matches(q, '"|\sOR\s|(^|\s)-[A-Za-z0-9_]')"""


@query(
    rf"""WITH {_QUESTION}, r AS (SELECT id, q, {_ROOTS} AS roots, {_OPERATORS} AS operators, regexp_extract_all(q, '[A-Za-z0-9_$]+') AS words FROM asked),
    n AS (SELECT *, list_distinct(list_filter(list_transform(words, lambda w: lower(w)), lambda w: length(w) >= 3 AND w NOT IN {_STOP})) AS ids FROM r)
    SELECT id, CASE WHEN NOT operators AND len(roots) > 0 THEN array_to_string(list_sort(list_transform(roots, lambda r: CASE WHEN length(r) >= 4 THEN r || ':*' ELSE r END)), ',') END AS terms,
           array_to_string(list_sort(roots), ',') AS words,
           array_to_string(list_sort(list_transform(list_filter(ids, lambda i: regexp_matches(i, '^[a-z0-9_]+$') AND len(list_filter(words, lambda w: lower(w) = i AND regexp_matches(w, '[_$0-9]|[a-z][A-Z]'))) > 0),
               lambda i: '%' || i || '%')), ',') AS names
    FROM n"""
)
def lexical_terms(s, d):
    q = F.col("q")
    return _questions(s, d).select("id", _sorted(ask.prefix_terms(q)).alias("terms"), _sorted(ask.roots(q)).alias("words"), _sorted(ask.name_patterns(q)).alias("names"))


@query(
    rf"""WITH {_QUESTION}, t AS (SELECT id, q, list_filter(regexp_extract_all(q, '[A-Za-z0-9_$]+(?:(?:\.|-|::)[A-Za-z0-9_$]+)*'), lambda t: (contains(t, '.') OR contains(t, '::') OR regexp_matches(t, '[_$0-9]|[a-z][A-Z]'))
        AND len(regexp_extract_all({_CAMEL.format('t')}, '[A-Za-z0-9]+')) > 1
        AND len(list_filter(regexp_extract_all({_CAMEL.format('t')}, '[A-Za-z0-9]+'), lambda p: length(p) >= 3 AND lower(p) NOT IN {_STOP})) > 0) AS w FROM asked)
    SELECT id, CASE WHEN {_OPERATORS} THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(w, lambda t: {_CAMEL.format('t')}))), ',') END AS whole FROM t"""
)
def whole_terms(s, d):
    return _questions(s, d).select("id", _sorted(ask.whole_phrases(F.col("q"))).alias("whole"))


@query(
    rf"""WITH {_QUESTION} SELECT id, array_to_string(list_sort(regexp_extract_all(q, '"([^"]+)"', 1)), ',') AS phrases,
    array_to_string(list_sort(regexp_extract_all(regexp_replace(q, '"[^"]*"', ' ', 'g'), '(?:^|\s)-([A-Za-z0-9_]+)', 1)), ',') AS left_out,
    array_to_string(list_sort(regexp_extract_all(regexp_replace(q, '"[^"]*"', ' ', 'g'), '(\S+)\s+OR\s+\S', 1)), ',') AS "either" FROM asked"""
)
def web_search_operators(s, d):
    found = _questions(s, d).select("id", ask.web_search(F.col("q")).alias("w"))
    return found.select("id", *(_sorted(f"w.{c}").alias(c) for c in ("phrases", "left_out", "either")))


@query(
    rf"""WITH {_QUESTION} SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(q, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda w: lower(w)),
    lambda w: length(w) >= 3 AND w NOT IN {_STOP}))), ',') AS words FROM asked"""
)
def question_subwords(s, d):
    return _questions(s, d).select("id", _sorted(ask.subwords(F.col("q"))).alias("words"))


_SYMBOL = r"""symbols AS (SELECT p_partkey AS id, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '.' || p_type || '.' || replace(p_name, ' ', '_') || '()' WHEN 1 THEN p_type || '::' || p_brand || '::at' || p_size
    WHEN 2 THEN './src/' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '.test.py' WHEN 3 THEN ' ' || replace(p_name, ' ', '#') || ' ' ELSE p_type || '.ts' END AS t FROM part)"""


@query(
    rf"""WITH {_SYMBOL}, x AS (SELECT id, trim(t) AS t, string_split(trim(t), '/')[-1] AS base, regexp_matches(trim(t), '(?i)/|\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|rb|java|kt|cs|php|c|cc|cpp|h|hpp|scala|ya?ml|json|toml|tf|hcl|sh|md)$') AS p,
        list_filter(regexp_split_to_array(regexp_replace(regexp_replace(trim(t), '^\.+', ''), '\(\)$', ''), '::|#|\.'), lambda y: y <> '') AS parts FROM symbols)
    SELECT id, CASE WHEN NOT p AND len(parts) > 1 THEN parts[-2] END AS owner, CASE WHEN p THEN CASE WHEN instr(base, '.') > 1 THEN left(base, instr(base, '.') - 1) ELSE base END ELSE parts[-1] END AS name,
           CASE WHEN p THEN regexp_replace(t, '^\./', '') END AS path FROM x"""
)
def parsed_symbols(s, d):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    name = lambda by: F.replace("p_name", F.lit(" "), F.lit(by))
    text = (
        F.when(kind == 0, F.concat(F.lit("."), "p_type", F.lit("."), name("_"), F.lit("()")))
        .when(kind == 1, F.concat("p_type", F.lit("::"), "p_brand", F.lit("::at"), size))
        .when(kind == 2, F.concat(F.lit("./src/"), F.lower("p_type"), F.lit("/"), name("-"), F.lit(".test.py")))
        .when(kind == 3, F.concat(F.lit(" "), name("#"), F.lit(" ")))
        .otherwise(F.concat("p_type", F.lit(".ts")))
    )
    return _t(s, d, "part").select(F.col("p_partkey").alias("id"), ask.parsed_symbol(text).alias("x")).select("id", "x.owner", "x.name", "x.path")


@query(
    r"""WITH l AS (SELECT o_orderkey AS id, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'x = load' || o_custkey || ' (y)' WHEN 1 THEN 'class A' || o_custkey || '(Base, load7)' WHEN 2 THEN 'import load' || o_custkey % 9 ELSE 'class B implements C.D, load7 {' END AS line FROM orders)
    SELECT id, regexp_matches(line, '\b(load7|load8)\b') AS word, regexp_matches(line, '\b(load7|load8)\b\s*\(') AS call,
    regexp_matches(line, '\b(extends|implements)\s+([\w.]+\s*,\s*)*load7\b|\bclass\s+\w+\s*\([^)]*\bload7\b') AS implements, regexp_matches(line, '\b(import|from|require)\b.*\bload7\b') AS imports FROM l"""
)
def symbol_patterns(s, d):
    cust, kind = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    line = (
        F.when(kind == 0, F.concat(F.lit("x = load"), cust, F.lit(" (y)")))
        .when(kind == 1, F.concat(F.lit("class A"), cust, F.lit("(Base, load7)")))
        .when(kind == 2, F.concat(F.lit("import load"), (F.col("o_custkey") % 9).cast("string")))
        .otherwise("class B implements C.D, load7 {")
    )
    one, two = F.lit("load7"), F.lit("load8")
    rows = _t(s, d, "orders").select(F.col("o_orderkey").alias("id"), line.alias("line"))
    return rows.select(
        "id", F.regexp("line", ask.word_pattern(one, two)).alias("word"), F.regexp("line", ask.call_pattern(one, two)).alias("call"),
        F.regexp("line", ask.implementation_pattern(one)).alias("implements"), F.regexp("line", ask.import_pattern(one)).alias("imports"),
    )


@query(r"""SELECT p_partkey, array_to_string(regexp_extract_all(p_brand || ' ' || p_name, '\w+'), '[\W_]*') AS pattern, regexp_matches(replace(p_name, ' ', '_-'), array_to_string(regexp_extract_all(p_name, '\w+'), '[\W_]*')) AS hit FROM part""")
def loose_patterns(s, d):
    loose = ask.loose_pattern(F.concat_ws(" ", "p_brand", "p_name"))
    hit = F.regexp(F.replace("p_name", F.lit(" "), F.lit("_-")), ask.loose_pattern(F.col("p_name")))
    return _t(s, d, "part").select("p_partkey", loose.alias("pattern"), hit.alias("hit"))


# --- paths and names ----------------------------------------------------------

_PATHS = r"""files AS (SELECT p_partkey AS id, ['src', 'src/tests', 'vendor/lib', 'Examples/x', 'a/node_modules/b', 'spec'][CAST(p_partkey % 6 + 1 AS INT)] || '/' ||
    ['test_', '', 'a_'][CAST(p_partkey % 3 + 1 AS INT)] || replace(p_name, ' ', '-') || ['.py', '_test.go', '.spec.ts', '.md'][CAST(p_partkey % 4 + 1 AS INT)] AS p FROM part)"""


def _files(s, d):
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % n + 1).cast("int"))
    folder = pick(6, "src", "src/tests", "vendor/lib", "Examples/x", "a/node_modules/b", "spec")
    path = F.concat(folder, F.lit("/"), pick(3, "test_", "", "a_"), F.replace("p_name", F.lit(" "), F.lit("-")), pick(4, ".py", "_test.go", ".spec.ts", ".md"))
    return _t(s, d, "part").select(F.col("p_partkey").alias("id"), path.alias("p"))


@query(
    rf"""WITH {_PATHS}, x AS (SELECT *, string_split(p, '/') AS seg FROM files)
    SELECT id, len(list_intersect(seg[:-2], ['test', 'tests'])) > 0 OR regexp_matches(seg[-1], '^test_|_test\.|\.(test|spec)\.[A-Za-z0-9]+$|^tests?\.rs$') AS test_file,
    regexp_matches(p, '(?i)(^|/)(tests?|spec|specs)/|(^|/)test_[^/]*$|[._-](test|spec)\.[^/]+$|_test\.[^/]+$|(^|/)tests?\.rs$') OR id % 10 = 0 AS test_path,
    len(list_intersect(seg, ['node_modules', 'vendor', '3rdparty', 'third_party', 'site-packages', '.venv'])) > 0 AS vendored,
    len(list_intersect(list_transform(seg[:-2], lambda y: lower(y)), ['test', 'tests', 'spec', 'specs', 'example', 'examples'])) > 0 AS fixture FROM x"""
)
def path_kinds(s, d):
    p = F.col("p")
    return _files(s, d).select("id", paths.is_test_file(p).alias("test_file"), paths.is_test_path(p, F.col("id") % 10 == 0).alias("test_path"), paths.is_vendored(p).alias("vendored"), paths.is_fixture(p).alias("fixture"))


@query(
    r"""SELECT p_partkey AS id, left('src/' || p_type || '.py::' || p_name, 512) AS entity, 'src/' || p_type || '.py' AS owner, p_name AS name, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9._-]+', '-', 'g'), '-') AS project,
    p_partkey % 2 = 0 AS fqdn, 'http_server/part_' || p_size || '_thing' AS snake, 'img/' || p_size || '.png' AS asset FROM part"""
)
def name_grammar(s, d):
    size = F.col("p_size").cast("string")
    path = F.concat(F.lit("src/"), "p_type", F.lit(".py"))
    entity = paths.entity_id(path, F.col("p_name"))
    host = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("web-"), size, F.lit(".example.com."))).otherwise(F.concat(F.lit("10.0.0."), size))
    return _t(s, d, "part").select(
        F.col("p_partkey").alias("id"), entity.alias("entity"), paths.owner_path(entity).alias("owner"), paths.entity_name(entity).alias("name"),
        paths.project_name(F.lit(" "), F.concat(F.lit("/srv/"), "p_brand", F.lit(" "), "p_name", F.lit("//"))).alias("project"), paths.is_fqdn(host).alias("fqdn"),
        paths.snake_file(F.concat(F.lit("HTTPServer::Part"), F.lit("_"), size, F.lit("Thing"))).alias("snake"), paths.asset_path(F.concat(F.lit("//img/"), size, F.lit(".png?v=1#x"))).alias("asset"),
    )


_ALPHABET = "chr(9) || chr(10) || chr(13) || ' _-,;:!?.''\"()[]{}@*/\\&#%`^+<=>|~$0123456789abcdefghijklmnopqrstuvwxyz'"


@query(
    rf"""WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || substring('_-. Aa9z', CAST(c_custkey % 8 + 1 AS INT), 1) || c_custkey % 7 AS n FROM customer),
    k AS (SELECT *, list_transform(string_split(n, ''), lambda x: instr({_ALPHABET}, lower(x))) AS w, list_transform(string_split(n, ''), lambda x: x <> lower(x)) AS caps FROM c)
    SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY w, caps, c_custkey) AS place FROM k"""
)
def collated_places(s, d):
    from pyspark.sql import Window

    ending = F.substring(F.lit("_-. Aa9z"), (F.col("c_custkey") % 8 + 1).cast("int"), F.lit(1))
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")), ending, (F.col("c_custkey") % 7).cast("string"))
    rows = _t(s, d, "customer").select("c_custkey", "c_nationkey", paths.collation_key(name).alias("key"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("key", "c_custkey")).cast("long")
    return rows.select("c_custkey", place.alias("place"))


# --- what is shown ------------------------------------------------------------


@query(
    r"""WITH x AS (SELECT p_partkey AS id, 'src/' || replace(p_name, ' ', '_') || '.py' AS p, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'The file ' || replace(p_name, ' ', '_') || '.py is a tool for ' || p_type WHEN 1 THEN 'This function counts ' || p_name || ' rows'
        WHEN 2 THEN 'The other.py file reads ' || p_name ELSE replace(p_name, ' ', '_') || '.py' END AS t FROM part)
    SELECT id, CASE CAST(id % 4 AS INT) WHEN 0 THEN 'A tool for ' || split_part(t, 'for ', 2) WHEN 1 THEN 'Counts ' || substring(t, 22) ELSE t END AS shown, id % 4 <> 3 AS useful FROM x"""
)
def summary_openings(s, d):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py"))
    kind = F.col("p_partkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("The file "), name, F.lit(" is a tool for "), "p_type"))
        .when(kind == 1, F.concat(F.lit("This function counts "), "p_name", F.lit(" rows")))
        .when(kind == 2, F.concat(F.lit("The other.py file reads "), "p_name"))
        .otherwise(name)
    )
    path = F.concat(F.lit("src/"), name)
    return _t(s, d, "part").select(F.col("p_partkey").alias("id"), shapes.without_preamble(text, path).alias("shown"), shapes.says_more(text, path).alias("useful"))


@query(
    r"""WITH x AS (SELECT doc_id AS id, text, 'f' || doc_id || '.txt' AS n, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '# About ' || doc_id || chr(10) WHEN 1 THEN '// does ' || doc_id || chr(10) ELSE '|' END || coalesce(text, '') AS t FROM documents)
    SELECT id, CASE CAST(id % 4 AS INT) WHEN 0 THEN 'About ' || id WHEN 1 THEN 'does ' || id WHEN 2 THEN 'a, b, +1 more' ELSE n || ' (' || len(string_split(t, chr(10))) || ' lines)' END AS summary FROM x"""
)
def file_summaries(s, d):
    kind, id_ = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    head = F.when(kind == 0, F.concat(F.lit("# About "), id_, F.lit("\n"))).when(kind == 1, F.concat(F.lit("// does "), id_, F.lit("\n"))).otherwise("|")
    names = F.when(kind == 2, F.array(*map(F.lit, "abc"))).otherwise(F.array().cast("array<string>"))
    text = F.concat(head, F.coalesce("text", F.lit("")))
    return _t(s, d, "documents").select(F.col("doc_id").alias("id"), shapes.file_summary(F.concat(F.lit("f"), id_, F.lit(".txt")), text, names, 2).alias("summary"))


@query(
    """WITH x AS (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(ts)) AS BIGINT) AS s, ts, value FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' min ago' WHEN s < 86400 THEN s // 3600 || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago'
        ELSE s // 86400 || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' END AS age, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at,
        CASE WHEN event_id % 100 > 0 THEN CAST(CASE WHEN event_id % 7 < event_id % 100 AND floor((event_id % 7) / (event_id % 100) * 100) = 100 THEN 99 ELSE floor((event_id % 7) / (event_id % 100) * 100) END AS BIGINT) END AS share,
        format('{:,}', event_id) AS number, printf('%.2f', value) AS fixed FROM x"""
)
def shown_values(s, d):
    seconds = F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp("ts")
    return _t(s, d, "events").select(
        "event_id", shapes.age(seconds).alias("age"), shapes.iso_utc(F.col("ts")).alias("at"), shapes.percent(F.col("event_id") % 7, F.col("event_id") % 100).alias("share"),
        shapes.thousands(F.col("event_id")).alias("number"), shapes.fixed(F.col("value"), 2).alias("fixed"),
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a=' || event_id || ',b=2,k=new' WHEN event_id % 3 = 1 THEN 'a=' || event_id || ',b=null,k=' || CAST(json_extract_string(props, '$.k') AS VARCHAR) ELSE 'a=' || event_id END AS merged,
    CASE WHEN event_id % 3 = 1 THEN 'a=' || event_id || ',k=' || CAST(json_extract_string(props, '$.k') AS VARCHAR) ELSE CASE WHEN event_id % 3 = 0 THEN 'a=' || event_id || ',b=2,k=new' ELSE 'a=' || event_id END END AS stripped FROM events"""
)
def json_objects(s, d):
    """Merge, removal of a key and of nulls, and one key set anew."""
    old = F.from_json("props", "map<string,string>")
    id_ = F.col("event_id").cast("string")
    three = F.col("event_id") % 3
    patch = F.when(three == 0, F.create_map(F.lit("b"), F.lit("2"), F.lit("k"), F.lit("new"))).when(three == 1, F.create_map(F.lit("b"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = shapes.json_set(shapes.json_merged(old, patch), "a", id_)
    merged = F.when(three == 2, shapes.json_without(merged, "k")).otherwise(merged)
    return _t(s, d, "events").select("event_id", shapes.entries_text(merged).alias("merged"), shapes.entries_text(shapes.json_without_nulls(merged)).alias("stripped"))
