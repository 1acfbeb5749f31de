"""Wanted symbols against brute force, and their query over all parts."""

import random

import duckdb

from lattica.operators import graph, symbols
from lattica.plans import QUERIES


def brute(nodes, edges, wanted):
    def bare(x):
        x = x.lstrip(".")
        return x[:-2] if x.endswith("()") else x

    name = {(p, i): n for p, i, n, t, _ in nodes if t not in symbols.PLACES}
    out = []
    for ask, called, by, where in wanted:
        found = []
        for p, i, n, t, path in nodes:
            if t in symbols.PLACES or t.startswith("external_") or bare(n) != called:
                continue
            if where is not None and path != where and not path.endswith("/" + where):
                continue
            holders = [(name[p, a] != by, a, name[p, a]) for q, a, b, r in edges if (q, b) == (p, i) and r in symbols.HOLDERS and (p, a) in name]
            owner = min(holders)[2] if holders else None
            found.append((ask, p, i, owner, by is not None and owner == by))
        out += [x for x in found if x[4]] or found
    return sorted(out, key=str)


def test_symbols_against_brute_force(spark):
    rnd = random.Random(5)
    nodes = [(i % 3, i, rnd.choice(["a", ".a()", "b()", "c"]), rnd.choice(["method", "class", "file", "external_x"]), rnd.choice(["x/m", "y/m", "m", "x/n"])) for i in range(400)]
    edges = sorted({(i % 3, a - a % 3 + i % 3, i, rnd.choice(["contains", "method", "calls"])) for i in range(400) for a in rnd.sample(range(399), 2)})
    edges = [e for e in edges if e[1] != e[2]]
    wanted = [(n, rnd.choice("abc"), rnd.choice([None, ".a()", "b()", "none"]), rnd.choice([None, "m", "x/m"])) for n in range(60)]
    got = symbols.resolve_symbols(
        spark.createDataFrame(nodes, "project int, id int, name string, type string, file_path string"),
        spark.createDataFrame(edges, "project int, source int, target int, relation string"),
        spark.createDataFrame(wanted, "ask int, name string, owner string, file_path string"),
    )
    want = brute(nodes, edges, wanted)
    assert any(x[1] > 0 and x[2] >= 200 and x[4] for x in want)
    assert sorted((tuple(r[c] for c in ("ask", "project", "id", "owner", "owned")) for r in got.collect()), key=str) == want


def test_every_part_asks_and_any_node_may_hold(spark, tmp_path):
    """2,000 parts, ten times the 200 ids of resolve_symbols."""
    duckdb.sql("SELECT range AS p_partkey, CASE WHEN range % 3 = 1 THEN 'red widget' ELSE 'blue nut' END AS p_name, 1 AS p_size, 'B' AS p_brand, 'T' AS p_type FROM range(2000)").write_parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES["resolve_symbols_all"](spark, str(tmp_path)).toPandas()
    assert set(rows.ask) == set(range(2000))
    held = rows[rows.owner.notna()]
    assert (held.id // 350 * 50 + held.id % 50 >= 200).any()
    assert (rows[rows.owned].owner == "red widget").all() and (rows[rows.owned].id >= 1400).any()


_ALL_SYMBOLS = """nodes AS (SELECT p_partkey % 50 AS project, p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 11 = 0 THEN 'file' ELSE 'method' END AS type, p_brand || '/' || p_type AS path FROM part),
    wanted AS (SELECT p_partkey AS ask, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'red widget' END AS owner, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS ending FROM part)"""


def test_all_symbols_are_those_of_sql(spark):
    import duckdb

    from lattica.plans import QUERIES

    where = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{where}/part.parquet'")
    want = duckdb.sql(
        f"""WITH {_ALL_SYMBOLS}, held AS (SELECT a.project, a.id, b.id AS source, b.name AS holder FROM nodes a JOIN nodes b ON b.id = a.id // 350 * 50 + a.id % 50 AND a.id <> b.id AND b.type <> 'file'),
    f AS (SELECT ask, owner AS asked, n.project, n.id FROM nodes n JOIN wanted w USING (name) WHERE type <> 'file' AND (ending IS NULL OR path = ending OR path LIKE '%/' || ending)),
    o AS (SELECT ask, f.project, f.id, holder AS owner, asked IS NOT NULL AND holder IS NOT DISTINCT FROM asked AS owned FROM f LEFT JOIN held USING (project, id))
    SELECT * FROM o WHERE owned OR ask NOT IN (SELECT ask FROM o WHERE owned)"""
    )
    got = QUERIES["resolve_symbols_all"](spark, where).select(*want.columns)
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_takers_of_other_projects_and_lists(spark):
    reached = spark.createDataFrame([(1, 0, 7), (1, 0, 8), (2, 1, 7), (3, 0, None)], "seed int, project int, id int")
    provided = spark.createDataFrame([(0, "k", "a", 7), (0, "k", "a", 8), (1, "k", "a", 7), (0, "k", None, 7), (0, "j", "b", 9)], "project int, kind string, name string, id int")
    taken = spark.createDataFrame([(0, "k", "a", 5), (2, "k", "a", 4), (2, "k", "a", 3), (2, "j", "b", 1), (None, "k", "a", 2)], "project int, kind string, name string, id int")
    crossing = symbols.crossings(reached, provided, taken)
    assert sorted(map(tuple, crossing.collect())) == [(1, 2, "k", "a", 3), (2, 0, "k", "a", 5), (2, 2, "k", "a", 3)]
    rows = [(1, 1, 0, n, "uses", f"api/{n}", n % 2 == 0) for n in range(40)] + [(1, 2, 0, 99, "sets", None, None), (4, 1, 0, 1, None, None, False)]
    hits = spark.createDataFrame(rows, "seed int, hop int, project int, id int, relation string, file_path string, test boolean")
    got = symbols.impact_lists(hits, crossing, "^api/", "^conf/", ["sets"], 3).collect()
    totals = {(r.seed, r.bucket): r.total for r in got}
    assert totals == {(1, "direct"): 40, (1, "indirect"): 1, (1, "tests"): 20, (1, "public_api"): 20, (1, "configuration"): 1, (1, "cross_project"): 1, (2, "cross_project"): 2, (4, "direct"): 1}
    assert [r.id for r in sorted(got, key=lambda r: r.place) if (r.seed, r.bucket) == (1, "public_api")] == [1, 3, 5]
    assert symbols.impact_lists(hits.limit(0), crossing.limit(0), "x", "y", []).count() == 0


def test_neighbours_have_turns(spark):
    edges = spark.createDataFrame([(0, "a", f"t{i}", "calls") for i in range(9)] * 2 + [(0, "a", "u", "uses"), (0, "z", "a", "calls"), (1, "a", "no", "calls"), (0, "a", "a", "own"), (None, "a", "x", "calls")], "project int, source string, target string, relation string")
    asked = spark.createDataFrame([(0, "a"), (0, "a"), (0, "gone"), (0, None)], "project int, of string")
    got = sorted((r.place, r.direction, r.relation, r.id, r.total) for r in graph.listed(edges, asked, 6).collect())
    assert got == [(1, "incoming", "calls", "z", 1), (1, "incoming", "own", "a", 1), (1, "outgoing", "calls", "t0", 9), (1, "outgoing", "own", "a", 1), (1, "outgoing", "uses", "u", 1), (2, "outgoing", "calls", "t1", 9)]
    assert [r.id for r in graph.listed(edges, asked, 6, "uses").collect()] == ["u"] and graph.listed(edges.limit(0), asked, 6).count() == 0


def test_neighbours_come_from_one_pass(spark):
    """Counts and places come from the same rows: nothing is joined but the asked nodes."""
    edges = spark.createDataFrame([(0, "a", "b", "calls"), (0, "a", "b", "calls"), (0, "a", "c", "calls")], "project int, source string, target string, relation string")
    found = graph.listed(edges, edges.select("project", edges.source.alias("of")), 1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert [tuple(r) for r in found.collect()] == [(0, "a", "outgoing", "calls", 1, 2, "b")]


def test_hits_are_worked_out_once(spark):
    """Hits are written before they are listed, and sorted without their texts."""
    hits = spark.createDataFrame([(1, 1, 0, 7, "uses", "api/7", False), (1, 1, 0, 7, "uses", "api/7", False), (1, 2, 0, 8, "uses", None, True)], "seed int, hop int, project int, id int, relation string, file_path string, test boolean").distinct()
    across = spark.createDataFrame([(1, 2, "k", "b", 3), (1, 2, "k", "a", 4)], "seed int, project int, kind string, name string, id int")
    found = symbols.impact_lists(hits, across, "^api/", "^conf/", [], 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "file_path" not in plan and "relation" not in plan
    assert sorted(map(tuple, found.collect())) == [
        (1, "cross_project", 2, 1, None, 2, 4), (1, "direct", 1, 1, 1, 0, 7), (1, "indirect", 1, 1, 2, 0, 8), (1, "public_api", 1, 1, 1, 0, 7), (1, "tests", 1, 1, 2, 0, 8)
    ]
