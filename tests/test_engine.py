"""Operators on small hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.operators import graph, incremental, links, relational, retrieval
from lattica.sources import text as files
from lattica.streaming import events as ev


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_unique_provider(spark):
    """One provider links, several are ambiguous, an own provider blocks."""
    provided = spark.createDataFrame(
        [("alpha", "image", "worker"), ("alpha", "npm", "api"), ("alpha", "image", "built"), ("gamma", "npm", "api")], "project string, kind string, name string"
    )
    taken = spark.createDataFrame([("beta", "image", "worker"), ("beta", "npm", "api"), ("beta", "image", "built"), ("alpha", "image", "built")], provided.schema)
    assert rows(links.unique_provider_links(provided, taken)) == [("beta", "image", "built", "alpha"), ("beta", "image", "worker", "alpha")]
    counts = {r[0]: tuple(r)[1:] for r in links.market_counts(provided, taken).collect()}
    assert counts == {"beta": (2, 1, 0), "alpha": (0, 0, 0)}


def test_edges_of_walks_are_not_grouped(spark, monkeypatch):
    """A walk's edges are written as they come: grouping them first keeps a task's whole share of them in memory."""
    e, plans = __import__("__spark_entry__"), []
    write = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: (name == "walk-edges" and plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    for name in ("bfs_hops", "shortest_path_len", "impact_buckets"):
        e.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("Aggregate" in p for p in plans)
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 3)], "source long, target long")
    start = spark.createDataFrame([(3,)], "id long")
    assert rows(graph.shortest_paths(edges, start, 5)) == [(1, 2, 2), (2, 1, 3), (3, 0, None)]


def test_shortest_paths_have_no_bound(spark, monkeypatch):
    """The query reaches all that can be reached, and a long chain's tables become one now and then."""
    e, asked = __import__("__spark_entry__"), []
    search = graph.walk
    monkeypatch.setattr(graph, "walk", lambda edges, start, hops: (asked.append(hops), search(edges, start, hops))[1])
    e.queries()["shortest_path_len"](spark, "/root/testdata/sf0.001")
    assert asked == [None]
    monkeypatch.setattr(graph, "HOPS_APART", 3)
    chain = spark.createDataFrame([(n, n + 1) for n in range(9)] + [(20, 21), (4, 4)], "source long, target long")
    start = spark.createDataFrame([(0,)], "id long")
    found = graph.shortest_paths(chain, start)
    assert rows(found) == [(n, n, n - 1 if n else None) for n in range(10)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") < 15
    assert rows(graph.walk(chain, start, 4)) == [(n, n) for n in range(5)]


def test_walk_visits_each_node_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "source long, target long")
    seeds = spark.createDataFrame([(1,)], "id long")
    assert rows(graph.walk(edges, seeds, 3)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(graph.walk(edges, seeds, 9)) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_packing_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 4), ("b", 1, 11)], "k string, n int, cost int")
    packed = retrieval.pack(df, "k", "n", "cost", 10)
    assert rows(packed.select("k", "n", "packed")) == [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, False)]


def test_chunks_cover_all_lines(spark):
    text = "\n".join(f"line {i} " + "x" * (i % 40) for i in range(300))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "y" * 4000)], "id long, text string")
    got = retrieval.chunk_lines(df, "id", "text").toPandas()
    one = got[got.id == 1].sort_values("chunk")
    assert set(got.id) == {1, 4}
    assert (one.text.str.len() <= 1500).all() and one.start_line.iloc[0] == 1 and one.end_line.iloc[-1] == 300
    assert (one.start_line.iloc[1:].to_numpy() <= one.end_line.iloc[:-1].to_numpy() + 1).all()


def test_levels_fall_back_field_by_field(spark):
    levels = spark.createDataFrame([("p", 0, "project", None, "a"), ("p", 1, "global", 3, "b")], "k string, rank int, origin string, x int, y string")
    assert rows(relational.nearest_level(levels, ["k"], ["x", "y"])) == [("p", 3, "global", "a", "project")]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(relational.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(relational.insert_missing(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(relational.replace_by_key(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]


def test_ring_and_names(spark):
    df = spark.createDataFrame([(["a", "b"], "c"), (["a", "b", "c"], "d"), (["a"], "a")], "q array<string>, x string")
    got = [r[0] for r in df.select(relational.ring_append(F.col("q"), F.col("x"), 3)).collect()]
    assert got == [["a", "b", "c"], ["b", "c", "d"], ["a"]]
    names = spark.createDataFrame([("image", "docker.io/library/Redis:7@sha256:ab"), ("pypi", "My_Pkg.x"), ("host", "A.b.")], "k string, n string")
    assert [r[0] for r in names.select(tx.normalize_name(F.col("k"), F.col("n"))).collect()] == ["redis", "my-pkg-x", "a.b"]
    ids = spark.createDataFrame([("a/b/c.py",), ("c.py",), ("a/b/",)], "id string")
    assert [r[0] for r in ids.select(tx.ancestors(F.col("id"))).collect()] == [["a/b/", "a/"], [], ["a/"]]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("one\r\ntwo\n")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "y.py").write_text("no")
    (tmp_path / "b.bin").write_bytes(b"a\0b")
    tree = files.read_tree(spark, str(tmp_path), ["skip"])
    assert [r["path"].rsplit("/", 1)[1] for r in tree.collect()] == ["x.py"]
    ranges = spark.createDataFrame([(1, 2, 9), (7, 1, 1)], "id int, start int, end int")
    texts = spark.createDataFrame([(1, "a\nb\nc")], "id int, text string")
    assert rows(files.read_ranges(texts, ranges, "id", "text")) == [(1, 2, 9, "b\nc"), (7, 1, 1, None)]
    assert rows(files.grep(texts, "id", "text", "B|C", 5)) == [(1, 2, "b"), (1, 3, "c")]


def test_metrics_and_stale(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, id string, rank int")
    good = spark.createDataFrame([("q", "b"), ("q", "c"), ("r", "x")], "query string, id string")
    assert rows(incremental.retrieval_metrics(hits, good, 5)) == [("q", 0.5, 0.5, 0.5), ("r", 0.0, 0.0, 0.0)]


def test_streamed_bursts_equal_the_batch(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    batch = spark.createDataFrame([("a", t(0)), ("a", t(10)), ("a", t(50)), ("b", t(5))], "k string, ts timestamp")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = ev.bursts(stream, "k", "ts").writeStream.format("memory").queryName("bursts").outputMode("complete")
    job = run.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert rows(spark.table("bursts")) == rows(ev.bursts(batch, "k", "ts")) and spark.table("bursts").count() == 3


def test_manifests_of_every_format(spark):
    from lattica.sources import manifests

    texts = {
        "a/package.json": '{"name": "Web-App", "dependencies": {"left": "1"}}',
        "vcpkg.json": '{"name": "v", "dependencies": ["zlib", {"name": "fmt"}]}',
        "b/c/Cargo.toml": '[package]\nname = "crab"\nversion = "1"\n\n[dependencies]\nserde = "1"\ntokio = { version = "1" }\n\n[profile.release]\nlto = true\n',
        "CMakeLists.txt": "project(Engine)\nfind_package(Boost REQUIRED)\n",
        "d/requirements.txt": "A.b_c>=1\n# no\n-e .\n",
        "e/go.mod": "module m.io/x\nrequire q.io/y v1.0.0\n",
        "bad/package.json": "{",
        "other.txt": "project(x)",
        "null/go.mod": None,
        "CMake/package.json": "",
    }
    rows = spark.createDataFrame([(1, p, t) for p, t in texts.items()], "project int, path string, text string")
    got = {(r.path, r.kind, r.name, r.provided) for r in manifests.manifest_names(rows).collect()}
    assert got == {
        ("a/package.json", "npm", "web-app", True), ("vcpkg.json", "vcpkg", "v", True), ("vcpkg.json", "vcpkg", "zlib", False), ("vcpkg.json", "vcpkg", "fmt", False),
        ("b/c/Cargo.toml", "cargo", "crab", True), ("b/c/Cargo.toml", "cargo", "serde", False), ("b/c/Cargo.toml", "cargo", "tokio", False),
        ("CMakeLists.txt", "cmake", "engine", True), ("CMakeLists.txt", "cmake", "boost", False), ("d/requirements.txt", "pypi", "a-b-c", False),
        ("e/go.mod", "go", "m.io/x", True), ("e/go.mod", "go", "q.io/y", False),
    }


def test_trace_stops_at_uses(spark):
    from lattica.operators import symbols

    edges = spark.createDataFrame([(1, 2, "calls"), (2, 3, "uses"), (3, 4, "calls"), (5, 2, "calls")], "source int, target int, relation string")
    got = symbols.trace(edges, spark.createDataFrame([(1,)], "id int"), 5, ["uses"]).collect()
    assert {r.id: (r.hop, r.chain, r.last) for r in got} == {
        1: (0, "1", False), 2: (1, "1 -[out calls]-> 2", False), 3: (2, "1 -[out calls]-> 2 -[out uses]-> 3", True), 5: (2, "1 -[out calls]-> 2 -[in calls]-> 5", True),
    }


def test_records(spark):
    from lattica.operators import records

    plans = spark.createDataFrame([(1, "a"), (2, None)], "id int, project string")
    prompts = spark.createDataFrame([(10, 1, "x"), (11, 2, "y"), (12, None, "z")], "id int, plan_id int, text string")
    gone = spark.createDataFrame([(1,)], "id int")
    left, kept, tied = records.drop_plans(gone, plans, prompts, prompts)
    assert [r.id for r in left.collect()] == [2]
    assert sorted(r.id for r in kept.collect()) == [11, 12]
    assert {r.id: r.plan_id for r in tied.collect()} == {10: None, 11: 2, 12: None}
    assert {r.id: r.project for r in records.inherit_scope(prompts, plans).collect()} == {10: "a", 11: None, 12: None}
    assert [r.id for r in records.own_then_global(plans, "a").collect()] == [1, 2]
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None)], "id int, tags array<string>")
    assert [r.id for r in records.tagged(rows, ["a", "b"]).collect()] == [1]
    assert records.tagged(rows, []).count() == 3
    nodes = spark.createDataFrame([("p", 1, "own", "manual"), ("p", 2, None, None)], "project string, id int, summary string, summary_source string")
    new = spark.createDataFrame([("p", 1, "m", "llm"), ("p", 2, "n", "llm")], nodes.schema)
    assert {r.id: r.summary for r in records.write_summaries(nodes, new).collect()} == {1: "own", 2: "n"}
