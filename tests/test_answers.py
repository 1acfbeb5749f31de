"""Packets, chunks, manifests and settings on hand-made rows, against plain loops where SQL has none."""

import os

from pyspark.sql import functions as F

from lattica.operators import packets, ranking, relational, retrieval, state
from lattica.plans import answers
from lattica.sources import manifests
from lattica.sources import text as files

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_packet(rows, budget, chunks=True):
    """Hits, then tiers in order, then chunks, as one reads the rules."""
    order = ["seed", *packets.TIERS]
    rows = sorted(rows, key=lambda r: (order.index(r["tier"]), r["place"], r["seed"], r["id"]))
    taken, used, cut, later = [], 0, False, []

    def covered(r):
        return any(t["project"] == r["project"] and t["file_path"] == r["file_path"] and t["start_line"] <= r["end_line"] and r["start_line"] <= t["end_line"] for t, _ in taken)

    for r in rows:
        if r["tier"] == "seed":
            if chunks and r["chunk_cost"] is not None and used + r["cost"] + r["chunk_cost"] <= budget:
                used += r["cost"] + r["chunk_cost"]
                taken.append((r, [True]))
                continue
            cut = cut or (chunks and r["chunk_cost"] is not None) or used + r["cost"] > budget
            if used + r["cost"] <= budget:
                used += r["cost"]
                taken.append((r, [False]))
        elif not covered(r):
            if used + r["cost"] > budget:
                cut = True
                continue
            used += r["cost"]
            taken.append((r, flag := [False]))
            if chunks and r["chunk_cost"] is not None:
                later.append((r, flag))
    for r, flag in later:
        if used + r["chunk_cost"] > budget:
            cut = True
            break
        used += r["chunk_cost"]
        flag[0] = True
    assert used <= budget
    return [(r["packet"], n, r["id"], r["tier"], flag[0], cut) for n, (r, flag) in enumerate(taken, 1)]


def test_packets_are_those_of_the_plain_loop(spark):
    rows = [r.asDict() for r in answers.packet_candidates(spark, DATA).collect()]
    for budget in (60, 900):
        got = sorted(map(tuple, packets.assembled(answers.packet_candidates(spark, DATA), budget).collect()))
        want = [x for p in sorted({r["packet"] for r in rows}) for x in plain_packet([r for r in rows if r["packet"] == p], budget)]
        assert got == sorted(want) and any(x[4] for x in got) == (budget > 60 or any(x[4] for x in want))
    assert packets.assembled(answers.packet_candidates(spark, DATA).limit(0), 100).count() == 0


def test_chunks_are_cut_before_entities(spark):
    text = "\r\n".join(["x" * 9] * 20)
    known = [{"line": 9, "name": "f"}, {"line": 15, "name": "g"}]
    df = spark.createDataFrame([(1, text, known), (2, text, None)], "id int, text string, e array<struct<line:int,name:string>>")
    got = retrieval.chunk_lines(df, "id", "text", 100, 2, "e").collect()
    assert [(r.start_line, r.end_line, r.entity) for r in got if r.id == 1] == [(1, 8, None), (9, 14, "f"), (15, 20, "g")]
    assert [(r.start_line, r.end_line, r.entity) for r in got if r.id == 2] == [(1, 10, None), (9, 18, None), (17, 20, None)]


def test_renamed_crates_and_tables(spark):
    text = '[package]\nname = "a"\n\n[dependencies]\nold = { version = "1", package = "new" }\nplain = "1"\n\n[dependencies.own]\nversion = "2"\n'
    got = manifests.manifest_names(spark.createDataFrame([(1, "Cargo.toml", text)], "project int, path string, text string"))
    assert {(r.name, r.provided) for r in got.collect()} == {("a", True), ("new", False), ("plain", False), ("own", False)}


def test_rerank_without_bonuses_is_the_fused_order(spark):
    pool = answers._pool(spark, DATA).filter("project = 'p1'")
    got = [r.id for r in ranking.reranked(pool, F.lit("anything"), 5, enabled=False).orderBy("place").collect()]
    assert got == [r.id for r in pool.orderBy(F.desc(F.round("rrf", 12)), "id").limit(5).collect()]


def test_upserts_do_not_depend_on_the_order_of_rows(spark):
    old = spark.createDataFrame([(1, 1, "a")], "k int, at int, v string")
    new = spark.createDataFrame([(2, 1, "z"), (2, 5, "b"), (2, 5, "c")], old.schema)
    for rows in (new, new.orderBy(F.desc("v"))):
        assert sorted(map(tuple, relational.upsert(old, rows, ["k"], ["at"]).collect())) == [(1, 1, "a"), (2, 5, "c")]
        assert sorted(map(tuple, relational.insert_missing(old, rows, ["k"], ["at"]).collect())) == [(1, 1, "a"), (2, 5, "c")]


def test_columns_of_one_value_are_left_out(spark):
    df = spark.createDataFrame([("p", 1), ("p", 2)], "project string, id int")
    assert state.without_constant(df, "project").columns == ["id"]
    assert state.without_constant(df.withColumn("project", F.col("id")), "project").columns == ["project", "id"]


def test_secrets_are_not_read(spark):
    rows = spark.createDataFrame([("a/.env", 3, "x"), ("b/key.pem", 3, "x"), ("c.txt", 9999, "x"), ("d.txt", 3, "a\0b"), ("e.txt", 3, "abcdef")], "path string, size int, text string")
    got = {r.path: (r.text, r.reason) for r in files.read_content(rows, 4, 100).collect()}
    assert got == {"a/.env": (None, "not readable"), "b/key.pem": (None, "not readable"), "c.txt": (None, "too large"), "d.txt": (None, "binary"), "e.txt": ("abcd", None)}


def test_communities_by_hand(spark):
    from lattica.operators import graph

    edges = spark.createDataFrame([(a, b) for a, b in (("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"))], "source string, target string")
    both = {}
    for a, b in edges.collect():
        both.setdefault(a, []).append(b)
        both.setdefault(b, []).append(a)
    label = {n: n for n in both}
    for _ in range(4):
        label = {n: min(((-sum(label[m] == x for m in both[n]), x) for x in {label[m] for m in both[n]}))[1] for n in both}
    assert dict(map(tuple, graph.communities(edges, 4).collect())) == label
    members = spark.createDataFrame([(n, "abc" if n < "d" else "xyz") for n in both], "id string, community string")
    assert sorted(map(tuple, graph.hubs(edges, members).collect())) == [("abc", "a", 3), ("xyz", "x", 3)]
