"""Walks between two nodes, searched from both ends."""

import random

from pyspark.sql import functions as F

from lattica.operators import graph


def plain(edges, start, end, hops):
    """All walks by length; the first that arrives, smallest ids first."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    walks = [[start]]
    for _ in range(hops + 1):
        there = [w for w in walks if w[-1] == end]
        if there:
            return min(there)
        walks = [[*w, n] for w in walks for n in near.get(w[-1], ()) if n not in w]
    return None


def run(spark, edges, pairs, hops, **budgets):
    rows = graph.paths_between(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame(pairs, "start long, end long"), hops, **budgets).collect()
    assert all(r.path is None or r.depth == len(r.path) - 1 for r in rows)
    return {(r.start, r.end): r.path for r in rows}


def test_walks_of_sparse_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(i, i + 1) for i in range(100, 107)]
    pairs = [(rng.randrange(42), rng.randrange(42)) for _ in range(60)] + [(100, 105), (107, 102), (100, 107)]
    got = run(spark, edges, pairs + pairs[:5], 5)
    assert got == {p: plain(edges, *p, 5) for p in pairs}
    assert got[(100, 105)] == [100, 101, 102, 103, 104, 105] and got[(100, 107)] is None


def test_odd_pairs(spark):
    edges = [(1, 2), (2, 1), (2, 2), (2, None), (None, 3)]
    got = run(spark, edges, [(1, 2), (1, 1), (9, 9), (1, 9), (None, 1), (1, None), (1, 3), (None, None)], 3)
    assert got == {(1, 2): [1, 2], (1, 1): [1], (9, 9): [9], (1, 9): None, (None, 1): None, (1, None): None, (1, 3): None, (None, None): None}
    assert run(spark, edges, [], 3) == {} and run(spark, [], [(1, 2)], 3) == {(1, 2): None}


def test_budgets_and_what_is_read(spark):
    star = [(0, i) for i in range(1, 300)] + [(1, 1000), (1000, 1001), (1001, 1002)]
    assert run(spark, star, [(1002, 200)], 6) == {(1002, 200): [1002, 1001, 1000, 1, 0, 200]}
    assert run(spark, star, [(5, 299)], 4, steps=400) == {(5, 299): [5, 0, 299]}
    assert run(spark, star, [(1001, 5)], 6, steps=2) == {(1001, 5): [1001, 1000, 1, 0, 5]}
    assert run(spark, star, [(1001, 5)], 6, steps=1) == {(1001, 5): None}  # every round turns back to what was seen
    assert run(spark, star, [(1002, 200)], 6, nodes=3) == {(1002, 200): None}
    rng = random.Random(1)
    wide = [(i, rng.randrange(4000)) for i in range(4000) for _ in range(4)]
    table, pairs = spark.createDataFrame(wide, "source long, target long"), spark.createDataFrame([(3, 77)], "start long, end long")
    met, seen, both = graph.meetings(table, pairs, 6)
    degree = both.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    depth = met.agg(F.min("depth")).first()[0]
    ends = seen.groupBy("side").agg(F.max("hop").alias("last"))
    two = seen.join(ends, "side").filter("hop < last").join(degree, "id").agg(F.sum("n")).first()[0]
    one = graph.walk(both, pairs.select(F.col("start").alias("id")), depth).filter(F.col("hop") < depth).join(degree, "id").agg(F.sum("n")).first()[0]
    assert depth >= 4 and 2 * two <= one


def test_last_round_keeps_only_what_meets(spark):
    ends = [(0, n) for n in range(1, 31)] + [(5000, n) for n in range(5001, 5031)]
    fans = [(n, 100 * n + k) for n in range(1, 31) for k in range(20)] + [(n, 100 * n + k) for n in range(5001, 5031) for k in range(20)]
    table, pairs = spark.createDataFrame([*ends, *fans], "source long, target long"), spark.createDataFrame([(0, 5000)], "start long, end long")
    met, seen, _ = graph.meetings(table, pairs, 3)
    assert met.count() == 0 and seen.count() == 62  # both ends and their neighbours, not the 600 nodes of the third round
    assert run(spark, [*ends, *fans, (7, 5020), (4, 5030)], [(0, 5000)], 3) == {(0, 5000): [0, 4, 5030, 5000]}
