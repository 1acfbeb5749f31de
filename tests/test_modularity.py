"""Communities by modularity: planted groups, a plain search to compare with, splits and odd graphs."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import modularity as mod


def planted(groups, size, inside, outside, seed=1):
    rng = random.Random(seed)
    edges = []
    for g in range(groups):
        for i in range(size):
            for _ in range(inside):
                edges.append((g * size + i, g * size + rng.randrange(size)))
            if rng.random() < outside:
                edges.append((g * size + i, rng.randrange(groups * size)))
    return [(a, b) for a, b in edges if a != b]


def frame(spark, edges):
    return spark.createDataFrame(edges, "source long, target long")


def quality(edges, label):
    """Modularity by its definition, over all edges."""
    k, total, inside = {}, len(edges), 0
    for a, b in edges:
        k[a], k[b] = k.get(a, 0) + 1, k.get(b, 0) + 1
        inside += label[a] == label[b]
    sums = {}
    for i, x in k.items():
        sums[label[i]] = sums.get(label[i], 0) + x
    return inside / total - sum(x * x for x in sums.values()) / (2 * total) ** 2


def plain(edges):
    """One node after another moves where it gains most, then communities become nodes, until nothing gains."""
    members = {i: i for e in edges for i in e}
    at = edges
    while True:
        label = {i: i for e in at for i in e}
        k, near = {}, {}
        for a, b in at:
            k[a], k[b] = k.get(a, 0) + 1, k.get(b, 0) + 1
            if a != b:
                near.setdefault(a, []).append(b)
                near.setdefault(b, []).append(a)
        tot, m2, moved, any_ = dict(k), 2 * len(at), True, False
        while moved:
            moved = False
            for i in sorted(label):
                tot[label[i]] -= k[i]
                w = {label[i]: 0}
                for j in near.get(i, []):
                    w[label[j]] = w.get(label[j], 0) + 1
                best = max(sorted(w), key=lambda c: (round(w[c] - k[i] * tot[c] / m2, 9), c == label[i]))
                moved, any_ = moved or best != label[i], any_ or best != label[i]
                label[i] = best
                tot[best] += k[i]
        if not any_:
            return members
        members = {i: label[c] for i, c in members.items()}
        at = [(label[a], label[b]) for a, b in at]


def test_planted_groups_are_found(spark):
    edges = planted(8, 25, 4, 0.3)
    found = {r.id: r.community for r in mod.communities(spark.createDataFrame([(9999,)], "id long"), frame(spark, edges)).collect()}
    assert found.pop(9999) == 9999
    assert len({(i // 25, c) for i, c in found.items()}) == 8 == len(set(found.values()))
    assert all(c == i // 25 * 25 for i, c in found.items())  # named by the smallest node


@pytest.mark.parametrize("outside", [0.8, 3])
def test_modularity_is_that_of_a_plain_search(spark, outside):
    edges = [e for s in range(max(1, int(outside))) for e in planted(6, 20, 2, outside, seed=s)]
    found = mod.louvain(mod.weighted(frame(spark, edges))).collect()
    label = {r.id: r.community for r in found}
    assert quality(edges, label) >= quality(edges, plain(edges)) - 0.02
    members = spark.createDataFrame(found, "part long, id long, community long")
    (q,) = mod.modularity(mod.weighted(frame(spark, edges)), members).collect()
    assert q.q == pytest.approx(quality(edges, label), abs=1e-9)


def test_large_communities_are_split_once(spark):
    """Two loose halves, each of four dense groups: the halves are too large and fall into their groups."""
    rng = random.Random(4)
    edges = [e for h in range(2) for e in [(a + h * 80, b + h * 80) for a, b in planted(4, 20, 3, 0, seed=h)]]
    edges += [(h * 80 + rng.randrange(80), h * 80 + rng.randrange(80)) for h in range(2) for _ in range(260)]
    edges = [(a, b) for a, b in edges if a != b]
    nodes = frame(spark, edges).select(F.col("source").alias("id"))
    sizes = mod.communities(nodes, frame(spark, edges), most=0.25).groupBy("community").count().collect()
    assert max(r["count"] for r in sizes) <= 40 and len(sizes) >= 4


def test_odd_graphs(spark):
    none = spark.createDataFrame([], "id long")
    assert mod.communities(none, frame(spark, [])).collect() == []
    loops = frame(spark, [(1, 1), (2, 3), (2, 3), (3, 2), (None, 4), (5, None)])
    got = mod.communities(spark.createDataFrame([(7,), (7,), (None,)], "id long"), loops).collect()
    assert {(r.id, r.community) for r in got} == {(1, 1), (2, 2), (3, 2), (7, 7)}
    numbers = mod.numbered(spark.createDataFrame([(1, 1), (2, 2), (3, 2), (7, 7)], "id long, community long")).collect()
    assert sorted((r.number, r.community, r.members) for r in numbers) == [(0, 2, 2), (1, 1, 1), (2, 7, 1)]


def test_a_round_shuffles_links_once(spark, monkeypatch):
    """What nodes hear meets by one shuffle of a turn's links, a hub's over several tasks; links are read in place."""
    plans, write = {}, mod.stage
    monkeypatch.setattr(mod, "HEARD", 8)
    monkeypatch.setattr(mod, "stage", lambda df, name, *dealt: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), write(df, name, *dealt))[1])
    edges = [*planted(4, 12, 3, 0.2), *((48, i) for i in range(40))]
    members, first, best = mod._level(mod.weighted(frame(spark, edges)), 4, 1, 1.0)
    label = {r.id: r.community for r in members.collect()}
    assert quality(edges, label) == pytest.approx(best, abs=1e-9) and quality(edges, {i: i for i in label}) == pytest.approx(first, abs=1e-9)
    plan = plans["moves-1"]
    assert "Bucketed: true" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning(") <= 3  # the state's rows, what is heard, and one row a node and shard
