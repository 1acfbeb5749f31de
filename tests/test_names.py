"""Names by trigrams: the index equals reading all names, the join equals comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.functions.text import similarity
from lattica.operators import names, retrieval

ROWS = "id long, name string"


def some(n=300, seed=3):
    rng = random.Random(seed)
    bits = ["load", "Limit", "small", "ring", "_", "-", " ", "7", "é", "x%", "blue", "L"]
    return [(i, "".join(rng.choices(bits, k=rng.randint(0, 6)))) for i in range(n)] + [(900, None), (None, "small ring"), (901, ""), (902, "load" * 3000), (903, "small ring")]


@pytest.mark.parametrize(
    ("pattern", "grams"),
    [("%ing%", ["ing"]), ("ing%", ["  i", " in", "ing"]), ("%a_bcd", ["bcd", "cd "]), ("%ab.b%", ["ab ", "  b"]), ("%", []), (r"%ax\%%", ["ax "]), ("", []), ("%Ax\\_b%", ["ax ", "  b"])],
)
def test_grams_that_a_pattern_is_sure_of(pattern, grams):
    assert names.certain_grams(pattern) == grams


def test_the_index_is_the_scan(spark, tmp_path):
    rows = spark.createDataFrame(some(), ROWS)
    index = names.NameIndex(spark, str(tmp_path / "names"))
    assert not index.built()
    index.build(rows, "id", "name")
    assert index.built()
    for question, part, patterns, least in (
        ("small rings", "small ring", ["%blue"], 0.3), ("loadLimit", "mitL", [], 0.5), ("", "x\\%", ["_"], 0.3), ("7", "é", ["ring%", "%l_a%"], 1.0), ("load", "zzz", ["load"], 0.9)
    ):
        want = retrieval.name_search(rows, "id", "name", question, part, patterns, 10_000, least).collect()
        got = index.search(question, part, patterns, 10_000, least).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)), (question, part)
        few = [r.score for r in index.search(question, part, patterns, 7, least).collect()]
        assert few == [r.score for r in retrieval.name_search(rows, "id", "name", question, part, patterns, 7, least).collect()]


def test_an_empty_index(spark, tmp_path):
    index = names.NameIndex(spark, str(tmp_path / "names"))
    index.build(spark.createDataFrame([], ROWS), "id", "name")
    assert index.built() and index.search("a", "b", ["%c%"], 5).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.75, 1.0])
def test_the_join_is_all_pairs(spark, least):
    left, right = spark.createDataFrame(some(80), ROWS), spark.createDataFrame(some(80, 8), ROWS)
    got = {(r.left, r.right): round(r.score, 9) for r in names.alike(left, right, least).collect()}
    a, b = (t.select("name").distinct().filter("name is not null").filter(F.length("name") < 100) for t in (left, right))
    pairs = a.toDF("a").crossJoin(b.toDF("b")).filter("a != b").withColumn("score", similarity(F.col("a"), F.col("b"))).filter(F.col("score") >= least)
    want = {(r.a, r.b): round(r.score, 9) for r in pairs.collect()}
    assert {k: v for k, v in got.items() if max(map(len, k)) < 100} == want and (want or least == 1.0)
    assert names.alike(left.limit(0), right, least).count() == 0


def test_pairs_are_compared_where_they_are_made(spark):
    rows = spark.createDataFrame([(f"http://m.example.org/en/{n}.html",) for n in range(1000, 1120)], "name string")
    found = names.alike(rows, rows, 0.7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Aggregate" not in plan  # no pair is shuffled
    from itertools import permutations

    def grams(t):
        import re

        return {p[i : i + 3] for w in re.findall("[a-z0-9]+", t) for p in [f"  {w} "] for i in range(len(p) - 2)}

    sets = {r.name: grams(r.name) for r in rows.collect()}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in permutations(sets, 2)}
    want = {p: round(s, 9) for p, s in share.items() if s >= 0.7}
    assert {(r.left, r.right): round(r.score, 9) for r in found.collect()} == want and found.count() == len(want) > 100
