"""Packing and taking turns where one key has most of the rows."""

import random

from pyspark.sql import functions as F

from lattica.operators import retrieval


def test_packing_streams_a_long_key(spark):
    """Batches of 7 rows cut the keys; no key is gathered whole."""
    rnd = random.Random(3)
    data = [(rnd.choice(["hot", "hot", "b", None]), n, rnd.choice([None, 0, 1, 3, 9, 40])) for n in range(900)]
    df = spark.createDataFrame(data, "k string, n int, cost int").repartition(5)
    want, left = [], {}
    for k, n, cost in data:
        fits = cost is not None and cost <= left.get(k, 50)
        left[k] = left.get(k, 50) - (cost if fits else 0)
        want.append((k, n, cost, fits))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        got = retrieval.pack(df, "k", "n", "cost", 50)
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    finally:
        spark.conf.set(size, before)


def test_turns_of_a_long_group(spark):
    """Places and totals as by hand; no window sees a group whole."""
    rnd = random.Random(4)
    data = [(n, rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice([None, 1, 2, 3])) for n in range(3000)]
    df = spark.createDataFrame(data, "id int, g string, size int").repartition(5)
    want = []
    for g in ("hot", "b", None):
        own = sorted((r for r in data if r[1] == g), key=lambda r: (-(r[2] or 0), r[0]))
        want += [(*r, n, len(own)) for n, r in enumerate(own, 1)]
    got = retrieval.round_robin(df, "g", F.desc("size"), F.col("id"))
    assert "_range" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(want)
