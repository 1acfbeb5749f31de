"""Counts kept by a stream: restarts, replays and a plain recount agree."""

import os

import pytest
from pyspark.sql import functions as F

from lattica.streaming import recounts

MESSAGES = "kind string, key long"


def test_a_stream_that_breaks_off_equals_the_batch(spark, tmp_path):
    source, out, records = (str(tmp_path / x) for x in ("in", "out", "records"))
    put = lambda rows, where, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
    put([(k, i) for k in range(6) for i in range(k)], records, "key long, i long")
    failing = []

    def counted(due):
        if failing:
            failing.pop()
            raise RuntimeError("broken off")
        rows = spark.read.parquet(records)
        return (rows if due is None else rows.join(due, "key", "left_semi")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    def run():
        recounts.keep_counts(recounts.feed(spark, source, MESSAGES, 1), counted, out).awaitTermination()
        return {r.key: r.n for r in recounts.latest(spark, out).collect()}

    put([("changed", 1), ("changed", 3), ("changed", 3), ("changed", None), ("noise", 5), (None, 4)], source, MESSAGES)
    assert run() == {1: 1, 3: 3}
    put([(1, 9), (4, 9), (9, 1)], records, "key long, i long")
    put([("changed", 9), ("changed", 77)], source, MESSAGES)
    put([("changed", 4)], source, MESSAGES)
    failing.append(1)
    with pytest.raises(Exception, match="broken off"):
        run()
    assert {r.key: r.n for r in recounts.latest(spark, out).collect()} == {1: 1, 3: 3}
    want = {1: 2, 3: 3, 4: 5, 9: 1, 77: 0}  # 1 is counted again with the batch after its message
    assert run() == want
    commits = f"{out}/checkpoint/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):  # written, but killed before the batch was known as done
        os.path.exists(f"{commits}/{f}") and os.unlink(f"{commits}/{f}")
    assert run() == want and spark.read.parquet(f"{out}/counts").groupBy("batch", "key").count().filter("count > 1").isEmpty()
    assert sorted(os.listdir(commits))[-1] == str(last)
    put([("resync", None)], source, MESSAGES)
    assert run() == {1: 2, 2: 2, 3: 3, 4: 5, 5: 5, 9: 1, 77: 0}
