"""The queue's rules, and the same from a stream that is stopped and started again."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import state
from lattica.streaming import queue

SECOND = 1_000_000
EVENTS = "task long, ts timestamp, action string, hash string, empty int, error string"


def plain(events, lease, attempts):
    """What the rules say, by dictionaries that are cleared and set."""
    waiting, leased, hashes, done, tries, failed = {}, {}, {}, {}, {}, {}
    for task, ts, action, digest, empty, error in events:
        if task in leased and leased[task] <= ts:
            waiting.setdefault(task, leased.pop(task))
        if action == "enqueue":
            queued = task in waiting or task in leased
            if done.get(task) != f"{digest}|v1|1" and not (queued and hashes.get(task) == digest):
                hashes[task] = digest
                waiting.setdefault(task, ts)
                done.pop(task, None), tries.pop(task, None), failed.pop(task, None)
        elif action == "claim" and task in waiting:
            del waiting[task]
            leased[task] = ts + lease
            tries[task] = tries.get(task, 0) + 1
        elif action == "finish":
            leased.pop(task, None), tries.pop(task, None), failed.pop(task, None)
            if hashes.get(task, digest) == digest:
                done[task] = f"{digest}|v1|{empty}"
        elif action == "release" and task in leased:
            del leased[task]
            waiting.setdefault(task, ts)
            tries[task] = max(tries.get(task, 0) - 1, 0)
        elif action == "fail":
            leased.pop(task, None)
            if tries.get(task, 0) >= attempts:
                waiting.pop(task, None)
                failed[task] = error
            else:
                waiting.setdefault(task, ts)
    return {t: (hashes.get(t), waiting.get(t), leased.get(t), tries.get(t, 0), done.get(t), failed.get(t)) for t in {e[0] for e in events}}


def history(n=400, seed=6):
    rng = random.Random(seed)
    ts, out = 1_700_000_000 * SECOND, []
    for _ in range(n):
        ts += rng.randint(1, 40) * SECOND
        action = rng.choice(["enqueue", "enqueue", "claim", "claim", "finish", "release", "fail"])
        out.append((rng.randrange(12), ts, action, rng.choice("ab") if action in ("enqueue", "finish") else None, rng.randrange(2), f"e{ts % 7}" if action == "fail" else None))
    return out


def test_one_task_at_a_time_is_the_plain_queue():
    for seed in range(20):
        events = history(300, seed)
        states = {}
        for task, ts, action, digest, empty, error in events:
            states[task] = queue.applied(states.get(task, queue.NEW), ts, action, digest, empty, error, 60 * SECOND, 2, "v1")
        end = {t: queue.expired(s, events[-1][1]) for t, s in states.items()}
        want = plain([*events, *((t, events[-1][1], "look", None, 0, None) for t in states)], 60 * SECOND, 2)
        assert end == want


def test_a_stream_with_a_restart_is_the_plain_queue(spark, tmp_path):
    events = history()
    last = events[-1][1]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    frame = lambda rows: spark.createDataFrame(rows, EVENTS.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_micros("ts"))
    for i in range(4):
        frame(events[i * 100 : i * 100 + 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame(events[:1]).schema).parquet(str(tmp_path / "in"))
        changes = queue.queue_changes(stream, 60, 2, "v1", late="0 seconds")
        run = changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()  # every turn starts the query anew from its checkpoint
    rows = queue.latest(spark.read.parquet(str(tmp_path / "out")))
    rows = rows.withColumns({c: F.unix_micros(c) for c in ("since", "until")}).collect()
    got = {r.task: queue.expired(tuple(r[f] for f in queue.FIELDS), last) for r in rows}
    want = plain([*events, *((t, last, "look", None, 0, None) for t in got)], 60 * SECOND, 2)
    assert got == want


def test_the_tables_rules(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    empty = spark.createDataFrame([], "task long, hash string, since timestamp, until timestamp, tries long, done string, error string")
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3), (None, "a", 4)], "task long, hash string, place long")
    queue_ = state.enqueued(empty, new, now, "v1")
    assert [(r.task, r.hash, r.tries) for r in queue_.orderBy("task").collect()] == [(1, "b", 0), (2, "a", 0)]
    held = state.claimed(queue_, now + F.expr("interval 1 minute"), 60, 1)
    assert [(r.task, r.until is not None, r.tries) for r in held.orderBy("task").collect()] == [(1, True, 1), (2, False, 0)]
    outcomes = lambda *rows: spark.createDataFrame(rows, "task long, outcome string, hash string, empty int, error string")
    broken = state.settled(held, outcomes((1, "fail", None, None, "bad"), (9, "finish", "x", 0, None)), now, 1, "v1")
    assert [(r.task, r.since, r.error) for r in broken.orderBy("task").collect()][0] == (1, None, "bad") and broken.count() == 2
    again = state.enqueued(broken, new.filter("place = 2"), now, "v1")  # a failed task comes back with the same hash
    assert [(r.task, r.since is not None, r.tries, r.error) for r in again.orderBy("task").collect()][0] == (1, True, 0, None)
    changed = state.settled(held, outcomes((1, "finish", "other", 0, None)), now, 1, "v1")  # the hash has changed since
    assert [(r.task, r.until, r.done) for r in changed.orderBy("task").collect()][0] == (1, None, None)
    assert pytest.approx(state.claimed(empty, now, 60, 5).count()) == 0
