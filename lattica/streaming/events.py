"""Change events: debounce, settled bursts, and a leased work queue, for streams and for replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bursts(events: DataFrame, key: str, ts: str, quiet: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """(key, start, end, n): events of a key without a pause of ``quiet``; works on streams, where ``late`` bounds the state."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    found = rows.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, ts: str, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """(start, keys, n) of tumbling windows."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    found = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("start"), *keys, "n")


def due(changed: Column, ran: Column, now: Column, settle: int, pause: int) -> Column:
    """Whether a project's run is due: changed since its run, quiet for ``settle`` seconds, ``pause`` since the run."""
    second = lambda c: F.unix_timestamp(c)
    moved = ran.isNull() | (changed > ran)
    return moved & (second(now) - second(changed) >= settle) & (ran.isNull() | (second(now) - second(ran) >= pause))


def replay_leases(events: DataFrame, now: Column, lease: int, attempts: int) -> DataFrame:
    """(task, state, tries) of a leased queue, from its events (task, ts, action: enqueue, claim, finish, release, fail).

    The last event decides; a claim older than ``lease`` seconds is waiting again, and a task
    claimed ``attempts`` times without success has failed. It is one aggregate a task.
    """
    last = F.max(F.struct("ts", "action"))
    rows = events.groupBy("task").agg(last.alias("last"), F.count_if(F.col("action") == "claim").alias("tries"))
    over = F.unix_timestamp(now) - F.unix_timestamp("last.ts") > lease
    state = (
        F.when(F.col("last.action") == "finish", "done")
        .when((F.col("last.action") == "claim") & ~over, "leased")
        .when(F.col("tries") >= attempts, "failed")
        .otherwise("waiting")
    )
    return rows.select("task", state.alias("state"), "tries")


def sequence(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """``events`` with the number of the event within its key and the seconds since the one before."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    return events.withColumn("n", F.row_number().over(w).cast("long")).withColumn("gap", gap)
