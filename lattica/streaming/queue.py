"""The leased queue as a stream: one state a task, with a timer for its lease.

Events are (task, ts, action, hash, empty, error) with the actions enqueue, claim, finish,
release and fail; the rules are those of ``operators.state`` for one task. A task's state is a
row of numbers and strings in the state store, so a query that is stopped or loses an executor
goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What a state holds; times are microseconds.
STATE = "hash string, since long, until long, tries long, done string, error string"
FIELDS = ("hash", "since", "until", "tries", "done", "error")
NEW = (None, None, None, 0, None, None)


def expired(state: tuple, now: int) -> tuple:
    """A lease that has run out at ``now`` waits again, from its end on if it does not wait already."""
    hash_, since, until, tries, done, error = state
    if until is None or until > now:
        return state
    return hash_, until if since is None else since, None, tries, done, error


def applied(state: tuple, ts: int, action: str, hash_in: str | None, empty: int, error_in: str | None, lease: int, attempts: int, version: str) -> tuple:
    """The state after an event; ``lease`` in microseconds. Events that do not fit the state change nothing."""
    hash_, since, until, tries, done, error = expired(state, ts)
    if action == "enqueue":
        queued = since is not None or until is not None
        if done != f"{hash_in}|{version}|1" and not (queued and hash_ == hash_in):
            return hash_in, ts if since is None else since, until, 0, None, None
    elif action == "claim" and since is not None:
        return hash_, None, ts + lease, tries + 1, done, error
    elif action == "finish":
        stamp = f"{hash_in}|{version}|{empty or 0}" if (hash_in if hash_ is None else hash_) == hash_in else done
        return hash_, since, None, 0, stamp, None
    elif action == "release" and until is not None:
        return hash_, ts if since is None else since, None, max(tries - 1, 0), done, error
    elif action == "fail":
        if tries >= attempts:
            return hash_, None, None, tries, done, error_in
        return hash_, ts if since is None else since, None, tries, done, error
    return hash_, since, until, tries, done, error


class LeasedQueue(StatefulProcessor):
    """Applies a task's events in the order of time; a timer ends a lease of which nothing is heard."""

    def __init__(self, lease: int, attempts: int, version: str):
        self.lease, self.attempts, self.version = lease * 1_000_000, attempts, version

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", STATE)

    def _now(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else NEW

    def _kept(self, key: tuple, state: tuple, at: int) -> pd.DataFrame:
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[2] is not None:
            self.handle.registerTimer(-(-state[2] // 1000))
        return pd.DataFrame({"task": [key[0]], "at": [at], **{f: pd.Series([v], dtype="Int64" if f in ("since", "until", "tries") else object) for f, v in zip(FIELDS, state, strict=True)}})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "action", "hash"], kind="stable")  # a task's events of one trigger
        state, ts = self._now(), 0
        for e in events.astype(object).where(events.notna(), None).itertuples(index=False):
            ts = int(e.ts)
            state = applied(state, ts, e.action, e.hash, int(e.empty or 0), e.error, self.lease, self.attempts, self.version)
        yield self._kept(key, state, ts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        before = self._now()
        after = expired(before, at)
        if after != before:
            yield self._kept(key, after, at)

    def close(self) -> None:
        pass


def queue_changes(events: DataFrame, lease: int, attempts: int, version: str, late: str = "1 minute") -> DataFrame:
    """The states (task, at, hash, since, until, tries, done, error) that tasks take, one row a task and trigger.

    ``events`` is a stream with task, ts (a time), action, hash, empty and error; rows later than
    ``late`` are dropped by the watermark, null tasks are passed over. The table of a queue is the
    last row of each task, by ``at``.
    """
    kind = events.schema["task"].dataType.simpleString()
    rows = events.filter("task is not null").withWatermark("ts", late).select("task", F.col("ts").alias("seen"), F.unix_micros("ts").alias("ts"), "action", "hash", F.col("empty").cast("int").alias("empty"), "error")
    schema = f"task {kind}, at long, {STATE}"
    out = rows.groupBy("task").transformWithStateInPandas(LeasedQueue(lease, attempts, version), schema, "Append", "eventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", "since", "until")})


def latest(changes: DataFrame) -> DataFrame:
    """The queue that changes lead to: each task's last state."""
    return changes.groupBy("task").agg(F.max_by(F.struct(*FIELDS), F.struct("at", F.coalesce(F.unix_micros("since"), F.lit(0)), "tries")).alias("s")).select("task", "s.*")
