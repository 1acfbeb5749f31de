"""Queries whose rows a stream keeps up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import catalog
from ..session import stage, work_dir
from ..streaming import recounts
from .registry import query


@query("SELECT u AS key, count(o_orderkey) AS n FROM (SELECT DISTINCT user_id AS u FROM events) LEFT JOIN orders ON o_custkey = u GROUP BY u")
def counts_kept_by_stream(s, d):
    """The orders of every customer that an event names, kept by a stream of the events in batches of two files."""
    events = catalog.table(s, d, "events").select(F.lit("changed").alias("kind"), F.col("user_id").alias("key"))
    files = stage(events.repartition(6, "key"), "feed")
    orders = catalog.table(s, d, "orders").select(F.col("o_custkey").alias("key"))

    def counted(due):
        rows = orders if due is None else orders.join(due, "key", "left_semi")
        return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    folder = f"{work_dir(s)}/lattica/counts-{uuid.uuid4().hex}"
    recounts.keep_counts(recounts.feed(s, files.staged_at, "kind string, key long", 2), counted, folder).awaitTermination()
    return recounts.latest(s, folder)
