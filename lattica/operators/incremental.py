"""What is owed, what is covered, and how well answers do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owed(sources: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Sources without a result of the same keys (id, hash, model, ...)."""
    return sources.join(done.select(*keys).distinct(), keys, "left_anti")


def stale(rows: DataFrame, stored: DataFrame, key: str, mark: str) -> DataFrame:
    """``rows`` with ``state``: new, changed or current against the stored marks."""
    old = stored.select(key, F.col(mark).alias("_old"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col(mark), "changed").otherwise("current")
    return rows.join(old, key, "left").withColumn("state", state).drop("_old")


def missing(stored: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key is found no more."""
    return stored.join(found.select(key), key, "left_anti")


def coverage(rows: DataFrame, groups: list[str], done: str) -> DataFrame:
    """(groups, total, done, share) by a boolean column."""
    total, n = F.count(F.lit(1)), F.count_if(F.col(done))
    return rows.groupBy(*groups).agg(total.alias("total"), n.alias("done"), F.round(n / total, 6).alias("share"))


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, recall, precision, reciprocal_rank): hits (query, id, rank) against relevant (query, id)."""
    top = hits.filter(F.col("rank") <= k).join(relevant.withColumn("good", F.lit(1)), ["query", "id"], "left")
    found = top.groupBy("query").agg(F.count("good").alias("n"), F.count(F.lit(1)).alias("shown"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"))
    wanted = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    rows = wanted.join(found, "query", "left")
    return rows.select(
        "query",
        F.round(F.coalesce("n", F.lit(0)) / F.col("wanted"), 6).alias("recall"),
        F.round(F.coalesce(F.col("n") / F.col("shown"), F.lit(0.0)), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )
