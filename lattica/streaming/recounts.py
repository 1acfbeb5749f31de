"""Counts that a change feed keeps up: every batch recounts the keys that it names, and a replayed batch writes the same again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def feed(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """The files of a folder as a stream, ``files`` of them a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def keep_counts(messages: DataFrame, counted: Callable[[DataFrame | None], DataFrame], folder: str) -> StreamingQuery:
    """Start the recounts that a stream of ``messages`` (kind, key) owes, on what is there, and return its query.

    A message of kind ``changed`` names a key, one of kind ``resync`` all keys. ``counted`` gives
    (key, n) from the records of the keys of a table, or of all keys where it gets None. A key is
    counted again in the batch after, since what was written with its message may have been
    written later than it; a key without records counts 0. Batch N has its keys in
    ``named/batch=N`` and its counts in ``counts/batch=N``, each replaced as a whole: a batch
    that is run twice leaves what it leaves when run once. Null keys and other kinds ask for nothing.
    """

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        asked = rows.filter((F.col("kind") == "resync") | ((F.col("kind") == "changed") & F.col("key").isNotNull()))
        asked.select((F.col("kind") == "resync").alias("all"), F.when(F.col("kind") == "changed", F.col("key")).alias("key")).distinct().write.mode("overwrite").parquet(f"{folder}/named/batch={n}")
        named = spark.read.parquet(*(f"{folder}/named/batch={b}" for b in (n - 1, n) if b >= 0))
        due = named.filter("not all").select("key").distinct()
        if named.filter("all").isEmpty():
            found = counted(due)
        else:
            found = counted(None)
            due = due.union(latest(spark, folder, rows.schema["key"].dataType.simpleString(), n).select("key")).union(found.select("key")).distinct()
        out = due.join(found, "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        out.write.mode("overwrite").parquet(f"{folder}/counts/batch={n}")

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, key_type: str = "long", before: int | None = None) -> DataFrame:
    """(key, n): the last count of every key, of batches before ``before`` only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/counts")
    schema = f"key {key_type}, n long, batch int"
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(schema).parquet(f"{folder}/counts") if there else spark.createDataFrame([], schema)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    return rows.groupBy("key").agg(F.max_by("n", "batch").alias("n"))
