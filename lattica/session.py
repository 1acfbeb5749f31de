"""Sessions and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


#: Whether an execution's shuffle files go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Sizes up to which a join's side is broadcast: by the files it is read from, and as measured in a shuffle.
BY_FILES, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Files of so many bytes at most are broadcast: packed ids take twenty times their file in the driver's memory.
MOST_FILES = 1 << 20


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as tests and bench.py use it; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lattica")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests, a laptop) a temporary folder is made
    and remembered in the session; on a cluster that is an error, as executors would not
    see each other's files.
    """
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    where = spark.conf.get("spark.lattica.workDir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.lattica.workDir", where)
    return where


def stage(df: DataFrame, name: str, dealt: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks since the
    last stage, and loops keep plans of constant size. A table that is ``dealt`` by columns lies in
    as many buckets as a shuffle has partitions, so joins by all of them, in that order, read it in place.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in (CLEAN_UP, BY_FILES, MEASURED)}
    spark.conf.set(CLEAN_UP, "true")  # nothing reads the shuffles again: the table is there instead
    now = spark.conf.get(BY_FILES)
    spark.conf.set(MEASURED, before[MEASURED] or now)
    spark.conf.set(BY_FILES, str(min(_bytes(spark, now), MOST_FILES)))
    try:
        if dealt:
            n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"lattica_{uuid.uuid4().hex}"
            df.repartition(n, *dealt).write.bucketBy(n, *dealt).option("path", path).format("parquet").saveAsTable(table)
        else:
            df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.table(table) if dealt else spark.read.schema(df.schema).parquet(path)
    out.staged_at, out.staged_as = path, table if dealt else None
    return out


def _bytes(spark: SparkSession, size: str) -> int:
    if size.startswith("-"):  # none is broadcast
        return -1
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size))


def discard(*frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more: their readers are staged themselves."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        if df.staged_as:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.staged_as}")
