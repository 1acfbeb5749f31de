"""Tables of a folder, and the code-graph tables that stand on them.

The engine answers questions about projects, nodes, edges, names that projects provide and
take, and texts. ``graph`` views show the business tables in those shapes: a region is an
organization, a nation a project, customers, suppliers and orders nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.names import NameIndex
from .operators.words import WordIndex
from .session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over all cores, for work that is heavy by their bytes: a small file would be one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, organization, id (a directory id)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("project"),
        F.col("r_name").alias("organization"),
        F.concat(F.lit("region/"), "r_regionkey", F.lit("/nation/"), "n_nationkey", F.lit("/")).alias("id"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, id, type, name of nations, customers and suppliers."""
    own = projects(spark, sf_dir).select("project", F.col("id").alias("parent"))
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("project"), F.concat(F.lit("customer/"), "c_custkey").alias("leaf"), F.lit("customer").alias("type"), F.col("c_name").alias("name")
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("project"), F.concat(F.lit("supplier/"), "s_suppkey").alias("leaf"), F.lit("supplier").alias("type"), F.col("s_name").alias("name")
    )
    leaves = customer.unionByName(supplier).join(own, "project").select("project", F.concat("parent", "leaf").alias("id"), "type", "name")
    top = own.select("project", F.col("parent").alias("id"), F.lit("directory").alias("type"), F.concat(F.lit("nation "), "project").alias("name"))
    return leaves.unionByName(top)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (source, target, relation): a customer's nation takes from a supplier's nation."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return (
        lines.select("l_orderkey", "l_suppkey")
        .join(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"), F.col("o_orderpriority").alias("relation"))
        .distinct()
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (source, target): customer to supplier, both numbered in one space (suppliers below zero).

    One row a line of an order: who buys again is there again, as walks drop repeated steps anyway and few rows repeat.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.select("l_orderkey", "l_suppkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("source"), (-F.col("l_suppkey")).alias("target"))


def offers(spark: SparkSession, sf_dir: str, often: int = 4) -> DataFrame:
    """provided names (project, kind, name): the parts, by brand, that a nation's suppliers have delivered ``often`` times or more.

    A name may have no such nation, one or several.
    """
    lines, supplier, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    delivered = (
        lines.select("l_partkey", "l_suppkey")
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("project"), F.col("l_partkey").alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= often)
    )
    return delivered.join(part.select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("kind")), "name").select("project", "kind", "name")


def wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken names (project, kind, name): the parts that a nation's customers buy."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, part = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    return (
        lines.select("l_partkey", "l_orderkey")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("c_nationkey").alias("project"), F.col("p_brand").alias("kind"), F.col("p_partkey").alias("name"))
        .distinct()
    )


def word_index(spark: SparkSession, sf_dir: str) -> WordIndex:
    """The stored word index of a folder's documents, in the shared folder; built when it is first asked for.

    It is known by the files of the table, their sizes and times: another state of the table has
    another index.
    """
    docs = table(spark, sf_dir, "documents")
    index = WordIndex(spark, f"{work_dir(spark)}/lattica/words-{_state(docs)}")
    if not index.generations():
        index.refresh(docs, "doc_id", "text")
    return index


def name_index(spark: SparkSession, sf_dir: str, name: str, id_col: str, name_col: str) -> NameIndex:
    """The stored trigram index of a column of a table, built when it is first asked for; known as the word index is."""
    rows = table(spark, sf_dir, name)
    index = NameIndex(spark, f"{work_dir(spark)}/lattica/names-{name_col}-{_state(rows)}")
    if not index.built():
        index.build(rows, id_col, name_col)
    return index


def _state(rows: DataFrame) -> str:
    """One word for the files of a table, their sizes and times."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return files.agg(F.hex(F.bit_xor(F.xxhash64("*")))).first()[0]
