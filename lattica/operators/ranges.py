"""Running sums over all rows of a table, by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def running(rows: DataFrame, order: list, sums: list[str], name: str) -> DataFrame:
    """``rows`` with, for each of ``sums``, ``<name>_before``: its sum over the rows before, in ``order``.

    Rows are dealt by ranges of the order; a sum is that of the ranges before and that within
    the range, so no task sees all rows.
    """
    dealt = stage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = dealt.groupBy("_part").agg(*(F.sum(c).alias(c) for c in sums))
    parts = parts.select("_part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}") for c in sums))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_own_{c}") for c in sums))
    out = summed.join(F.broadcast(parts), "_part")
    return out.select(*rows.columns, *((F.col(f"_{c}") + F.col(f"_own_{c}")).alias(f"{c}_before") for c in sums))
