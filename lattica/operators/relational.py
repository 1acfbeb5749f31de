"""Filters, pages, tops, facets and upserts that the engine's listings are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_filter(rows: DataFrame, **wanted: object) -> DataFrame:
    """Only rows with the values given; None means any."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def scoped(rows: DataFrame, projects: DataFrame, key: str = "project", keep_global: bool = False) -> DataFrame:
    """Rows of the given projects; with ``keep_global`` those of no project too."""
    inside = rows.join(projects.select(key).distinct(), key, "left_semi")
    return inside.unionByName(rows.filter(F.col(key).isNull())) if keep_global else inside


def keyset_page(rows: DataFrame, keys: Sequence[str], after: Sequence[object], size: int) -> DataFrame:
    """The ``size`` rows behind ``after`` in the order of ``keys``."""
    later, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, after, strict=True):
        later = later | (same & (F.col(key) > F.lit(value)))
        same = same & (F.col(key) == F.lit(value))
    return rows.filter(later).orderBy(*keys).limit(size)


def page_with_total(rows: DataFrame, order: Sequence[Column], size: int, skip: int = 0) -> DataFrame:
    """A page, each row with the number of all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(skip).limit(size).crossJoin(F.broadcast(total))


def top_per_group(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``place``. Spark keeps k rows a task and group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long")
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def latest(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row a key, the one with the greatest ``by``; an aggregate, so hot keys are combined map-side."""
    rest = [c for c in rows.columns if c not in keys]
    lead = [*by, *(c for c in rest if c not in by)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*lead)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``new`` and the rows of ``old`` whose key it has not; of a key that ``new`` repeats the row with the greatest ``by``, then the greatest rest, stays."""
    return old.join(new, list(keys), "left_anti").unionByName(latest(new, keys, by).select(*new.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it has not, one a key as in ``upsert``."""
    return old.unionByName(latest(new.join(old, list(keys), "left_anti"), keys, by).select(*new.columns))


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the keys in ``new`` give way to its rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def nearest_level(levels: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per key and field the value of the nearest level (least ``rank``) that has one, and its origin.

    ``levels`` has the keys, rank, origin and the fields; null means unset.
    """
    first = lambda f: F.min(F.when(F.col(f).isNotNull(), F.struct("rank", F.col(f).alias("value"), "origin")))
    found = levels.groupBy(*keys).agg(*(first(f).alias(f) for f in fields))
    return found.select(*keys, *(x for f in fields for x in (F.col(f"{f}.value").alias(f), F.col(f"{f}.origin").alias(f"{f}_origin"))))


def ring_append(queue: Column, value: Column, size: int = 20) -> Column:
    """An array with one more value at its end, without repeats, the oldest gone beyond ``size``."""
    room = F.when(F.size(queue) >= size, F.slice(queue, 2, size - 1)).otherwise(queue)
    return F.when(F.array_contains(queue, value), queue).otherwise(F.concat(room, F.array(value)))
