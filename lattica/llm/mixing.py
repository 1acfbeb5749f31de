"""Mixing sources to target weights, by words.

Every document gets a hash-random key. A source's documents stand in the order of their
keys; the running sum of their sizes is a sum over equal key ranges plus one within the
range, so no task ever holds a source. The mix takes whole epochs of a source and then
the documents up to the exact word at which its budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import running
from ..session import stage
from .text import whole, word_count


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with ``target``, in words.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share``
    of all words. A target stops at ``most`` times its source; the excess goes to the
    others by weight until none is above. That level is found at once: by rising
    size/weight a first part of the sources is full, the rest stand at one level. Sources may
    be as many as hosts: their order and sums are found by ranges.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    s = running(sizes.withColumn("one", F.lit(1).cast("long")), by_name, ["one"], "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("one_before") % len(weights) + 1).cast("int")).cast("long")
    s = s.select("source", "source_size", weight.alias("w"))
    s = s.withColumn("full", F.col("source_size") * F.lit(most) / F.col("w"))
    s = running(s, [F.col("full"), *by_name], ["source_size", "w"], "levels")
    total = sizes.agg(F.sum("source_size").alias("all_words"))
    total = total.crossJoin(s.agg(F.sum("w").alias("all_weights")))  # one row
    level = (F.col("all_words") * F.lit(share) - F.col("source_size_before") * F.lit(most)) / (F.col("all_weights") - F.col("w_before"))
    s = s.crossJoin(F.broadcast(total)).withColumn("own_level", level)
    common = s.filter("full > own_level").agg(F.min(F.struct("full", "own_level"))["own_level"].alias("level"))  # one row
    s = s.crossJoin(F.broadcast(common))
    whole_source = F.col("source_size") * F.lit(most)
    capped = F.col("level").isNull() | (F.col("full") <= F.col("level"))
    return s.select(
        "source", "source_size", F.when(capped, whole_source).otherwise(F.col("level") * F.col("w")).alias("target")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    ranges: int = 1024,
    per_range: int = 50_000,
) -> DataFrame:
    """What the mix takes of each document: one row per row of ``docs``.

    Returns id_col, source_col, the columns named in ``carry`` (those of a result's name give
    way to it), and size, source_size, target, taken. A document's key is the md5 of the seed
    and its id: reruns agree, and so do rows in another order. Equal keys stand by id, size
    and text. Whole epochs come first; the document at the end of the budget gives its first
    words only. Null text has size 0; rows with a null id take their text's hash for it; null
    is a source of its own. Columns that are neither named nor carried are ignored, so none
    can clash; an empty table gives an empty one.

    A source's keys are cut into equal parts, ``ranges`` or as many more as leave each
    ``per_range`` rows: a window sorts one of them, never a source. Only ids and sizes are
    written for the sums; what is carried is shuffled once.
    """
    carry = tuple(c for c in carry if c not in (id_col, source_col, "size", "source_size", "target", "taken"))
    extra = {c: f"_x{i}" for i, c in enumerate(carry)}
    name = F.coalesce(F.col(id_col).cast("string"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col).cast("string")), F.lit(""))
    rows = docs.select(
        F.col(source_col).alias("_source"),
        F.col(id_col).alias("_id"),
        F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")).alias("_key"),
        F.xxhash64(text_col).alias("_text"),
        word_count(whole(text_col)).alias("size"),
        *(F.col(c).alias(n) for c, n in extra.items()),
    )
    keys = stage(rows.drop(*extra.values()), "mix-keys")
    if not extra:
        rows = keys  # words are counted once; only what is carried is read again
    ranges = max(ranges, keys.count() // per_range)
    at = [F.coalesce("_source", F.lit("")).alias("_s"), F.col("_source").isNull().alias("_n"), _range(F.col("_key"), ranges).alias("_r")]
    parts = keys.groupBy(*at).agg(F.first("_source").alias("_source"), F.sum("size").alias("_words"))
    parts = stage(parts, "mix-parts")
    aims = targets(parts.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size")), weights, share, most)
    before = Window.partitionBy("_s", "_n").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    starts = starts.join(aims, F.col("_source").eqNullSafe(F.col("source"))).select("_s", "_n", "_r", "_start", "source_size", "target")
    within = (
        Window.partitionBy("_s", "_n", "_r").orderBy("_key", "_id", "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = rows.select("*", *at).join(starts, ["_s", "_n", "_r"])
    place = F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))).otherwise(0)
    rest = F.floor(F.col("target")) - epochs * F.col("source_size")
    summed = summed.withColumns({"_epochs": epochs, "_left": rest - place})
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left")))
    return summed.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        *(F.col(n).alias(c) for c, n in extra.items()),
        "size",
        "source_size",
        "target",
        (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"),
    )


def _range(key: Column, ranges: int) -> Column:
    """Which of ``ranges`` equal parts of the key space a key is in."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * ranges / 2**32).cast("int")
