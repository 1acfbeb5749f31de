"""Exact dedup by deterministic block naming.

A text is cut into blocks of fixed size. Equal blocks get one integer name (the
smallest place at which the block stands); then adjacent pairs of names are named
in the same way, and so on, until every document has one integer. No hash decides
anything: two documents have one identity exactly if their texts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import one_spaced, whole

NO_NEIGHBOUR = -1


def _named(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``parts`` (row, index, place, ...) with an integer ``name`` for each distinct value of ``keys``.

    Every part has a place of its own, an integer. A value is named after the smallest place
    where it stands, so two values never share a name. Counting is combined map-side, so a
    key that many rows share costs one row a task. Only keys met twice are joined back; the
    others keep their own place. The check column makes both sides of the join shuffles that
    AQE can split when a key is hot.
    """
    check = F.hash(*keys)
    names = (
        parts.groupBy(*keys)
        .agg(F.min("place").alias("name"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(*keys, "name", check.alias("check"))
    )
    own = parts.withColumn("check", check)
    return own.join(names, [*keys, "check"], "left").withColumn("name", F.coalesce("name", "place")).drop("check", *keys)


def document_names(docs: DataFrame, id_col: str, text: Column, block_chars: int = 8192) -> DataFrame:
    """One row per row of ``docs``: row, id, sha (of ``text``), n_blocks and name.

    Two rows have equal (n_blocks, name) exactly if their texts are equal. Rows and blocks are
    numbered by partition and place, so ``docs`` must read alike each time, as tables do.
    """
    cut = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.when(F.length("text") <= block_chars, F.array("text"))
        .otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
        .alias("blocks"),
    )
    blocks = cut.select(
        "id", "row", "sha", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("index", "block")
    )
    first = F.col("index") == 0  # what belongs to the document travels with its first block
    blocks = blocks.withColumns({"sha": F.when(first, F.col("sha")), "id": F.when(first, F.col("id")), "place": F.monotonically_increasing_id()})
    level = stage(_named(blocks, ["block"]), "block-names")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    done, width = [level.filter("n_blocks = 1")], 1
    while width < most:
        open_ = level.filter(F.col("n_blocks") > width)
        left = F.col("index") % 2 == 0
        pairs = open_.groupBy("row", F.shiftright("index", 1).alias("index")).agg(
            F.max("n_blocks").alias("n_blocks"),
            F.min("place").alias("place"),
            F.max("id").alias("id"),
            F.max("sha").alias("sha"),
            F.max(F.when(left, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~left, F.col("name"))), F.lit(NO_NEIGHBOUR)).alias("b"),
        )
        width *= 2
        level = stage(_named(pairs, ["a", "b"]), f"pair-names-{width}")
        done.append(level.filter(F.col("n_blocks") <= width))
    out = [d.select("id", "row", "sha", "n_blocks", "name") for d in done]
    whole_ = out[0]
    for d in out[1:]:
        whole_ = whole_.union(d)
    return whole_


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8192
) -> DataFrame:
    """For each document the one that stays of those with its text.

    Texts are equal when identical after each run of white space became one space; null
    is empty. Returns one row per row of ``docs``: id_col, keep_id, group_size, kept,
    text_sha256. Of equal texts the row with the smallest id stays; ids that are null
    come last; of rows that repeat id and text one stays. Other columns are ignored, so
    none can clash. An empty table gives an empty one.
    """
    names = document_names(docs, id_col, one_spaced(whole(text_col)), block_chars)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))).alias("first")
    groups = names.groupBy("n_blocks", "name").agg(first, F.count(F.lit(1)).alias("group_size"))
    check = F.hash("n_blocks", "name")
    out = names.withColumn("check", check).join(
        groups.withColumn("check", check), ["n_blocks", "name", "check"]
    )
    return out.select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
