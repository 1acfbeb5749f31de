"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import SPACE_CHARS, ascii_lower, whole


def _kept_lines(lines: Column, dropped: Column) -> Column:
    """``lines`` without the positions in ``dropped`` (sorted), by the runs between them."""
    after = F.concat(F.array(F.lit(-1)), dropped)
    before = F.concat(dropped, F.array(F.size(lines)))
    runs = F.zip_with(after, before, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.flatten(runs)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``; adds n_lines and n_dropped.

    A line's key is the line without white space at its ends, A-Z in lower case. A key
    of ``min_chars`` code points found in ``min_docs`` documents loses all its lines
    except those of the smallest id. Text that is null counts as one empty line and
    becomes empty. Rows that repeat an id are one document: they keep or lose a line
    together. A null id is larger than any other. All other columns stay as they are,
    whatever their names, but n_lines and n_dropped of ``docs`` give way to the counts; an
    empty table gives an empty one.

    Keys travel as sha-256 digests; documents per digest are counted after a distinct, so
    a line that a third of all documents hold is pre-aggregated in every task. A row is
    known by its id and the hash of its text, which any retried task computes alike.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    id_, text = names[id_col], names[text_col]
    known = F.coalesce(F.concat(F.lit("="), F.col(id_).cast("string")), F.lit(""))  # no id gives what null gives
    rows = rows.withColumns({"_id": known, "_hash": F.xxhash64(text)})
    key = ascii_lower(F.btrim(F.col("_line"), F.lit(SPACE_CHARS)))
    lines = (
        rows.select(id_, "_hash", F.posexplode(F.split(whole(text), "\n", -1)).alias("_pos", "_line"))
        .select(id_, "_hash", "_pos", key.alias("_key"))
        .filter(F.length("_key") >= min_chars)
        .select(id_, "_hash", "_pos", F.unhex(F.sha2("_key", 256)).alias("_key"))
    )
    lines = stage(lines, "lines")
    by_doc = lines.select("_key", F.col(id_).alias("_doc"), F.lit(True).alias("_there")).distinct()
    shared = (
        by_doc.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_docs"), F.min("_doc").alias("_first"))
        .filter(F.col("_docs") >= min_docs)
        .select("_key", "_first", F.hash("_key").alias("_check"))
    )
    dropped = (
        lines.withColumn("_check", F.hash("_key"))
        .join(shared, ["_key", "_check"])
        .filter(~F.col(id_).eqNullSafe(F.col("_first")))
        .groupBy(known.alias("_id"), "_hash")
        .agg(F.array_sort(F.array_distinct(F.collect_list("_pos"))).alias("_dropped"))
    )
    out = rows.join(dropped, ["_id", "_hash"], "left")
    out = out.withColumn("_lines", F.split(whole(text), "\n", -1))
    none = F.col("_dropped").isNull()
    kept = F.when(none, whole(text)).otherwise(F.array_join(_kept_lines(F.col("_lines"), F.col("_dropped")), "\n"))
    return out.select(
        *((kept if c == text_col else F.col(n)).alias(c) for c, n in names.items() if c not in ("n_lines", "n_dropped")),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
