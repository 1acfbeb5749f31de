"""References to files and symbols: nearest and suffix matches, placeholders, and what to link again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import shared_folders, suffixes
from ..functions.text import extension

#: Endings that may call each other (fixed values); all others are a family of their own.
FAMILIES = {
    "c": (".c", ".h", ".cc", ".cpp", ".hpp"), "jvm": (".java", ".kt", ".scala"), "script": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"),
}


def family(path: Column) -> Column:
    """The language family of a file, by its ending."""
    end = extension(path)
    out = end
    for name, endings in FAMILIES.items():
        out = F.when(end.isin(*endings), name).otherwise(out)
    return out


def nearest(candidates: DataFrame) -> DataFrame:
    """(reference, target): of a reference's candidates the one that shares most folders with it, if only one does.

    ``candidates`` has reference, path (the asking file), target (a path).
    """
    rows = candidates.select("reference", "target", shared_folders(F.col("path"), F.col("target")).alias("shared")).distinct()
    counted = rows.groupBy("reference", "shared").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))
    best = counted.groupBy("reference").agg(F.max(F.struct("shared", "n", "target")).alias("b"))
    return best.filter("b.n = 1").select("reference", "b.target")


def by_suffix(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(reference, path): the only file whose path ends with an import's segments."""
    ends = files.select("path", F.explode(suffixes(F.col("path"))).alias("suffix"))
    only = ends.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1")
    return imports.select("reference", "suffix").join(only, "suffix").select("reference", "path")


def with_placeholders(resolved: DataFrame) -> DataFrame:
    """(reference, target): imports and bases that lead nowhere point to a placeholder of their name, calls fall out.

    ``resolved`` has reference, kind (import, base, call), name and target.
    """
    stand_in = F.when(F.col("kind") != "call", F.concat(F.lit("external::"), "name"))
    return resolved.select("reference", F.coalesce("target", stand_in).alias("target")).filter("target is not null")


def within_family(candidates: DataFrame) -> DataFrame:
    """Candidates (path, target, ...) of the asking file's language family."""
    return candidates.filter(family(F.col("path")) == family(F.col("target")))


def to_relink(files: DataFrame, previous: DataFrame, changed: DataFrame, imports: DataFrame, fresh: bool = False) -> DataFrame:
    """(path): files whose references are resolved again.

    If the set of files moved, or with ``fresh``, all of them; else the changed files and those
    that import one (``imports``: path, target).
    """
    now, before = files.select("path").distinct(), previous.select("path").distinct()
    moved = now.join(before, "path", "left_anti").union(before.join(now, "path", "left_anti")).limit(1)
    some = moved.agg((F.count(F.lit(1)) > 0).alias("moved"))  # one row
    hit = changed.select("path").union(imports.join(changed.select(F.col("path").alias("target")), "target", "left_semi").select("path")).distinct()
    marked = now.join(hit.withColumn("hit", F.lit(True)), "path", "left").crossJoin(F.broadcast(some))
    return marked.filter(F.col("moved") | F.lit(fresh) | F.col("hit")).select("path")
