"""Layered data: files that patterns of a hierarchy name, what they select, configure and include.

Paths are relative to the root of their space, a folder with data and modules. ``patterns`` has
(space, data_dir, place, pattern): the layers of a space in their order, ``{name}`` being a
variable of one path segment or a part of it. ``entries`` has (space, path, key, value, listed):
the top-level keys of data files, one row a text or an item of a list, value null for what is nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The file that stands for a module, the first that is there.
ENTRY_POINTS = ("requires.yaml", "requires.yml", "code/main.py", "README.md")
MODULE = r"^modules/([^/]+)/"


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def rules(patterns: DataFrame) -> DataFrame:
    """(space, data_dir, place, names, rule): every pattern with its variables as a regular expression; a repeated variable must repeat its value. Patterns without variables are none."""
    pieces, asked = F.split("pattern", r"\{\w+\}"), F.regexp_extract_all("pattern", F.lit(r"\{(\w+)\}"), F.lit(1))
    rows = patterns.select("space", "data_dir", "place", pieces.alias("pieces"), asked.alias("asked")).filter(F.size("asked") > 0)
    rows = rows.withColumn("names", F.array_distinct("asked"))
    again = lambda v: F.concat(F.lit("(?:\\"), F.array_position("names", v).cast("string"), F.lit(")"))
    group = lambda v, i: F.when(F.array_position("asked", v) == i + 1, F.lit("([^/]+)")).otherwise(again(v))
    parts = F.transform("asked", lambda v, i: F.concat(group(v, i), _quoted(F.get("pieces", i + 1))))
    return rows.select("space", "data_dir", "place", "names", F.concat(F.lit("\\A"), _quoted(F.get("pieces", F.lit(0))), F.array_join(parts, ""), F.lit("\\z")).alias("rule"))


def filled(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """(space, variable, value, path): the file that stands for a variable's value, the smallest path of several.

    A file speaks for the variables of the first layer that names it. ``files`` has (space, path);
    repeated and null paths do no harm.
    """
    near = files.select("space", "path").distinct().join(rules(patterns), "space").filter(F.col("path").startswith(F.col("data_dir")))
    near = near.withColumn("inside", F.expr("substring(path, length(data_dir) + 1)")).filter("inside rlike rule")
    first = near.groupBy("space", "path").agg(F.min_by(F.struct("inside", "rule", "names"), "place").alias("b")).select("space", "path", "b.*")
    each = first.select("space", "path", "inside", "rule", F.posexplode("names").alias("at", "variable"))
    said = each.select("space", "path", "variable", F.expr("regexp_extract(inside, rule, at + 1)").alias("value"))
    return said.groupBy("space", "variable", "value").agg(F.min("path").alias("path"))


def modules(files: DataFrame) -> DataFrame:
    """(space, module, entry): the modules of a space, each with its entry file, or its folder where it has none."""
    rows = files.select("space", "path", F.regexp_extract("path", MODULE, 1).alias("module")).filter("module != ''")
    inside = F.expr("substring(path, length(module) + 10)")  # behind modules/ and the module's slash
    place = F.array_position(F.array(*map(F.lit, ENTRY_POINTS)), inside)
    best = rows.groupBy("space", "module").agg(F.min_by("path", F.when(place > 0, place)).alias("entry"))
    return best.select("space", "module", F.coalesce("entry", F.concat(F.lit("modules/"), "module", F.lit("/"))).alias("entry"))


def followed(patterns: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """(space, source, target, relation), distinct: what data files lead to.

    A key that is a module's name configures its entry; a text under a variable's name selects the
    file that stands for it, unless that is the asking file; an item under ``modules`` includes a
    module. Data of a module itself leads nowhere, nor do names that are not there.
    """
    rows = entries.filter(F.regexp_extract("path", MODULE, 1) == "").select("space", "path", "key", "value", "listed")
    known = modules(files)
    target = lambda found, relation: found.select("space", F.col("path").alias("source"), "target", F.lit(relation).alias("relation"))
    by_key = known.select("space", F.col("module").alias("key"), F.col("entry").alias("target"))
    items = rows.filter("key = 'modules' and listed").select("space", "path", F.col("value").alias("key"))
    stands = filled(patterns, files).select("space", F.col("variable").alias("key"), "value", F.col("path").alias("target"))
    selected = rows.filter("not listed and value is not null").join(stands, ["space", "key", "value"]).filter("target != path")
    out = target(rows.join(by_key, ["space", "key"]), "configures").union(target(items.join(by_key, ["space", "key"]), "includes_module"))
    return out.union(target(selected, "selects")).distinct()


def names(patterns: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """(space, way, kind, name, path), distinct: modules and the values that are selected by name are provided, listed modules that are not there are taken."""
    rows = entries.filter(F.regexp_extract("path", MODULE, 1) == "")
    known = modules(files)
    row = lambda df, way, kind, name, path: df.select("space", F.lit(way).alias("way"), F.lit(kind).alias("kind"), F.col(name).alias("name"), path.alias("path"))
    own = row(known, "provided", "deploy-module", "module", F.concat(F.lit("modules/"), "module", F.lit("/")))
    asked = rows.filter("not listed and value is not null").select("space", F.col("key").alias("variable")).distinct()
    roles = row(filled(patterns, files).join(asked, ["space", "variable"], "left_semi"), "provided", "deploy-role", "value", F.col("path"))
    items = rows.filter("key = 'modules' and listed and value is not null").select("space", "path", F.col("value").alias("module"))
    taken = row(items.join(known, ["space", "module"], "left_anti"), "taken", "deploy-module", "module", F.col("path"))
    return own.union(roles).union(taken).distinct()
