"""The market of names between projects: who provides what others take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..session import stage

NAME = ["kind", "name"]


def _providers(provided: DataFrame) -> DataFrame:
    """Per name how many projects provide it, and the smallest of them; projects of a hot name are combined map-side."""
    return provided.select("project", *NAME).distinct().groupBy(*NAME).agg(F.count(F.lit(1)).alias("providers"), F.min("project").alias("provider"))


def unique_provider_links(provided: DataFrame, taken: DataFrame) -> DataFrame:
    """(project, kind, name, provider): a taken name that exactly one project provides, and another one than the taker."""
    one = _providers(provided).filter("providers = 1").select(*NAME, "provider")
    return taken.select("project", *NAME).distinct().join(one, NAME).filter("project != provider").select("project", *NAME, "provider")


def market_counts(provided: DataFrame, taken: DataFrame) -> DataFrame:
    """(project, linked, ambiguous, unprovided) of each taker."""
    rows = taken.select("project", *NAME).distinct().join(_providers(provided), NAME, "left")
    own = provided.select("project", *NAME).distinct().withColumn("own", F.lit(1))
    rows = rows.join(own, ["project", *NAME], "left")
    return rows.groupBy("project").agg(
        F.count_if((F.col("providers") == 1) & F.col("own").isNull()).alias("linked"),
        F.count_if(F.col("providers") > 1).alias("ambiguous"),
        F.count_if(F.col("providers").isNull()).alias("unprovided"),
    )


def link_samples(links: DataFrame, k: int) -> DataFrame:
    """(project, provider, n, samples): how many names link two projects, and the first ``k``."""
    # The k smallest names are found per row order, so no group's names are all gathered.
    links = stage(links, "links")
    place = F.row_number().over(Window.partitionBy("project", "provider").orderBy("name"))
    n = links.groupBy("project", "provider").agg(F.count(F.lit(1)).alias("n"))
    top = links.withColumn("place", place).filter(F.col("place") <= k)
    top = top.groupBy("project", "provider").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return n.join(top, ["project", "provider"]).select("project", "provider", "n", F.array_join(F.col("names").cast("array<string>"), ",").alias("samples"))


def link_summary(links: DataFrame) -> DataFrame:
    """(project, direction, n): names used from others and used by others."""
    ends = F.inline(F.array(F.struct(F.col("project"), F.lit("uses").alias("direction")), F.struct(F.col("provider").alias("project"), F.lit("used_by").alias("direction"))))
    return links.select(ends).groupBy("project", "direction").agg(F.count(F.lit(1)).alias("n"))


def resolved(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """(reference, target, ambiguous): the candidate of least priority, if there is one only.

    ``references`` has reference, ``candidates`` has reference, target, priority.
    """
    rows = candidates.select("reference", "target", "priority").distinct()
    best = rows.groupBy("reference", "priority").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))
    best = best.groupBy("reference").agg(F.min(F.struct("priority", "n", "target")).alias("b"))
    out = references.select("reference").join(best, "reference", "left")
    return out.select("reference", F.when(F.col("b.n") == 1, F.col("b.target")).alias("target"), F.coalesce(F.col("b.n") > 1, F.lit(False)).alias("ambiguous"))


def name_matches(names: DataFrame, spelling: Column) -> DataFrame:
    """Rows of ``names`` (kind, name, ...) that a spelling means: the whole name, a host's first label, or the last path segment."""
    key, host = name_key(spelling), F.when(F.col("kind") == "host", F.split_part("name", F.lit("."), F.lit(1)))
    last = F.when(F.contains("name", F.lit("/")), F.regexp_replace("name", "^.*/", ""))
    fits = (name_key(F.col("name")) == key) | F.coalesce(name_key(host) == key, F.lit(False)) | F.coalesce(name_key(last) == key, F.lit(False))
    return names.filter((key != "") & fits)


def project_walk(links: DataFrame, starts: DataFrame, direction: str, depth: int) -> DataFrame:
    """(project, hop): projects around ``starts`` (project) by links (source, target), outgoing, incoming or both."""
    from .graph import walk

    out = links.select("source", "target").distinct()
    back = out.select(F.col("target").alias("source"), F.col("source").alias("target"))
    edges = {"outgoing": out, "incoming": back, "both": out.union(back).distinct()}[direction]
    return walk(edges, starts.select(F.col("project").alias("id")), depth).select(F.col("id").alias("project"), "hop")


def along_walk(links: DataFrame, hops: DataFrame, direction: str) -> DataFrame:
    """Links (source, target, ...) one step apart in a walk, the way it went; links among the starts count too."""
    a = hops.select(F.col("project").alias("source"), F.col("hop").alias("_a"))
    b = hops.select(F.col("project").alias("target"), F.col("hop").alias("_b"))
    rows = links.join(a, "source").join(b, "target")
    step = F.col("_b") - F.col("_a")
    near = {"outgoing": step == 1, "incoming": step == -1, "both": F.abs(step) == 1}[direction]
    return rows.filter(near | ((F.col("_a") == 0) & (F.col("_b") == 0))).select(*links.columns)


def manual_first(auto: DataFrame, manual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both with ``origin``; what was entered by hand replaces what was found of the same keys."""
    found = auto.join(manual.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("auto"))
    return manual.withColumn("origin", F.lit("manual")).unionByName(found)


def built_images(names: DataFrame, builds: DataFrame) -> DataFrame:
    """(project, name, node): images that one service both names and builds (both: project, node, name)."""
    a, b = names.select("project", "node", "name"), builds.select("project", "node", "name")
    return a.join(b, ["project", "node", "name"], "left_semi").select("project", "name", "node").distinct()
