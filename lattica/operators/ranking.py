"""Reranking of a candidate pool, and lists shared out between groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_file, is_vendored, without_extension
from ..functions.questions import identifiers, subwords

# Bonuses in units of a first rank of one list, 1 / 61, and what they count at most.
UNIT = 1 / 61
SYMBOL, WORD_NAME, WHOLE, PATH_WORD, POOL_LINK, DEGREE = 0.75, 0.25, 0.5, 0.1, 0.05, 0.03
PROSE, EXTERNAL, VENDORED, TEST = -0.25, -0.5, -0.5, -0.15
PATH_WORDS, POOL_LINKS, DEGREES = 3, 3, 3
PROSE_TYPES, PROSE_PROJECTS = ("heading", "image"), ("docs", "memory", "suggestions", "issues")
TEST_WORDS = ("test", "tests", "spec", "specs")


def is_external() -> Column:
    return F.col("type").startswith("external_")


def is_prose() -> Column:
    """Prose in a project that is not prose."""
    return F.col("type").isin(*PROSE_TYPES) & ~F.coalesce(F.col("project_type").isin(*PROSE_PROJECTS), F.lit(False))


def pool_links(rows: DataFrame) -> DataFrame:
    """``rows`` with ``links``: the other strong rows of the pool in the same file."""
    weak = is_external() | is_prose()
    files = rows.filter(~weak & F.col("file_path").isNotNull()).groupBy("project", "file_path").agg(F.count(F.lit(1)).alias("links"))
    out = rows.join(files, ["project", "file_path"], "left")
    return out.withColumn("links", F.greatest(F.coalesce("links", F.lit(0)) - F.when(weak, 0).otherwise(1), F.lit(0)))


def bonuses(question: Column) -> Column:
    """What a row gains or loses by its name, path, type, links and in-degree, in units of a first rank."""
    words, named = subwords(question), identifiers(question)
    name = F.lower(F.regexp_replace(F.regexp_replace("name", r"\(\)$", ""), r"^\.", ""))
    own = F.filter(named, lambda x: x["word"] == name)
    by_name = F.when(F.size(own) == 0, 0.0).when(F.get(own, 0)["shaped"], SYMBOL).otherwise(WORD_NAME)
    path = F.coalesce("file_path", F.when(F.col("type") == "directory", F.col("id")))
    parts = subwords(without_extension(path))
    alike = lambda known, w: F.exists(known, lambda p: p.startswith(w) | w.startswith(p))
    among = lambda known: F.filter(words, lambda w: F.when(F.col("type") == "directory", alike(known, w)).otherwise(F.array_contains(known, w)))
    hits = F.get(F.transform(F.array(parts), lambda known: F.size(among(known))), 0)  # a path is split once, not for every word
    asks_tests = F.exists(words, lambda w: w.isin(*TEST_WORDS))
    test = (is_test_file(path) | F.coalesce("test", F.lit(False))) & ~asks_tests
    by_path = F.least(hits, F.lit(PATH_WORDS)) * PATH_WORD + F.when(is_vendored(path), VENDORED).when(test, TEST).otherwise(0.0)
    return (
        by_name
        + F.when(F.col("whole"), WHOLE).otherwise(0.0)
        + F.when(path.isNotNull(), by_path).otherwise(0.0)
        + F.when(is_external(), EXTERNAL).when(is_prose(), PROSE).otherwise(0.0)
        + F.least("links", F.lit(POOL_LINKS)) * POOL_LINK
        + F.least(F.log1p("in_degree"), F.lit(float(DEGREES))) * DEGREE
    )


def reranked(pool: DataFrame, question: Column, limit: int, enabled: bool = True) -> DataFrame:
    """The ``limit`` best rows with score and place: each project's best row comes before any project's second.

    ``pool`` has project, project_type, id, type, name, file_path, rrf, whole, in_degree, test; it is a list of
    bounded depth. Without ``enabled`` the score is rrf alone.
    """
    extra = bonuses(question) * UNIT if enabled else F.lit(0.0)
    rows = pool_links(pool).withColumn("score", F.col("rrf") + extra)
    own = F.row_number().over(Window.partitionBy("project").orderBy(F.desc(F.round("score", 12)), "id"))
    rows = rows.withColumn("turn", own).orderBy("turn", F.desc(F.round("score", 12)), "id").limit(limit)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("turn", F.desc(F.round("score", 12)), "id")).cast("long"))


def shared_out(placed: DataFrame, group: str, order: Sequence[str], limit: int) -> DataFrame:
    """(group, shown, total, cut) of a list of ``limit`` rows that the groups of ``placed`` (place, total) take in turns."""
    shown = placed.orderBy("place", group, *order).limit(limit).groupBy(group).agg(F.count(F.lit(1)).alias("shown"))
    all_ = placed.groupBy(group).agg(F.max("total").alias("total"))
    out = all_.join(shown, group, "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    return out.select(group, "shown", "total", (F.col("shown") < F.col("total")).alias("cut"))


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, project): the project whose root is the longest that a path starts with.

    ``paths`` has path, ``roots`` root (ending with a slash) and project. Every folder above a path is a row, so
    this is a join by equality.
    """
    from ..functions.text import ancestors

    above = paths.select("path", F.explode(F.concat(F.array("path"), ancestors(F.col("path")))).alias("root"))
    found = above.join(roots.select("root", "project"), "root")
    best = found.groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), F.col("project"))).alias("best"))
    return best.select("path", F.col("best.project").alias("project"))


def prefix_pairs(words: DataFrame, roots: DataFrame, least: int = 3) -> DataFrame:
    """(word, root): words that a root begins or that begin a root, both of ``least`` letters at least.

    Either side's beginnings are rows, so both directions are joins by equality.
    """
    w = words.select("word").distinct().filter(F.length("word") >= least)
    r = roots.select("root").distinct().filter(F.length("root") >= least)
    starts = lambda c: F.explode(F.transform(F.sequence(F.lit(least), F.length(c)), lambda i: F.substring(c, F.lit(1), i)))
    longer = w.select("word", starts("word").alias("root")).join(r, "root")
    shorter = r.select("root", starts("root").alias("word")).join(w, "word")
    return longer.select("word", "root").union(shorter.select("word", "root")).distinct()


def at_share(placed: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(group, share, value): the value at index floor(share * n) of each group, without interpolation.

    ``placed`` is a group's rows with their ``place`` in the order of the value and ``total``.
    """
    wanted = F.array(*map(F.lit, map(float, shares)))
    hit = F.filter(wanted, lambda x: F.least(F.floor(x * F.col("total")), F.col("total") - 1) == F.col("place") - 1)
    return placed.select(group, F.explode(hit).alias("share"), value)
