"""Work records kept as tables: a batch of writes makes the next table from the last one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import ring_append


def write_items(items: DataFrame, written: DataFrame) -> DataFrame:
    """Roadmap items after at most one write a roadmap.

    Both have roadmap, item, position and more fields; null in ``written`` leaves a field as it
    is. An item put at a place moves those at it or behind it down by one; a new one without a
    place goes to the end.
    """
    fields = [c for c in items.columns if c not in ("roadmap", "item", "position")]
    asked = written.select("roadmap", F.col("item").alias("at_item"), F.col("position").alias("at"))
    pushed = F.col("at").isNotNull() & (F.col("item") != F.col("at_item")) & (F.col("position") >= F.col("at"))
    moved = items.join(asked, "roadmap", "left").withColumn("position", F.col("position") + F.coalesce(pushed, F.lit(False)).cast("int"))
    ends = items.groupBy("roadmap").agg(F.max("position").alias("end"))
    new = written.select("roadmap", "item", F.col("position").alias("new_position"), *(F.col(c).alias(f"new_{c}") for c in fields))
    both = moved.drop("at", "at_item").join(new, ["roadmap", "item"], "full").join(ends, "roadmap", "left")
    place = F.coalesce("new_position", "position", F.coalesce("end", F.lit(0)) + 1).alias("position")
    return both.select("roadmap", "item", place, *(F.coalesce(f"new_{c}", c).alias(c) for c in fields))


def count_sightings(old: DataFrame, seen: DataFrame, now: Column, settled: Sequence[str] = ("fixed", "dismissed"), keep: int = 20) -> DataFrame:
    """Suggestions after a batch of sightings, one an id at most.

    ``old`` has id, hits, status, queries (array), first_seen, last_seen; ``seen`` has id, bump
    (0 or 1), status and query (null: none). A sighting counts, opens a settled suggestion
    again unless it brings a status, and adds its query to the last ``keep``.
    """
    new = seen.select("id", "bump", F.col("status").alias("new_status"), "query")
    both = old.join(new, "id", "full")
    again = F.coalesce("bump", F.lit(0)) > 0
    status = F.coalesce("new_status", F.when(again & F.col("status").isin(*settled), "open"), "status", F.lit("open"))
    queries = F.coalesce("queries", F.array().cast("array<string>"))
    return both.select(
        "id",
        (F.coalesce("hits", F.lit(0)) + F.coalesce("bump", F.lit(0))).alias("hits"),
        status.alias("status"),
        F.when(F.col("query").isNull(), queries).otherwise(ring_append(queries, F.col("query"), keep)).alias("queries"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(again | F.col("last_seen").isNull(), now).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def settle(issues: DataFrame, changes: DataFrame, now: Column, settled: Sequence[str]) -> DataFrame:
    """Issues (id, status, closed_at, ...) after changes (id, status): closed_at moves with a change of state only."""
    both = issues.join(changes.select("id", F.col("status").alias("after")), "id", "left")
    done = lambda c: F.coalesce(F.col(c).isin(*settled), F.lit(False))
    both = both.withColumn("after", F.coalesce("after", "status"))
    closed = F.when(done("after") & done("status"), F.col("closed_at")).when(done("after"), now)
    return both.withColumn("closed_at", closed).withColumn("status", F.col("after")).select(*issues.columns)


def drop_plans(dropped: DataFrame, plans: DataFrame, prompts: DataFrame, *tied: DataFrame) -> tuple[DataFrame, ...]:
    """Plans and prompts without those of dropped plans (id); rows of ``tied`` tables stay, their plan_id null."""
    gone = dropped.select(F.col("id").alias("plan_id")).distinct()
    untied = []
    for rows in tied:
        known = rows.join(gone.withColumn("gone", F.lit(True)), "plan_id", "left")
        untied.append(known.withColumn("plan_id", F.when(F.col("gone").isNull(), F.col("plan_id"))).select(*rows.columns))
    left = plans.join(gone, plans.id == gone.plan_id, "left_anti")
    return left, prompts.join(gone, "plan_id", "left_anti").select(*prompts.columns), *untied


def inherit_scope(prompts: DataFrame, plans: DataFrame) -> DataFrame:
    """Prompts with the project of their plan; null where the plan has none or is missing."""
    scope = plans.select(F.col("id").alias("plan_id"), "project")
    return prompts.drop("project").join(scope, "plan_id", "left")


def own_then_global(rows: DataFrame, project: object, *order: Column) -> DataFrame:
    """Rows of a project, then those of none."""
    mine = rows.filter((F.col("project") == F.lit(project)) | F.col("project").isNull())
    return mine.orderBy(F.col("project").isNull(), *order)


def tagged(rows: DataFrame, tags: Sequence[str], column: str = "tags") -> DataFrame:
    """Rows that carry every tag; no tags ask nothing."""
    wanted = F.array(*map(F.lit, tags)).cast("array<string>")
    return rows.filter(F.size(F.array_except(wanted, F.coalesce(column, F.array().cast("array<string>")))) == 0)


def flag_missing(ties: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ties of records (project, id, ...) with ``missing``: the node is gone."""
    there = nodes.select("project", "id", F.lit(False).alias("missing")).distinct()
    return ties.join(there, ["project", "id"], "left").withColumn("missing", F.coalesce("missing", F.lit(True)))


def write_summaries(nodes: DataFrame, written: DataFrame) -> DataFrame:
    """Nodes (project, id, summary, summary_source, ...) after writes of both fields; a manual summary gives way to manual ones only."""
    new = written.select("project", "id", F.col("summary").alias("new"), F.col("summary_source").alias("by"))
    both = nodes.join(new, ["project", "id"], "left")
    takes = F.col("by").isNotNull() & ((F.col("by") == "manual") | ~F.col("summary_source").eqNullSafe("manual"))
    both = both.withColumn("summary", F.when(takes, F.col("new")).otherwise(F.col("summary")))
    return both.withColumn("summary_source", F.when(takes, F.col("by")).otherwise(F.col("summary_source"))).select(*nodes.columns)
