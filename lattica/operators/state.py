"""State that follows its sources: owed work, caches, projects renamed or dropped, settings by level, a leased queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, line_of
from .ranges import running

#: The bit that keeps a node out of summaries (fixed value).
SKIP_SUMMARY = 2
#: Columns of a queue.
QUEUE = ("task", "hash", "since", "until", "tries", "done", "error")


def summaries_owed(nodes: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(project, id, line): nodes whose summary has no vector of this text and model.

    ``nodes`` has project, id, type, summary; ``vectors`` project, id, hash, model.
    """
    rows = nodes.filter((F.coalesce("summary", F.lit("")) != "") & ~F.col("type").isin("external_import", "external_symbol"))
    have = vectors.filter(F.col("model") == model).select("project", "id", F.col("hash").alias("have")).distinct()
    rows = rows.withColumn("have", F.md5(F.col("summary").cast("binary"))).join(have, ["project", "id", "have"], "left_anti")
    return rows.select("project", "id", F.coalesce(line_of(F.col("id")), F.lit(0)).alias("line"))


def owed_directories(directories: DataFrame, changing: DataFrame) -> DataFrame:
    """(id): folders to describe anew, and with them all folders above what changes.

    ``directories`` has id, source (auto, llm or manual), described, wanted (hashes of what the
    summary was and would be made from) and skip; ``changing`` has ids. Manual and skipped
    folders are left alone.
    """
    open_ = directories.filter((F.col("source") != "manual") & (F.col("skip").bitwiseAND(F.lit(SKIP_SUMMARY)) == 0))
    own = open_.filter((F.col("source") == "auto") | ~F.col("described").eqNullSafe(F.col("wanted"))).select("id")
    above = own.union(changing.select("id")).select(F.explode(ancestors(F.col("id"))).alias("id")).distinct()
    return own.union(above.join(open_.select("id"), "id", "left_semi")).distinct()


def work_order(files: DataFrame, directories: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, kind, rank): files first, then folders deepest first, then entities; all have id."""
    depth = F.size(ancestors(F.col("id"))) + 1
    rows = files.select("id", F.lit("file").alias("kind"), F.lit(0).alias("rank"))
    rows = rows.union(directories.select("id", F.lit("directory").alias("kind"), (1000 - depth).alias("rank")))
    return rows.union(entities.select("id", F.lit("entity").alias("kind"), F.lit(2000).alias("rank")))


def memoised(rows: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``summary`` from the cache (key, summary), by the sha256 of their text; null where it is still to be made."""
    known = cache.groupBy(F.col("key").alias("_key")).agg(F.min("summary").alias("summary"))
    keyed = rows.withColumn("_key", F.sha2(F.col(text).cast("binary"), 256))
    return keyed.join(known, "_key", "left").drop("_key")


def listing(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(project, total, one map a column): how many nodes a project has, and of each value of the columns.

    Counts come first, so a map is made of a project's distinct values, not of its nodes.
    """
    out = nodes.groupBy("project").agg(F.count(F.lit(1)).alias("total"))
    for c in by:
        counts = nodes.groupBy("project", c).agg(F.count(F.lit(1)).alias("n")).filter(F.col(c).isNotNull())
        maps = counts.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct(F.col(c).cast("string"), "n"))).alias(f"by_{c}"))
        out = out.join(maps, "project", "left")
    return out


def renamed(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]], old: object, new: object) -> dict[str, DataFrame]:
    """All tables with a project's name changed in every column that holds one."""
    swap = lambda c: F.when(F.col(c) == F.lit(old), F.lit(new)).otherwise(F.col(c)).alias(c)
    return {t: df.select(*(swap(c) if c in columns.get(t, ()) else F.col(c) for c in df.columns)) for t, df in tables.items()}


def dropped(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]], project: object) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without a project's rows, and the report (table, rows) of what goes."""
    left, report = {}, None
    for t, df in tables.items():
        own = F.lit(False)
        for c in columns.get(t, ()):
            own = own | F.coalesce(F.col(c) == F.lit(project), F.lit(False))
        left[t] = df.filter(~own)
        count = df.filter(own).agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("rows"))
        report = count if report is None else report.union(count)
    return left, report


def without_dependents(gone: DataFrame, edges: DataFrame, *tied: DataFrame) -> tuple[DataFrame, ...]:
    """Edges without those from or to nodes that are ``gone`` (project, id), and tied tables (project, id, ...) without theirs."""
    keys = gone.select("project", "id").distinct()
    for end in ("source", "target"):
        edges = edges.join(keys.withColumnRenamed("id", end), ["project", end], "left_anti").select(*edges.columns)
    return edges, *(t.join(keys, ["project", "id"], "left_anti").select(*t.columns) for t in tied)


def gated(levels: DataFrame, resolved: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Resolved settings with ``allowed``; where the global level forbids, fields are null and it is the origin.

    ``levels`` has the key, origin and allowed.
    """
    no = levels.filter((F.col("origin") == "global") & ~F.col("allowed")).select(key, F.lit(False).alias("allowed")).distinct()
    out = resolved.join(no, key, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
    value = lambda f: F.when(F.col("allowed"), F.col(f)).alias(f)
    source = lambda f: F.when(F.col("allowed"), F.col(f"{f}_origin")).otherwise("global").alias(f"{f}_origin")
    return out.select(key, "allowed", *(x for f in fields for x in (value(f), source(f))))


def summed_documents(levels: DataFrame, key: str) -> DataFrame:
    """(key, document): the documents of all levels one under another, the most general (greatest ``rank``) first; blank ones fall out."""
    rows = levels.filter(F.trim("document") != "")
    parts = F.reverse(F.array_sort(F.collect_list(F.struct("rank", "document"))))  # a key has as many levels as there are kinds
    return rows.groupBy(key).agg(parts.alias("p")).select(key, F.array_join(F.transform("p", lambda x: x["document"]), "\n").alias("document"))


def effective(candidates: DataFrame, switches: DataFrame, locked: Column) -> DataFrame:
    """(project, name, owner): of each name the nearest scope's entry that is switched on.

    ``candidates`` has project (who asks), id, name, owner, rank (0 own, 1 organization, 2
    global) and standard (whether on without a switch); ``switches`` has project, id, rank and
    enabled. The project's switch decides, else any organization's; ``locked`` ones are always on.
    """
    own = switches.filter("rank = 0").groupBy("project", "id").agg(F.bool_or("enabled").alias("own"))
    org = switches.filter("rank = 1").groupBy("project", "id").agg(F.bool_or("enabled").alias("org"))
    rows = candidates.join(own, ["project", "id"], "left").join(org, ["project", "id"], "left")
    on = rows.filter(locked | F.coalesce("own", "org", "standard"))
    best = on.groupBy("project", "name").agg(F.min(F.struct("rank", "id", "owner")).alias("b"))
    return best.select("project", "name", "b.owner")


def masked(links: DataFrame, held: DataFrame, ends: Sequence[str], hidden: Sequence[str]) -> DataFrame:
    """``links`` with at least one end among ``held`` projects; columns of an end that is not are blanked (its name stays)."""
    rows = links
    for i, end in enumerate(ends):
        rows = rows.join(held.select(F.col("project").alias(end), F.lit(True).alias(f"_h{i}")).distinct(), end, "left")
    seen = F.coalesce(*(F.col(f"_h{i}") for i in range(len(ends))))
    show = [F.when(F.col(f"_h{i}"), F.col(h)).alias(h) for i, h in enumerate(hidden)]
    return rows.filter(seen).select(*(c for c in links.columns if c not in hidden), *show)


def without_constant(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` without a column that has one value only; a look at two distinct values decides."""
    return rows if rows.select(column).distinct().limit(2).count() > 1 else rows.drop(column)


def enqueued(queue: DataFrame, new: DataFrame, now: Column, version: str) -> DataFrame:
    """The queue after ``new`` tasks (task, hash, place) at ``now``.

    A queue has ``QUEUE``: a task waits since ``since``, is leased until ``until`` or both (one put in
    again while it is worked on), has used ``tries``, is done with a stamp hash|version|empty or has
    failed with an error. A task is passed over if it waits or is leased with the same hash, or is
    done with the same hash and version and was found empty; any other is put in, keeps its
    place if it waits already and starts with no tries, stamp or error. Of rows that repeat a task
    the last place has the hash, the first the time; rows of one place go by hash.
    """
    by = F.struct("place", "hash")
    new = new.filter("task is not null").groupBy("task").agg(F.max(by)["hash"].alias("_hash"), F.min("place").alias("_place"))
    rows = queue.select(*QUEUE).join(new, "task", "full")
    same = F.col("hash").eqNullSafe(F.col("_hash")) & (F.col("since").isNotNull() | F.col("until").isNotNull())
    settled_ = F.coalesce(F.col("done") == F.concat_ws("|", "_hash", F.lit(version), F.lit("1")), F.lit(False))
    put = F.col("_place").isNotNull() & ~same & ~settled_
    at = F.timestamp_micros(F.unix_micros(now) + F.col("_place"))
    return rows.select(
        "task", F.when(put, F.col("_hash")).otherwise(F.col("hash")).alias("hash"), F.when(put, F.coalesce("since", at)).otherwise(F.col("since")).alias("since"), "until",
        F.when(put, F.lit(0)).otherwise(F.col("tries")).cast("long").alias("tries"), *(F.when(~put, F.col(c)).alias(c) for c in ("done", "error")),
    )


def claimed(queue: DataFrame, now: Column, lease: int, most: int) -> DataFrame:
    """The queue after a claim of up to ``most`` tasks for ``lease`` seconds: those that wait longest, the smaller task on a tie.

    Leases that have run out wait again first, from now on if they do not wait already. Tries are
    counted here and judged when a task fails.
    """
    over = F.coalesce(F.col("until") <= now, F.lit(False))
    rows = queue.select(*QUEUE).withColumns({"since": F.when(over, F.coalesce("since", now)).otherwise(F.col("since")), "until": F.when(~over, F.col("until"))})
    picked = rows.filter("since is not null").orderBy("since", "task").limit(most).select("task", F.lit(True).alias("picked"))
    got = F.col("picked").isNotNull()
    end = F.timestamp_micros(F.unix_micros(now) + lease * 1_000_000)
    return rows.join(picked, "task", "left").select(
        "task", "hash", F.when(~got, F.col("since")).alias("since"), F.when(got, end).otherwise(F.col("until")).alias("until"),
        (F.col("tries") + got.cast("long")).alias("tries"), "done", "error",
    )


def settled(queue: DataFrame, outcomes: DataFrame, now: Column, attempts: int, version: str) -> DataFrame:
    """The queue after outcomes (task, outcome, hash, empty, error), the greatest of a task's rows in this order.

    finish ends the lease and forgets tries and error; the task is done if the queue still asks for
    the hash that was worked on. release gives a lease and its try back. fail ends the lease; a task
    whose tries are spent leaves the queue with its error, any other waits again. Outcomes of
    unknown tasks are passed over.
    """
    given = outcomes.groupBy("task").agg(F.max(F.struct("outcome", "hash", "empty", "error")).alias("o"))
    rows = queue.select(*QUEUE).join(given, "task", "left")
    is_ = lambda x: F.coalesce(F.col("o.outcome") == x, F.lit(False))
    leased, spent = F.col("until").isNotNull(), F.col("tries") >= attempts
    back = (is_("release") & leased) | (is_("fail") & ~spent)
    stamp = F.concat_ws("|", "o.hash", F.lit(version), F.coalesce("o.empty", F.lit(0)).cast("string"))
    return rows.select(
        "task", "hash",
        F.when(back, F.coalesce("since", now)).when(~(is_("fail") & spent), F.col("since")).alias("since"),
        F.when(F.col("o").isNull(), F.col("until")).alias("until"),
        F.when(is_("finish"), F.lit(0)).when(is_("release") & leased, F.greatest(F.col("tries") - 1, F.lit(0))).otherwise(F.col("tries")).cast("long").alias("tries"),
        F.when(is_("finish") & (F.coalesce("hash", "o.hash") == F.col("o.hash")), stamp).otherwise(F.col("done")).alias("done"),
        F.when(is_("fail") & spent, F.col("o.error")).when(~is_("finish"), F.col("error")).alias("error"),
    )


def overdue_first(projects: DataFrame, now: Column, running: int, capacity: int) -> DataFrame:
    """(project, late, start): due projects, the longest overdue first; as many start as capacity leaves.

    ``projects`` has project, due (a time) and busy.
    """
    late = F.unix_timestamp(now) - F.unix_timestamp("due")
    rows = projects.filter(~F.col("busy")).withColumn("late", late).filter("late >= 0")
    started = rows.orderBy(F.desc("late"), "project").limit(max(0, capacity - running)).select("project", F.lit(True).alias("start"))
    return rows.select("project", "late").join(started, "project", "left").withColumn("start", F.coalesce("start", F.lit(False)))


def recounts(marks: DataFrame, tick: str, full: str) -> DataFrame:
    """(at, project): a project marked dirty is counted once at the end of its tick; ``full`` passes have a null project."""
    dirty = marks.select(F.window("ts", tick)["end"].alias("at"), "project").distinct()
    whole = marks.select(F.window("ts", full)["end"].alias("at"), F.lit(None).cast(marks.schema["project"].dataType).alias("project")).distinct()
    return dirty.unionByName(whole)


def after_resync(changes: DataFrame, listing_: DataFrame) -> DataFrame:
    """(project, path, action): what a feed of changes asks for.

    ``changes`` has project, ts, kind (changed, removed or resync) and path. A project's last resync puts its
    whole listing (project, path) in; changes behind it count, the last of a path.
    """
    last = changes.filter("kind = 'resync'").groupBy("project").agg(F.max("ts").alias("since"))
    rows = changes.filter("kind != 'resync'").join(last, "project", "left").filter("since is null or ts > since")
    own = rows.groupBy("project", "path").agg(F.max(F.struct("ts", "kind"))["kind"].alias("action"))
    all_ = listing_.join(last.select("project"), "project", "left_semi").select("project", "path", F.lit("changed").alias("action"))
    return own.unionByName(all_.join(own.select("project", "path"), ["project", "path"], "left_anti"))


def regressed(metrics: DataFrame, baseline: DataFrame, allowed: float = 0.02) -> DataFrame:
    """(name, value, base, regressed): quality metrics (name, value) below the baseline by more than ``allowed``."""
    rows = metrics.join(baseline.select("name", F.col("value").alias("base")), "name", "left")
    return rows.withColumn("regressed", F.coalesce(F.col("value") < F.col("base") - allowed, F.lit(False)))


def numbered_groups(rows: DataFrame, group: str) -> DataFrame:
    """(group, number, members): groups numbered by size, the largest first, then by their first id; by ranges, as groups may be many."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first"))
    placed = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.desc("members"), "first"], ["one"], "groups")
    return placed.select(group, (F.col("one_before") + 1).cast("int").alias("number"), "members")
