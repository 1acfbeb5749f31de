"""Walks over edge tables. Each hop is one join; what is visited lives in tables, never on the driver."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors
from ..session import discard, stage

#: Words of the Bloom filter that a pair's front carries in its last round.
WORDS = 8
#: Tables of hops that a walk reads one by one; with more, they become one.
HOPS_APART = 12


def both_ways(edges: DataFrame) -> DataFrame:
    """(source, target) of an undirected graph."""
    pairs = edges.select("source", "target")
    return pairs.union(pairs.select(F.col("target"), F.col("source"))).distinct()


def doubled(edges: DataFrame) -> DataFrame:
    """(source, target) of an undirected graph in one pass, nothing is grouped: repeated edges stay, and so do loops."""
    return edges.select(F.inline(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))))


def walk(edges: DataFrame, seeds: DataFrame, hops: int | None, per_node: int | None = None) -> DataFrame:
    """(id, hop): every node reached from ``seeds`` (id), with the least number of hops; without ``hops`` the walk ends when nothing is new.

    ``per_node`` follows at most so many edges of each node, smallest targets first. A node is
    expanded once: visited ones leave by an anti join. Edges are written once, not worked out
    anew in every hop. Edges may repeat: of all steps only distinct nodes go on.
    """
    if per_node:
        place = F.row_number().over(Window.partitionBy("source").orderBy("target"))
        edges = edges.select("source", "target").distinct().withColumn("n", place).filter(F.col("n") <= per_node)
    edges = edges if hasattr(edges, "staged_at") else stage(edges.select("source", "target"), "walk-edges")
    seen = stage(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "walk")
    front, tables = seen, [seen]
    for hop in count(1) if hops is None else range(1, hops + 1):
        step = front.select("id").join(edges, F.col("id") == edges.source).select(F.col("target").alias("id")).distinct()
        front = stage(step.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)), f"walk-{hop}")
        if front.isEmpty():
            break
        seen = seen.union(front)
        tables.append(front)
        if len(tables) > HOPS_APART:  # a long walk's plan stays as small as a short one's
            seen, last = stage(seen, "walk"), tables
            discard(*(t for t in last if t is not front))
            tables = [seen]
    return seen


def listed(edges: DataFrame, asked: DataFrame, limit: int, relation: str | None = None) -> DataFrame:
    """(project, of, direction, relation, place, total, id): what every asked node (project, of) is tied to, ``limit`` rows of it.

    Each direction and relation has a turn: all first ids, then all second ones. ``total`` is what a
    direction and relation has in all. ``edges`` has project, source, target, relation; repeated
    ones count once. Edges are read once: counts and places come from one shuffle by the asked node.
    """
    edges = edges.filter(F.col("relation") == relation) if relation else edges
    end = lambda of, direction, to: F.struct(F.col(of).alias("of"), F.lit(direction).alias("direction"), "relation", F.col(to).alias("id"))
    both = F.inline(F.array(end("source", "outgoing", "target"), end("target", "incoming", "source")))
    rows = edges.select("project", "source", "target", "relation").distinct().select("project", both)
    rows = rows.join(asked.select("project", "of").distinct(), ["project", "of"], "left_semi")
    group = ["project", "of", "direction", "relation"]
    same = Window.partitionBy(*group)
    rows = rows.withColumn("total", F.count(F.lit(1)).over(same)).withColumn("place", F.row_number().over(same.orderBy("id"))).filter(F.col("place") <= limit)
    turn = F.row_number().over(Window.partitionBy("project", "of").orderBy("place", "direction", "relation", "id"))
    return rows.withColumn("turn", turn).filter(F.col("turn") <= limit).select(*group, "place", "total", "id")


def shortest_paths(edges: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """(id, hop, parent): undirected distances from ``start``, to all that can be reached or within ``hops``; the parent is the smallest one a hop nearer."""
    edges = stage(doubled(edges), "walk-edges")
    seen = walk(edges, start, hops)
    near = seen.select(F.col("id").alias("source"), F.col("hop").alias("near"))
    steps = edges.join(near, "source").select(F.col("target").alias("id"), "source", "near").join(seen, "id").filter("near = hop - 1")
    parents = steps.groupBy("id").agg(F.min("source").alias("parent"))
    return seen.join(parents, "id", "left").select("id", "hop", "parent")


def paths_between(edges: DataFrame, pairs: DataFrame, hops: int, nodes: int | None = None, steps: int | None = None) -> DataFrame:
    """(start, end, depth, path) of every distinct pair (start, end): a shortest undirected walk of ``hops`` at most, nulls where there is none.

    Both ends are searched at once; in every round a pair expands the end whose frontier is
    smaller, and is done when the two meet. Of several walks the one with the smallest ids comes,
    from the start on. ``nodes`` closes a pair that has seen more than so many, and ``steps``
    follows so many edges of a pair in a round, smallest ids first; with either, walks may be
    missed or not be the shortest. Pairs with a null have no walk; a pair of equal ids has one of
    length 0, whether the graph has the node or not.
    """
    met, seen, edges = meetings(edges, pairs, hops, nodes, steps)
    best = met.groupBy("start", "end").agg(F.min("depth").cast("int").alias("depth"))
    middle = met.join(best, ["start", "end", "depth"]).select("start", "end", "id", "hop", F.col("depth") - F.col("hop"))
    seen = seen.join(best, ["start", "end"], "left_semi")
    kept = [middle.toDF("start", "end", "id", "near", "far")]
    for side, down in ((0, "near"), (1, "far")):
        up, front = "far" if side == 0 else "near", kept[0]
        here = seen.filter(F.col("side") == side).select("start", "end", "id", F.col("hop").alias(down))
        for n in range(hops):  # from the meeting back to one end, along nodes that the search has seen
            step = front.filter(F.col(down) > 0).join(edges, front.id == edges.source)
            step = step.select("start", "end", F.col("target").alias("id"), F.col(down) - 1, F.col(up) + 1).toDF("start", "end", "id", down, up)
            front = stage(step.distinct().join(here, ["start", "end", "id", down], "left_semi").select("start", "end", "id", "near", "far"), f"path-{side}-{n}")
            if front.isEmpty():
                break
            kept.append(front)
    places = reduce(DataFrame.union, kept).select("start", "end", F.col("id").alias("next"), F.col("near").alias("place")).distinct()
    at = best.select("start", "end", "depth", F.array("start").alias("path"))
    done = [at.filter("depth = 0")]
    for n in range(1, hops + 1):
        at = at.filter(F.col("depth") >= n).join(places.filter(F.col("place") == n), ["start", "end"])
        at = at.join(edges, (F.element_at("path", -1) == edges.source) & (F.col("next") == edges.target))
        at = at.groupBy("start", "end", "depth", "path").agg(F.min("next").alias("next")).select("start", "end", "depth", F.concat("path", F.array("next")).alias("path"))
        done.append(at.filter(F.col("depth") == n))
    walks = reduce(DataFrame.union, done)
    same = pairs.select("start", "end").distinct()
    both = [same[c].eqNullSafe(walks[c]) for c in ("start", "end")]
    return same.join(walks, both, "left").select(same["start"], same["end"], "depth", "path")


def meetings(edges: DataFrame, pairs: DataFrame, hops: int, nodes: int | None = None, steps: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The search of ``paths_between``: (start, end, id, hop, depth) where two ends meet, (start, end, side, id, hop) that were seen, and the edges, both ways.

    Nothing is expanded beyond the last round, so what it reaches is written only where two ends meet.
    """
    edges = stage(both_ways(edges), "between-edges")
    asked = pairs.select("start", "end").filter("start is not null and end is not null").distinct()
    ends = F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("id")), F.struct(F.lit(1).alias("side"), F.col("end").alias("id"))))
    seen = front = stage(asked.select("start", "end", ends).withColumn("hop", F.lit(0)), "between")
    met = asked.filter("start = end").select("start", "end", F.col("start").alias("id"), F.lit(0).alias("hop"), F.lit(0).alias("depth"))
    key = ["start", "end"]
    for hop in range(1, hops + 1):
        width = front.groupBy(key).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
        turn = width.filter("a > 0 and b > 0").select(*key, F.when(F.col("a") <= F.col("b"), 0).otherwise(1).alias("side"))
        turn = turn.join(met.select(key), key, "left_anti")
        if nodes:
            turn = turn.join(seen.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > nodes), key, "left_anti")
        turn = stage(turn, f"between-turn-{hop}")
        other = seen.select(*key, "id", (1 - F.col("side")).alias("side"), F.col("hop").alias("far"))
        if hop == hops and not steps:
            met = met.union(stage(_hits(_last_steps(front, turn, other, edges), other), f"between-met-{hop}"))
            break
        step = front.join(turn, [*key, "side"]).join(edges, F.col("id") == edges.source)
        if steps:
            place = F.row_number().over(Window.partitionBy(*key).orderBy("source", "target"))
            step = step.withColumn("place", place).filter(F.col("place") <= steps)
        step = step.select(*key, "side", F.col("target").alias("id"), (F.col("hop") + 1).alias("hop")).distinct()
        new = stage(step.join(seen, [*key, "side", "id"], "left_anti"), f"between-{hop}")
        if new.isEmpty():
            break
        met = met.union(stage(_hits(new, other), f"between-met-{hop}"))
        still = front.join(turn.select(*key, (1 - F.col("side")).alias("side")), [*key, "side"], "left_semi")
        seen, front = seen.union(new), new.union(still)
    return met, seen, edges


def _hits(new: DataFrame, other: DataFrame) -> DataFrame:
    """(start, end, id, hop, depth) of new nodes that the other end has seen."""
    hop = F.when(F.col("side") == 0, F.col("hop")).otherwise(F.col("far")).alias("hop")
    return new.join(other, ["start", "end", "side", "id"]).select("start", "end", "id", hop, (F.col("hop") + F.col("far")).alias("depth"))


def _last_steps(front: DataFrame, turn: DataFrame, other: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, end, side, id, hop): steps of the last round that the other end may have seen, all true ones among them.

    A Bloom filter of what the other end has seen, ``WORDS`` words a pair, travels with the front, so
    most steps end in the join that makes them. A pair in turn has not met, so none of the nodes
    that both ends share was seen from its own.
    """
    key = ["start", "end", "side"]
    word = lambda c: F.expr(f"xxhash64({c}) & {WORDS - 1}")
    bits = lambda c: F.expr(" | ".join(f"shiftleft(1L, cast(shiftright(xxhash64({c}), {n}) & 63 as int))" for n in (8, 14, 20)))
    marks = other.join(turn, key).groupBy(key).agg(*(F.bit_or(F.when(word("id") == w, bits("id")).otherwise(F.lit(0).cast("long"))).alias(f"_{w}") for w in range(WORDS)))
    kept = reduce(lambda case, w: case.when(word("target") == w, F.col(f"_{w}")), range(1, WORDS), F.when(word("target") == 0, F.col("_0")))
    steps = front.join(marks, key).join(edges, F.col("id") == edges.source).filter(kept.bitwiseAND(bits("target")) == bits("target"))
    return steps.select(*key, F.col("target").alias("id"), (F.col("hop") + 1).alias("hop")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree)."""
    ends = edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(
        edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def neighbours(edges: DataFrame, share: int) -> DataFrame:
    """(id, other, relation, direction): both directions, ``share`` of each node, relation and direction."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "relation", F.lit("out").alias("direction"))
    in_ = edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "relation", F.lit("in").alias("direction"))
    rows = out.union(in_).distinct()
    place = F.row_number().over(Window.partitionBy("id", "relation", "direction").orderBy("other"))
    return rows.withColumn("place", place).filter(F.col("place") <= share).drop("place")


def overview(ids: DataFrame) -> DataFrame:
    """(id, parent, depth, members) of every directory above the ids: all are one explode away, so no recursion."""
    dirs = ids.select(F.explode(ancestors(F.col("id"))).alias("id"))
    dirs = dirs.groupBy("id").agg(F.count(F.lit(1)).alias("members"))
    above = ancestors(F.col("id"))
    return dirs.select("id", F.when(F.size(above) > 0, above[0]).alias("parent"), (F.size(above) + 1).alias("depth"), "members")


def impact(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(bucket, n): who depends on the seeds directly and indirectly, following edges backwards."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    hop = walk(back, seeds, hops).filter("hop > 0")
    return hop.groupBy(F.when(F.col("hop") == 1, "direct").otherwise("indirect").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by label propagation: the label most frequent among neighbours, the smallest on a tie.

    Counts are combined before the shuffle, so hubs cost no more than their edges. The
    number of rounds is fixed; labels may still move after it.
    """
    pairs = stage(both_ways(edges), "community-edges")
    labels = pairs.select(F.col("source").alias("id")).distinct().withColumn("label", F.col("id"))
    for n in range(rounds):
        votes = pairs.join(labels, pairs.target == labels.id).groupBy("source", "label").agg(F.count(F.lit(1)).alias("votes"))
        best = votes.groupBy("source").agg(F.min(F.struct((-F.col("votes")).alias("few"), "label")).alias("best"))
        before, labels = labels, stage(best.select(F.col("source").alias("id"), F.col("best.label").alias("label")), f"community-{n}")
        if n:
            discard(before)
    return labels.select("id", F.col("label").alias("community"))


def relative_degrees(edges: DataFrame, threshold: float) -> DataFrame:
    """(id, degree, size, labelled): the degree, its share of the greatest one, and whether that reaches ``threshold``."""
    both = degrees(edges).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    most = both.agg(F.max("degree").alias("most"))  # one row
    out = both.crossJoin(F.broadcast(most)).withColumn("size", F.col("degree") / F.col("most"))
    return out.select("id", "degree", "size", (F.col("size") >= threshold).alias("labelled"))


def hubs(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, hub, members) of communities of two at least: the member of greatest degree, the smallest id on a tie."""
    sized = members.join(relative_degrees(edges, 0.0).select("id", "degree"), "id")
    top = F.min(F.struct((-F.col("degree")).alias("few"), "id"))
    out = sized.groupBy("community").agg(top.alias("top"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    return out.select("community", F.col("top.id").alias("hub"), "members")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id) that no edge leads to."""
    return nodes.join(edges.select(F.col("target").alias("id")), "id", "left_anti")
