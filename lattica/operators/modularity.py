"""Communities by modularity: distributed local moving, contraction level by level, and a second pass.

All tables carry ``part``: each part is a graph of its own with its own total weight, so many
subgraphs are searched in one go. In a round every node weighs the communities of its
neighbours by the gain in modularity; half of the nodes, drawn by a hash of the round, may
move, so neighbours seldom move at once. The best labelling of the rounds is kept. Then
communities become nodes, links between them are summed, and the next level begins; levels
end when one brings no gain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stage
from .ranges import running

#: A level must gain this much to count.
GAIN = 1e-6
#: Links of a node that one task hears, about.
HEARD = 1 << 17


def weighted(edges: DataFrame) -> DataFrame:
    """(part, a, b, w) with a <= b, parallel edges summed; edges: source, target and perhaps part and w. Null ends are ignored."""
    rows = edges.filter("source is not null and target is not null")
    rows = rows if "w" in edges.columns else rows.withColumn("w", F.lit(1.0))
    rows = rows if "part" in edges.columns else rows.withColumn("part", F.lit(0).cast("long"))
    ends = F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    return rows.select("part", *ends, F.col("w").cast("double").alias("w")).groupBy("part", "a", "b").agg(F.sum("w").alias("w"))


def _degrees(edges: DataFrame) -> DataFrame:
    """(part, id, k, loop, ends): a loop counts twice in the degree (k); ends are its links, counted."""
    loop = F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0).alias("loop")
    ends = edges.select("part", F.col("a").alias("id"), "w", loop).union(edges.select("part", F.col("b").alias("id"), "w", F.lit(0.0)))
    return ends.groupBy("part", "id").agg(F.sum("w").alias("k"), F.sum("loop").alias("loop"), F.count(F.lit(1)).alias("ends"))


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(part, q): the modularity of a labelling (part, id, community) of the nodes of ``edges`` (as ``weighted`` gives them)."""
    label = lambda end: members.select("part", F.col("id").alias(end), F.col("community").alias(f"c{end}"))
    inside = edges.join(label("a"), ["part", "a"]).join(label("b"), ["part", "b"]).filter("ca = cb").groupBy("part").agg(F.sum("w").alias("inside"))
    sums = _degrees(edges).join(members, ["part", "id"]).groupBy("part", "community").agg(F.sum("k").alias("k"))
    sums = sums.groupBy("part").agg(F.sum("k").alias("m2"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    q = 2 * F.coalesce("inside", F.lit(0.0)) / F.col("m2") - resolution * F.col("squares") / (F.col("m2") * F.col("m2"))
    return sums.join(inside, "part", "left").select("part", q.alias("q"))


def _level(edges: DataFrame, rounds: int, seed: int, resolution: float) -> tuple[DataFrame, float, float]:
    """((part, id, community), modularity of single nodes, modularity found), summed over the parts.

    Links lie dealt by the end that speaks, with what is fixed of the other. In a round every node tells
    its community to its neighbours, and what a node hears meets by one shuffle; of links whose
    ends both wait, one way is told, as it counts for the modularity alone. What a hub hears is dealt over shards.
    """
    own = edges.filter("a != b")
    ways = own.select("part", F.col("a").alias("id"), F.col("b").alias("to"), "w").union(own.select("part", F.col("b").alias("id"), F.col("a").alias("to"), "w"))
    nodes = _degrees(edges)
    totals = edges.groupBy("part").agg((2 * F.sum("w")).alias("m2"))  # one row a part
    heard = F.ceil(F.col("ends") / HEARD).cast("int").alias("shards")
    nodes = stage(nodes.join(totals, "part").select("part", "id", "k", "loop", "m2", heard), "level-nodes")
    links = stage(ways.join(nodes.select("part", "id", "k", "shards"), ["part", "id"]), "level-links", ["part", "to"])
    state = nodes.withColumns({"label": F.col("id"), "tot": F.col("k"), "n": F.lit(1).cast("long")})
    loops = nodes.agg(F.sum(2 * F.col("loop") / F.col("m2"))).first()[0] or 0.0
    kept, first, most, idle = state, None, -1.0, 0
    tables = [nodes, links]
    nothing, m2 = F.lit(0.0), F.col("m2")
    for turn in range(rounds + 1):
        turns = lambda c, salt=f"{seed} {turn}": F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(2)) == 0  # noqa: E731  a text, as a number would compile anew in every round
        asked = links.filter(turns("id") | (~turns("to") & (F.col("to") < F.col("id"))))
        rate, alone = (resolution * F.col("tot") / m2).alias("rate"), (F.col("n") == 1).alias("alone")
        told = asked.join(state.select("part", F.col("id").alias("to"), "label", rate, alone).hint("shuffle_hash"), ["part", "to"])
        inside = F.when(turns("id") & turns("to"), F.col("w")).otherwise(2 * F.col("w")).alias("inside")
        shard = F.pmod(F.hash("label"), F.col("shards")).alias("shard")
        told = told.select("id", "part", shard, "label", "w", inside, F.lit(False).alias("stays"), "k", "rate", "alone", nothing.alias("weight"), nothing.alias("square"))
        without = (resolution * (F.col("tot") - F.col("k")) / m2).alias("rate")  # the least of its community's rates
        kept_by = state.select("id", "part", shard, "label", nothing.alias("w"), nothing.alias("inside"), F.lit(True).alias("stays"), "k", without, alone, (1 / m2).alias("weight"), (resolution * F.col("k") * F.col("tot") / (m2 * m2)).alias("square"))
        rows = told.union(kept_by).repartition("id", "part", "shard").groupBy("id", "part", "shard", "label").agg(
            *(F.sum(c).alias(c) for c in ("w", "inside", "weight", "square")), F.bool_or("stays").alias("stays"), F.max("k").alias("k"), F.min("rate").alias("rate"), F.bool_or("alone").alias("alone")
        )
        gain, stays = F.rint(1e9 * (F.col("w") - F.col("k") * F.col("rate"))) / 1e9, F.col("stays")
        # Ties: stay, else a community of several, else the smallest label.
        order = F.struct((-gain).alias("less"), (~stays).alias("goes"), "alone", "label")
        best = rows.groupBy("id", "part").agg(F.min(order).alias("to"), F.max(F.when(stays, F.struct(gain.alias("gain"), "alone", "label", "inside", "weight", "square"))).alias("was"))
        best = best.select("part", "id", "to", "was.*")
        swap = F.col("to.alone") & F.col("alone") & (F.col("to.label") > F.col("label"))  # of two single nodes only the larger joins the smaller
        moves = turns("id") & ~swap & (-F.col("to.less") > F.col("gain") + 1e-9)
        after = best.select("part", "id", "label", F.when(moves, F.col("to.label")).otherwise(F.col("label")).alias("next"), (F.col("inside") * F.col("weight") - F.col("square")).alias("q"))
        after = stage(after, f"moves-{turn}")
        tables.append(after)
        q, moved, n = after.agg(F.sum("q"), F.count_if(F.col("next") != F.col("label")), F.count(F.lit(1))).first()
        q = (q or 0.0) + loops
        first = q if first is None else first
        if q > most:
            kept, most = after, q
        idle = idle + 1 if 1000 * (moved or 0) <= (n or 0) else 0
        if idle == 2 or turn == rounds:  # both halves stay, but for one node in a thousand
            break
        state = _state(after.select("part", "id", F.col("next").alias("label")), nodes, f"state-{turn}")
        tables.append(state)
    out = stage(kept.select("part", "id", F.col("label").alias("community")), "level-communities")
    discard(*tables)
    return out, first, most


def _state(now: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` with the label each has ``now``, and that community's total (tot) and number of nodes (n)."""
    rows = nodes.join(now, ["part", "id"])
    sums = rows.groupBy("part", "label").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("n"))
    check = F.hash("label").alias("check")  # a second key: a shuffle that AQE can split
    return stage(rows.select("*", check).join(sums.select("*", check), ["part", "label", "check"]).drop("check"), name)


def louvain(edges: DataFrame, rounds: int = 8, levels: int = 12, seed: int = 1, resolution: float = 1.0) -> DataFrame:
    """(part, id, community) of every node of an edge; a community is named by one of its nodes.

    ``edges`` as ``weighted`` gives them. Results are the same in every run. Tables of a level go
    when the next is written; an empty table gives an empty one.
    """
    members, at = None, stage(edges, "modularity-edges")
    for level in range(levels):
        found, before, after = _level(at, rounds, seed + level, resolution)
        if members is not None and after < before + GAIN:
            break
        if members is None:
            members = found
        else:
            up = found.select("part", F.col("id").alias("community"), F.col("community").alias("_up"))
            members = stage(members.join(up, ["part", "community"]).select("part", "id", F.col("_up").alias("community")), "members")
        name = lambda end, found=found: found.select("part", F.col("id").alias(end), F.col("community").alias(f"c{end}"))
        up = at.join(name("a"), ["part", "a"]).join(name("b"), ["part", "b"])
        up = up.groupBy("part", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))
        last, at = at, stage(up, f"contracted-{level}")
        discard(last)
    return members


def communities(nodes: DataFrame, edges: DataFrame, most: float = 0.25, least: int = 10, rounds: int = 8) -> DataFrame:
    """(id, community) of all ``nodes`` (id): a node without an edge is alone; a community is named by its smallest node.

    A community of more than ``most`` of all nodes, and of more than ``least``, is searched once more
    within itself; its own edges alone count there. Edges (source, target) have no direction; ends
    that are not in ``nodes`` count as nodes too. Null ids are ignored.
    """
    all_ = stage(weighted(edges), "graph-edges")
    ends = all_.select(F.col("a").alias("id")).union(all_.select(F.col("b").alias("id"))).distinct()
    ids = stage(nodes.select("id").filter("id is not null").distinct().union(ends).distinct(), "graph-nodes")
    loops_only = all_.filter("a != b")
    found = louvain(loops_only, rounds).select("id", "community")
    limit = max(least, int(ids.count() * most))
    large = stage(found.groupBy("community").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("community"), "graph-large")
    out = ids.join(found, "id", "left").select("id", F.coalesce("community", "id").alias("label"))
    if not large.isEmpty():
        inner = found.join(F.broadcast(large), "community")  # few: each holds more than a share of the nodes
        label = lambda end: inner.select(F.col("id").alias(end), F.col("community").alias(f"c{end}"))
        within = loops_only.join(label("a"), "a").join(label("b"), "b").filter("ca = cb").select(F.col("ca").alias("part"), "a", "b", "w")
        again = louvain(within, rounds).select("id", F.col("community").alias("finer"))
        out = out.join(again, "id", "left").select("id", F.coalesce("finer", "label").alias("label"))
    out = stage(out, "communities")
    names = out.groupBy("label").agg(F.min("id").alias("community"))
    return out.join(names, "label").select("id", "community")


def numbered(members: DataFrame) -> DataFrame:
    """(community, number, members) of a labelling (id, community): from 0, the largest first, then by the first id; by ranges, as communities may be many."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first"))
    placed = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.desc("members"), "first"], ["one"], "numbers")
    return placed.select("community", F.col("one_before").alias("number"), "members")
