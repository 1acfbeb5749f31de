"""From search hits to a packet: neighbours over one or two hops, caps a hit and tier, budget, then the links between what was kept."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .packets import IMPORTS, assembled, cap, tier

# Neighbours read of a node, hops at most, the share of the budget that is kept for links.
NEIGHBOURS, HOPS, RESERVE = 40, 2, 8
#: Hops that a tier follows.
ONE_HOP = {"caller": 1, "callee": 1, "test": 1, "import": 1, "defines": 1}


def neighbours(frontier: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Up to ``NEIGHBOURS`` nodes that the edges of each frontier node (packet, seed, project, of, via) reach.

    Described nodes come first, then by relation and id. A node that many edges meet is cut
    before its rows are shuffled (a rank with a limit).
    """
    ends = {"out": ("source", "target"), "in": ("target", "source")}
    each = [frontier.join(edges.select("project", F.col(a).alias("of"), F.col(b).alias("id"), "relation"), ["project", "of"]).withColumn("direction", F.lit(d)) for d, (a, b) in ends.items()]
    rows = each[0].unionByName(each[1]).distinct().join(nodes.select("project", "id", "type", "file_path", "test", "described"), ["project", "id"])
    rows = rows.filter(~F.startswith("type", F.lit("external_")))
    place = F.row_number().over(Window.partitionBy("packet", "project", "of").orderBy(F.desc("described"), "relation", "id", F.desc("direction")))
    return rows.withColumn("rank", place).filter(F.col("rank") <= NEIGHBOURS)


def around(hits: DataFrame, edges: DataFrame, nodes: DataFrame, hops: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """What stands around the hits of each packet, and the links by which it was reached.

    ``hits`` has packet, seed (rank from 0), project, id; ``edges`` project, source, target,
    relation; ``nodes`` project, id, type, file_path, test, described. Rows are taken in the order
    of project, node and rank: one whose tier is spent for its node is left out, one that leads
    to a node of the packet is a link only. A second hop stays in the tier of the first. Folders
    that contain a hit are left out. A repeated hit counts with its best rank, repeated edges once;
    hits and edges with nulls, and nodes that ``nodes`` lacks, are in no packet.

    Returns (packet, hop, seed, tier, place, project, id) and (packet, hop, project, of, rank,
    relation, id, direction). A packet's rows are bounded by ``NEIGHBOURS`` for each node of the
    frontier and its frontier by the caps, so one task can choose among them.
    """
    hops = ONE_HOP if hops is None else hops
    hits = _single(hits)
    places = ("packet", "hop", "seed", "tier", "place", "project", "id")
    frontier = hits.select("packet", "seed", "project", F.col("id").alias("of"), F.lit(None).cast("string").alias("via"))
    known = hits.select("packet", "project", "id")
    found, links = [], []
    for hop in range(1, min(HOPS, max(hops.values())) + 1):
        rows = neighbours(frontier, edges, nodes).withColumn("tier", tier(F.col("relation"), F.col("direction"), F.col("file_path"), F.coalesce("test", F.lit(False))))
        follows = F.element_at(F.create_map(F.lit("container"), F.lit(1), *(F.lit(x) for pair in hops.items() for x in pair)), F.col("tier"))
        rows = rows.filter(~((F.col("tier") == "container") & (F.col("type") == "directory")) & (follows >= hop) & (F.col("via").isNull() | (F.col("via") == F.col("tier"))))
        rows = rows.withColumn("importer", (F.col("tier") == "caller") & (F.col("direction") == "in") & F.col("relation").isin(*IMPORTS))
        rows = rows.withColumn("most", cap(F.col("tier"), F.col("seed"), F.col("importer")))
        chosen = stage(_chosen(rows, known).withColumn("hop", F.lit(hop)), f"around-{hop}")
        links.append(chosen.select("packet", "hop", "project", "of", "rank", "relation", "id", "direction"))
        found.append(chosen.filter("taken").withColumn("place", F.col("place").cast("long")).select(*places, follows.alias("follows")))
        frontier = found[-1].filter(F.col("follows") > hop).select("packet", "seed", "project", F.col("id").alias("of"), F.col("tier").alias("via"))
        known = known.union(found[-1].select("packet", "project", "id"))
    both = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return both([f.drop("follows") for f in found]), both(links)


def _single(hits: DataFrame) -> DataFrame:
    return hits.dropna(subset=["packet", "project", "id"]).groupBy("packet", "project", "id").agg(F.min("seed").alias("seed"))


def _chosen(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows that their caps let through, with place and whether they bring a new node."""
    columns = ["packet", "seed", "project", "of", "rank", "relation", "id", "direction", "tier", "importer", "most"]
    rows = rows.select(*columns)
    before = known.select("packet", F.lit(0).alias("seed"), "project", F.col("id").alias("of"), F.lit(0).alias("rank"), F.lit("").alias("relation"), "id", *(F.lit("").alias(c) for c in ("direction", "tier")), F.lit(False).alias("importer"), F.lit(0).alias("most"))
    both = before.unionByName(rows)
    schema = T.StructType([*both.schema.fields, T.StructField("place", T.IntegerType()), T.StructField("taken", T.BooleanType())])

    def choose(packet: pd.DataFrame) -> pd.DataFrame:
        held = packet["rank"] == 0
        taken = set(zip(packet.loc[held, "project"], packet.loc[held, "id"], strict=True))
        asked = packet.loc[~held].sort_values(["project", "of", "rank"])
        spent: dict[tuple, int] = {}
        kept, place, new = [], [], []
        for at, (project, of, kind, importer, most, node) in enumerate(zip(*(asked[c] for c in ("project", "of", "tier", "importer", "most", "id")), strict=True)):
            group = project, of, kind, importer
            n = spent.get(group, 0)
            if n >= most:
                continue
            kept.append(at)
            place.append(n)
            new.append((project, node) not in taken)
            if new[-1]:
                taken.add((project, node))
                spent[group] = n + 1
        return asked.iloc[kept].assign(place=pd.Series(place, dtype="int32").values, taken=pd.Series(new, dtype="bool").values)

    return both.groupBy("packet").applyInPandas(choose, schema)


def packet(hits: DataFrame, edges: DataFrame, nodes: DataFrame, budget: int, hops: dict[str, int] | None = None, chunks: bool = True) -> tuple[DataFrame, DataFrame]:
    """Whole packets within ``budget`` tokens: entries, then the links between them from what is left.

    ``nodes`` has start_line, end_line, cost and chunk_cost (null: no source) beside what ``around``
    reads. An eighth of the budget is kept for links; those that contain come last, and the first
    that does not fit ends them. Returns (packet, turn, project, id, tier, chunk, cut) and
    (packet, project, of, relation, id, direction).
    """
    found, links = around(hits, edges, nodes, hops)
    hits = _single(hits)
    own = hits.select("packet", F.lit(0).alias("seed"), F.lit("seed").alias("tier"), F.col("seed").cast("long").alias("place"), "project", "id")
    rows = own.unionByName(found.drop("hop")).join(nodes.select("project", "id", "file_path", "start_line", "end_line", "cost", "chunk_cost"), ["project", "id"])
    rows = rows.withColumn("node", F.struct("project", "id"))
    taken = assembled(rows.drop("id").withColumnRenamed("node", "id"), budget - budget // RESERVE, chunks)
    entries = stage(taken.select("packet", "turn", "id.project", "id.id", "tier", "chunk", "cut"), "packet-entries")

    costs = nodes.select("project", "id", "cost", "chunk_cost")
    used = entries.join(costs, ["project", "id"]).groupBy("packet").agg(F.sum(F.col("cost") + F.when(F.col("chunk"), F.col("chunk_cost")).otherwise(0)).alias("used"))
    end = lambda name: entries.select("packet", "project", F.col("id").alias(name))
    inside = links.join(end("of"), ["packet", "project", "of"], "left_semi").join(end("id"), ["packet", "project", "id"], "left_semi").join(used, "packet")
    price = F.ceil(F.length(F.to_json(F.struct("project", F.col("of").alias("from"), "relation", F.col("id").alias("to"), "direction"))) / 4)
    order = Window.partitionBy("packet").orderBy((F.col("relation") == "contains"), "hop", "project", "of", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("spent", F.col("used") + F.sum(price).over(order)).filter(F.col("spent") <= budget)
    return entries, inside.select("packet", "project", "of", "relation", "id", "direction")
