"""A prefix trie over conversations, built level by level.

At each depth the live conversations, those that share their node with another one, are
grouped by (node, next turn); the smallest conversation of a group names the child. A
conversation that is alone at a node leaves the rounds: what follows of it is a chain of
nodes of its own, which one join emits. So there are as many rounds as the longest prefix
that two conversations share, and a long conversation costs no round. Then the levels are
joined in reverse, and each node gets the leaves and savings of its subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running
from ..session import discard, stage
from .text import whole

#: Ends of a node that are joined to one string at most.
ENDS = 4096


def numbered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((conv, pos, digest, bytes) of every turn, (conv, n) of every conversation).

    Positions count from 1 by turn, null first; rows of one turn stand by the digest of role
    and text, so repeated rows are turns of their own. Null roles and texts are empty; rows
    without an id are in no conversation. Positions come from key ranges, so a conversation
    that holds a third of all turns is dealt to many tasks.
    """
    role, text = whole(role_col), whole(text_col)
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one")
    )
    placed = stage(running(rows, ["conv", "turn", "digest"], ["one"], "turns").drop("turn", "one"), "turn-places")
    convs = stage(placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.min("one_before").alias("start")), "conversations")
    check = F.hash("conv").alias("check")
    by_place = placed.select("*", check).join(convs.select("conv", "start", check), ["conv", "check"])
    return by_place.select("conv", (F.col("one_before") - F.col("start") + 1).alias("pos"), "digest", "bytes"), convs.select("conv", "n")


def respliced(turns: DataFrame, convs: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``heads`` turns of another one and go on with their own.

    ``base`` and ``heads`` are expressions of ``conv``, ``heads`` being ``most`` at most. A base
    that is absent gives no turns, one with fewer turns gives all. Returns what ``numbered`` returns.
    """
    known = convs.withColumns({"base": base, "h": heads})
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    known = known.join(bases, "base", "left").withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0))))
    known = stage(known.withColumn("size", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "splices")
    turns = stage(turns, "turns")
    check = F.hash("conv").alias("check")
    own = turns.select("*", check).join(known.select("conv", "h", "lead", check), ["conv", "check"]).filter("pos > h")
    own = own.select("conv", (F.col("lead") + F.col("pos") - F.col("h")).alias("pos"), "digest", "bytes")
    first = turns.filter(F.col("pos") <= most).withColumnRenamed("conv", "base")  # ``most`` rows of a base
    lent = known.select("conv", "base", "h").join(first, "base").filter("pos <= h").select("conv", "pos", "digest", "bytes")
    return own.unionByName(lent), known.select("conv", F.col("size").alias("n"))


def _chained(ends: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256): the hash over a node's ends, joined by commas in ascending order.

    Ends are joined to strings of ``ENDS`` at most, by ranges; a node's strings then stream
    through one hash, so that no row and no task ever holds all ends of a node.
    """
    order = ["depth", "node", "conv"]
    placed = running(ends.withColumn("one", F.lit(1).cast("long")), order, ["one"], "ends")
    parts = placed.groupBy("depth", "node", F.floor(F.col("one_before") / ENDS).alias("part"))
    parts = parts.agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    parts = parts.repartition("depth", "node").sortWithinPartitions("depth", "node", "part")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, sha = ["depth", "conv_id", "ends_sha256"], None, None
        for batch in batches:
            out = []
            for depth, node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (depth, node) == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = (depth, node), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], names)

    return parts.mapInArrow(run, "depth long, conv_id long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` (conv, pos, digest, bytes) and ``convs`` (conv, n) as ``numbered`` gives them; a
    conversation may have no turns, it ends at the root. A node is named by its depth and its
    smallest member; the root has depth 0 and no parent. n_leaves counts childless nodes of the
    subtree, saved_tokens sums (n_convs - 1) times the bytes of a node's last text over it, and
    ends_sha256 is the hash of the members that end at the node. Without conversations there
    are no nodes, not even the root. Many conversations at one node cost no task more than its
    share: counts are combined map-side, and names are joined back by keys that AQE can split.
    """
    ranged = stage(turns.repartitionByRange("pos", "conv").sortWithinPartitions("pos", "conv"), "sequences")
    top, members = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    live = stage(convs.withColumn("node", F.lit(top).cast("long")), "level-0")
    levels: list[DataFrame] = [live]
    while True:
        depth = len(levels)
        step = live.filter(F.col("n") >= depth).join(ranged.filter(F.col("pos") == depth).drop("pos"), "conv")
        check = F.hash("node", "digest").alias("check")
        groups = step.groupBy("node", "digest").agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("convs"))
        step = step.select("*", check).join(groups.select("*", check), ["node", "digest", "check"])
        step = stage(step.select("conv", "n", F.col("node").alias("parent"), F.col("first").alias("node"), "convs", "bytes"), f"level-{depth}")
        levels.append(step)
        live = step.filter(F.col("convs") > 1).select("conv", "n", "node")
        if live.filter(F.col("n") > depth).isEmpty():
            break

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    none = F.lit(0).cast("long")
    below, nodes = None, []
    for depth in range(len(levels) - 1, -1, -1):
        if depth:
            own = levels[depth].filter("conv = node").select("node", "parent", "convs", "bytes", ((F.col("convs") == 1) & (F.col("n") > depth)).cast("long").alias("next"))
        else:
            own = convs.sparkSession.createDataFrame([(top, None, members, 0, 0)] * bool(members), "node long, parent long, convs long, bytes long, next long")
        if below is None:
            own = own.withColumns({"children": F.lit(None).cast("long"), "leaves": F.lit(None).cast("long"), "saved": F.lit(None).cast("long")})
        else:
            up = below.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            own = own.join(up, "node", "left")
        below = own.select(
            F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("convs").alias("n_convs"),
            F.coalesce("children", "next").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            ((F.col("convs") - 1) * F.col("bytes") + F.coalesce("saved", none)).alias("saved_tokens"),
        )
        below = stage(below, f"nodes-{depth}")
        nodes.append(below)

    ends = levels[0].filter("n = 0").select(none.alias("depth"), "node", "conv")
    alone = None
    for depth, level in enumerate(levels[1:], 1):
        at = F.lit(depth).cast("long")
        ends = ends.union(level.filter((F.col("n") == depth)).select(at.alias("depth"), "node", "conv"))
        one = level.filter("convs = 1").select("conv", "n", at.alias("since"))
        alone = one if alone is None else alone.union(one)
    check = F.hash("conv").alias("check")
    chain = ranged.select("conv", "pos", check).join(alone.select("*", check), ["conv", "check"]).filter("pos > since")
    last = F.col("pos") == F.col("n")
    chain = chain.select(
        F.col("conv").alias("conv_id"), F.col("pos").cast("long").alias("depth"), F.col("conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, none).otherwise(F.lit(1).cast("long")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), none.alias("saved_tokens"),
        F.sha2(F.when(last, F.col("conv").cast("string")).otherwise("").cast("binary"), 256).alias("ends_sha256"),
    )
    tops = nodes[0]
    for more in nodes[1:]:
        tops = tops.union(more)
    tops = tops.join(_chained(ends), ["depth", "conv_id"], "left")
    tops = tops.select(*columns, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    out = stage(tops.union(chain), "trie")
    discard(ranged, *levels, *nodes)
    return out
