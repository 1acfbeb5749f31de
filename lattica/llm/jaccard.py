"""Similarity join on word shingles by T-occurrence search.

A shingle's inverted list holds the documents that have it. Two documents of n and m
shingles link only if they meet in T = ceil(0.8 max(n, m)) lists. As in DivideSkip, each
document sets its T - 1 longest lists aside: whoever links with it meets it in one of the
others, so only those short lists are shuffled and merged, and the long ones are probed for
the candidates alone. Lengths come from a counting sketch over all documents; they only order
the lists, so their errors cost time, never links. The sketch grows with the documents up to a
size that can be broadcast, and its counts are never cut: where many lists share a counter, a
long list still stands out from counters that are all about equally full.

Lists are searched in two turns, and in both all links come from ``search``: queries' short
lists are merged by a heap, the long ones probed by binary search, block by block. First
each list's most typical document is searched against the list. Lists whose documents are
connected then are done, which in groups of near copies are almost all. In the others every
pair of unconnected documents is searched: in lists of bounded length those pairs that meet
in enough of them, in longer lists all queries against all targets. No list is ever gathered
in one task, and a text travels once for each block, not once for each pair.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..session import discard, stage
from .batches import slices
from .shingles import mixed, shingle_sets

#: The sketch has a counter for the upper bits of a shingle, from 16 to 18 of them; its list is named by the lower 46.
LEAST_BITS, MOST_BITS = 16, 18
NAME_BITS = np.uint64(64 - MOST_BITS)
NAME = np.uint64(2 ** (64 - MOST_BITS) - 1)
#: Counters for each document, as far as there is room.
COUNTERS = 16
#: Lists longer than this are searched in blocks of their own, of so many queries (and their shingles) and targets.
LONG, QUERIES, SHINGLES, TARGETS = 64, 512, 1 << 20, 1024
#: Sizes whose logarithms to this base are more than one apart are too different to link.
BAND = 1.25 + 1e-7
#: Bits of a set's signature.
BITS = 4096
#: What probing a long list costs beside merging it.
MU = 0.0085


def sketch_bits(documents: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (COUNTERS * documents).bit_length()))


def _slots(shingles: np.ndarray, size: int) -> np.ndarray:
    """The counter of each shingle in a sketch of ``size``, a power of two."""
    return (shingles >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, d1, d2) of every document; and, with id null and n -1, (slots, counts) of every task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        names = ["id", "n", "d1", "d2", "slots", "counts"]
        ints, lists = pa.int64(), pa.list_(pa.int64())
        for rows, texts in slices(batches, 1):
            doc, found = shingle_sets(texts)
            np.add.at(total, _slots(found, size), 1)
            n = np.bincount(doc, minlength=len(texts))
            d1, d2 = np.zeros(len(texts), dtype=np.uint64), np.zeros(len(texts), dtype=np.uint64)
            if len(doc):
                some = n > 0
                at = (np.cumsum(n) - n)[some]
                d1[some] = np.add.reduceat(mixed(found ^ np.uint64(0x5851F42D4C957F2D)), at)
                d2[some] = np.bitwise_xor.reduceat(mixed(found), at)
            none = pa.nulls(len(texts), lists)
            digests = (pa.array(d.view(np.int64)) for d in (d1, d2))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, ints), *digests, none, none], names)
        at = np.flatnonzero(total)
        row = [pa.array(x, t) for x, t in (([None], ints), ([-1], ints), ([0], ints), ([0], ints), ([at], lists), ([total[at]], lists))]
        yield pa.RecordBatch.from_arrays([row[0].cast(docs_type), *row[1:]], names)

    kind = docs.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    docs_type = to_arrow_type(kind)
    return docs.mapInArrow(run, f"id {kind.simpleString()}, n long, d1 long, d2 long, slots array<long>, counts array<long>")


def _short_lists(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(id, n, typical, last, lists): each document's lists without the T - 1 longest ones, and the place of the longest left in the order of all lists.

    The order is that of the counters, whatever their size: a key has the place of the list's
    counter among all different counts, then the list's name.
    """
    shared = docs.sparkSession.sparkContext.broadcast((sketch, np.unique(sketch, return_inverse=True)[1].astype(np.uint64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, places = shared.value
        for rows, texts in slices(batches, 1):
            doc, found = shingle_sets(texts)
            slot = _slots(found, len(sketch))
            length = sketch[slot]
            n = np.bincount(doc, minlength=len(texts))
            first = np.cumsum(n) - n
            typical = np.bincount(doc, np.log2(length), len(texts)) / np.maximum(n, 1)
            key = places[slot] << NAME_BITS | found & NAME
            for a, b in zip(first, first + n, strict=True):
                key[a:b].sort()
            kept = np.arange(len(doc)) - first[doc] < (n - (4 * n + 4) // 5 + 1)[doc]
            names = (key[kept] & NAME).astype(np.int64)
            stops = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=len(texts)))])
            last = np.zeros(len(texts), dtype=np.int64)
            last[n > 0] = (key[kept][stops[1:][n > 0] - 1] ^ np.uint64(1 << 63)).view(np.int64)  # in the order of unsigned keys
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n, pa.int32()), pa.array((typical * 256).astype(np.int32)), pa.array(last), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(names))],
                ["id", "n", "typical", "last", "lists"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n int, typical int, last long, lists array<long>")


def _merged(lists: list[list[int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(targets in ``least`` of the sorted lists or more, in how many), by a heap of the lists' heads."""
    hit, count = [], []
    for target, run in groupby(heapq.merge(*lists)):
        n = len(list(run))
        if n >= least:
            hit.append(target)
            count.append(n)
    return np.array(hit, dtype=np.int64), np.array(count, dtype=np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BITS`` bits a set: each says whether an odd number of the set's shingles fall on it."""
    out = np.empty((len(sets), BITS // 8), dtype=np.uint8)
    for i, shingles in enumerate(sets):
        out[i] = np.packbits(np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1)
    return out.view(np.uint64)


def _near(query: np.ndarray, n: int, signs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Targets that a query may link with: like sizes, and signatures that differ in few bits.

    Sets that link differ in a ninth of their sizes' sum at most, and no signatures differ in
    more bits than their sets in shingles, so no link is lost.
    """
    some = np.flatnonzero(100 * np.minimum(sizes, n) >= 80 * np.maximum(sizes, n))
    bits = np.bitwise_count(signs[some] ^ query).sum(axis=1, dtype=np.int64)
    return some[9 * bits <= sizes[some] + n]


def search(queries: list[np.ndarray], targets: list[np.ndarray], asked: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(query, targets that link with it), by DivideSkip over the inverted lists of ``targets``.

    A query needs T targets' shingles in common. Its L longest lists are set aside, L by the
    usual rule T / (MU log2 M + 1) for a longest list of M; the others are merged by a heap,
    and who is in T - L of them is looked up in the long ones by binary search. Targets whose
    signatures rule out any link are in no list, queries without another target are not merged.
    """
    asked = signatures(queries) if asked is None else asked
    signs, sizes = signatures(targets), np.array([len(t) for t in targets], dtype=np.int64)
    near = [_near(asked[q], len(x), signs, sizes) for q, x in enumerate(queries)]
    places = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *near]))
    targets, sizes = [targets[i] for i in places], sizes[places]
    flat = np.concatenate([np.empty(0, dtype=np.uint64), *targets])
    owner = np.repeat(np.arange(len(targets)), sizes)
    order = np.argsort(flat, kind="stable")  # so every list is sorted by target
    flat, owner = flat[order], owner[order]
    for q, shingles in enumerate(queries):
        n = len(shingles)
        if not n or not len(near[q]):
            continue
        start, stop = np.searchsorted(flat, shingles, "left"), np.searchsorted(flat, shingles, "right")
        length = stop - start
        need = (4 * n + 4) // 5
        if np.count_nonzero(length) < need:
            continue
        by = np.argsort(length, kind="stable")
        aside = min(need - 1, int(need / (MU * np.log2(length[by[-1]] + 1) + 1)))
        short, long_ = by[: n - aside], by[n - aside :]
        hit, count = _merged([owner[start[i] : stop[i]].tolist() for i in short if length[i]], need - aside)
        some = 100 * np.minimum(sizes[hit], n) >= 80 * np.maximum(sizes[hit], n)
        hit, count = hit[some], count[some]
        for i in long_:
            if not len(hit):
                break
            own = owner[start[i] : stop[i]]
            if len(own):
                count = count + (own[np.minimum(np.searchsorted(own, hit), len(own) - 1)] == hit)
        yield q, places[hit[100 * count >= 80 * (sizes[hit] + n - count)]]


def _searched(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) in blocks of (key, part, query, id, component): the queries of each against its other rows.

    A block's rows come sorted, queries first; they are all that a task keeps, and targets
    stream past them in slices of bounded text. One link between two components is enough.
    """
    check = F.hash("id").alias("check")
    rows = blocks.select("*", check).join(texts.select("id", "text", check), ["id", "check"])
    rows = rows.select("key", "part", "query", "id", "component", "text").repartition("key", "part").sortWithinPartitions("key", "part", F.desc("query"))
    kind = texts.schema["id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, asks, names, seen, asked = None, [], [], set(), None
        for rows, found_texts in slices(batches, 5):
            keys = list(zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True))
            ids, component = rows.column(3).to_pylist(), rows.column(4).to_pylist()
            doc, found = shingle_sets(found_texts)
            stops = np.searchsorted(doc, np.arange(len(keys) + 1))
            sets = [found[a:b] for a, b in zip(stops, stops[1:], strict=False)]
            out, at = [], 0
            for key, run_ in groupby(keys):
                to = at + sum(1 for _ in run_)
                if key[:2] != last:
                    last, asks, names, seen, asked = key[:2], [], [], set(), None
                if key[2]:
                    asks, asked = asks + sets[at:to], None
                    names += zip(component[at:to], ids[at:to], strict=True)
                else:
                    asked = signatures(asks) if asked is None else asked
                    for q, hits in search(asks, sets[at:to], asked):
                        for i in (hits + at).tolist():
                            pair = names[q][0], component[i]
                            if pair[0] != pair[1] and pair not in seen:
                                seen.add(pair)
                                out.append((names[q][1], ids[i]))
                at = to
            ends = [pa.array([x[i] for x in out], rows.schema.field(3).type) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return rows.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's leader and the members of like size."""
    alike = (F.col("id") != F.col("leader")) & (100 * F.least("n", "leader_n") >= 80 * F.greatest("n", "leader_n"))
    return members.filter(alike).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()


def _of_pairs(pairs: DataFrame) -> DataFrame:
    """Blocks of each ``a`` against its ``b``."""
    check = F.hash("a").alias("check")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TARGETS).alias("parts")).select("a", "parts", check)
    targets = pairs.select("a", "b", check).join(parts, ["a", "check"])
    targets = targets.select(F.col("a").alias("key"), F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(False).alias("query"), F.col("b").alias("id"))
    queries = parts.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("query"), F.col("a").alias("id"))
    return queries.unionByName(targets).withColumn("component", F.col("id"))


def _of_lists(members: DataFrame) -> DataFrame:
    """Blocks of long lists; members: list, id, n, component, query. Both sides are dealt by what they weigh.

    A query is in the band of its size, a target in that and the next ones, so sizes that can't link seldom meet.
    """
    band = F.floor(F.log("n") / F.log(F.lit(BAND)))
    asks = members.filter("query").withColumn("band", band)
    gives = members.withColumns({"query": F.lit(False), "band": F.explode(F.sequence(band - 1, band + 1))})
    members = asks.unionByName(gives).withColumn("list", F.xxhash64("list", "band")).drop("band")
    weight = lambda rows: F.greatest(F.sum(F.when(rows, F.col("n"))) / SHINGLES, F.count_if(rows) / QUERIES)
    parts = members.groupBy("list").agg(F.ceil(weight(F.col("query"))).alias("q_parts"), F.ceil(F.count_if(~F.col("query")) / TARGETS).alias("t_parts"))
    rows = members.withColumn("check", F.hash("list")).join(parts.filter("q_parts > 0").withColumn("check", F.hash("list")), ["list", "check"])
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = (F.col("q") * F.col("t_parts") + F.col("t")).alias("part")
    asks = rows.filter("query").withColumn("q", part("q_parts")).withColumn("t", every("t_parts"))
    gives = rows.filter("not query").withColumn("t", part("t_parts")).withColumn("q", every("q_parts"))
    return asks.unionByName(gives).select(F.col("list").alias("key"), block, "query", "id", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id.

    Words are what white space leaves, A-Z in lower case. A document's set are its distinct
    5-word shingles; with fewer words the whole sequence; null and empty texts have none and
    link with nothing. Documents link when their sets' Jaccard similarity is 0.8 or more;
    component_id is the smallest id reachable by links, the own one included. Rows that
    repeat an id are one document that links where any of its texts does. Rows without an id
    link with nothing and have no component. Other columns are ignored, so none can clash;
    an empty table gives an empty one. Documents of equal sets are searched once.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = 1 << sketch_bits(named.count())
    seen = stage(_profiles(named, size), "profiles")
    counts = seen.filter("n = -1").select(F.explode(F.arrays_zip("slots", "counts")).alias("x"))
    counts = counts.groupBy("x.slots").agg(F.sum("x.counts").alias("n")).toArrow()  # ``size`` rows at most
    sketch = np.ones(size, dtype=np.int64)
    sketch[counts["slots"].to_numpy()] = counts["n"].to_numpy()

    profiles = seen.filter("n >= 0").select("id", "n", "d1", "d2")
    classes = profiles.filter("n > 0 and id is not null").groupBy("n", "d1", "d2").agg(F.min("id").alias("first"))
    firsts = classes.select(F.col("first").alias("id")).distinct()
    lists = _short_lists(named.filter("id is not null"), sketch).filter("n > 0").join(firsts, "id", "left_semi")
    lists = stage(lists, "short-lists")
    entries = lists.select("id", "n", "typical", F.explode("lists").alias("list"))
    side = F.col("list").bitwiseAND(F.lit(1)).alias("check")  # makes both sides of the join shuffles that AQE can split
    leaders = (
        entries.groupBy("list")
        .agg(F.count(F.lit(1)).alias("length"), F.max(F.struct("typical", "id", "n")).alias("leader"))
        .filter("length > 1")
        .select("list", side, F.col("leader.id").alias("leader"), F.col("leader.n").alias("leader_n"))
    )
    members = entries.select("list", "id", "n", side).join(leaders, ["list", "check"]).drop("check")
    members = stage(members, "lists")

    searched = members.select("id").distinct()
    texts = stage(named.join(searched, "id", "left_semi"), "searched")
    pairs = stage(_stars(members), "star-pairs")
    links = stage(_searched(_of_pairs(pairs), texts), "star-links")
    discard(pairs)

    found = connected_components(links)
    joined = members.withColumn("check", F.hash("id")).join(
        found.select(F.col("node").alias("id"), "component", F.hash("node").alias("check")), ["id", "check"], "left"
    )
    joined = joined.select("list", "id", "n", F.coalesce("component", "id").alias("component"), F.col("id").eqNullSafe(F.col("leader")).alias("leads"))
    joined = stage(joined, "list-components")
    open_ = (
        joined.groupBy("list")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("leads"), F.col("component"))).alias("main"), F.count(F.lit(1)).alias("n_targets"))
        .filter("low != high")
        .select("list", "main", "n_targets", F.hash("list").alias("check"))
    )
    rows = joined.withColumn("check", F.hash("list")).join(open_, ["list", "check"]).drop("check")
    rows = stage(rows.withColumn("query", ~F.col("component").eqNullSafe(F.col("main"))), "open-lists")
    few = rows.filter(F.col("n_targets") <= LONG)
    q = few.filter("query and not leads").select("list", F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("component").alias("a_c"))
    t = few.filter("not leads").select("list", F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("component").alias("b_c"), F.col("query").alias("b_q"))
    pairs = q.join(t, "list").filter("a_c != b_c and 100 * least(a_n, b_n) >= 80 * greatest(a_n, b_n) and (not b_q or a < b)")
    # Of two documents, the one whose short lists end earlier meets the other in all that both have of them.
    ends = lists.groupBy("id").agg(F.max("last").alias("last"), F.count(F.lit(1)).alias("texts"))
    swap = F.col("a") > F.col("b")
    pairs = pairs.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("a_n", "b_n"), ("b_n", "a_n"))))
    met = pairs.groupBy("a", "b", "a_n", "b_n").agg(F.count(F.lit(1)).alias("met"))
    for x in ("a", "b"):
        met = met.join(ends.select(F.col("id").alias(x), F.col("last").alias(f"{x}_last"), F.col("texts").alias(f"{x}_texts")), x)
    need = F.expr("(4 * (a_n + b_n) + 8) div 9")
    aside = F.expr("(4 * if(a_last <= b_last, a_n, b_n) + 4) div 5 - 1")
    met = met.filter((F.col("met") >= need - aside) | (F.col("a_texts") > 1) | (F.col("b_texts") > 1))
    met = stage(met.select("a", "b").distinct(), "met")
    more = _searched(_of_pairs(met), texts)
    many = _searched(_of_lists(rows.filter(F.col("n_targets") > LONG)), texts)
    stars, links = links, stage(links.union(more).union(many), "links")
    discard(lists, members, texts, stars, joined, rows, met)

    keys = ["n", "d1", "d2"]
    # An id of several texts joins their classes, also where it is not searched itself.
    texts_of = profiles.filter("n > 0 and id is not null").select("id", *keys)
    several = texts_of.groupBy("id").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("id")
    bridges = texts_of.join(several, "id", "left_semi").distinct().join(classes, keys).select(F.col("first").alias("a"), F.col("id").alias("b"))
    found = connected_components(links.union(bridges)).select(F.col("node").alias("first"), "component", F.hash("node").alias("check"))
    own = profiles.withColumn("check", F.hash(*keys)).join(classes.withColumn("check", F.hash(*keys)), [*keys, "check"], "left").drop("check")
    own = own.withColumn("check", F.hash("first")).join(found, ["first", "check"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "first", "id"))
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
