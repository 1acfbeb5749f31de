"""Ranked lexical search by sort-based accumulation.

Texts are split once; of each document only its size and the counts of terms that some item
asks for are kept. A task then takes slices of these rows: for every count and every item
that asks for the term it makes one entry, a packed (item, document) key and the impact. A
radix sort brings equal keys together, ``reduceat`` sums them, and what can still enter an
item's top goes to its heap. A slice is a range of documents, so no document's sum is ever
split; tasks give their heaps, which are merged in two rounds.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.ranges import running
from ..session import discard, stage

#: A term in UTF-8: ASCII letters and digits, and all that is not ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text that are split at a time; entries of a slice; (item, term) pairs of a block of items.
PIECE, ENTRIES, PAIRS = 1 << 20, 1 << 21, 500_000
#: Heaps of an item that the first round merges in one place.
ROUND = 256


def term_counts(text: bytes) -> Counter[bytes]:
    """Terms of a whole text with A-Z in lower case, split piece by piece."""
    found: Counter[bytes] = Counter()
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + PIECE)
        stop = gap.start() if gap else len(text)
        found.update(TERM.findall(text[start:stop].lower()))
        start = stop
    return found


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned keys, 16 bits a pass from the lowest; numpy's stable sort of 16 bits is a radix sort."""
    order = np.arange(len(keys))
    top = int(keys.max()) if len(keys) else 0
    for shift in range(0, max(top.bit_length(), 1), 16):
        digit = (keys[order] >> np.uint64(shift)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def _asked(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term, times, block): the items' terms, in blocks of ``PAIRS`` pairs, or one larger item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = term_counts(batch.column(1)[row].as_py() or b"")
                names = pa.array(list(found), pa.binary())
                item = pa.array([batch.column(0)[row].as_py()] * len(found), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([item, names, pa.array(list(found.values()), pa.int64())], ["item", "term", "times"])

    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text"))
    pairs = rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, term binary, times long")
    pairs = stage(pairs.groupBy("item", "term").agg(F.sum("times").alias("times")), "item-terms")
    sizes = running(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("pairs")), ["item"], ["pairs"], "item-sizes")
    blocks = sizes.select(F.col("item").alias("of"), F.floor(F.col("pairs_before") / PAIRS).alias("block"))
    return stage(pairs.join(blocks, F.col("item").eqNullSafe(F.col("of"))).drop("of"), "item-blocks")


def _matched(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(id, n, terms, tfs): a document's terms with repeats, and which of the vocabulary it has how often."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                found = term_counts(text.as_py() or b"")
                both = found.keys() & place.keys()
                n.append(found.total())
                terms.append([place[t] for t in both])
                tfs.append([found[t] for t in both])
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, terms array<int>, tfs array<long>")


def lengths(n: Iterable[int], docs: int, terms: int) -> np.ndarray:
    """m of documents with ``n`` terms, in Python's integers, as n * N may pass 64 bits."""
    return np.array([25 + 75 * x * docs // terms for x in n], dtype=np.int64)


class Asked:
    """The items of a block by term: for each term which items ask for it, with what weight."""

    def __init__(self, vocabulary: int, term: np.ndarray, item: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.item, self.weight = item[order].astype(np.uint64), weight[order]
        self.count = np.bincount(term, minlength=vocabulary)
        self.start = np.cumsum(self.count) - self.count

    def sums(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) of all pairs that share a term, by item."""
        each = self.count[term]
        at = np.arange(int(each.sum())) + np.repeat(self.start[term] - (np.cumsum(each) - each), each)
        bits = np.uint64(int(doc.max(initial=0)).bit_length())
        keys = self.item[at] << bits | np.repeat(doc.astype(np.uint64), each)
        order = radix_order(keys)
        keys, values = keys[order], (self.weight[at] * np.repeat(impact, each))[order]
        new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        score = np.add.reduceat(values, new) if len(new) else values
        keys = keys[new]
        return (keys >> bits).astype(np.int64), (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), score


def _scored(matched: DataFrame, asked: Asked, items: list, kind: str, docs: int, terms: int, k: int) -> DataFrame:
    """(item, id, score, salt): each task's ``k`` best documents of every item."""
    shared = matched.sparkSession.sparkContext.broadcast((asked, items))
    item_type = to_arrow_type(matched.sparkSession.createDataFrame([], f"x {kind}").schema["x"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, items = shared.value
        heaps: dict[int, list] = {}
        least = np.ones(len(items), dtype=np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            term = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            if not len(term):
                continue
            m = lengths(batch.column(1).to_pylist(), docs, terms)
            stops = np.cumsum(sizes)
            entries = np.concatenate([[0], np.cumsum(asked.count[term])])[stops]
            row = 0
            while row < len(sizes):
                stop = max(row + 1, int(np.searchsorted(entries, (entries[row - 1] if row else 0) + ENTRIES, "right")))
                a, b = int(stops[row] - sizes[row]), int(stops[stop - 1])
                doc = np.repeat(np.arange(stop - row), sizes[row:stop])
                impact = 1_000_000_000 * tf[a:b] // (1000 * tf[a:b] + 8 * m[row + doc])
                item, own, score = asked.sums(doc, term[a:b], impact)
                good = score >= least[item]
                item, own, score = item[good], own[good], score[good]
                cuts = np.flatnonzero(np.diff(item, prepend=-1))
                for x, y in zip(cuts, [*cuts[1:], len(item)], strict=True):
                    ids = batch.column(0).take(pa.array(own[x:y] + row)).to_pylist()
                    new = ((-s, i is None, i) for s, i in zip(score[x:y].tolist(), ids, strict=True))
                    heap = heapq.nsmallest(k, [*heaps.get(int(item[x]), []), *new], key=lambda e: (e[0], e[1], 0 if e[1] else e[2]))
                    heaps[int(item[x])] = heap
                    if len(heap) == k:
                        least[item[x]] = max(1, -heap[-1][0])
                row = stop
        flat = [(items[i], e[2], -e[0]) for i, heap in heaps.items() for e in heap]
        if flat:
            salt = pa.array([TaskContext.get().partitionId() % ROUND] * len(flat), pa.int32())
            columns = [pa.array([x[i] for x in flat], t) for i, t in enumerate((item_type, id_type, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, salt], ["item", "id", "score", "salt"])

    return matched.mapInArrow(run, f"item {kind}, id {matched.schema['id'].dataType.simpleString()}, score long, salt int")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 10,
) -> DataFrame:
    """The ``k`` best documents of every item: item_col, rank (from 1), id_col, score.

    Terms are runs of letters, digits and whatever is not ASCII, A-Z in lower case; null texts
    have none. Weights, lengths and scores are the integers of BM25-like impacts as ``lengths``
    and the weight ``floor(1000 ln((2N+2)/(2df+1)))`` say, over all documents with terms. Only
    scores above 0 are returned; equal scores stand by ascending id, a null id last. Rows that
    repeat an id are documents of their own; rows that repeat an item are one item with all
    their terms, and null is an item too. Other columns are ignored, so none can clash; empty
    tables give an empty one.

    Items go in blocks of ``PAIRS`` (item, term) pairs, so what is sent to the tasks has a
    bound; each block reads the documents once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    pairs = _asked(items, item_col, item_text_col)
    kind = pairs.schema["item"].dataType.simpleString()
    found, totals = None, None
    for block in range((pairs.agg(F.max("block")).first()[0] or 0) + 1):
        own = pairs.filter(F.col("block") == block).select("item", "term", "times").toArrow()
        vocabulary = own["term"].unique().to_pylist()
        matched = stage(_matched(rows, vocabulary), "matched-terms")
        if totals is None:
            totals = matched.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, n_terms = totals
        df = matched.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()  # the vocabulary at most
        frequency = dict(zip(df["term"].tolist(), df["count"].tolist(), strict=True))
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency.get(i, 0) + 1))) for i in range(len(vocabulary))]
        place = {t: i for i, t in enumerate(vocabulary)}
        term = np.array([place[t] for t in own["term"].to_pylist()], dtype=np.int64)
        names = own["item"].combine_chunks().dictionary_encode(null_encoding="encode")
        weights = np.array(weight, dtype=np.int64)[term] * own["times"].to_numpy()
        asked = Asked(len(vocabulary), term, names.indices.to_numpy(), weights)
        best = _scored(matched, asked, names.dictionary.to_pylist(), kind, n_docs, n_terms, k)
        found = best if found is None else found.union(best)
    by = [F.desc("score"), F.col("id").asc_nulls_last()]
    for keys in (["item", "salt"], ["item"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    out = found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
    discard(pairs)
    return out
