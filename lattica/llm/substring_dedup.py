"""Substring dedup: suffix automata of reference passages, and documents streamed through them.

Every window of words has an anchor, the least hash of the short word runs in it, so equal
windows have equal anchors wherever they stand. Windows are compared under their anchor, and
only anchors of two or more documents count. The reference are the passages of the smallest
documents holding a window that others repeat; an anchor's reference is one shard, or several
of bounded size. Shards are too many to broadcast to all executors, as they grow with the
corpus: each is sent once to the task that streams the documents' segments of its anchor, and
hot anchors to several tasks. There an automaton of the passages gives, word by word, the
longest match and its smallest document.

Which windows repeat is counted by their hashes before, to keep the reference small: taken
whole, all segments of a hot anchor would have to run through automata of each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stage
from .batches import slices
from .shingles import Rolling, Words, window_starts, words_of

#: Words of the runs whose least hash is a window's anchor.
RUN = 10
#: Words of an anchor's passages that make one automaton, and segments that one task streams through it.
BLOCK, PART = 16_384, 512


class Automaton:
    """Suffix automaton of word sequences; every state knows the smallest owner of its words."""

    def __init__(self, passages: Iterable[tuple[int, list[str]]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]
        for owner, words in passages:
            last = 0
            for word in words:
                last = self._extended(last, word, owner)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self._own(self.link[state], self.owner[state])

    def _own(self, state: int, owner: int | None) -> None:
        if owner is not None and (self.owner[state] is None or owner < self.owner[state]):
            self.owner[state] = owner

    def _state(self, length: int, link: int, after: dict[str, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(None)
        return len(self.next) - 1

    def _split(self, state: int, word: str, target: int) -> int:
        """A copy of ``target`` for the shorter words that ``state`` leads to it with."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extended(self, last: int, word: str, owner: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            new = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
            self._own(new, owner)
            return new
        new = self._state(self.length[last] + 1, 0, {})
        self._own(new, owner)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def windows(self, words: list[str], width: int) -> list[tuple[int, int]]:
        """(end, smallest owner) of every window of ``width`` words that a passage has too."""
        after, link, length, owners = self.next, self.link, self.length, self.owner
        found: list[tuple[int, int]] = []
        state = match = end = 0
        for word in words:
            end += 1
            step = after[state].get(word)
            while step is None and state:
                state = link[state]
                match = length[state]
                step = after[state].get(word)
            if step is None:
                continue
            state, match = step, match + 1
            if match >= width:
                while length[link[state]] >= width:
                    state = link[state]
                    match = length[state]
                found.append((end, owners[state]))
        return found


def covered(windows: list[tuple[int, int]], owner: int, width: int) -> list[tuple[int, int]]:
    """Maximal spans of the words in windows that a smaller owner has too."""
    spans: list[tuple[int, int]] = []
    for end, first in windows:
        if first < owner:
            if spans and end - width <= spans[-1][1]:
                spans[-1] = spans[-1][0], end
            else:
                spans.append((end - width, end))
    return spans


def _anchors(words: Words, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of equal anchor: (document, anchor, first word of all, windows)."""
    sizes = words.sizes
    doc, start = window_starts(sizes, width)
    empty = np.empty(0, dtype=np.int64)
    if not len(doc):
        return empty, empty, empty, empty
    short = min(RUN, width)
    at = np.arange(len(words.hashes) - short + 1)
    least = Rolling(words.hashes)(at, short)
    over, span = width - short + 1, 1  # a window's anchor is the least of so many runs
    while span * 2 <= over:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    anchor = np.minimum(least[start], least[start + over - span]).view(np.int64)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    return doc[first], anchor[first], start[first], np.diff(np.append(first, len(doc)))


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _document_anchors(docs: DataFrame, width: int) -> DataFrame:
    """(id, anchors): the distinct anchors of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, 1):
            doc, anchor, _, _ = _anchors(words_of(texts), width)
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
            counts = np.bincount(doc[new], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([rows.column(0), _lists(counts, pa.array(anchor[new]))], ["id", "anchors"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, anchors array<long>")


def _segments(docs: DataFrame, width: int) -> DataFrame:
    """(anchor, id, row, start, words): the words of a document's windows of each of its ``anchors``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, 2):
            wanted = [np.sort(np.array(x)) for x in rows.column(3).to_pylist()]
            words = words_of(texts)
            doc, anchor, start, n = _anchors(words, width)
            begin = np.cumsum(words.sizes) - words.sizes
            stops = np.searchsorted(doc, np.arange(len(texts) + 1))
            parts = [np.isin(anchor[a:b], w) for a, b, w in zip(stops, stops[1:], wanted, strict=False)]
            keep = np.flatnonzero(np.concatenate(parts)) if parts else []
            at = doc[keep]
            segments = [words.run(s, k + width - 1) for s, k in zip(start[keep], n[keep], strict=True)]
            chosen = rows.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[keep], pa.int64()), chosen.column(0), chosen.column(1), pa.array(start[keep] - begin[at], pa.int64()), pa.array(segments, pa.string())],
                ["anchor", "id", "row", "start", "words"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "row", "text", "anchors").mapInArrow(run, f"anchor long, id {kind}, row long, start long, words string")


def _windows(segments: DataFrame, width: int) -> DataFrame:
    """(anchor, id, windows): hashes of the windows of every segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, 2):
            words = words_of(texts)
            doc, start = window_starts(words.sizes, width)
            found = Rolling(words.hashes)(start, width).view(np.int64)
            counts = np.bincount(doc, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], _lists(counts, pa.array(found))], ["anchor", "id", "windows"])

    kind = segments.schema["id"].dataType.simpleString()
    return segments.select("anchor", "id", "words").mapInArrow(run, f"anchor long, id {kind}, windows array<long>")


def _passages(owned: DataFrame, width: int) -> DataFrame:
    """(anchor, owner, words, n): maximal runs of the windows that a segment's document owns, of n words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, 2):
            words = words_of(texts)
            doc, start = window_starts(words.sizes, width)
            found = Rolling(words.hashes)(start, width).view(np.int64)
            stops = np.searchsorted(doc, np.arange(len(texts) + 1))
            at, passages, sizes = [], [], []
            ends, mine = rows.column(3).value_lengths().to_numpy().cumsum(), rows.column(3).flatten().to_numpy()
            for i in range(len(texts)):
                own = slice(stops[i], stops[i + 1])
                hit = start[own][np.isin(found[own], mine[ends[i - 1] if i else 0 : ends[i]])]
                for part in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                    if len(part):
                        at.append(i)
                        sizes.append(part[-1] - part[0] + width)
                        passages.append(words.run(part[0], sizes[-1]))
            chosen = rows.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1), pa.array(passages, pa.string()), pa.array(sizes, pa.int64())], ["anchor", "owner", "words", "n"])

    kind = owned.schema["id"].dataType.simpleString()
    return owned.select("anchor", "id", "words", "windows").mapInArrow(run, f"anchor long, owner {kind}, words string, n long")


def _dealt(segments: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages and segments of each (anchor, block, part), passages first.

    A block is a shard of an anchor's passages, of BLOCK words in the mean; a part takes some
    of its segments, PART in the mean. Most anchors have one of each. The others are few; Spark
    broadcasts their counts if their table is small, and else joins.
    """
    sizes = passages.groupBy("anchor").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    asks = segments.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    crowded = stage(sizes.join(asks, "anchor").filter("blocks > 1 or parts > 1"), "crowded-anchors")
    one = F.lit(1).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, one) - 1))
    mine = lambda n: F.pmod(F.xxhash64("words"), F.coalesce(n, one))
    rows = [
        segments.join(crowded, "anchor", "left").withColumn("part", mine("parts")).withColumn("block", every("blocks")).withColumn("segment", F.lit(True)),
        passages.join(crowded, "anchor", "left").withColumn("block", mine("blocks")).withColumn("part", every("parts"))
        .select("*", F.col("owner").alias("id"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("start"), F.lit(False).alias("segment")),
    ]
    columns = ["anchor", "block", "part", "segment", "words", "id", "row", "start"]
    both = rows[0].select(*columns).unionByName(rows[1].select(*columns))
    return both.repartition("anchor", "block", "part").sortWithinPartitions("anchor", "block", "part", "segment", "words")


def _streamed(rows: DataFrame, width: int) -> DataFrame:
    """(id, row, spans): what the automaton of each (anchor, block, part) finds in the segments behind it.

    Passages come first and become one automaton; segments stream through it one by one, and
    equal ones, which are neighbours, run through it once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, passages, shard, low, known = None, [], None, None, (None, [])
        for batch, words in slices(batches, 4):
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            segment, ids, rows, starts = (batch.column(i).to_pylist() for i in (3, 5, 6, 7))
            at, spans = [], []
            for i, key in enumerate(keys):
                if key != last:
                    last, passages, shard, known = key, [], None, (None, [])
                if not segment[i]:
                    passages.append((ids[i], words[i].split(" ")))
                    continue
                if not passages:
                    continue
                if shard is None:
                    shard, low = Automaton(passages), min(owner for owner, _ in passages)
                if low >= ids[i]:
                    continue
                if words[i] != known[0]:
                    known = words[i], shard.windows(words[i].split(" "), width)
                if found := covered(known[1], ids[i], width):
                    at.append(i)
                    spans.append([{"a": starts[i] + a, "b": starts[i] + b} for a, b in found])
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            chosen = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen.column(5), chosen.column(6), pa.array(spans, kind)], ["id", "row", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, row long, spans array<struct<a: long, b: long>>")


def _without(docs: DataFrame, out_schema: str) -> DataFrame:
    """(id, n_words, n_removed, kept): words outside all spans, joined by one space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, 1):
            n, gone, kept = [], [], []
            for text, spans in zip(texts, rows.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()  # of bytes: at the contract's white space alone
                n.append(len(words))
                if spans:
                    out, free = [], 0
                    for a, b in sorted((s["a"], s["b"]) for s in spans):
                        if a > free:
                            out += words[free:a]
                        free = max(free, b)
                    words = out + words[free:]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return docs.select("id", "text", "spans").mapInArrow(run, out_schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of ``width`` consecutive words covers it that a document with a
    smaller id has too; windows are judged on the input. Null text has no words. Rows that
    repeat an id are one document, so they take nothing from each other. Rows without an id
    are compared with nothing. Other columns are ignored, so none can clash; an empty table
    gives an empty one.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    anchors = _document_anchors(named.filter("id is not null"), width).select("id", F.explode("anchors").alias("anchor"))
    anchors = stage(anchors, "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high")
    shared = shared.select("anchor", F.hash("anchor").alias("check"))
    wanted = anchors.withColumn("check", F.hash("anchor")).join(shared, ["anchor", "check"]).groupBy("id").agg(F.collect_set("anchor").alias("anchors"))
    segments = stage(_segments(named.join(wanted, "id"), width), "segments")

    windows = _windows(segments, width).select("anchor", "id", F.explode("windows").alias("window"))
    owned = windows.groupBy("anchor", "window").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high")
    owned = owned.groupBy("anchor", F.col("low").alias("id")).agg(F.collect_list("window").alias("windows"))
    passages = _passages(segments.join(owned, ["anchor", "id"]), width)
    passages = stage(passages.groupBy("anchor", "words").agg(F.min("owner").alias("owner"), F.max("n").alias("n")), "passages")

    spans = _streamed(_dealt(segments, passages), width).select("id", "row", F.explode("spans").alias("span")).distinct()
    spans = stage(spans.groupBy("id", "row").agg(F.collect_list("span").alias("spans")), "spans")
    discard(anchors, segments, passages)
    kind = named.schema["id"].dataType.simpleString()
    out = _without(named.join(spans, ["id", "row"], "left"), f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
