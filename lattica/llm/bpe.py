"""Byte-level BPE encoding and decoding by the rank files of public tokenizers.

Texts are cut by the tokenizer's pattern. New pieces are merged together: pieces of one
length class form a padded matrix of ids, and in each round every row merges its leftmost
pair of least rank, found in a hash table of pairs, with all others of that rank that stand
clear of it, and closes the gaps. Rows that have no pair left leave the matrix.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import slices

#: Unicode's White_Space, which \s means to the tokenizer's library.
WHITE = "\t-\r \x85\xa0  -     　"
NONE = np.int64(2**62)
#: Cells of a padded matrix; a longer piece has one of its own.
CELLS = 4_000_000
#: Chunks, and characters of chunks, whose ids a task remembers.
REMEMBERED, REMEMBERED_CHARS = 400_000, 16_000_000


class Vocabulary:
    """Ranks, the bytes of every id, and a hash table of the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        pairs = [
            (ranks[t[:i]] << 32 | ranks[t[i:]], rank)
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        keys = np.array([k for k, _ in pairs], dtype=np.uint64)
        values = np.array([v for _, v in pairs], dtype=np.int64)
        # Ids of which a pair makes something of lower rank: such a merge may come before others of its own rank.
        self.sinks = np.zeros(size, dtype=bool)
        for half in (keys >> np.uint64(32), keys & np.uint64(2**32 - 1)):
            self.sinks[half[half.astype(np.int64) > values].astype(np.int64)] = True
        self.bits = max(4, int(len(pairs) * 2).bit_length())
        self.keys = np.full(1 << self.bits, 2**64 - 1, dtype=np.uint64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int64)
        at = self._slots(keys)
        while len(keys):  # in each turn one key of each free slot settles, the others move on
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, chosen = np.unique(np.where(free, at, -1), return_index=True)
            chosen = chosen[free[chosen]]
            self.keys[at[chosen]], self.values[at[chosen]] = keys[chosen], values[chosen]
            left = np.ones(len(keys), dtype=bool)
            left[chosen] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)})

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; NONE where there is none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(len(keys), NONE)
        at, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (there != np.uint64(2**64 - 1))
            open_, at = open_[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, where each piece's ids start, how many it has)."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pieces, their counts, their ids
        sizes = np.array([len(p) for p in pieces])
        classes = np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
        for c in np.unique(classes):
            rows = np.flatnonzero(classes == c)
            for part in range(0, len(rows), step := max(1, CELLS >> int(c))):
                self._merge_class(pieces, rows[part : part + step], found)
        starts, counts = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        at = 0
        for rows, n, ids in found:
            counts[rows] = n
            starts[rows] = at + np.cumsum(n) - n
            at += len(ids)
        return np.concatenate([np.empty(0, dtype=np.int64), *(x for _, _, x in found)]), starts, counts

    def _merge_class(self, pieces: list[bytes], rows: np.ndarray, found: list) -> None:
        sizes = np.array([len(pieces[i]) for i in rows])
        width = max(2, int(sizes.max(initial=0)))
        column = np.arange(width)
        filled = column < sizes[:, None]
        ids = np.zeros((len(rows), width), dtype=np.int64)
        ids[filled] = self.first[np.frombuffer(b"".join(pieces[i] for i in rows), dtype=np.uint8)]
        ranks = np.full((len(rows), width), NONE)
        pair = filled[:, 1:]
        ranks[:, :-1][pair] = self.pair_ranks(ids[:, :-1][pair], ids[:, 1:][pair])
        while len(rows):
            best = ranks.min(axis=1)
            over = best == NONE
            if over.any():
                found.append((rows[over], sizes[over], ids[over][np.arange(ids.shape[1]) < sizes[over][:, None]]))
                rows, sizes, best, ids, ranks = rows[~over], sizes[~over], best[~over], ids[~over], ranks[~over]
                if not len(rows):
                    return
            row, at = self._first_pairs(ranks == best[:, None], best)
            ids[row, at] = best[row]
            # The right halves go, and all behind them closes up.
            kept = np.arange(ids.shape[1]) < sizes[:, None]
            kept[row, at + 1] = False
            gone = np.bincount(row, minlength=len(rows))
            before = np.zeros(len(row), dtype=np.int64)  # merges of the same row to the left
            before[1:] = np.where(row[1:] == row[:-1], 1, 0)
            before = np.arange(len(row)) - np.maximum.accumulate(np.where(before == 0, np.arange(len(row)), 0))
            sizes = sizes - gone
            now = np.arange(max(2, int(sizes.max()))) < sizes[:, None]
            closed_ids, closed_ranks = np.zeros(now.shape, dtype=np.int64), np.full(now.shape, NONE)
            closed_ids[now], closed_ranks[now] = ids[kept], ranks[kept]
            ids, ranks, at = closed_ids, closed_ranks, at - before
            ranks[np.arange(len(rows)), sizes - 1] = NONE
            left = at > 0
            ranks[row[left], at[left] - 1] = self.pair_ranks(ids[row[left], at[left] - 1], ids[row[left], at[left]])
            right = at < sizes[row] - 1
            ranks[row[right], at[right]] = self.pair_ranks(ids[row[right], at[right]], ids[row[right], at[right] + 1])

    def _first_pairs(self, least: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the leftmost of each row's least pairs, and of all that do not overlap one to their left where that is the same.

        If no pair with the merged id ranks below it, a merge makes no pair as low as itself,
        so the next rounds would merge just these: a round does them at once.
        """
        row, at = np.nonzero(least)
        place = np.arange(len(row))
        first = np.ones(len(row), dtype=bool)
        first[1:] = row[1:] != row[:-1]
        new = first.copy()
        new[1:] |= at[1:] != at[:-1] + 1
        even = (place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0  # of overlapping ones every second
        chosen = np.where(self.sinks[best[row]], first, even)
        return row[chosen], at[chosen]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of consecutive runs of ``ids``, of ``counts`` ids each."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        all_ = self.blob[_ranges(self.starts[ids], lengths)].tobytes()
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [all_[a:b] for a, b in zip(stops, stops[1:], strict=False)]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


#: The encoder of this Python process, by vocabulary: the tasks after the first find its chunks.
_ENCODERS: dict[tuple[int, str], Encoder] = {}


class Encoder:
    """Texts to ids. Chunks between spaces repeat, so a chunk's ids are worked out once."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        explicit = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.pieces = regex.compile(explicit).findall
        # No piece of the pattern reaches over these chunks' ends.
        self.chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.ids = np.empty(0, dtype=np.int32)
        self.starts = np.empty(0, dtype=np.int64)
        self.counts = np.empty(0, dtype=np.int64)

    def _learn(self, chunks: list[str]) -> None:
        cut = [self.pieces(c) for c in chunks]
        number: dict[str, int] = {}
        flat = [number.setdefault(p, len(number)) for ps in cut for p in ps]
        merged, starts, sizes = self.vocabulary.merge([p.encode("utf-8", "surrogatepass") for p in number])
        flat_ = np.array(flat, dtype=np.int64)
        ids = merged[_ranges(starts[flat_], sizes[flat_])]
        per_chunk = np.array([len(ps) for ps in cut])
        owner = np.repeat(np.arange(len(chunks)), per_chunk)
        counts = np.bincount(owner, weights=sizes[flat_], minlength=len(chunks)).astype(np.int64)
        self.chars += sum(map(len, chunks))
        self.place.update(zip(chunks, range(len(self.place), len(self.place) + len(chunks)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        chunks = [self.chunks(t) for t in texts]
        if new := list(set().union(*chunks).difference(self.place)):
            if len(self.place) > REMEMBERED or self.chars > REMEMBERED_CHARS:
                self._forget()
                new = list(set().union(*chunks))
            self._learn(new)
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(chunks)), dtype=np.int64, count=int(sizes.sum()))
        counts = self.counts[at]
        total = np.concatenate([[0], np.cumsum(counts)])
        stops = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[_ranges(self.starts[at], counts)], np.diff(total[stops])


def encode_decode(
    docs: DataFrame, vocabulary: Vocabulary, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_tokens, ids (array of int), decoded (binary).

    Texts are encoded whole, without special tokens; null is empty, and empty texts have
    no ids and decode to no bytes; rows that repeat an id are encoded each on its own. decoded is made from the ids alone. Other columns are
    ignored, so none can clash; an empty table gives an empty one. The vocabulary is
    broadcast: its size is fixed by the rank file and does not grow with the input. No
    row leaves its partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    known = shared._jbroadcast.id(), pattern

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if known not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[known] = Encoder(shared.value, pattern)
        encoder = _ENCODERS[known]
        for rows, texts in slices(batches, 1):
            ids, counts = encoder.encode(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            decoded = shared.value.decode(ids.astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(decoded, pa.binary())],
                ["id", "n_tokens", "ids", "decoded"],
            )

    kind = docs.schema[id_col].dataType
    out = T.StructType(
        [T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    )
    return docs.select(id_col, text_col).mapInArrow(run, out).withColumnRenamed("id", id_col)
