"""Quality classifier: a factorisation machine over hashed words, structure and length.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): the
pairwise interactions of all features in time linear in their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Hash buckets of words; statistics follow them, each with its bins.
BUCKETS = 1 << 14
BINS = 12
STATS = (
    "symbols", "upper", "digits", "ends", "mean_word", "distinct", "twice", "lines", "line_words", "same_lines", "longest", "length",
)
FEATURES = BUCKETS + BINS * len(STATS)
#: Words, and characters of words, that a task remembers.
REMEMBERED, REMEMBERED_CHARS = 300_000, 8_000_000

# What a word adds to the sums: its bucket, characters, symbols, capitals, digits, punctuation at the end.
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")
_END = re.compile(r"[^\w\s]{2,}$")


def _word(word: str) -> tuple[int, ...]:
    return (
        crc32(word.lower().strip(".,;:!?").encode("utf-8", "surrogatepass")) % BUCKETS,
        len(word),
        len(_SYMBOL.findall(word)),
        sum(map(str.isupper, word)),
        sum(map(str.isdigit, word)),
        bool(_END.search(word)),
    )


class Features:
    """Texts to sparse rows of at most ``FEATURES`` columns."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.empty((0, 6), dtype=np.int64)
        self.chars = 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of all non-zero features, by row."""
        words = [WORDS(t) for t in texts]
        if new := list(set().union(*words).difference(self.place)):
            if len(self.place) > REMEMBERED or self.chars > REMEMBERED_CHARS:
                self.place, self.table, self.chars = {}, self.table[:0], 0
                new = list(set().union(*words))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.array(list(map(_word, new)), dtype=np.int64)])
            self.chars += sum(map(len, new))
        n = np.array([len(w) for w in words], dtype=np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(n.sum()))
        doc = np.repeat(np.arange(len(texts)), n)
        docs = len(texts)
        key, count = np.unique(doc * BUCKETS + self.table[at, 0], return_counts=True)
        row, column, value = key // BUCKETS, key % BUCKETS, np.log1p(count)
        norm = np.sqrt(np.bincount(row, value * value, docs))
        value = value / np.maximum(norm[row], 1e-9)

        sums = [np.bincount(doc, self.table[at, i], docs) for i in range(1, 6)]
        chars, symbols, upper, digits, ends = sums
        some, letters = np.maximum(n, 1), np.maximum(chars, 1)
        same = np.zeros(len(at), dtype=bool)
        same[1:] = (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])
        lines = [t.split("\n") for t in texts]
        n_lines = np.array([len(x) for x in lines])
        kinds = np.bincount(row, minlength=docs)
        stats = np.stack(
            [
                symbols / letters,
                upper / letters,
                digits / letters,
                ends / some,
                chars / some / 20,
                kinds / some,
                np.bincount(doc, same, docs) / some,
                np.log1p(n_lines) / 10,
                np.log1p(n / n_lines) / 8,
                1 - np.array([len(set(x)) for x in lines]) / n_lines,
                np.array([max(map(len, x)) for x in lines]) / np.maximum([len(t) for t in texts], 1),
                np.log1p(n) / 14,
            ],
            axis=1,
        )
        # Small shares tell the most, so bins are equal in the square root.
        bins = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64), BINS - 1)
        extra = BUCKETS + np.arange(len(STATS)) * BINS + bins
        row = np.concatenate([row, np.repeat(np.arange(docs), len(STATS))])
        column = np.concatenate([column, extra.ravel()])
        value = np.concatenate([value, np.full(extra.size, 0.5)])
        order = np.argsort(row, kind="stable")
        return row[order], column[order], value[order]


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """The probability of label 1 for each of ``docs`` rows."""
        return 1 / (1 + np.exp(-np.clip(self._sums(row, column, value, docs)[0], -30, 30)))

    def _sums(self, row, column, value, docs):
        out = self.bias + np.bincount(row, self.weights[column] * value, docs)
        mixed = np.empty((docs, self.factors.shape[1]))
        for f in range(self.factors.shape[1]):
            vx = self.factors[column, f] * value
            mixed[:, f] = np.bincount(row, vx, docs)
            out += 0.5 * (mixed[:, f] ** 2 - np.bincount(row, vx * vx, docs))
        return out, mixed

    @classmethod
    def fit(
        cls, row, column, value, label: np.ndarray, factors: int = 6, steps: int = 300, batch: int = 256,
        rate: float = 0.03, decay: float = 1e-4, seed: int = 7,
    ) -> Machine:
        """Adam on the logistic loss, ``steps`` steps in whole epochs. With fewer than two labels the score is their rate."""
        rng = np.random.default_rng(seed)
        docs = len(label)
        share = (label.sum() + 0.5) / (docs + 1)
        m = cls(float(np.log(share / (1 - share))), np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, factors)))
        if docs == 0 or label.min() == label.max():
            m.factors[:] = 0
            return m
        starts = np.searchsorted(row, np.arange(docs + 1))
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("w", m.weights), ("v", m.factors))}
        step = 0
        for _ in range(-(-steps // -(-docs // batch))):
            order = rng.permutation(docs)
            for part in range(0, docs, batch):
                chosen = order[part : part + batch]
                n = starts[chosen + 1] - starts[chosen]
                at = np.arange(int(n.sum())) + np.repeat(starts[chosen] - (np.cumsum(n) - n), n)
                r, c, x = np.repeat(np.arange(len(chosen)), n), column[at], value[at]
                out, mixed = m._sums(r, c, x, len(chosen))
                error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[chosen]) / len(chosen)
                step += 1
                m.bias -= rate * error.sum()
                e = error[r] * x
                used, inverse = np.unique(c, return_inverse=True)
                for name, param, grad in (
                    ("w", m.weights, np.bincount(inverse, e)),
                    ("v", m.factors, np.stack([np.bincount(inverse, e * (mixed[r, f] - m.factors[c, f] * x)) for f in range(factors)], axis=1)),
                ):
                    grad = grad + decay * param[used]
                    one, two = state[name]
                    one[used] = 0.9 * one[used] + 0.1 * grad
                    two[used] = 0.99 * two[used] + 0.01 * grad * grad
                    param[used] -= rate * (one[used] / (1 - 0.9**step)) / (np.sqrt(two[used] / (1 - 0.99**step)) + 1e-8)
        return m


#: The words this Python process has met, for the tasks after the first.
_KNOWN = Features()


def held_out(id_col: str):
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6000) -> Machine:
    """Fit on at most ``max_rows`` labelled documents that are not held out.

    Which rows, if there are more, follows from a hash of the id, so they are a random but
    fixed sample. Labels that are null or of no document are ignored; ids labelled twice
    take their rounded mean, and of rows that repeat an id the least text counts. The driver
    gets hashed features of these rows only.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna()
    known = known.filter(~held_out("id")).groupBy("id").agg(F.round(F.avg("label")).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, 1):
            row, column, value = _KNOWN(texts)
            offsets = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.ListArray.from_arrays(offsets, pa.array(column, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(value, pa.float32()))],
                ["id", "label", "columns", "x"],
            )

    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(known), "id")
    sample = sample.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = sample.mapInArrow(features, f"id {kind}, label double, columns array<int>, x array<float>").toArrow()
    order = np.lexsort([[str(x) for x in found["id"].to_pylist()]]) if len(found) else np.empty(0, dtype=int)
    found = found.take(pa.array(order))
    row = np.repeat(np.arange(len(found)), pc.list_value_length(found["columns"]).to_numpy())
    flat = lambda name: pc.list_flatten(found[name]).to_numpy()
    return Machine.fit(row, flat("columns"), flat("x").astype(np.float64), found["label"].to_numpy())


def score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, 0 to 1, of each whole text.

    Null and empty texts get the score of a text without words. All other columns pass
    through as they are; ``score_col`` replaces a column of its name. The machine is
    broadcast: its size is fixed. No row leaves its partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.drop(score_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, place):
            found = pa.array(shared.value.scores(*_KNOWN(texts), len(texts)), pa.float64())
            yield pa.RecordBatch.from_arrays([*rows.columns, found], [*rows.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
