"""Word hashes and rolling window hashes of whole texts, in numpy, for operators that run inside tasks."""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: The white space of all contracts, by byte; UTF-8 uses these bytes for nothing else.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(9, 14), 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2**bits powers of the base and of its inverse, modulo 2**64."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(1 << bits, np.uint64(x))
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


class Rolling:
    """Hashes of any windows over one array of hashes, by prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _powers(max(16, int(len(values)).bit_length()))
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        raw = (self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts]
        return mixed(raw + np.asarray(lengths).astype(np.uint64) * _MIX[1])


class Words(NamedTuple):
    """The words of some texts: their hashes, how many each text has, and where they stand in ``text``."""

    hashes: np.ndarray
    sizes: np.ndarray
    text: bytes
    starts: np.ndarray
    ends: np.ndarray

    def run(self, first: int, n: int) -> str:
        """``n`` words from word ``first`` on, joined by one space."""
        part = self.text[self.starts[first] : self.ends[first + n - 1]]
        return b" ".join(part.split()).decode("utf-8", "surrogatepass")


def words_of(texts: list[str], lower: bool = False) -> Words:
    """The words that white space leaves; ``lower`` puts A-Z in lower case, other letters stay."""
    each = [t.encode("utf-8", "surrogatepass") for t in texts]
    text = b"\n".join(each)
    text = text.lower() if lower else text  # of bytes: A-Z alone
    letters = np.frombuffer(text, dtype=np.uint8)
    edge = np.ones(len(letters) + 2, dtype=bool)
    edge[1:-1] = _SPACE[letters]
    turn = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = turn[0::2], turn[1::2]
    stops = np.cumsum(np.fromiter(map(len, each), dtype=np.int64, count=len(each)) + 1)
    sizes = np.diff(np.searchsorted(starts, stops), prepend=0)
    return Words(Rolling(_LETTER[letters])(starts, ends - starts), sizes, text, starts, ends)


def window_starts(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word among all words) of every window of ``width`` words."""
    counts = np.maximum(sizes - width + 1, 0)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), counts)
    return doc, np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def shingle_sets(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct word shingles, by document and hash.

    A text of fewer than ``width`` words has one shingle, the whole sequence; one without
    words has none.
    """
    words = words_of(texts, lower=True)
    sizes, roll = words.sizes, Rolling(words.hashes)
    doc, start = window_starts(sizes, width)
    few = np.flatnonzero((sizes > 0) & (sizes < width))
    found = roll(start, width)
    if len(few):
        first = np.cumsum(sizes) - sizes
        doc, found = np.concatenate([doc, few]), np.concatenate([found, roll(first[few], sizes[few])])
        order = np.argsort(doc, kind="stable")
        doc, found = doc[order], found[order]
    stops = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(stops, stops[1:], strict=False):
        found[a:b].sort()
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return doc[new], found[new]
