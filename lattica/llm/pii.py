"""Personal data: fixed patterns, and a linear-chain conditional random field beside them.

The field labels the words of a line by their shapes and those of their neighbours. It is
trained here from a small labelled table of invented lines and decoded by Viterbi over
padded matrices of lines. It adds what the patterns leave out: mail addresses spelt with
"at" and "dot", telephone numbers without a plus, cards and addresses with other
separators. What it labels must still pass the checks of its kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

# --- the patterns -----------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# Digits before a run's first one cannot start a match that the first one cannot.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_DIGIT = re.compile(r"[0-9]").search
_NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each @ outwards."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN(text, end)):
            yield start, 0, m.end()
            free = end = m.end()
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns by start, then kind."""
    found = list(_emails(text))
    if _DIGIT(text):
        for m in _IP(text):
            if all(map(_octet, m.group().split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD(text):
            digits = _NOT_DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE(text):
            if 10 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- the field ---------------------------------------------------------------


def _size(n: int) -> int:
    return n if n < 5 else 5 if n < 8 else 6 if n < 12 else 7


_SHAPE = ((re.compile(r"[0-9]+"), lambda m: "9" * min(len(m.group()), 5)), (re.compile(r"[^\W\d_]+"), lambda m: "a"))


def features(word: str) -> list[str]:
    """What the field sees of a word: its shape and its length, and words of its own for short ones."""
    shape = word
    for pattern, by in _SHAPE:
        shape = pattern.sub(by, shape)
    out = [f"shape {shape[:24]}", f"size {_size(len(word))}", f"digits {_size(sum(map(str.isdigit, word)))}"]
    if len(word) <= 7:
        out.append(f"word {word.lower().strip('.,;:')}")
    out += [f"has {c}" for c in "@+()-./[]" if c in word]
    return out


def _training_lines() -> list[list[tuple[str, int]]]:
    """The small labelled table: lines of (word, label), by rule from a fixed seed."""
    rng = np.random.default_rng(11)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    syllables = ("an", "the", "er", "ti", "on", "le", "que", "ch", "au", "en", "re", "st", "ou", "in")
    word = lambda: "".join(pick(*syllables) for _ in range(rng.integers(1, 5)))

    def plain() -> list[str]:
        kind = rng.integers(12)
        if kind == 0:
            return [pick("at", "dot", "Call", "from", "the")]
        if kind == 1:
            return [digits(rng.integers(1, 8)) + pick("", ".", ",")]
        if kind == 2:
            return [pick("v", "", "-") + ".".join(digits(rng.integers(1, 3)) for _ in range(rng.integers(2, 4)))]
        if kind == 3:
            return [f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}"]
        if kind == 4:
            return [f"{word()}={word()}{digits(5)}{word()}{digits(2)}", f"({word()})"]
        w = word()
        return [pick(w, w, w.title(), w + ".", w + ",")]

    def private() -> list[tuple[str, int]]:
        kind = int(rng.integers(1, 5))
        if kind == 1:
            mail = [
                [f"{word()}.{digits(2)}@mail{digits(1)}.example.com"],
                [word(), pick("at", "(at)", "[at]", "AT"), word(), pick("dot", "(dot)", "[dot]", "DOT"), pick("com", "org", "net")],
                [f"{word()}[at]{word()}[dot]{pick('com', 'org')}"],
                [word(), pick("(at)", "[at]"), f"{word()}.{pick('com', 'org', 'net')}"],
            ][rng.integers(4)]
            return [(w, kind) for w in mail]
        if kind == 2:
            parts = [str(x) for x in rng.integers(0, 256, 4)]
            return [(pick(".", "[.]", "(.)").join(parts), kind)]
        if kind == 3:
            groups = [digits(4) for _ in range(4)]
            return [(w, kind) for w in pick([pick("", ".", "/", "-").join(groups)], groups)]
        phones = [
            [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
            [f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
            [f"({digits(3)}){digits(3)}-{digits(4)}"],
            [f"{digits(3)}-{digits(3)}-{digits(4)}"],
            [f"{digits(3)}.{digits(3)}.{digits(4)}"],
        ]
        return [(w, kind) for w in phones[rng.integers(5)]]

    lines = []
    for _ in range(600):
        line: list[tuple[str, int]] = []
        for _ in range(rng.integers(2, 10)):
            line += private() if rng.random() < 0.2 else [(w, 0) for w in plain()]
        lines.append(line)
    return lines


@dataclass
class Field:
    """Scores of labels by the features of a word (own, of the word before, of the next) and of steps."""

    columns: dict[str, int]
    weights: np.ndarray  # (3, features, labels)
    steps: np.ndarray  # (labels, labels)

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, 3, labels): what a word adds to its own label and to those beside it."""
        out = np.zeros((len(words), 3, len(LABELS)), dtype=np.float32)
        plain: dict[int, np.ndarray] = {}  # long words of letters alone differ by their size only
        alike: dict[tuple[int, ...], np.ndarray] = {}
        for i, word in enumerate(words):
            size = _size(len(word)) if len(word) > 7 and word.isalpha() else 0
            if size in plain:
                out[i] = plain[size]
                continue
            known = tuple(c for f in features(word) if (c := self.columns.get(f)) is not None)
            if known not in alike:
                alike[known] = self.weights[:, list(known)].sum(axis=1)
            out[i] = alike[known]
            if size:
                plain[size] = out[i]
        return out

    @classmethod
    def fit(cls, lines: list[list[tuple[str, int]]], rounds: int = 120, rate: float = 0.15, decay: float = 2e-4) -> Field:
        """Adam on the conditional likelihood, by the forward-backward sums of all lines at once."""
        seen = [[features(w) for w, _ in line] for line in lines]
        columns = {f: i for i, f in enumerate(sorted(set(chain.from_iterable(chain.from_iterable(seen)))))}
        count, n = len(LABELS), len(columns)
        width, rows = max(map(len, lines)), len(lines)
        gold = np.full((rows, width), -1)
        at_row, at_col, at_feature = [], [], []
        for r, line in enumerate(lines):
            gold[r, : len(line)] = [label for _, label in line]
            for c, fs in enumerate(seen[r]):
                for f in fs:
                    at_row.append(r), at_col.append(c), at_feature.append(columns[f])
        at = np.array(at_row), np.array(at_col), np.array(at_feature)
        there = gold >= 0
        # A feature of word t counts for the labels at t, t + 1 (as "before") and t - 1 (as "next").
        uses = []
        for kind, move in enumerate((0, 1, -1)):
            c = at[1] + move
            ok = (c >= 0) & (c < width)
            ok[ok] = there[at[0][ok], c[ok]]
            uses.append((kind, at[0][ok], c[ok], at[2][ok]))
        weights, steps = np.zeros((3, n, count)), np.zeros((count, count))
        moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(steps), np.zeros_like(steps)]
        one_hot = np.eye(count)[np.maximum(gold, 0)] * there[:, :, None]
        pair = there[:, 1:, None, None]
        gold_steps = np.einsum("rti,rtj->ij", one_hot[:, :-1], one_hot[:, 1:])
        for k in range(1, rounds + 1):
            scores = np.zeros((rows, width, count))
            for kind, r, c, f in uses:
                np.add.at(scores, (r, c), weights[kind, f])
            forward, backward = np.zeros_like(scores), np.zeros_like(scores)
            forward[:, 0] = scores[:, 0]
            for t in range(1, width):
                x = forward[:, t - 1, :, None] + steps
                forward[:, t] = np.where(there[:, t, None], _log_sum(x, 1) + scores[:, t], forward[:, t - 1])
            for t in range(width - 2, -1, -1):
                x = steps + (scores[:, t + 1] + backward[:, t + 1])[:, None, :]
                backward[:, t] = np.where(there[:, t + 1, None], _log_sum(x, 2), 0)
            total = _log_sum(forward[:, -1], 1)
            chance = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
            both = forward[:, :-1, :, None] + steps + (scores[:, 1:] + backward[:, 1:])[:, :, None, :]
            both = np.where(pair, np.exp(np.minimum(both - total[:, None, None, None], 0)), 0).sum(axis=(0, 1))
            error = (chance - one_hot) / rows
            grad = np.zeros_like(weights)
            for kind, r, c, f in uses:
                np.add.at(grad[kind], f, error[r, c])
            grads = grad + decay * weights, (both - gold_steps) / rows + decay * steps
            for i, (param, g) in enumerate(zip((weights, steps), grads, strict=True)):
                one, two = moments[2 * i], moments[2 * i + 1]
                one[:] = 0.9 * one + 0.1 * g
                two[:] = 0.99 * two + 0.01 * g * g
                param -= rate * (one / (1 - 0.9**k)) / (np.sqrt(two / (1 - 0.99**k)) + 1e-8)
        return cls(columns, weights, steps)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


def trained() -> Field:
    """The field of the labelled table; training is fixed, so every call gives the same."""
    return Field.fit(_training_lines())


#: Words, and characters of words, that a task remembers.
REMEMBERED, REMEMBERED_CHARS = 300_000, 8_000_000
#: Cells of a padded matrix of lines.
CELLS = 400_000


class Decoder:
    """Labels of whole texts; what a word adds is worked out once."""

    def __init__(self, field: Field):
        self.field = field
        self.steps = field.steps.astype(np.float32)
        self.place: dict[str, int] = {}
        self.chars = 0
        self.table = np.empty((0, 3, len(LABELS)), dtype=np.float32)

    def labels(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each line."""
        if new := list(set().union(*lines).difference(self.place)):
            if len(self.place) > REMEMBERED or self.chars > REMEMBERED_CHARS:
                self.place, self.table, self.chars = {}, self.table[:0], 0
                new = list(set().union(*lines))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.field.emissions(new)])
            self.chars += sum(map(len, new))
        sizes = np.array([len(x) for x in lines])
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(lines)), dtype=np.int64, count=int(sizes.sum()))
        own = self.table[at, 0]
        starts = np.cumsum(sizes) - sizes
        inner = np.ones(len(at), dtype=bool)
        inner[starts[sizes > 0]] = False
        own[inner] += self.table[at[:-1][inner[1:]], 1]
        own[:-1][inner[1:]] += self.table[at[1:][inner[1:]], 2]
        out = [np.empty(0, dtype=np.int8)] * len(lines)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        while len(order):
            # Lines of like length share a matrix; the longest of those left sets its width.
            width = int(sizes[order[-1]])
            rows = order[max(0, len(order) - max(1, CELLS // width)) :]
            rows = rows[sizes[rows] * 2 > width]
            order = order[: len(order) - len(rows)]
            for r, best in zip(rows.tolist(), self._viterbi(own, starts[rows], sizes[rows]), strict=True):
                out[r] = best
        return out

    def _viterbi(self, own: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        width = int(sizes.max())
        back = np.zeros((width, len(starts), len(LABELS)), dtype=np.int8)
        score = own[starts]
        for t in range(1, width):
            there = t < sizes
            x = score[:, :, None] + self.steps
            back[t] = x.argmax(axis=1)
            nxt = x.max(axis=1) + own[np.minimum(starts + t, len(own) - 1)]
            score = np.where(there[:, None], nxt, score)
        best = np.zeros((width, len(starts)), dtype=np.int8)
        label = score.argmax(axis=1)
        line = np.arange(len(starts))
        for t in range(width - 1, -1, -1):
            best[t] = label
            label = np.where(t < sizes, back[t, line, label], label) if t else label
        return [best[:n, i] for i, n in enumerate(sizes)]


_AT = re.compile(r"@|\bat\b", re.I)
_DOT = re.compile(r"\.|\bdot\b", re.I)


def _passes(kind: int, text: str) -> bool:
    digits = _NOT_DIGITS.sub("", text)
    if kind == 0:
        return len(text.split()) <= 6 and bool(_AT.search(text)) and bool(_DOT.search(text)) and bool(re.search(r"[A-Za-z0-9]\W*$", text))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(map(_octet, parts))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and bool(re.search(r"[().+-]", text))


_TRIM = ".,;:!?\"'"


def added_spans(text: str, start: int, line: str, labels: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of one label in a line that pass their checks and touch no base span."""
    words = list(WORDS.finditer(line))
    out, i = [], 0
    while i < len(words):
        kind = int(labels[i])
        j = i
        while j + 1 < len(words) and labels[j + 1] == kind:
            j += 1
        if kind:
            a, b = words[i].start(), words[j].end()
            while b > a and line[b - 1] in _TRIM:
                b -= 1
            if _passes(kind - 1, line[a:b]) and not any(s < start + b and start + a < e for s, _, e in base):
                out.append((start + a, kind - 1, start + b))
        i = j + 1
    return out


#: The decoder of this Python process, by broadcast, for the tasks after the first.
_DECODERS: dict[int, Decoder] = {}


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, base and spans, arrays of (kind, start, end).

    base are the spans of the fixed patterns, spans those and what the field adds, both by
    start and then kind; places count code points and ends are exclusive. Null text is
    empty and has no spans; rows that repeat an id are judged each on its own, and spans of one
    start stand in the order of the kinds. Other columns are ignored, so none can clash; an empty table
    gives an empty one. Lines are the field's sequences; texts are read whole. The field is
    broadcast: its size is fixed. No row leaves its partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    known = shared._jbroadcast.id()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def column(found: list[list[Span]]) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found], pa.list_(kind))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if known not in _DECODERS:
            _DECODERS.clear()
            _DECODERS[known] = Decoder(shared.value)
        for rows, texts in slices(batches, 1):
            base = [base_spans(t) for t in texts]
            lines = [t.split("\n") for t in texts]
            labels = iter(_DECODERS[known].labels([WORDS.findall(x) for ls in lines for x in ls]))
            spans = []
            for text, ls, own in zip(texts, lines, base, strict=True):
                start, more = 0, []
                for line in ls:
                    best = next(labels)
                    if best.any():
                        more += added_spans(text, start, line, best, own)
                    start += len(line) + 1
                spans.append(sorted(own + more))
            yield pa.RecordBatch.from_arrays([rows.column(0), column(base), column(spans)], ["id", "base", "spans"])

    each = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("base", each), T.StructField("spans", each)])
    return docs.select(id_col, text_col).mapInArrow(run, out).withColumnRenamed("id", id_col)


def digest(spans: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
