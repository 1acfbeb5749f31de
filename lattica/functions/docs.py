"""What a source says of an entity: the docstring below its signature, else the comment above it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import bound

# Fixed values.
COMMENT = r"""^(\"{3}|'{3}|###|#|//|/[*]|[*]/|[*]|--|<!--)"""
QUOTES = r"""^(\"{3}|'{3})"""
STRING = r"""\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"""
SIGNATURE_LINES = 40


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _tail(lines: Column, n: Column) -> Column:
    """The lines behind the first ``n``."""
    return F.slice(lines, n + 1, F.lit(1 << 30))


def _until(lines: Column, stops) -> Column:
    """How many lines come before the first for which ``stops`` holds."""
    at = F.array_position(F.transform(lines, stops), F.lit(True))
    return bound(at, lambda n: F.when(n > 0, n - 1).otherwise(F.size(lines)).cast("int"))


def comment_above(lines: Column, start: Column) -> Column:
    """The first line with prose of the comment right above line ``start``, decorators stepped over; empty where there is none."""
    above = F.transform(F.reverse(F.slice(lines, F.lit(1), F.greatest(start - 1, F.lit(0)))), _bare)
    below = bound(above, lambda rest: _tail(rest, _until(rest, lambda x: ~x.rlike(r"^(@|#\[)"))))
    block = bound(below, lambda rest: F.slice(rest, F.lit(1), _until(rest, lambda x: ~x.rlike(COMMENT) | x.startswith("#!") | x.rlike(QUOTES))))
    bare = lambda x: _bare(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, COMMENT, ""), r"^[ \t*/<>!#;-]+|[ \t*/<>!#;-]+$", ""), "^[\"']+|[\"']+$", ""))
    texts = F.filter(F.transform(F.reverse(block), bare), lambda x: (x != "") & ~x.startswith("@"))
    return F.coalesce(F.get(texts, F.lit(0)), F.lit(""))


def signature_end(lines: Column, start: Column) -> Column:
    """The line whose colon ends the signature that begins at ``start``; null where no colon does.

    Brackets are counted with strings and comments taken away; within open ones, and behind a
    backslash, the signature goes on, over ``SIGNATURE_LINES`` lines at most.
    """
    plain = lambda x: F.regexp_replace(x, STRING, '""')
    codes = F.transform(F.slice(lines, start, F.lit(SIGNATURE_LINES)), lambda x: F.regexp_replace(F.regexp_replace(plain(x), "(?s)#.*$", ""), r"\s+$", ""))
    count = lambda c, chars: F.length(F.regexp_replace(c, f"[^{chars}]", ""))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("line"), F.lit(False).alias("over"), F.lit(False).alias("colon"))

    def after(s, c, depth):
        over = ~((depth > 0) | c.endswith("\\"))
        return F.struct(depth.alias("depth"), (s["line"] + 1).alias("line"), over.alias("over"), (over & c.endswith(":")).alias("colon"))

    def step(s, c):
        depth = s["depth"] + count(c, r"(\[{") - count(c, r")\]}")
        return F.when(s["over"], s).otherwise(bound(depth, lambda d: after(s, c, d)))

    return F.aggregate(codes, zero, step, lambda s: F.when(s["colon"], start + s["line"] - 1))


def docstring_below(lines: Column, start: Column) -> Column:
    """The first line of a docstring that opens the body of the entity at line ``start``; empty where there is none."""
    body = F.transform(_tail(lines, signature_end(lines, start)), _bare)
    body = bound(body, lambda x: _tail(x, _until(x, lambda line: line != "")))

    def text(body, first, quote):
        upto = lambda x: _bare(F.split_part(x, quote, F.lit(1)))
        return F.when(quote != "", bound(upto(F.substring(first, F.lit(4), F.length(first))), lambda t: F.when(t != "", t).otherwise(upto(F.get(body, F.lit(1))))))

    first = lambda body: F.regexp_replace(F.get(body, F.lit(0)), r"""^[rRuU](?=\"{3}|'{3})""", "")
    found = bound(body, lambda b: bound(first(b), lambda f: bound(F.regexp_extract(f, QUOTES, 1), lambda q: text(b, f, q))))
    return F.coalesce(found, F.lit(""))


def entity_summary(lines: Column, start: Column, most: int = 300) -> Column:
    """The docstring, else the comment, of the entity at line ``start`` (from 1), ``most`` characters of it; empty for lines that are not there.

    What several steps need is worked out once a row.
    """

    def found(x):
        below = docstring_below(x["lines"], x["start"])
        return bound(below, lambda b: F.when(b != "", b).otherwise(comment_above(x["lines"], x["start"])))

    def summary(x):
        inside = (x["start"] >= 1) & (x["start"] <= F.size(x["lines"]))
        return F.substring(F.when(inside, found(x)).otherwise(F.lit("")), 1, most)

    return bound(F.struct(lines.alias("lines"), start.alias("start")), summary)
