"""Machines that read the lines of a text in order, as column expressions: what they know so far, what they say at each line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines whose findings are gathered before they are put away, so that long texts take time in proportion.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def walked(lines: Column, start: dict[str, Column], step: Callable[[Column, Column], Column], found: str) -> Column:
    """All that a machine finds, in order.

    ``step(state, line)`` gives a struct of the next state's fields and of ``said``, an array of
    ``found`` (a type, as text). Null lines give null, no lines nothing.
    """
    names = list(start)
    none, nones = F.array().cast(f"array<{found}>"), F.array().cast(f"array<array<{found}>>")
    whole = lambda get, out, outs: F.struct(*(get(n).alias(n) for n in names), out.alias("out"), outs.alias("outs"))

    def one(s: Column, line: Column) -> Column:
        return bound(step(s, line), lambda t: whole(lambda n: t[n], F.when(F.size(t["said"]) == 0, s["out"]).otherwise(F.concat(s["out"], t["said"])), s["outs"]))

    def block(s: Column, part: Column) -> Column:
        put_away = lambda t: whole(lambda n: t[n], none, F.when(F.size(t["out"]) == 0, t["outs"]).otherwise(F.concat(t["outs"], F.array(t["out"]))))
        return F.aggregate(part, s, one, put_away)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / BLOCK).cast("int")), lambda i: F.slice(lines, i * BLOCK + 1, F.lit(BLOCK)))
    parts = F.when(F.size(lines) > 0, parts).otherwise(F.array().cast("array<array<string>>"))
    return F.aggregate(F.when(lines.isNotNull(), parts), whole(lambda n: start[n], none, nones), block, lambda s: F.flatten(s["outs"]))


def outline(text: Column) -> Column:
    """The keys of an indented data text, each with those above it: array of (doc, keys, value).

    A line ``key: value`` is below the nearest line before it that is indented less; a list entry
    is a key ``-``, and what a block sign (``|`` or ``>``) opens is below one more key ``|``. ``---``
    begins the next document. Comments and empty lines say nothing; quotes around a key or value go.
    """
    start = {"doc": F.lit(0), "seen": F.lit(False), "at": F.array().cast("array<int>"), "keys": F.array().cast("array<string>")}
    bare = lambda x: F.regexp_replace(F.trim(x), """^(["'])(.*)\\1$""", "$2")

    def step(s: Column, line: Column) -> Column:
        indent = F.length(F.regexp_extract(line, "^ *", 0))
        key = F.regexp_extract(line, """^ *("[^"]*"|'[^']*'|[^\\s"'#\\[\\]{},-][^#]*?|-[^\\s#][^#]*?)[ \\t]*:(?:[ \\t]|$)""", 1)
        value = bare(F.regexp_replace(F.regexp_extract(line, """^ *(?:"[^"]*"|'[^']*'|[^#]*?)[ \\t]*:(?:[ \\t]+(.*))?$""", 1), "(^|[ \\t])#.*$", ""))
        entry = line.rlike("^ *-([ \\t]|$)")
        here = F.struct(indent.alias("indent"), F.when(entry, "-").otherwise(bare(key)).alias("key"), F.when(entry, "").otherwise(value).alias("value"))

        def after(h: Column) -> Column:
            above = F.size(F.filter(s["at"], lambda a: a < h["indent"]))  # indents grow down the stack
            opens = h["value"].rlike("^[|>][-+0-9]*$")
            keys = F.concat(F.slice(s["keys"], F.lit(1), above), F.array(h["key"]))
            at = F.concat(F.slice(s["at"], F.lit(1), above), F.array(h["indent"]))
            said = F.when(h["key"] != "-", F.array(F.struct(s["doc"].alias("doc"), keys.alias("keys"), h["value"].alias("value"))))
            return F.struct(
                s["doc"].alias("doc"), F.lit(True).alias("seen"), F.when(opens, F.concat(at, F.array(h["indent"]))).otherwise(at).alias("at"),
                F.when(opens, F.concat(keys, F.array(F.lit("|")))).otherwise(keys).alias("keys"), F.coalesce(said, none).alias("said"),
            )

        none = F.array().cast("array<struct<doc:int,keys:array<string>,value:string>>")
        same = F.struct(s["doc"].alias("doc"), s["seen"].alias("seen"), s["at"].alias("at"), s["keys"].alias("keys"), none.alias("said"))
        fresh = F.struct((s["doc"] + s["seen"].cast("int")).alias("doc"), F.lit(False).alias("seen"), start["at"].alias("at"), start["keys"].alias("keys"), none.alias("said"))
        return F.when(line.rlike("^---([ \\t]|$)"), fresh).when(entry | (key != ""), bound(here, after)).otherwise(same)

    return walked(F.split(text, "\r?\n"), start, step, "struct<doc:int,keys:array<string>,value:string>")
