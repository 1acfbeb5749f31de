"""How values are shown: summaries, ages, numbers, times, JSON objects; column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_SUMMARY = 12


def says_more(summary: Column, path: Column) -> Column:
    """Whether a summary is long enough and more than its file's name."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    names = letters(path), letters(F.substring_index(path, "/", -1))
    return (F.length(summary) >= LEAST_SUMMARY) & ~letters(summary).isin(*names)


# How models open a summary, and what such an opening leaves behind.
PREAMBLE = r"""(?i)^(?:the|this)\s+(?:file\s+)?[`'"]?([\w./+-]+)[`'"]?\s*(?:file\s+)?(?:in\s+the\s+[\w./+-]+\s+directory\s+)?"""
BARE_PREAMBLE = r"(?i)^(?:the|this)\s+(?:file|directory|function|method|class)\s+"
DANGLING_VERB = r"(?i)^is\s+"


def without_preamble(summary: Column, path: Column) -> Column:
    """A summary without an opening that only names its own file; kept where it names another or too little would be left."""
    named = F.lower(F.regexp_extract(summary, PREAMBLE, 1))
    own = named.isin(F.lower(path), F.lower(F.substring_index(path, "/", -1))) & (named != "")
    cut = F.when(own, F.regexp_replace(summary, PREAMBLE, "")).when(~named.rlike("[./]") & summary.rlike(BARE_PREAMBLE), F.regexp_replace(summary, BARE_PREAMBLE, ""))
    rest = F.trim(F.regexp_replace(F.trim(cut), DANGLING_VERB, ""))
    upper = F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))
    return F.when(F.length(rest) >= LEAST_SUMMARY, upper).otherwise(summary)


def file_summary(name: Column, text: Column, entities: Column, most: int = 5) -> Column:
    """A summary from a file itself: a heading, a leading comment, else its first entities, else how long it is."""
    heading = F.nullif(F.trim(F.regexp_extract(text, r"^\s*#+[ \t]+([^\n]+)", 1)), F.lit(""))
    comment = F.nullif(F.trim(F.regexp_extract(text, r"^\s*(?://|--|;)[ \t]*([^\n]+)", 1)), F.lit(""))
    more = F.when(F.size(entities) > most, F.concat(F.lit(", +"), F.size(entities) - most, F.lit(" more"))).otherwise("")
    listed = F.when(F.size(entities) > 0, F.concat(F.array_join(F.slice(entities, 1, most), ", "), more))
    return F.coalesce(heading, comment, listed, F.concat(name, F.lit(" ("), F.size(F.split(text, "\n")), F.lit(" lines)")))


def age(seconds: Column) -> Column:
    """Seconds as words: minutes below an hour, then hours, then days, rounded down."""
    def some(unit: int, name: str) -> Column:
        n = F.floor(seconds / unit)
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, minutes).when(seconds < 86400, some(3600, "hour")).otherwise(some(86400, "day"))


def percent(part: Column, whole: Column) -> Column:
    """A share in whole percent, null of nothing, never 100 while one is missing."""
    share = F.floor(part / F.nullif(whole, F.lit(0)) * 100)
    return F.when((share == 100) & (part < whole), 99).otherwise(share).cast("long")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def fixed(x: Column, digits: int = 5) -> Column:
    """A number with so many decimals, as text."""
    return F.format_string(f"%.{digits}f", F.round(x, digits))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_merged(left: Column, right: Column) -> Column:
    """Two objects (map<string,string>) as one; the right one's keys win."""
    rest = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(rest, right)


def json_without(value: Column, key: str) -> Column:
    return F.map_filter(value, lambda k, v: k != key)


def json_without_nulls(value: Column) -> Column:
    return F.map_filter(value, lambda k, v: v.isNotNull())


def json_set(value: Column, key: str, to: Column) -> Column:
    """An object with one key set anew."""
    return json_merged(value, F.create_map(F.lit(key), to))


def entries_text(value: Column) -> Column:
    """A map as text, keys in order: a=1,b=2."""
    pairs = F.array_sort(F.map_entries(value))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ",")
