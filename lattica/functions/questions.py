"""What a question or a name asks for, as column expressions over its text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import split_camel, stem

# Words that ask nothing, and the forms of identifiers and operators.
STOP_WORDS = (
    "and", "are", "does", "for", "from", "how", "into", "the", "that", "this", "what", "when", "where", "which", "who", "why", "with",
)
SHAPED = "[_$0-9]|[a-z][A-Z]"
OPERATORS = r'"|\sOR\s|(^|\s)-[A-Za-z0-9_]'
WHOLE = r"[A-Za-z0-9_$]+(?:(?:\.|-|::)[A-Za-z0-9_$]+)*"
PATH_LIKE = r"(?i)/|\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|rb|java|kt|cs|php|c|cc|cpp|h|hpp|scala|ya?ml|json|toml|tf|hcl|sh|md)$"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def worth(word: Column) -> Column:
    """True for words of at least three characters that are not in ``STOP_WORDS``."""
    return (F.length(word) >= 3) & ~word.isin(*STOP_WORDS)


def identifiers(text: Column) -> Column:
    """Array of (word, shaped): the words worth matching, in order, and whether any spelling looks like a symbol."""
    found = _all(text, "[A-Za-z0-9_$]+")
    words = F.array_distinct(F.filter(F.transform(found, F.lower), worth))
    shaped = lambda w: F.exists(found, lambda x: (F.lower(x) == w) & x.rlike(SHAPED))
    return F.transform(words, lambda w: F.struct(w.alias("word"), shaped(w).alias("shaped")))


def subwords(text: Column) -> Column:
    """Distinct words worth matching, lower-case letters and capitals taken apart."""
    spaced = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower), worth))


def roots(text: Column) -> Column:
    """Stems of the words worth matching, camel case split."""
    return F.array_distinct(F.transform(F.filter(F.transform(_all(split_camel(text), "[A-Za-z0-9]+"), F.lower), worth), stem))


def has_operators(text: Column) -> Column:
    """Whether a question uses quotes, OR or a leading minus."""
    return text.rlike(OPERATORS)


def prefix_terms(text: Column) -> Column:
    """Terms that any may match: stems of four letters as prefixes, shorter ones whole; null where the question uses operators or has no words."""
    found = F.transform(roots(text), lambda r: F.when(F.length(r) >= 4, F.concat(r, F.lit(":*"))).otherwise(r))
    return F.when(~has_operators(text) & (F.size(found) > 0), found)


def name_patterns(text: Column) -> Column:
    """ILIKE patterns of the identifiers that look like symbols."""
    named = F.filter(identifiers(text), lambda x: x["shaped"] & x["word"].rlike("^[a-z0-9_]+$"))
    return F.transform(named, lambda x: F.concat(F.lit("%"), x["word"], F.lit("%")))


def whole_phrases(text: Column) -> Column:
    """Identifiers that a text must hold whole, spelt as its words are read; none where the question uses operators."""
    parts = lambda t: _all(split_camel(t), "[A-Za-z0-9]+")
    joined = lambda t: F.contains(t, F.lit(".")) | F.contains(t, F.lit("::"))
    whole = F.filter(_all(text, WHOLE), lambda t: (joined(t) | t.rlike(SHAPED)) & (F.size(parts(t)) > 1) & F.exists(parts(t), lambda p: worth(F.lower(p))))
    return F.when(has_operators(text), F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(whole, split_camel)))


def web_search(text: Column) -> Column:
    """Struct of phrases (quoted), left_out (leading minus) and either (words beside an OR)."""
    plain = F.regexp_replace(text, '"[^"]*"', " ")
    return F.struct(
        _all(text, '"([^"]+)"', 1).alias("phrases"),
        _all(plain, r"(?:^|\s)-([A-Za-z0-9_]+)", 1).alias("left_out"),
        _all(plain, r"(\S+)\s+OR\s+\S", 1).alias("either"),
    )


def bare(label: Column) -> Column:
    """A label without leading dots and one closing ()."""
    return F.regexp_replace(F.regexp_replace(label, r"^\.+", ""), r"\(\)$", "")


def parsed_symbol(text: Column) -> Column:
    """Struct (owner, name, path) of Class.method, A::b, a#b, or a path."""
    trimmed = F.trim(text)
    base = F.substring_index(trimmed, "/", -1)
    dot = F.instr(base, ".")
    parts = F.filter(F.split(bare(trimmed), r"::|#|\."), lambda p: p != "")
    n, none = F.size(parts), F.lit(None).cast("string")
    as_path = F.struct(none.alias("owner"), F.when(dot > 1, F.substring(base, F.lit(1), dot - 1)).otherwise(base).alias("name"), F.regexp_replace(trimmed, r"^\./", "").alias("path"))
    as_name = F.struct(F.when(n > 1, F.get(parts, n - 2)).alias("owner"), F.when(n > 0, F.get(parts, n - 1)).otherwise(bare(trimmed)).alias("name"), none.alias("path"))
    return F.when(trimmed.rlike(PATH_LIKE), as_path).otherwise(as_name)


def escaped(text: Column) -> Column:
    """The text with a backslash before each character that has a meaning in patterns."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def any_of(names: Sequence[Column]) -> Column:
    """A pattern for any of some names."""
    return F.concat(F.lit("("), F.array_join(F.array_distinct(F.array(*map(escaped, names))), "|"), F.lit(")"))


def word_pattern(*names: Column) -> Column:
    return F.concat(F.lit(r"\b"), any_of(names), F.lit(r"\b"))


def call_pattern(*names: Column) -> Column:
    return F.concat(word_pattern(*names), F.lit(r"\s*\("))


def implementation_pattern(name: Column) -> Column:
    """Lines that extend or implement a name."""
    n = escaped(name)
    return F.concat(F.lit(r"\b(extends|implements)\s+([\w.]+\s*,\s*)*"), n, F.lit(r"\b|\bclass\s+\w+\s*\([^)]*\b"), n, F.lit(r"\b"))


def import_pattern(module: Column) -> Column:
    return F.concat(F.lit(r"\b(import|from|require)\b.*\b"), escaped(module), F.lit(r"\b"))


def loose_pattern(text: Column) -> Column:
    """The words of a text with anything but letters and digits between them."""
    return F.array_join(F.transform(_all(text, r"\w+"), escaped), r"[\W_]*")
