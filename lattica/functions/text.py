"""Text functions of the engine, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_camel(text: Column) -> Column:
    """fooBar -> foo Bar, HTTPServer -> HTTP Server."""
    once = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(once, "([A-Z]+)([A-Z][a-z])", "$1 $2")


def lexical_words(text: Column) -> Column:
    """Lower-case words of letters and digits, camel case split; no stemming, no stop words."""
    return F.regexp_extract_all(F.lower(split_camel(text)), F.lit("[a-z0-9]+"), F.lit(0))


def stem(word: Column) -> Column:
    """Cuts the first of some endings that leaves four letters; a doubled consonant after ing or ed goes too."""
    out = word
    for ending in ("s", "ed", "es", "ied", "ies", "ing"):  # the last one is asked first
        root = F.substring(word, F.lit(1), F.length(word) - len(ending))
        if ending in ("ing", "ed"):
            twice = root.rlike(r"([b-df-hj-np-tv-z])\1$")
            root = F.when(twice, F.substring(root, F.lit(1), F.length(root) - 1)).otherwise(root)
        out = F.when(word.endswith(ending) & (F.length(word) - len(ending) >= 4), root).otherwise(out)
    return out


def trigrams(text: Column) -> Column:
    """Distinct three-letter runs of each word, two spaces before it and one behind."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    runs = F.transform(padded, lambda w: F.regexp_extract_all(w, F.lit("(?=(...))"), F.lit(1)))  # linear in the word
    return F.array_distinct(F.flatten(runs))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams of all trigrams; two texts without words have none, so 0."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where one has no length."""
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    a, b = double(a), double(b)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def name_key(text: Column) -> Column:
    """Letters and digits alone, so that spellings of one name agree."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def normalize_name(kind: Column, raw: Column) -> Column:
    """One spelling for a name of a kind, in lower case, 255 characters of it; empty for what is no name.

    Images lose digest, tag and the default registry, python packages their version, roles their
    folder, module sources getter, scheme, user, ref and ending. A name with a variable in it is none.
    """
    name = F.trim(raw)
    lowered = F.lower(name)
    image = F.regexp_replace(F.regexp_replace(lowered, "@.*$", ""), "^(.*/)?([^/:]*)(:[^/]*)?$", "$1$2")
    source = F.regexp_replace(F.regexp_replace(F.regexp_replace(lowered, "^[a-z0-9]+::", ""), "[?].*$", ""), "^([a-z0-9+]+://)?([^@/]+@)?", "")
    source = F.regexp_replace(source, "^([^/:]*):(?![0-9])", "$1/")
    source = F.regexp_replace(F.regexp_replace(F.regexp_replace(source, "[.]git//", "//"), "[.]git$", ""), "/+$", "")
    spelled = (
        F.when(kind == "pypi", F.lower(F.regexp_replace(F.regexp_extract(name, "^[A-Za-z0-9][A-Za-z0-9._-]*", 0), "[-_.]+", "-")))
        .when(kind == "image", F.regexp_replace(image, "^(docker[.]io/)?(library/)?", ""))
        .when(kind == "role", F.substring_index(F.regexp_replace(lowered, "/+$", ""), "/", -1))
        .when(kind == "host", F.regexp_replace(lowered, "[.]+$", ""))
        .when(kind == "tfmodule", source)
        .when((kind == "package") & F.contains(name, F.lit("%")), "")
        .otherwise(lowered)
    )
    return F.substring(F.when(F.contains(name, F.lit("$")), "").otherwise(spelled), 1, 255)


def ancestors(id_: Column) -> Column:
    """Every directory above an id, nearest first: a/b/c -> a/b/, a/."""
    parts = F.split(F.regexp_replace(id_, "/$", ""), "/")
    n = F.size(parts)
    above = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, n - i), "/"), F.lit("/")))
    return F.when(n > 1, above).otherwise(F.array().cast("array<string>"))


def directory(path: Column) -> Column:
    """The part up to the last slash, ./ where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("./"))


def extension(path: Column) -> Column:
    """The last segment's ending with its dot, in lower case; the whole segment without a dot."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(F.instr(last, ".") > 0, F.concat(F.lit("."), F.lower(F.element_at(F.split(last, r"\."), -1)))).otherwise(last)


def line_of(id_: Column) -> Column:
    """The line behind @L at an id's end."""
    return F.nullif(F.regexp_extract(id_, "@L([0-9]+)$", 1), F.lit("")).cast("int")


def text_hash(text: Column) -> Column:
    """md5 with all line ends alike."""
    return F.md5(F.regexp_replace(text, "\r\n?", "\n").cast("binary"))


def token_estimate(text: Column) -> Column:
    """Four characters make a token."""
    return F.ceil(F.length(text) / 4).cast("long")


def first_sentence(text: Column, most: int = 300) -> Column:
    """A summary's first line; beyond ``most`` characters its first sentence, else cut at a word."""
    line = F.regexp_extract(F.trim(text), "^[^\n]*", 0)
    sentence = F.regexp_extract(line, r"^(.*?[.!?])( |$)", 1)
    cut = F.concat(F.regexp_replace(F.substring(line, 1, most - 3), r" [^ ]*$", ""), F.lit("..."))
    return F.when(F.length(line) <= most, line).when((sentence != "") & (F.length(sentence) <= most), sentence).otherwise(cut)
