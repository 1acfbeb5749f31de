"""Texts as sources: files of a tree, lines, ranges of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_hash


def read_tree(spark: SparkSession, root: str, ignored: list[str] = (), pattern: str = "*") -> DataFrame:
    """(path, size, modified, content, hash) of the text files below ``root``; ``ignored`` are directory names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    for name in ignored:
        files = files.filter(~F.col("path").contains(f"/{name}/"))
    files = files.filter(F.instr(F.decode("content", "ISO-8859-1"), "\u0000") == 0)  # binary files fall out
    text = F.decode("content", "UTF-8")
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), text.alias("content"), text_hash(text).alias("hash"))


def shebang_extension(text: Column) -> Column:
    """The ending a script's first line stands for; null without one."""
    name = F.regexp_extract(F.substring(text, 1, 200), r"^#!\s*\S*?/?(?:env\s+)?([a-z]+)[0-9.]*\s*(?:\n|$|\s)", 1)
    return F.when(name.isin("python", "pypy"), ".py").when(name.isin("sh", "bash", "zsh", "dash", "ksh"), ".sh").when(name == "node", ".js").when(name == "ruby", ".rb").when(name == "perl", ".pl").when(name == "php", ".php")


def lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, text), lines from 1."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def grep(texts: DataFrame, id_col: str, text_col: str, pattern: str, limit: int, fixed: bool = False) -> DataFrame:
    """(id, line, text): the first matching lines by id and line, regardless of case.

    Texts without a match fall out before their lines are taken apart.
    """
    hit = (lambda c: F.lower(c).contains(pattern.lower())) if fixed else (lambda c: c.rlike("(?im)" + pattern))
    return lines(texts.filter(hit(F.col(text_col))), id_col, text_col).filter(hit(F.col("text"))).orderBy("id", "line").limit(limit)


def read_ranges(texts: DataFrame, ranges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start, end, text) of ``ranges`` (id, start, end): lines from start to end; null where there is no text."""
    parts = F.split(F.col(text_col), "\n", -1)
    found = ranges.join(texts.select(F.col(id_col).alias("id"), text_col), "id", "left")
    text = F.array_join(F.slice(parts, F.col("start"), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0))), "\n")
    return found.select("id", "start", "end", text.alias("text"))


#: Files that are never read, whoever asks (fixed values): secrets by name or ending.
SECRETS = r"(^|/)(\.env(\..*)?|\.netrc|\.pgpass|id_rsa|id_ed25519|credentials)$|\.(pem|key|p12|pfx|keystore)$"


def read_content(files: DataFrame, limit: int, largest: int) -> DataFrame:
    """``files`` (path, size, text, ...) with text cut to ``limit`` characters, or none and the reason why."""
    reason = F.when(F.col("path").rlike(SECRETS), "not readable").when(F.col("size") > largest, "too large").when(F.instr("text", "\u0000") > 0, "binary")
    return files.withColumn("reason", reason).withColumn("text", F.when(F.col("reason").isNull(), F.substring("text", 1, limit)))


def _glob(pattern: str) -> str:
    """An ignore file's pattern as a regular expression on the path below the file's folder."""
    import re

    anchored, folder = "/" in pattern.rstrip("/"), pattern.endswith("/")
    body = re.escape(pattern.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(^|/)") + body + ("/" if folder else "(/|$)")


def ignored(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``files`` (path, ...) with ``ignored``, by the rules (folder, pattern) of ignore files, in order.

    The deepest folder with a rule that fits decides, and of its rules the last; a leading ! takes a path back.
    Comments and blank lines are no rules. Rules are a tree's ignore files, so they go into the plan.
    """
    found = F.lit(False)
    for folder, pattern in sorted(rules, key=lambda r: r[0].count("/")):  # the last one is asked first
        line = pattern.strip()
        if line and not line.startswith("#"):
            below = F.substring("path", F.lit(len(folder) + 1), F.length("path"))
            fits = F.col("path").startswith(folder) & below.rlike(_glob(line.lstrip("!")))
            found = F.when(fits, F.lit(not line.startswith("!"))).otherwise(found)
    return files.withColumn("ignored", found)
