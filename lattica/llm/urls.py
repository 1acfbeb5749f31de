"""URL filters: given rules by host and path, and rules mined from labelled URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import ascii_lower

#: The item of a transaction whose label is bad; no token has this form.
BAD = "label bad"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between :// and the next /, ? or #, A-Z in lower case; empty where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host up to ? or #."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):  # the last one is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        one = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, one).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: scheme, labels of the host, segments, ending, names in the query."""
    tag = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + " "), x))
    segments = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, "[0-9]+", "0"))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    return F.array_distinct(
        F.concat(
            tag("scheme", F.array(F.regexp_extract(url, "^([A-Za-z0-9+.-]*)://", 1))),
            tag("host", F.split(host, r"\.")),
            tag("path", segments),
            tag("ending", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
            tag("query", names),
            tag("part", F.array(F.when(F.instr(url, "#") > 0, "fragment").otherwise(""))),
        )
    )


def mine(
    urls: DataFrame, url_col: str, bad_col: str, min_support: float = 0.002, min_confidence: float = 0.8, min_urls: int = 10, margin: float = 0.1, z: float = 3.0
) -> DataFrame:
    """Rules (rule_id, items, confidence, support): token sets whose urls are bad.

    FP-growth over the token sets of labelled urls, the label among the items. A rule stays if
    ``min_urls`` urls hold it and a share of ``min_support`` is bad with it, if its confidence is
    high enough and lies above the share of bad urls among all by ``margin`` even at the lower
    end of its interval (Wilson's, ``z`` standard deviations), and if no part of it does as well
    alone. So a few urls that happen to be bad make no rule. No labelled urls, no rules. Nulls in
    either column are ignored; repeated rows count each.
    """
    url = F.col(url_col)
    rows = urls.filter(url.isNotNull() & F.col(bad_col).isNotNull())
    bad = F.when(F.col(bad_col), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    rows = stage(rows.select(F.concat(tokens(url, host_of(url), path_of(url)), bad).alias("items")), "url-items")
    n, base = rows.agg(F.count(F.lit(1)), F.avg(F.array_contains("items", BAD).cast("double"))).first()
    if not n:
        return urls.sparkSession.createDataFrame([], "rule_id long, items array<string>, confidence double, support double")
    least = min(1.0, max(min_support, min_urls * min_confidence / n))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(rows)
    p, held = F.col("confidence"), F.round(F.col("support") * n / F.col("confidence"))
    low = (p + z * z / (2 * held) - z * F.sqrt(p * (1 - p) / held + z * z / (4 * held * held))) / (1 + z * z / held)
    rules = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BAD))) & (held >= min_urls) & (low >= base + margin))
    rules = stage(rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support"), "url-rules")
    one_less = rules.filter(F.size("items") > 1).select(
        "items", "confidence", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part")
    )
    parts = rules.select(F.col("items").alias("part"), F.col("confidence").alias("_c"))
    needless = one_less.join(parts, "part").filter(F.col("_c") >= F.col("confidence")).select("items").distinct()
    kept = rules.join(needless, "items", "left_anti")
    return kept.select(F.xxhash64("items").alias("rule_id"), "items", "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct urls that hold all items of a rule, through an index from item to rules."""
    index = rules.select(F.explode("items").alias("item"), "rule_id", F.size("items").alias("n"))
    url = F.col(url_col)
    known = urls.select(url.alias("url")).filter(url.isNotNull()).distinct()
    items = known.select("url", F.explode(tokens(F.col("url"), host_of(F.col("url")), path_of(F.col("url")))).alias("item"))
    hits = items.join(index, "item").groupBy("url", "rule_id").agg(F.count(F.lit(1)).alias("hit"), F.first("n").alias("n"))
    return hits.filter("hit = n").select("url").distinct()


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    given: tuple[Rule, ...],
    id_col: str = "page_id",
    url_col: str = "url",
    bad_col: str = "bad",
    min_support: float = 0.002,
    min_confidence: float = 0.8,
    min_urls: int = 10,
) -> DataFrame:
    """One row per row of ``pages``: id_col, host, path, rule, verdict.

    The longest given rule decides, of two of one length the one given first; where none fits, a url that a mined rule matches is
    blocked and any other allowed. A null url, or one without ://, has an empty host and
    path and fits no rule. Urls are matched once each, so copies cost nothing. Other
    columns are ignored, so none can clash; an empty table gives an empty one.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)})
    rows = rows.withColumn("given", given_rule(F.col("host"), F.col("path"), given))
    rules = mine(labelled, url_col, bad_col, min_support, min_confidence, min_urls)
    open_ = rows.filter(F.col("given").isNull())
    hit = matched(open_, rules, "url").withColumns({"hit": F.lit(True), "check": F.hash("url")})
    out = rows.withColumn("check", F.hash("url")).join(hit, ["url", "check"], "left")
    own = F.when(F.col("hit"), "block").otherwise("allow")
    return out.select(
        F.col("_id").alias(id_col), "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", own).alias("verdict")
    )
