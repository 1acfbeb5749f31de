"""Retrieval: lexical and vector lists, their fusion, reranking, interleaving and packing."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.text import cosine, lexical_words, similarity
from ..session import stage

#: Document frequencies stop here; the constant of rank fusion.
COMMON, FUSION = 2000, 60


def postings(texts: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """(id, term, tf) of the query's terms alone, counted within each row; other words are never rows."""
    words = F.filter(lexical_words(F.col(text_col)), lambda w: w.isin(terms))
    found = texts.select(F.col(id_col).alias("id"), words.alias("words"))  # no filter: it would split the words once more
    counted = F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("term"), F.size(F.filter("words", lambda x: x == w)).cast("long").alias("tf")))
    return found.select("id", F.inline(counted)).groupBy("id", "term").agg(F.sum("tf").alias("tf"))


def term_weights(found: DataFrame, common: int = COMMON) -> DataFrame:
    """(term, df, idf, common): capped document frequencies and ln(1 + cap / df)."""
    df = found.groupBy("term").agg(F.least(F.count(F.lit(1)), F.lit(common)).alias("df"))
    return df.select("term", "df", F.log(1 + F.lit(common) / F.col("df")).alias("idf"), (F.col("df") >= common).alias("common"))


def weighed(found: DataFrame, weights: DataFrame, depth: int | None) -> DataFrame:
    """(id, score, tf) of counts (id, term, tf): the share of the query's weight that a text has, ties by frequency, then id.

    Candidates come from rare terms unless all are common. ``weights`` has a row for each of a
    query's terms at most and is broadcast.
    """
    total = weights.agg(F.sum("idf").alias("total"), F.bool_and("common").alias("all_common"))
    rows = found.join(F.broadcast(weights), "term").crossJoin(F.broadcast(total))  # one row
    scored = rows.groupBy("id").agg(
        (F.sum("idf") / F.max("total")).alias("score"), F.sum("tf").alias("tf"), F.bool_or(~F.col("common") | F.col("all_common")).alias("picked")
    )
    out = scored.filter("picked").select("id", "score", "tf")
    return out if depth is None else out.orderBy(F.desc(F.round("score", 9)), F.desc("tf"), "id").limit(depth)


def lexical_search(texts: DataFrame, id_col: str, text_col: str, terms: list[str], depth: int) -> DataFrame:
    """``weighed`` over texts that have no index; they are read once."""
    found = stage(postings(texts, id_col, text_col, terms), "postings")
    return weighed(found, term_weights(found), depth)


def phrase_search(texts: DataFrame, id_col: str, text_col: str, phrase: list[str]) -> DataFrame:
    """(id, score): texts that hold the words one after another; they score 2 and so come first."""
    joined = F.concat(F.lit(" "), F.array_join(lexical_words(F.col(text_col)), " "), F.lit(" "))
    return texts.filter(joined.contains(" " + " ".join(phrase) + " ")).select(F.col(id_col).alias("id"), F.lit(2.0).alias("score"))


def name_search(rows: DataFrame, id_col: str, name_col: str, question: str, part: str, patterns: list[str], depth: int, least: float = 0.3) -> DataFrame:
    """(id, score): names like the question by trigrams, holding ``part``, or fitting one of the ILIKE ``patterns``."""
    name, near = F.col(name_col), similarity(F.col(name_col), F.lit(question))
    fits = F.lit(False)
    for p in patterns:
        fits = fits | name.ilike(p)
    holds = name.ilike(f"%{part}%")
    score = F.greatest(near, F.when(holds, 0.5).otherwise(0.0), F.when(fits, 0.4).otherwise(0.0))
    found = rows.filter((near >= least) | holds | fits).select(F.col(id_col).alias("id"), score.alias("score"))
    return found.orderBy(F.desc(F.round("score", 6)), "id").limit(depth)


def summary_search(rows: DataFrame, id_col: str, summary_col: str, terms: list[str], depth: int) -> DataFrame:
    """(id, score): summaries with any of the words, by how many of them, then by their share of the summary."""
    words = lexical_words(F.col(summary_col))
    hits = F.filter("words", lambda w: w.isin(terms))
    found = rows.select(F.col(id_col).alias("id"), words.alias("words")).withColumns({"n": F.size(hits), "kinds": F.size(F.array_distinct(hits))})
    score = F.col("kinds") + F.col("n") / (F.col("n") + F.size("words"))
    return found.filter("n > 0").select("id", score.alias("score")).orderBy(F.desc(F.round("score", 6)), "id").limit(depth)


def best_rows(rows: DataFrame, depth: int) -> DataFrame:
    """The union of lists (project, id, score, matched): the best row of each id, ``depth`` of each project, with their place."""
    best = rows.groupBy("project", "id").agg(F.max(F.struct("score", "matched")).alias("b")).select("project", "id", "b.matched", "b.score")
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc(F.round("score", 9)), "id")).cast("long")
    return best.withColumn("place", place).filter(F.col("place") <= depth)


def depths(limit: int) -> tuple[int, int]:
    """(rows, chunks) that each list brings for an answer of ``limit`` rows."""
    depth = max(3 * limit, 50)
    return depth, 4 * depth


def by_mode(mode: str, lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """One list alone, or both fused, by the ranks they have in their lists."""
    if mode == "hybrid":
        return fuse(lexical, vector)
    return fuse(lexical, vector.limit(0)) if mode == "lexical" else fuse(lexical.limit(0), vector)


def snippet(matched: Column, text: Column, start: Column, end: Column, summary: Column, most: int = 400) -> Column:
    """What matched: the lines of a source hit, or the summary; null where that is empty."""
    lines = F.array_join(F.slice(F.split(text, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")
    return F.nullif(F.substring(F.when(matched == "source", lines).when(matched == "summary", summary), 1, most), F.lit(""))


def origin(source: Column) -> Column:
    """How a text came to be, for readers; null where it is the file's own."""
    return F.when(source == "manual", "written by hand").when(source == "llm", "from a model")


def vector_search(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], depth: int) -> DataFrame:
    """(id, score): nearest by cosine, exact."""
    near = cosine(F.col(vector_col), F.array(*map(F.lit, query)))
    return vectors.select(F.col(id_col).alias("id"), near.alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(depth)


def ranked(top: DataFrame, name: str, *order: Column) -> DataFrame:
    """``top`` with its rank; it is a list of bounded depth, so one task orders it."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def fuse(lexical: DataFrame, vector: DataFrame, constant: int = FUSION) -> DataFrame:
    """(id, rrf, lexical_rank, vector_rank): reciprocal ranks of both lists added up."""
    a = ranked(lexical, "lexical_rank", F.desc(F.round("score", 9)), F.desc("tf"), F.col("id")).select("id", "lexical_rank")
    b = ranked(vector, "vector_rank", F.desc(F.round("score", 9)), F.col("id")).select("id", "vector_rank")
    part = lambda c: F.coalesce(1 / (constant + F.col(c)), F.lit(0.0))
    return a.join(b, "id", "full").select("id", (part("lexical_rank") + part("vector_rank")).alias("rrf"), "lexical_rank", "vector_rank")


def rerank(rows: DataFrame, bonuses: dict[str, tuple[Column, float]], unit: float = 1 / (FUSION + 1)) -> DataFrame:
    """``rows`` with ``score``: rrf and, in units of a first rank, what each condition or amount adds."""
    total = F.lit(0.0)
    for what, weight in bonuses.values():
        total = total + what.cast("double") * weight
    return rows.withColumn("score", F.col("rrf") + total * unit)


def round_robin(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with ``place`` and ``total`` in their group: sorted by place, groups take turns.

    Rows are dealt by ranges of the order, so a long group is spread over tasks: a place is
    the group's rows in the ranges before and the place within the range.
    """
    dealt = stage(rows.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()), "turns")
    parts = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)  # a row a range
    before = F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_rows").over(whole).alias("total"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    placed = dealt.withColumn("_within", within)
    placed = placed.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return placed.select(*rows.columns, (F.col("_start") + F.col("_within")).alias("place"), "total")


def pack(rows: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """``rows`` with ``packed``: each key takes its rows in order while they fit, and skips those that do not.

    A task reads its rows sorted and carries one key and what is left of its budget, so a
    long key costs no memory; its rows are one task's, as each depends on those before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, budget
        for batch in batches:
            out = []
            for name, price in zip(batch.column(key).to_pylist(), batch.column(cost).to_pylist(), strict=True):
                if name != last and (name == name or last == last):  # NaN is one key
                    last, left = name, budget
                out.append(price is not None and price <= left)
                left -= price if out[-1] else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "packed"])

    dealt = rows.repartition(key).sortWithinPartitions(key, F.asc_nulls_last(order))
    return dealt.mapInArrow(run, StructType([*rows.schema.fields, StructField("packed", BooleanType())]))


def chunk_lines(texts: DataFrame, id_col: str, text_col: str, most: int = 1500, overlap: int = 5, entities: str | None = None, slack: float = 0.4) -> DataFrame:
    """(id, chunk, start_line, end_line, entity, text): windows of whole lines.

    Lines are packed to ``most`` characters, their ends counted; a longer line is a window
    of its own. The next window repeats up to ``overlap`` lines but always moves on. Blank
    windows are left out. ``entities`` names an array column of (line, name): a full window is
    cut before an entity that starts in its last part, a share of ``slack``, and the next one
    begins there; ``entity`` is the one a window starts in, else the first within. A text is
    read by one task and leaves it row by row.
    """

    def cut(text: str, known: list[tuple[int, str]]) -> Iterator[tuple[int, int, str | None, str]]:
        lines = text.splitlines()
        starts = [line for line, _ in known]
        cuts = sorted({line - 1 for line in starts if line > 1})
        start = 0
        while start < len(lines):
            end, size = start, 0
            while end < len(lines) and (end == start or size + len(lines[end]) + 1 <= most):
                size += len(lines[end]) + 1
                end += 1
            at = bisect_right(cuts, end) - 1
            clean = end < len(lines) and at >= 0 and start + max(1, int((end - start) * (1 - slack))) <= cuts[at]
            end = cuts[at] if clean else end
            part = "\n".join(lines[start:end])
            if part.strip():
                inside = bisect_right(starts, start + 1)
                name = known[max(inside - 1, 0)][1] if inside or (starts and starts[0] <= end) else None
                yield start + 1, end, name, part
            if end >= len(lines):
                return
            start = end if clean else max(start + 1, end - overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = ([] if x is None else sorted((e["line"], e["name"]) for e in x) for x in batch["entities"])
            rows = [(i, n, *c) for i, t, e in zip(batch["id"], batch["text"], known, strict=True) for n, c in enumerate(cut(t or "", e))]
            yield pd.DataFrame(rows, columns=["id", "chunk", "start_line", "end_line", "entity", "text"])

    kind = texts.schema[id_col].dataType.simpleString()
    known = F.col(entities) if entities else F.lit(None)
    named = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), known.cast("array<struct<line:int,name:string>>").alias("entities"))
    return named.mapInPandas(run, f"id {kind}, chunk int, start_line int, end_line int, entity string, text string")


def embedding_input(path: Column, entity: Column, text: Column) -> Column:
    """What a model reads of a chunk: path, entity and text, each on its line."""
    return F.concat_ws("\n", path, entity, text)
