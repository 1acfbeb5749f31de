"""A corpus pipeline: quality, repeated lines, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, jaccard, line_dedup, mixing, quality
from lattica.llm.text import WORD
from lattica.session import discard, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the folder's labels, does not reject.

    Null and empty texts are scored as texts without words; rows that repeat an id are judged
    one by one; without labels of two kinds the score is the labels' rate, 0.5 without any.
    """
    machine = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), machine).filter("score >= 0.5").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first; n_chars follows the text. All rows stay."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; rows without an id stay.

    Lines have gone before, so a copy may have lost what it shares with its original. Therefore
    documents are searched twice, by the texts that they have now and by those that ``documents``
    has for their ids, and a document goes that is not the smallest of its group in either
    search. The two are never compared with each other. Empty and null texts are in no group.
    Rows that repeat an id are one document, which stays or goes whole; an id that ``documents``
    does not have is searched by its text alone. Texts may be of any length.
    """
    here = docs.select("doc_id").distinct()
    whole = stage(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").join(here, "doc_id", "left_semi"), "whole-texts")
    by_whole = stage(_copies(whole), "copies-by-whole-texts")
    discard(whole)
    gone = by_whole.union(_copies(docs.select("doc_id", "text"))).distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def _copies(texts: DataFrame) -> DataFrame:
    return jaccard.near_duplicates(texts).filter("component_id != doc_id").select("doc_id")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; where a budget ends within one, its first words.

    Documents without words take nothing of a budget and go. A null source is one of its own. Rows
    that repeat an id are taken each on its own; a very long text is taken in part where a budget
    ends within it.
    """
    mix = mixing.mix(docs.select(*COLUMNS), carry=("text", "lang"))
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("rest").cast("int")), " ")
    mix = mix.filter("taken > 0").withColumn("rest", F.col("taken") % F.col("size"))
    parts = F.when(F.col("rest") > 0, F.array(first_words)).otherwise(F.array().cast("array<string>"))
    copies = F.concat(F.array_repeat("text", F.floor(F.col("taken") / F.col("size")).cast("int")), parts)
    out = mix.select("doc_id", F.explode(copies).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row, repeated ones too; null and empty texts have no ids, a very long one has all."""
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.encode_decode(docs, vocabulary, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing", mixed_sources),
    ("byte-level BPE", tokens),
]

#: The classifier and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, function) in enumerate(STAGES[:-1]):
        before, docs = docs, stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
