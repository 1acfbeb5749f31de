"""A stored index of words: postings with positions in ranges of words, kept up by generations.

``postings/gen=G`` has (word, id, text, tf, positions), sorted by word over its files, so a
search for words or for their beginnings reads the few row groups whose range may hold them.
``docs/gen=G`` has (id, hash) of what a generation brought, hash null for texts that are gone; it
is written last and makes the generation count, so a refresh that breaks off leaves no trace.
A posting is alive if no later generation names its id. Texts are read by a refresh only, and
split only if they have changed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import questions
from ..functions.text import lexical_words
from ..session import discard, stage
from .retrieval import COMMON, term_weights, weighed

#: Rows of a part of the postings, about; texts whose words are sorted together.
ROWS, TEXTS = 1 << 20, 256
DOCS = "id {kind}, hash string, gen int"


@dataclass(frozen=True)
class Question:
    """What a question asks for: terms of which any may match, phrases that rank first, words and phrases that must not be there."""

    terms: tuple[str, ...]  # ``ab`` or, as a beginning, ``ab:*``
    phrases: tuple[str, ...] = ()
    left_out: tuple[str, ...] = ()


def asked(spark: SparkSession, text: str) -> Question:
    """The question in a text. Stems are beginnings; identifiers spelt like symbols and quoted phrases must stand whole.

    Where the text uses quotes, OR or a leading minus its words are taken as they are.
    """
    t = F.lit(text)
    plain = F.regexp_replace(t, r'"[^"]*"|(^|\s)-\S+|\bOR\b', " ")
    words = F.array_distinct(F.filter(lexical_words(plain), questions.worth))
    web = questions.web_search(t)
    split = lambda a: F.transform(a, lambda p: F.array_join(lexical_words(p), " "))
    row = spark.range(1).select(
        F.coalesce(questions.prefix_terms(t), words).alias("terms"), split(F.concat(questions.whole_phrases(t), web["phrases"])).alias("phrases"), split(web["left_out"]).alias("left_out")
    ).first()
    return Question(*(tuple(dict.fromkeys(x for x in row[c] if x)) for c in ("terms", "phrases", "left_out")))


def places(rows: DataFrame) -> DataFrame:
    """(word, id, text, tf, positions) of rows (id, text, words): a row's words are brought together where it is read, so no word is shuffled by itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                lists = batch.column("words")
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), size)
                pos = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
                coded = lists.flatten().dictionary_encode()
                key = row.astype(np.int64) * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                stops = np.append(first, len(key))
                one = pa.array(order[first])
                owner = pa.array(row[order[first]])
                word = coded.dictionary.take(coded.indices.take(one))
                held = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(pos[order]))
                yield pa.RecordBatch.from_arrays([word, batch.column("id").take(owner), batch.column("text").take(owner), pa.array(np.diff(stops), pa.int64()), held], ["word", "id", "text", "tf", "positions"])

    return rows.mapInArrow(run, f"word string, id {rows.schema['id'].dataType.simpleString()}, text long, tf long, positions array<int>")


@dataclass(frozen=True)
class WordIndex:
    spark: SparkSession
    path: str

    def generations(self) -> list[int]:
        """Generations that count, oldest first."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        docs = jvm.org.apache.hadoop.fs.Path(f"{self.path}/docs")
        fs = docs.getFileSystem(conf)
        if not fs.exists(docs):
            return []
        whole = [s.getPath() for s in fs.listStatus(docs) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in whole)

    def _docs(self) -> DataFrame:
        """(id, hash, gen): the last word on every id."""
        rows = self.spark.read.option("basePath", f"{self.path}/docs").parquet(*(f"{self.path}/docs/gen={g}" for g in self.generations()))
        return rows.groupBy("id").agg(F.max("gen").alias("gen"), F.max_by("hash", "gen").alias("hash"))

    def refresh(self, texts: DataFrame, id_col: str, text_col: str) -> int:
        """Bring the index up to ``texts`` and return the generation; nothing is written if nothing has changed.

        Rows that repeat an id are one text with several parts; no phrase goes over their ends. Rows
        without an id are left out; null and empty texts have no words. Other columns are ignored.
        """
        rows = texts.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        sums = F.sum(F.xxhash64("text").cast("decimal(38,0)"))
        now = rows.groupBy("id").agg(F.concat_ws(":", F.count(F.lit(1)), sums).alias("hash"))
        known = self.generations()
        gen = known[-1] + 1 if known else 0
        if known:
            before = self._docs().filter("hash is not null").select("id", F.col("hash").alias("old"))
            now = now.join(before, "id", "full").filter("hash is null or old is null or hash != old").select("id", "hash")
            if now.isEmpty():
                return known[-1]
            rows = rows.join(now.filter("hash is not null").select("id"), "id", "left_semi")
        found = stage(places(rows.select("id", F.xxhash64("text").alias("text"), lexical_words(F.col("text")).alias("words"))), "word-places")
        parts = found.count() // ROWS + 1
        found.repartitionByRange(parts, "word", "id").sortWithinPartitions("word", "id").write.mode("overwrite").parquet(f"{self.path}/postings/gen={gen}")
        discard(found)
        now.write.mode("overwrite").parquet(f"{self.path}/docs/gen={gen}")
        return gen

    def postings(self) -> DataFrame:
        """(word, id, text, tf, positions) that are alive."""
        known = self.generations()
        rows = self.spark.read.option("basePath", f"{self.path}/postings").parquet(*(f"{self.path}/postings/gen={g}" for g in known))
        if len(known) == 1:
            return rows.drop("gen")
        later = self.spark.read.option("basePath", f"{self.path}/docs").parquet(*(f"{self.path}/docs/gen={g}" for g in known[1:]))
        later = later.groupBy("id").agg(F.max("gen").alias("last"))
        return rows.join(later, "id", "left").filter("last is null or gen = last").drop("gen", "last")

    def found(self, terms: tuple[str, ...]) -> DataFrame:
        """(id, term, tf) of words or beginnings of words."""
        fits = {t: F.col("word").startswith(t[:-2]) if t.endswith(":*") else F.col("word") == t for t in dict.fromkeys(terms)}
        if not fits:
            return self.postings().limit(0).select("id", F.col("word").alias("term"), "tf")
        rows = self.postings().filter(reduce(lambda a, b: a | b, fits.values()))
        term = F.array_compact(F.array(*(F.when(fit, F.lit(t)) for t, fit in fits.items())))
        return rows.select("id", "tf", F.explode(term).alias("term")).groupBy("id", "term").agg(F.sum("tf").alias("tf"))

    def holding(self, phrase: str) -> DataFrame:
        """(id) whose text has the words of ``phrase`` one after another: places that all words agree on, no text is read."""
        words = phrase.split()
        rows = self.postings().filter(F.col("word").isin(*words))
        if len(words) == 1:
            return rows.select("id").distinct()
        texts = rows.groupBy("id", "text").agg(F.collect_list(F.struct("word", "positions")).alias("rows"))  # a row for each of a phrase's words
        own = lambda word: F.flatten(F.transform(F.filter("rows", lambda r: r["word"] == word), lambda r: r["positions"]))
        before = lambda word, n: F.transform(own(word), lambda p: p - n)
        starts = [before(word, n) for n, word in enumerate(words)]
        return texts.filter(F.size(reduce(F.array_intersect, starts)) > 0).select("id").distinct()

    def search(self, question: Question, depth: int, common: int = COMMON) -> DataFrame:
        """(id, score, tf): by the share of the question's weight, ties by frequency, then id; texts that hold a phrase score 2 and so come first.

        Texts that hold what is left out are not among them. Terms of which all texts have none
        weigh nothing; without any term that is found only phrases count.
        """
        found = self.found(question.terms)
        out = weighed(found, term_weights(found, common), depth if not question.left_out else None)
        for phrase in question.phrases:
            tf = F.lit(1).cast("long").alias("tf")
            out = out.unionByName(self.holding(phrase).select("id", F.lit(2.0).alias("score"), tf))
        if question.phrases:
            out = out.groupBy("id").agg(F.max("score").alias("score"), F.max("tf").alias("tf"))
        for phrase in question.left_out:
            out = out.join(self.holding(phrase), "id", "left_anti")
        return out.orderBy(F.desc(F.round("score", 9)), F.desc("tf"), "id").limit(depth)
