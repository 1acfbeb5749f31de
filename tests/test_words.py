"""The stored word index: refreshes touch what has changed, searches equal those over texts."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import retrieval, words

TERMS = ["an", "ox", "blue", "rare"]


def texts(seed=1, n=120):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(["an", "ox", "blueSky", "rare", "the", "x1"], [9, 6, 2, 1, 9, 3], k=rng.randint(0, 30)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def found(df):
    return [(r.id, round(r.score, 9), r.tf) for r in df.collect()]


@pytest.fixture
def index(spark, tmp_path):
    return words.WordIndex(spark, str(tmp_path / "index"))


def test_refreshes_write_what_has_changed_only(spark, index):
    rows = texts()
    assert index.refresh(frame(spark, rows), "id", "text") == 0
    assert index.refresh(frame(spark, rows[::-1]), "id", "text") == 0  # nothing new
    rows = [(i, t + " rare rare" if i % 9 == 0 else t) for i, t in rows if i % 10] + [(500, "an ox"), (501, None)]
    assert index.refresh(frame(spark, rows), "id", "text") == 1
    written = {r.id for r in spark.read.parquet(f"{index.path}/postings/gen=1").select("id").distinct().collect()}
    assert written == {i for i, t in rows if i % 9 == 0 and i < 500} | {500}
    now = frame(spark, rows)
    for terms in (TERMS, ["rare"], ["none"], ["the", "x1"]):
        want = found(retrieval.lexical_search(now, "id", "text", terms, 40))
        assert found(index.search(words.Question(tuple(terms)), 40)) == want
    for phrase in ("an ox", "blue sky", "the the the", "rare rare", "none"):
        want = {r.id for r in retrieval.phrase_search(now, "id", "text", phrase.split()).collect()}
        assert {r.id for r in index.holding(phrase).collect()} == want
    assert index.refresh(now.limit(0), "id", "text") == 2 and index.postings().count() == 0


def test_a_refresh_that_breaks_off_does_not_count(spark, index):
    index.refresh(frame(spark, texts()), "id", "text")
    before = found(index.search(words.Question(("rare",)), 20))
    frame(spark, [(1, "x")]).write.parquet(f"{index.path}/postings/gen=1")  # postings without their docs
    assert index.generations() == [0] and found(index.search(words.Question(("rare",)), 20)) == before
    assert index.refresh(frame(spark, [(1, "rare")]), "id", "text") == 1
    assert [r.id for r in index.search(words.Question(("rare",)), 20).collect()] == [1]


def test_questions(spark, index):
    rows = [(1, "The parser reads parseTree nodes"), (2, "parsing the tree"), (3, "a tree of names"), (4, "readers of trees"), (4, "parse"), (5, None), (None, "tree"), (6, "tree x parse x " * 1500)]
    index.refresh(frame(spark, rows), "id", "text")
    assert words.asked(spark, "parsing trees") == words.Question(("pars:*", "tree:*"))
    ids = lambda text: [r.id for r in index.search(words.asked(spark, text), 10).collect()]
    assert set(ids("parsing trees")) == {1, 2, 3, 4, 6}
    assert ids("parseTree")[0] == 1  # spelt like a symbol: it must stand whole to come first
    assert set(ids('"the tree" OR names -parsing')) == {3} and set(ids("tree -of -parsing")) == {1, 6}
    assert words.asked(spark, "") == words.Question(()) and ids("") == []
    assert index.postings().filter(F.col("id") == 6).select(F.sum("tf")).first()[0] == 6000


def test_words_are_brought_together_where_texts_are_read(spark, index):
    rows = [(1, "an ox an ox"), (1, "an ox an ox"), (2, "ox an"), (3, ""), (4, None), (None, "an ox")]
    index.refresh(frame(spark, rows), "id", "text")
    held = {(r.word, r.id, r.tf, tuple(r.positions)) for r in index.postings().collect()}
    assert held == {("an", 1, 2, (0, 2)), ("ox", 1, 2, (1, 3)), ("ox", 2, 1, (0,)), ("an", 2, 1, (1,))}
    for phrase, want in (("an ox", {1}), ("ox an", {1, 2}), ("ox", {1, 2}), ("ox ox", set()), ("an ox an", {1})):  # a text that is there twice holds its phrases, too
        assert {r.id for r in index.holding(phrase).collect()} == want
    assert {(r.id, r.tf) for r in index.found(("an",)).collect()} == {(1, 4), (2, 1)}
