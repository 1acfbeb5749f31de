"""Queries on the stored word index: questions from their text, phrases by places, refreshes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import catalog
from ..operators import words
from ..session import work_dir
from .queries import _POSTINGS, TERMS
from .registry import query

QUESTION = "Which thinging of the anedhes goes with erblees in shouing"
OPERATORS = 'ntan "and the" -erth OR whed'

_WORDS = r"""w AS (SELECT doc_id AS id, regexp_extract_all(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[a-z0-9]+') AS words FROM documents),
    each AS (SELECT id, unnest(words) AS word FROM w)"""
_SCORES = """weights AS (SELECT term, ln(1 + 2000 / least(count(*), 2000)) AS idf, count(*) >= 2000 AS common FROM found GROUP BY term),
    lexical AS (SELECT id, sum(idf) / (SELECT sum(idf) FROM weights) AS score, CAST(sum(tf) AS BIGINT) AS tf FROM found JOIN weights USING (term) GROUP BY id
        HAVING bool_or(NOT common OR (SELECT bool_and(common) FROM weights)))"""


@query(
    f"""WITH {_WORDS}, t AS (SELECT unnest(['thing', 'anedh', 'goes', 'erble', 'shou']) AS term),
    found AS (SELECT id, term, count(*) AS tf FROM each JOIN t ON starts_with(word, term) GROUP BY id, term), {_SCORES}
    SELECT id, round(score, 6) AS score, tf FROM lexical ORDER BY round(score, 9) DESC, tf DESC, id LIMIT 100"""
)
def question_search(s, d):
    """A question in words: its stems are beginnings of words."""
    found = catalog.word_index(s, d).search(words.asked(s, QUESTION), 100)
    return found.select("id", F.round("score", 6).alias("score"), "tf")


@query(
    f"""WITH {_WORDS}, found AS (SELECT id, word AS term, count(*) AS tf FROM each WHERE word IN ('ntan', 'whed') GROUP BY ALL), {_SCORES},
    a AS (SELECT * FROM lexical UNION ALL SELECT id, 2.0, 1 FROM w WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' and the ')),
    b AS (SELECT id, max(score) AS score, max(tf) AS tf FROM a WHERE id NOT IN (SELECT id FROM each WHERE word = 'erth') GROUP BY id)
    SELECT id, round(score, 6) AS score, tf FROM b ORDER BY round(score, 9) DESC, tf DESC, id LIMIT 100"""
)
def question_with_operators(s, d):
    """A quoted phrase that ranks first, a word that must not be there, words beside an OR."""
    found = catalog.word_index(s, d).search(words.asked(s, OPERATORS), 100)
    return found.select("id", F.round("score", 6).alias("score"), "tf")


@query(f"WITH {_WORDS} SELECT id FROM w WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' the in the ')")
def index_phrase(s, d):
    """All texts that hold a phrase with a repeated word."""
    return catalog.word_index(s, d).holding("the in the")


@query(f"WITH {_POSTINGS} SELECT id, round(score, 6) AS score, tf FROM lexical")
def index_refreshed(s, d):
    """An index of an earlier state of all documents, brought up to the present one: texts changed, added and gone."""
    docs = catalog.table(s, d, "documents")
    at = F.abs("doc_id") % 10
    before = docs.filter(at != 4).select("doc_id", F.when(at == 3, F.concat(F.lit("the old erth "), "text")).otherwise(F.col("text")).alias("text"))
    before = before.union(docs.filter(at == 5).select(-F.col("doc_id") - 1, "text"))
    index = words.WordIndex(s, f"{work_dir(s)}/lattica/words-{uuid.uuid4().hex}")
    for state in (before, docs):
        index.refresh(state, "doc_id", "text")
    return index.search(words.Question(tuple(TERMS)), 200).select("id", F.round("score", 6).alias("score"), "tf")
