"""A query on entities of sources: every part is a function with a docstring, a comment or neither."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import docs
from .registry import query

#: Sources by the part's number, and the line at which the function begins.
SOURCES = [
    ("# About {n}.\n# More.\n@cached\n@other(1)\ndef f(a, b):\n    return a", 5),
    ("# Not this.\ndef f(\n    a='x:)', # (:\n    b=(1, 2),\n):\n\n    r'''Makes {n}, ''' + '''x'''\n", 2),
    ("import x\nclass A:\n    \"\"\"\n    Holds {n}.\n    \"\"\"\n", 2),
    ("/**\n * Takes {n}.\n * @param a\n */\nfunction f(a) {", 5),
    ("#!/bin/sh\ndef f(a): return a", 2),
    ("-- Sums {n};\n<!-- -->\ncreate view v", 3),
    ("x = 1\n# Old {n}\n\ndef f(a) \\\n        -> int:\n\t\"\"\" Kept {n}\"\"\"", 4),
    ("def f():\n    pass", 9),
]


@query(
    """SELECT p_partkey AS id, replace(['About {n}.', 'Makes {n},', 'Holds {n}.', 'Takes {n}.', '', 'Sums {n}', 'Kept {n}', ''][CAST(p_partkey % 8 + 1 AS INT)], '{n}', p_name) AS summary FROM part"""
)
def entity_summaries(s, d):
    k = (F.col("p_partkey") % len(SOURCES) + 1).cast("int")
    source = F.element_at(F.array(*(F.lit(text) for text, _ in SOURCES)), k)
    start = F.element_at(F.array(*(F.lit(at) for _, at in SOURCES)), k)
    rows = catalog.spread(catalog.table(s, d, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").alias("id"), F.split(F.replace(source, F.lit("{n}"), F.col("p_name")), "\n").alias("lines"), start.alias("start"))
    return rows.select("id", docs.entity_summary(F.col("lines"), F.col("start")).alias("summary"))
