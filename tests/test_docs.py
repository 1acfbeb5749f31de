"""Docstrings and comments of entities."""

from pyspark.sql import functions as F

from lattica import catalog
from lattica.functions import docs

CASES = [
    ('def f():\n    """One."""', 1, "One."), ('def f():\n\n\n    """\n    Two.\n    """', 1, "Two."), ("def f():\n    '''Three''' + x", 1, "Three"), ("def f():\n    u'''Four", 1, "Four"),
    ("def f():\n    'no'", 1, ""), ("def f():", 1, ""), ('def f(a=")",\n  b={1: [2]}):  # :(\n  """Five."""', 1, "Five."), ('x = (\n  1\n)\n"""Six."""', 1, ""), ('def f():\n    fr"""No."""', 1, ""),
    ('def f() \\\n  :\n  """Seven."""', 1, "Seven."), ("def f(" + "\n a," * 38 + '\n):\n """Forty."""', 1, "Forty."), ("def f(" + "\n a," * 39 + '\n):\n """Too far."""', 1, ""),
    ('def f(a="' + "x\\\"" * 20_000 + '"):\n """Long."""', 1, "Long."), ("# A\n# B\ndef f(): pass", 3, "A"), ("#\n#   \n# @param\n## B ##\n@x\n#[y]\nfn f()", 7, "B"), ("# A\n\ndef f(): pass", 3, ""),
    ('# A\n"""\ndef f(): pass', 3, ""), ("#! x\n# B\nf()", 3, "B"), ("/* 'Quoted' */\nf()", 2, "Quoted"), ("x = 1\n// A\n\t// B\nf()", 4, "A"), ("# Above\ndef f():\n  '''Below'''", 2, "Below"),
    ("# A\nf()", 0, ""), ("# A\nf()", 3, ""), ("# A\nf()", -4, ""), ("", 1, ""), ("# " + "y" * 900 + "\nf()", 2, "y" * 300), ("<!-- Seen -->\n<f>", 2, "Seen"), (None, 1, None), ("# A\nf()", None, None),
]


def test_summaries_of_entities(spark):
    rows = spark.createDataFrame([(i, text, start) for i, (text, start, _) in enumerate(CASES)], "i int, text string, start int")
    got = {r.i: r.x for r in rows.select("i", docs.entity_summary(F.split("text", "\n"), F.col("start")).alias("x")).collect()}
    for i, (text, start, want) in enumerate(CASES):
        assert (got[i] or None) == (want or None), (text, start, got[i])


def test_a_signature_is_read_once_a_row(spark):
    rows = spark.range(1).select(docs.entity_summary(F.split(F.lit("f()"), "\n"), F.lit(1)).alias("x"))
    assert rows._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1


def test_rows_of_a_small_file_are_dealt_out(spark):
    rows = catalog.spread(spark.range(100, numPartitions=1))
    assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and rows.count() == 100
