"""The range query reads every document."""

import duckdb

from lattica.plans import QUERIES


def test_range_of_every_document(spark, tmp_path):
    duckdb.sql("SELECT range AS doc_id, concat_ws(chr(10), 'a' || range, 'b' || range, 'c' || range, 'd') AS text FROM range(25)").write_parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["range_read_all"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, 2, 3, f"b{i}\nc{i}") for i in range(25)]
