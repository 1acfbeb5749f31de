"""A repeated id joins what its rows are equal to, though others stand for them in the search."""

from lattica.llm import embeddings, jaccard

ONE, TWO = "a b c d e f g", "q r s t u v w"


def test_texts_of_one_id(spark):
    docs = spark.createDataFrame([(3, ONE), (4, TWO), (5, ONE), (5, TWO), (9, "z z y y x x"), (9, "z z y y x x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert got == [(3, 3), (4, 3), (5, 3), (5, 3), (9, 9), (9, 9)]


def test_vectors_of_one_id(spark):
    rows = [(3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (9, [-1.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_dedup(vectors).collect())
    assert got == [(3, 1, 3), (4, 1, 3), (5, 1, 3), (5, 1, 3), (9, 0, 9)]
