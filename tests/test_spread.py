from lattica.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_manifests_are_read_by_all_cores(spark):
    assert "RoundRobinPartitioning" in QUERIES["manifest_formats"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_questions_and_pools_are_worked_on_by_all_cores(spark):
    for name in ("lexical_terms", "whole_terms", "rerank_features"):
        assert "RoundRobinPartitioning" in QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
