import numpy as np

from lattica.llm import quality
from lattica.session import BY_FILES, CLEAN_UP, MEASURED, stage


def test_packed_files_are_not_broadcast(spark):
    """A small file may hold many rows: beyond a megabyte it is joined by shuffles where a table is written."""
    before = [spark.conf.get(k, None) for k in (BY_FILES, MEASURED, CLEAN_UP)]
    few = stage(spark.range(700_000).selectExpr("id", "xxhash64(id) as h"), "some")  # about six megabytes of files
    size = few._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert 1 << 20 < size < 10 << 20
    stage(spark.range(3_000_000).join(few, "id"), "joined")
    store = spark._jsparkSession.sharedState().statusStore()
    plans = store.executionsList(store.executionsCount() - 1, 1)
    assert "BroadcastHashJoin" not in plans.apply(0).physicalPlanDescription()
    assert [spark.conf.get(k, None) for k in (BY_FILES, MEASURED, CLEAN_UP)] == before


def test_training_takes_arrays(spark, monkeypatch):
    """The driver's memory: features come as arrays, and never are Python objects one by one."""
    docs = spark.createDataFrame([(i, "good words here " * (i % 5 + 1) if i % 2 else f"x{i} !!") for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    fit, given = quality.Machine.fit, []
    monkeypatch.setattr(quality.Machine, "fit", lambda *a: given.append(a) or fit(*a))
    monkeypatch.setattr(quality, "chain", None)  # what strung lists together
    quality.train(docs, labels)
    row, column, x, label = given[0]
    assert len(row) == len(column) == len(x) and len(label) == row.max() + 1 and x.dtype == np.float64
