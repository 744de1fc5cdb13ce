"""Hits meet their texts without moving these."""

from siftstone.operators import retrieval


def test_texts_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id int, text string")
        hits = spark.createDataFrame([(1, 3), (1, 4), (2, 3), (2, 99)], "query_id int, id int")
        got = retrieval.with_rows(hits, docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.query_id, r.id, r.text) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == [(1, 3, "text 3"), (1, 4, "text 4"), (2, 3, "text 3")]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
