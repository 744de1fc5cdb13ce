import pytest
from pyspark.sql import functions as F

from siftstone.operators import postings


@pytest.fixture
def tasks(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_lists_are_made_where_their_block_lies(spark, tasks, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 2)
    texts = [(1, "heart failure"), (2, "potassium heart"), (3, None), (None, "renal heart"), (2, "zinc heart heart"), (6, "failure of iron"), (7, "heart")]
    docs = spark.createDataFrame(texts, "id long, text string")
    path = str(tmp_path / "index")
    postings.refreshed(docs.where("id IS NULL OR id <> 7").withColumn("text", F.when(F.col("id") == 1, "other").otherwise(F.col("text"))), path, "id", "text")
    postings.refreshed(docs, path, "id", "text")
    lists = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data/segment=*/kind=postings").withColumn("task", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1))
    per = lists.groupBy("segment", "block").agg(F.count_distinct("task").alias("n"), F.count("*").alias("lists")).collect()
    assert {r.n for r in per} == {1} and max(r.lists for r in per) > 1
    other = str(tmp_path / "fresh")
    postings.refreshed(docs, other, "id", "text")
    asked = spark.createDataFrame([(1, "heart zinc potassium"), (2, "failure renal iron other")], "query_id int, text string")
    found = lambda p: sorted((r.query_id, r["rank"], r.id or 0, round(r.score, 9)) for r in postings.search(asked, p, "query_id", "text", 5).collect())
    assert found(path) == found(other) and len(found(path)) > 5
