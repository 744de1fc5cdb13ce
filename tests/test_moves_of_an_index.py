"""What of a stored index moves: texts once, lists whole and once, and of a corpus nothing."""

import re

import pytest
from pyspark.sql import functions as F

from siftstone.operators import postings, retrieval, rounds


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_gone_documents_meet_whole_lists_by_their_block(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(postings, "BLOCK", 2)
    monkeypatch.setattr(postings, "QUERY_WORDS", few)
    rows = [(1, "heart failure"), (2, "potassium heart"), (3, None), (None, "renal heart"), (5, "zinc heart heart"), (6, "failure of iron"), (7, "heart")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    path = str(tmp_path / "index")
    postings.refreshed(frame([*rows, (8, "heart zinc"), (9, "")]), path, "id", "text")
    now = [(i, "iron of the heart" if i in (2, None) else x) for i, x in rows if i != 6]
    postings.refreshed(frame(now), path, "id", "text")
    asked = spark.createDataFrame([(1, "heart zinc potassium"), (2, "failure renal iron")], "q int, text string")
    rows_of = lambda df: sorted((r.q, r["rank"], str(r.id), round(r.score, 9)) for r in df.withColumnRenamed("query_id", "q").collect())
    found = postings.search(asked, path, "q", "text", 5)
    assert rows_of(found) == rows_of(retrieval.bm25(asked, frame(now), "q", "text", "id", "text", 5)) and found.count() > 6
    # Only what is more than is sent to all tasks is dealt anew.
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and (not few or not any(re.search(r"\b_?id#", x) for x in dealt))


def test_documents_of_a_refresh_are_all_remembered(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(1, "heart"), (2, None), (2, "b"), (None, "of the"), (None, "heart"), (4, ""), (5, "the heart of it")]
    docs = spark.createDataFrame(rows, "id long, text string")
    postings.refreshed(docs, path, "id", "text")
    there = spark.read.parquet(f"{path}/data/segment=*/kind=documents").collect()
    want = docs.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("sign")).groupBy("id").agg(F.max("sign").alias("sign")).collect()
    assert sorted(((r.id, r.sign) for r in there), key=str) == sorted(((r.id, r.sign) for r in want), key=str)
    assert postings.refreshed(docs, path, "id", "text") == 1
    kept = {p.name for p in next((tmp_path / "index" / "data").iterdir()).iterdir()}
    assert kept == {"kind=postings", "kind=documents"} and not list((tmp_path / "index").glob("data/*/kind=postings/bucket=-1"))


def test_hits_are_sent_to_the_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"heart word{i}") for i in range(9)], "id long, text string")
    path = str(tmp_path / "index")
    postings.refreshed(docs, path, "id", "text")
    corpus = docs.select("id", F.lit("s").alias("source_id"), F.col("id").alias("chunk_id"), F.lit("t").alias("title"), F.col("text").alias("snippet"))
    found = rounds.by_index(path, corpus, 2)(spark.createDataFrame([(1, "heart word3")], "query_id int, text string"))
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == [3, 0]
    assert "strategy=broadcast" in found._jdf.queryExecution().analyzed().toString()
