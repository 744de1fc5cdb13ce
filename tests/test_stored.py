"""Versions, keyed tables, the stored keyword index and the file of vector cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.operators import cells, postings, retrieval
from siftstone.sources import tables, versions


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read(spark, path) == (0, {})
    assert versions.commit(spark, path, 0, {"a": 1}) == 1 and versions.commit(spark, path, 1, {"a": 2}) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, 1, {"a": 3})
    assert versions.read(spark, path) == (2, {"a": 2}) and versions.read(spark, path, 1) == (1, {"a": 1})
    assert versions.listed(spark, f"{path}/drafts") == []


def _rows(spark, path):
    return sorted(((r.k, r.v) for r in tables.table(spark, path).collect()), key=str)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    at = lambda rows: spark.createDataFrame(rows, "k long, v string, gone boolean, at int")
    put = lambda rows: tables.merge(at(rows), path, ["k"], F.col("gone"), [F.col("at").desc()], buckets=8)
    assert put([(i, "a", False, 0) for i in range(20)]) == 1
    before = versions.read(spark, path)[1]["folders"]
    assert put([(3, "b", False, 1), (3, "old", False, 0), (4, None, True, 1), (None, "n", False, 1)]) == 2
    after = versions.read(spark, path)[1]["folders"]
    touched = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(touched) <= 3 and _rows(spark, path) == sorted([(i, "a") for i in range(20) if i not in (3, 4)] + [(3, "b"), (None, "n")], key=str)
    assert put([(None, None, True, 2)]) == 3 and (None, "n") not in _rows(spark, path)
    assert [r.v for r in tables.table(spark, path, 1).where("k = 4").collect()] == ["a"]
    tables.swept(spark, path, keep=1)
    assert versions.numbers(spark, path) == [3] and len(_rows(spark, path)) == 19


def test_two_writers_of_one_bucket_conflict_of_two_buckets_not(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *ks: spark.createDataFrame([(k, "x") for k in ks], "k long, v string")
    tables.merge(rows(*range(40)), path, ["k"], buckets=8)
    bucket = {r.k: r.b for r in rows(*range(40)).select("k", F.pmod(F.xxhash64("k"), F.lit(8)).alias("b")).collect()}
    other = next(k for k in bucket if bucket[k] != bucket[0])
    mate = next(k for k in bucket if k and bucket[k] == bucket[0])
    meanwhile = lambda k: lambda: versions.read(spark, path)[0] == 1 and tables.merge(rows(k).withColumn("v", F.lit("y")), path, ["k"])
    with pytest.raises(versions.Conflict):
        tables.merge(rows(0).withColumn("v", F.lit("z")), path, ["k"], before_commit=meanwhile(mate))
    assert ("x",) == tuple(r.v for r in tables.table(spark, path).where("k = 0").collect())
    seen = versions.read(spark, path)[0]
    later = lambda: versions.read(spark, path)[0] == seen and tables.merge(rows(other).withColumn("v", F.lit("y")), path, ["k"])
    assert tables.merge(rows(0).withColumn("v", F.lit("z")), path, ["k"], before_commit=later) == seen + 2
    assert {r.k: r.v for r in tables.table(spark, path).where(F.col("v") != "x").collect()} == {0: "z", mate: "y", other: "y"}


def test_a_batch_counts_once_and_a_dead_writer_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 1)], "k long, n long")
    put = tables.sink(path, ["k"], "stream")
    put(rows, 0)
    put(rows.withColumn("n", F.lit(9).cast("long")), 0)
    assert versions.read(spark, path)[0] == 1 and [r.n for r in tables.table(spark, path).collect()] == [1]

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        tables.merge(rows.withColumn("n", F.lit(5).cast("long")), path, ["k"], writer="stream", batch=1, before_commit=die)
    assert versions.read(spark, path)[0] == 1
    put(rows.withColumn("n", F.lit(7).cast("long")), 1)
    assert [r.n for r in tables.table(spark, path).collect()] == [7] and tables.swept(spark, path) > 0


def test_stream_into_a_table_restarts_where_it_was(spark, tmp_path):
    path, into = str(tmp_path / "in"), str(tmp_path / "t")
    rows = lambda *xs: spark.createDataFrame(list(xs), "k long, v string")
    for new in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")], []):
        rows(*new).coalesce(1).write.mode("append").parquet(path) if new else None
        q = spark.readStream.schema("k long, v string").parquet(path).writeStream.foreachBatch(tables.sink(into, ["k"], "s")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination()
    assert _rows(spark, into) == [(1, "a"), (2, "c"), (3, "d")] and versions.read(spark, into)[1]["writers"] == {"s": 1}


def _same_hits(spark, corpus, asked, path, k=3):
    hits = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    got = hits(postings.search(asked, path, "q", "text", k))
    assert got == hits(retrieval.bm25(asked, corpus, "q", "text", "id", "text", k))
    return got


def test_index_follows_the_corpus(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    rng = random.Random(3)
    word = lambda: f"w{int(rng.random() ** 3 * 40)}"
    text = lambda: " ".join(word() for _ in range(rng.randrange(1, 30)))
    rows = {i: text() for i in range(120)} | {200: None, 201: "", 202: "the of"}
    frame = lambda: spark.createDataFrame(list(rows.items()), "id long, text string")
    asked = spark.createDataFrame([(i, text()) for i in range(15)] + [(20, "w1 w1 w2"), (21, "unseen"), (22, None)], "q long, text string")
    path = str(tmp_path / "index")
    assert postings.refreshed(frame(), path, "id", "text") == 1
    assert _same_hits(spark, frame(), asked, path)
    assert postings.refreshed(frame(), path, "id", "text") == 1
    for i in range(0, 120, 7):
        rows[i] = text()
    for i in range(3, 120, 11):
        del rows[i]
    rows |= {300 + i: text() for i in range(10)}
    assert postings.refreshed(frame(), path, "id", "text") == 2
    _same_hits(spark, frame(), asked, path, 5)
    rows.update({0: "w1 w2 w3", 300: None})
    del rows[200]
    assert postings.refreshed(frame(), path, "id", "text") == 3
    _same_hits(spark, frame(), asked, path)
    rows.clear()
    rows[1] = ""
    assert postings.refreshed(frame(), path, "id", "text") == 4
    assert postings.search(asked, path, "q", "text").count() == 0
    assert postings.search(asked, path, "q", "text", version=2).count() > 0


def test_search_reads_no_text_and_few_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    path = str(tmp_path / "index")
    postings.refreshed(docs, path, "doc_id", "text")
    found = postings.search(asked, path, "item_id", "text")
    read = found.inputFiles()
    assert not any("documents.parquet" in f for f in read) and any("kind=postings" in f for f in read)
    want = {(r.query_id, r["rank"]): r.id for r in retrieval.bm25(asked, docs, "item_id", "text", "doc_id", "text").collect()}
    assert {(r.query_id, r["rank"]): r.id for r in found.collect()} == want


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    points = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    cells.stored(points, path, cells.fitted(points))
    return points, path


def test_codes_find_most_of_vectors_without_groups(spark, filed):
    points, path = filed
    asked = points.where("vec_id % 50 = 0")
    exact = retrieval.dense(asked, points, "vec_id", "embedding", "vec_id", "embedding", 10)
    # 40 of 2,000 vectors are compared exactly.
    assert cells.recall(cells.search(asked, path, "vec_id", "embedding", 10, None, 40), exact) >= 0.95


def test_few_cells_find_most_of_vectors_in_groups(spark, tmp_path):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(40, 16))
    rows = [(i, (centre[i % 40] + 0.3 * rng.normal(size=16)).tolist()) for i in range(2000)]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cells.stored(points, str(tmp_path), cells.fitted(points, cells=40))
    asked = points.where("vec_id % 50 = 0")
    exact = retrieval.dense(asked, points, "vec_id", "embedding", "vec_id", "embedding", 10)
    assert cells.pairs(asked, str(tmp_path), "embedding", 3) < 0.1
    assert cells.recall(cells.search(asked, str(tmp_path), "vec_id", "embedding", 10, 3), exact) >= 0.9
    assert cells.recall(cells.search(asked, str(tmp_path), "vec_id", "embedding", 10, 3, 60), exact) >= 0.9


def test_codes():
    unit = np.array([[0.6, -0.8, 0.0], [0.0, 0.0, 0.0], [1.0, 0.0, 0.0]])
    assert np.abs(cells.decoded(*cells.coded(unit), 3) - unit).max() <= 0.8 / 14 + 1e-6


def test_all_cells_are_exact(spark, filed):
    points, path = filed
    asked = points.where("vec_id % 50 = 0")
    hits = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    got, want = hits(cells.search(asked, path, "vec_id", "embedding", 5)), hits(retrieval.dense(asked, points, "vec_id", "embedding", "vec_id", "embedding", 5))
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-8)


def test_cells_of_odd_vectors(spark, tmp_path):
    points = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(None, [0.0, 0.0])], "vec_id long, embedding array<double>")
    cells.stored(points, str(tmp_path), cells.fitted(points, cells=2))
    got = cells.search(points.where("vec_id = 1"), str(tmp_path), "vec_id", "embedding", 4, None).collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [1, 4, 7, 2]
    assert cells.search(points.limit(0), str(tmp_path), "vec_id", "embedding").count() == 0
    with pytest.raises(ValueError):
        cells.search(points.select("vec_id", F.array(F.lit(1.0)).alias("embedding")), str(tmp_path), "vec_id", "embedding")
