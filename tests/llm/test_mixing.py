import duckdb
import pytest
from pyspark.sql import functions as F

from siftstone.llm import mixing, repeats


def test_targets_by_hand(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(100, "a"), (10, "b"), (60, "c"), (30, None)])]
    got = {r.source: (r.source_size, r.target) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # Weights 3, 1, 2, 3 share 300: all but the first and the third fill up at twice their size.
    level = (300 - 2 * 10 - 2 * 30) / 5
    assert got == {"a": (100, pytest.approx(132.0)), "b": (10, 20.0), "c": (60, pytest.approx(88.0)), None: (30, 60.0)} and level == 44


def test_query_is_near_its_targets_and_repeats(spark):
    df = mixing.op9(spark, "/root/testdata/sf0.01")
    rows = df.collect()
    assert sorted(rows, key=str) == sorted(mixing.op9(spark, "/root/testdata/sf0.01").collect(), key=str)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    for of in {r.source_size for r in rows}:
        own = [r for r in rows if r.source_size == of]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)


@pytest.mark.parametrize(("query", "sql", "tables"), [(mixing.op9, mixing.SQL, ["documents", "labels"]), (repeats.op4, repeats.SQL, ["documents"])])
def test_sql_agrees(spark, query, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want, got = con.sql(sql), query(spark, "/root/testdata/sf0.001")
    shown = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert shown(want.fetchall()) == shown(tuple(r) for r in got.select(*want.columns).collect())


def test_heavier_documents_come_first(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    once = mixing.mix(docs, labels).where("source = 'b'").groupBy(F.col("doc_id") % 2).agg(F.avg("copies")).collect()
    assert dict(map(tuple, once))[1] > dict(map(tuple, once))[0] + 0.1


def test_odd_rows(spark, odd, empty):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    assert {r.taken for r in mixing.mix(odd).where("size = 0").collect()} == {0}
    assert mixing.mix(odd, spark.createDataFrame([(1, None, 1), (1, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")).count() == odd.count()


def test_rows_that_share_an_id_are_taken_each_for_itself(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i // 3, f"text {i} " + "w " * (i % 5), "a", i) for i in range(300)] + [(None, "twice", "a", 1), (None, "twice", "a", 2), (None, None, None, 3)] + [(i, "other text here", "b", 0) for i in range(2000, 2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    kept = mixing.stage(spark, docs, str(tmp_path)).collect()
    mixed = mixing.mix(docs).where("copies > 0").collect()
    assert sum(r.copies_ for r in kept) == sum(r.copies for r in mixed)
    assert len(kept) == len({(r.doc_id, r.source, r.sign) for r in mixed}) and {r.text for r in kept} <= {r[1] for r in rows}
    assert mixing.stage(spark, docs.limit(0), str(tmp_path)).count() == 0
