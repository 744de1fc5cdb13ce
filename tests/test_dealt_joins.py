"""Sides of joins that grow with the input don't go through the driver, however small Spark takes them for."""

from pyspark.sql import functions as F

from siftstone.operators import datasets, dosing, retrieval
from siftstone.plans import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_requests_are_dealt(spark):
    patients, known, out = queries._dosed(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"), True)
    shown = dosing.visible(out, spark.createDataFrame(list(dosing.PRIORITY.items()), "family string, priority int"))
    assert plan(out).count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan(out)
    # Only the priorities of families are sent.
    assert plan(shown).count("BroadcastHashJoin") == 1
    assert plan(dosing.verdicts(out, shown)).count("BroadcastHashJoin") == 1


def test_aliases_are_sent_instead_of_patients(spark):
    variables = spark.range(9).select(F.col("id").alias("patient_id"), F.lit("K").alias("key"), F.lit("1").alias("value"))
    aliases = spark.createDataFrame([("k", "potassium", 0)], "alias string, field string, priority int")
    assert "BuildRight" in plan(dosing.snapshot(variables, aliases)) and "BuildLeft" not in plan(dosing.snapshot(variables, aliases))


def test_texts_are_read_once_for_a_search(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    found = plan(retrieval.bm25(read("benchmark"), read("documents"), "item_id", "text", "doc_id", "text"))
    # Postings are kept before their uses; what reads texts afterwards are queries.
    assert "documents.parquet" not in found
    # Scores of all pairs of queries and documents aren't shuffled to be summed.
    assert "Exchange hashpartitioning(query_id#" in found and not [x for x in found.splitlines() if "Exchange hashpartitioning(query_id#" in x and ", id#" in x]


def test_a_passage_is_cleaned_once_per_case(spark):
    cases = spark.range(1).select(F.concat(F.lit("What is the dose of alpha beta gamma"), "id").alias("question"), F.concat(F.lit("Alpha, beta."), "id").alias("passage"), F.lit(True).alias("answerable"), F.lit(9).alias("words"))
    refined = datasets.refined(cases)
    assert refined.select("key_terms").first().key_terms == ["alpha", "beta"]
    assert plan(refined.select("key_terms", "review_status")).count("[^a-z0-9") == 1


def test_long_records_are_made_in_many_tasks(spark):
    for name in ("ana02_run_rows", "ana02_case_rows"):
        rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "REPARTITION_BY_NUM" in plan(rows) and rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
