import math
import time

from pyspark.sql import functions as F

from siftstone.functions.text import tokens
from siftstone.operators import indexing


def test_hashed_vector_by_hand(spark):
    texts = ["heart failure and potassium heart", "", None, "x", "dose dose dose of 5 mg"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    places = rows.select("id", F.transform(tokens(F.col("text")), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(16)).alias("at"), F.pmod(F.hash(t), F.lit(2)).alias("odd"))).alias("ps"))
    want = {}
    for r in places.collect():
        sums = [sum((1 if p.odd == 0 else -1) for p in r.ps if p.at == i) for i in range(16)]
        n = math.sqrt(sum(x * x for x in sums))
        want[r.id] = [x / n if n else 0.0 for x in sums]
    assert {r.id: r.v for r in rows.select("id", indexing.hashed_vector(F.col("text"), 16).alias("v")).collect()} == want


def test_long_texts_take_time_by_their_tokens(spark):
    rows = spark.range(1).select(F.repeat(F.lit("heart failure potassium "), 70_000).alias("text"))
    begin = time.monotonic()
    assert len(rows.select(indexing.hashed_vector(F.col("text"), 4096).alias("v")).first().v) == 4096
    assert time.monotonic() - begin < 20
