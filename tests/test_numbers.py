"""Rounding as Python does it."""

import random

from pyspark.sql import functions as F

from siftstone.functions.numbers import rounded
from siftstone.operators import matching


def test_rounded(spark):
    rng = random.Random(5)
    values = [k / 10000 + 0.00005 for k in range(10001)] + [(2 * k + 1) / 20000 for k in range(10000)] + [j / 32 for j in range(-64, 128)] + [rng.random() * 4 for _ in range(5000)]
    values += [-v for v in values[:500]] + [0.0, 1e-300, 1e-7, 3.99999999, 4.0, 17.25, -0.00005, 0.1, 1 / 3, 2 / 3] + [rng.randrange(200) / (1 + rng.randrange(200)) % 4 for _ in range(5000)]
    got = spark.createDataFrame([(v,) for v in [*values, None]], "x double").select("x", rounded(F.col("x")).alias("r")).collect()
    assert [(r.x, r.r) for r in got if r.x is not None and r.r != round(r.x, 4)] == []
    assert [r.r for r in got if r.x is None] == [None]


def test_source_lists(spark):
    """Lists by label and rank; without labels all is direct evidence."""
    rows = [(1, 3, "supporting", "c"), (1, 2, "partial_direct_evidence", "b"), (1, 1, None, "a"), (1, 4, "direct_evidence", "d"), (2, 1, "irrelevant", "e")]
    evidence = spark.createDataFrame(rows, "case_id long, rank int, label string, id string")
    one, two = matching.source_lists(evidence, ["id"]).orderBy("case_id").collect()
    assert [[x.id for x in one[n]] for n in (*matching.LABELS, "matches")] == [["a", "d"], ["b"], ["c"], [], [], ["a", "d", "b"]]
    assert two.matches == [] and [x.id for x in two.irrelevant] == ["e"]
    assert [x.id for x in matching.source_lists(evidence.drop("label"), ["id"]).where("case_id = 1").first().matches] == ["a", "b", "c", "d"]
