import numpy as np
from pyspark.sql import functions as F

from siftstone.operators import mapping, retrieval


def test_products_give_the_rows_of_every_pair(spark):
    made = np.random.default_rng(1).integers(-3, 4, (300, 5)).astype(float).tolist()
    rows = [(i, v[: 5 - i % 2]) for i, v in enumerate(made)] + [(900, None), (901, [0.0] * 5), (902, [1.0, None, 2.0, 0.0, 1.0]), (903, [])]
    points = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    asked = points.where("id % 7 = 0 OR id > 900")
    got = {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in retrieval.dense(asked, points, "id", "v", "id", "v", 4).collect()}
    unit = lambda v: np.zeros(len(v)) if None in v or not np.dot(v, v) else np.array(v) / np.sqrt(np.dot(v, v))
    want = {}
    for q, x in rows:
        if x is not None and (q % 7 == 0 or q > 900):
            near = sorted((-round(float(unit(x) @ unit(y)), 9), i) for i, y in rows if y is not None and len(y) == len(x))[:4]
            want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(near)}
    assert {k: i for k, (i, _) in got.items()} == {k: i for k, (i, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-9 for k in want)
    # Before, every pair went through an expression of Spark, number by number.
    assert "MapInArrow" in retrieval.dense(asked, points, "id", "v", "id", "v", 4)._jdf.queryExecution().executedPlan().toString()


def test_candidates_meet_passages_once(spark, monkeypatch):
    monkeypatch.setattr(mapping, "CASE_WORDS", 3)
    text = lambda i: F.concat_ws(" ", F.lit("common words"), *(F.concat(F.lit(w), i % n) for w, n in (("alpha", 3), ("beta", 5), ("gamma", 7))), F.lit("of of"))
    chunks = spark.range(40).select(F.lit("s").alias("source_id"), F.col("id").alias("chunk_id"), F.col("id").alias("chunk_index"), text(F.col("id")).alias("text"))
    cases = spark.range(4).select(F.col("id").alias("case_id"), F.lit("s").alias("source_id"), text(F.col("id") * 9).alias("gold"))
    found = mapping.candidates(cases, mapping.units(chunks, 1), least=0.5)
    gold, there = {r.case_id: r.gold.split() for r in cases.collect()}, {r.chunk_id: r.text.split() for r in chunks.collect()}
    for case, words in gold.items():
        own = [(round(sum(min(words.count(w), t.count(w)) for w in set(words)) / len(words), 9), i) for i, t in there.items() if len({w for w in words if len(w) > 2} & set(t)) >= 0.5 * len({w for w in words if len(w) > 2})]
        assert [(round(r.multiset_coverage, 9), r.first) for r in found.where(F.col("case_id") == case).orderBy("rank").collect()] == sorted(own, key=lambda x: (-x[0], x[1]))[:5]
    # Passages in blocks; texts are met by their words and never joined to pairs.
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
