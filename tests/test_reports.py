"""Answers, warnings and payloads of dosing, and contexts per family."""

import json

from siftstone.operators import dosing

_EVIDENCE = "request_id long, family string, chunk_ids array<string>, start_dose string"
_TOLD = "request_id long, family string, drug string, action string, dose string, status string, note string, assumed boolean, grounded boolean, chunk_ids array<string>, pages array<int>"


def test_reports(spark):
    patients = spark.createDataFrame([(1, 5.9), (2, None)], "request_id long, potassium double")
    known = spark.createDataFrame([(1, "mra", ["c1"], "25 mg"), (1, "sglt2", ["c2", "c3"], None), (1, "ras", [], None), (2, "mra", [], None)], _EVIDENCE)
    told = spark.createDataFrame([
        (1, "sglt2", "dapagliflozin", "start", "10 mg o.d.", "eligible", "Watch fluids.", True, True, ["c2", "c3"], [7]),
        (1, "mra", "spironolactone", "reduce", "25 mg", "caution", "Near a threshold.", False, True, ["c1"], [None]),
        (1, "beta_blocker", None, "avoid_start", None, "contraindicated", None, False, True, ["c4"], []),
        (1, "ras", "enalapril", "unavailable", None, "contraindicated", "Not told.", True, False, [], []),
        (2, "mra", "spironolactone", "unavailable", None, "ungrounded", "Nothing found.", False, False, [], []),
    ], _TOLD)
    shown = told.where("status = 'eligible'").selectExpr("*", "1 AS rank").unionByName(told.where("family = 'beta_blocker'").selectExpr("*", "2 AS rank"))
    queries = spark.createDataFrame([(1, "b", 1), (1, "a", 0)], "request_id long, query string, ord int")
    one, two = dosing.reports(patients, known, told, shown, queries).orderBy("request_id").collect()
    assert one.answer == "dapagliflozin: 10 mg o.d.\nbeta_blocker" and two.answer == dosing.NO_DOSE
    assert one.tradeoffs == ["mra: Near a threshold."] and two.tradeoffs == []
    assert [(x.family, x.evidence_chunk_ids) for x in one.safety_cautions] == [("mra", ["c1"]), ("beta_blocker", ["c4"])] and two.safety_cautions == []
    assert one.warnings == [*dosing.WARNINGS, dosing.ASSUMED + "dapagliflozin, enalapril"]
    assert two.warnings == [*dosing.WARNINGS, dosing.NO_EVIDENCE, dosing.NOTHING_SHOWN]
    payload = json.loads(one.payload)
    assert list(payload) == ["mode", "recommendations", "selected_recommendations", "evidence_rows_used", "tradeoffs", "safety_cautions", "inputs_used", "retrieval_queries"]
    assert list(payload["recommendations"]) == ["mra", "beta_blocker", "ras", "sglt2"] and payload["recommendations"]["mra"]["tradeoff"] == "Near a threshold." and payload["recommendations"]["sglt2"]["tradeoff"] is None
    assert payload["evidence_rows_used"] == {"mra": {"chunk_ids": ["c1"], "start_dose": "25 mg"}, "sglt2": {"chunk_ids": ["c2", "c3"], "start_dose": None}}
    assert payload["inputs_used"] == {"potassium": 5.9} and payload["retrieval_queries"] == ["a", "b"]
    assert json.loads(two.payload)["evidence_rows_used"] == {} and json.loads(two.payload)["retrieval_queries"] == []
    assert dosing.reports(patients.where("false"), known.where("false"), told.where("false"), shown.where("false")).count() == 0


def test_contexts_per_family_and_request(spark):
    hits = spark.createDataFrame(
        [(1, f, q, r, "s", c, None, x) for f, q, r, c, x in [("mra", 1, 1, "a", "A"), ("mra", 1, 2, "a", "A"), ("mra", 1, 3, None, "N"), ("mra", 1, 4, "z", "Z"), ("ras", 2, 1, "a", "A"), ("ras", 2, 2, None, "N"), ("ras", 2, 3, "g", "G")]],
        "request_id long, family string, query_index int, rank int, source_id string, chunk_id string, title string, snippet string",
    )
    brought = spark.createDataFrame([(1, 1, "s", "g", None, "G"), (1, 2, "s", "g", None, "G"), (2, 1, "s", "a", None, "A")], "request_id long, ord int, source_id string, chunk_id string, title string, snippet string")
    families, whole = dosing.retrieved(hits, brought)
    assert sorted(((r.family, r.ord, r.snippet) for r in families.collect())) == [("mra", 1, "A"), ("mra", 2, "N"), ("ras", 1, "A"), ("ras", 2, "N"), ("ras", 3, "G")]
    assert sorted((r.request_id, r.ord, r.snippet) for r in whole.collect()) == [(1, 1, "G"), (1, 2, "G"), (1, 3, "A"), (1, 4, "N"), (2, 1, "A")]
    assert [r.snippet for r in dosing.retrieved(hits, None, top_k=1, most=2)[1].orderBy("ord").collect()] == ["A", "N"]


def test_names_with_marks_of_expressions(spark):
    """Titles that end a quotation in an expression, or have letters outside of ASCII, are taken out like others."""
    from pyspark.sql import functions as F

    from siftstone.operators import answers

    contexts = F.array(F.struct(F.lit("a.b*").alias("source_id"), F.lit(r"x\Ey").alias("title")), F.struct(F.lit("").alias("source_id"), F.lit("ÄRZTE $1").alias("title")))
    said = spark.createDataFrame([(r"See x\Ey and axb* and a.b* and ärzte $1.",)], "t string")
    assert said.select(answers.normalised_answer(F.col("t"), contexts, F.lit(None).cast("double")).alias("t")).first().t == "See the available evidence and axb* and the available evidence and the available evidence."
