"""Plans of searches, checks of answers and answers that are made of what was found."""

import pytest
from pyspark.sql import functions as F

from siftstone.operators import answers, clinical, planning

TABLE = "Percutaneous supports can be characterized by one of four circuit configurations: 1. intra-aortic devices, 2. transvalvular aortic (Impella) 3. left atrium to systemic artery (TandemHeart); 4. right atrium to systemic artery (veno-arterial extracorporeal memb"
FOUR = "What are the four circuit configurations for percutaneous mechanical circulatory support as described in Supplementary Table 22?"
GENERIC = "1. Direct answer\n- The main value abnormalities point to a clinically relevant pattern that should be interpreted as a whole rather than marker by marker.\n\n2. Rationale\n- Words.\n\n3. Caution\n- I don't know.\n\n4. General advice\n- Review."
SCHEMA = "request_id int, question string, answer string, contexts array<struct<source_id:string,title:string,snippet:string>>, potassium double"


@pytest.fixture(scope="module")
def portraits(spark):
    """Patient 1 is one of heart failure, 2 has a high potassium, 3 nothing that is read."""
    bad = lambda p, key, value, label, status: (p, key, value, label, None, float(value), 1.0, 2.0, status)
    rows = [bad(1, "ef", "28", "Ejection fraction", "low"), bad(1, "nt_pro_bnp", "2400", "NT-proBNP", "high"), bad(1, "creatinine", "1.7", "Creatinine", "high"), bad(1, "potassium", "5.4", "Potassium", "high"), bad(1, "sbp", "110", "SBP", "normal"), bad(2, "potassium", "5.6", "Potassium", "high")]
    findings = spark.createDataFrame([*rows, (3, "shoe", "42", None, None, None, None, None, "unknown")], "patient_id int, key string, value string, label string, unit string, number double, low double, high double, status string")
    return clinical.portrait(findings).withColumnRenamed("patient_id", "request_id")


def requests(spark, portraits, rows):
    asked = spark.createDataFrame(rows, SCHEMA).withColumn("contexts", F.coalesce("contexts", F.array().cast("array<struct<source_id:string,title:string,snippet:string>>")))
    none = lambda c: F.coalesce(c, F.array().cast(dict(portraits.dtypes)[c]))
    out = asked.join(portraits, "request_id", "left")
    out = out.withColumns({c: none(c) for c in portraits.columns if c != "request_id"})
    # The value stands for the summary here.
    return answers.prepared(out.withColumn("abnormal", F.transform("abnormal", lambda x: x.withField("summary", F.concat(x["label"], F.lit("="), x["value"])))))


def test_plans(spark, portraits):
    asked = spark.createDataFrame([(1, ""), (2, None), (4, "What does RV stand for in the context of heart failure studies?"), (5, FOUR)], "request_id int, question string")
    got = {r.request_id: r for r in planning.plans(asked.join(portraits, "request_id", "left")).collect()}
    assert got[1].specialty == "heart_failure" and got[1].question.startswith("For this heart-failure-oriented profile") and got[1].question.endswith("for Creatinine, Ejection fraction, NT-proBNP?")
    assert got[1].base_query == "heart failure guidance hf severity and congestion cardio-renal and electrolyte safety creatinine ejection fraction nt-probnp potassium congestion cardio-renal safety follow-up"
    assert got[1].queries[0] == got[1].base_query and got[1].clusters == ["Cardio-renal and electrolyte safety", "HF severity and congestion"]
    assert "Heart failure management or follow-up guidance for HF severity and congestion with focus on Ejection fraction, NT-proBNP." in got[1].queries
    assert "Clinical management or follow-up guidance for Creatinine with patient value 1.7." in got[1].queries and sum("rhythm" in q for q in got[1].queries) == 0
    assert got[2].specialty == "general" and got[2].question == "What are the most relevant next-step priorities, safety checks, and interpretation points for this patient, especially regarding Potassium?"
    assert got[4].queries == [
        "What does RV stand for in the context of heart failure studies?",
        "heart failure studies guidance",
        "heart failure studies definition glossary abbreviation",
        "RV abbreviation meaning definition in heart failure studies",
        "heart failure studies glossary RV",
    ]
    topic = "four circuit configurations percutaneous mechanical circulatory"
    assert got[5].queries[1:] == [f"{topic} guidance", f"{topic} definition glossary abbreviation", f"{topic} exact wording glossary table definition", f"{topic} categories list configurations"]
    assert [len(r.queries) for r in planning.plans(asked.where("request_id = 1").join(portraits, "request_id"), adaptive=False).collect()] == [1]


def test_issues_and_verdicts(spark, portraits):
    context = [("doc-1", "HF therapy", "Symptomatic HFrEF escalation may include sacubitril/valsartan, dapagliflozin, ivabradine, or CRT in selected patients.")]
    rows = [
        (10, "", "1. Direct answer\nThe PDF says the best document is helpful.\n\n2. Rationale\nMore text.\n\n3. Caution\nI don't know.\n\n4. General advice\nMore text.", [], None),
        (2, "", "1. Direct answer\nPrevent hypokalemia.\n\n2. Rationale\nPotassium is high.\n\n3. Caution\nI don't know.\n\n4. General advice\nReview medications.", [], 5.6),
        (11, "anything", "Based on the provided context, I don't know.", [], None),
        (12, "What escalation of therapy should be considered for symptomatic HFrEF despite ACE inhibitor and beta blocker therapy?", GENERIC, context, None),
        (13, FOUR, GENERIC, [("1", "Supplementary Table 22", TABLE)], None),
        (14, FOUR, "1. Direct answer\n- intra-aortic devices.\n- transvalvular aortic.\n- left atrium.\n\n2. Rationale\n- The retrieved excerpts enumerate them, as far as they go and as they are given here for the reader.\n\n3. Caution\n- I am relying only on the supplied excerpts.\n\n4. General advice\n- If exact wording matters, retrieve more.", [("1", "Supplementary Table 22", TABLE)], None),
        (1, "", "1. Direct answer\nAssess congestion and aliskiren.\n\n2. Rationale\nx\n\n3. Caution\nlimited\n\n4. General advice\nx", context, 5.4),
    ]
    made = requests(spark, portraits, rows).withColumn("issues", answers.issues())
    got = {r.request_id: r for r in made.withColumns({"forced": answers.needs_made_answer(F.col("issues"), F.lit(True)), "v": answers.verified(F.col("issues"))}).collect()}
    has = lambda i, part: any(part in x for x in got[i].issues)
    assert has(10, "document-selection") and got[10].v.verdict == "fail" and got[10].forced
    assert has(2, "potassium value") and not has(2, "acknowledge") and got[2].v.confidence == "medium"
    assert got[11].issues == [] and got[11].v.verdict == "pass" and got[11].v.issues == ["none"]
    assert has(12, "explicit question") and has(13, "literal question") and got[13].forced
    assert got[14].issues == [] and not got[14].forced
    assert has(1, "unsupported treatment-specific") and has(1, "acknowledge the 'Cardio-renal") and not has(1, "acknowledge the 'HF")
    raw = spark.createDataFrame([("VERDICT: fail\nISSUES:\n- one\n * two\nCONFIDENCE: High",), ("verdict : PASS",), ("none",)], "t string")
    assert [tuple(r.x) if r.x else None for r in raw.select(answers.read_verdict(F.col("t")).alias("x")).collect()] == [("fail", ["one", "two"], "high"), ("pass", ["none"], "low"), None]


def test_made_answers(spark, portraits):
    rows = [(20, FOUR, None, [("1", "Supplementary Table 22", TABLE)], None), (21, "Which escalation helps in HFrEF?", None, [("1", "A", "Escalation may include ivabradine. Nothing else.")], None), (1, "", None, [("1", "A", "Creatinine and potassium. Heart failure with congestion.")], 5.4), (3, "", None, [], None)]
    made = answers.made_answer(F.col("request_id") == 20, F.when(F.col("request_id") == 1, F.array(F.lit("incomplete_cluster_coverage"))).otherwise(F.array().cast("array<string>")), F.create_map(F.lit("HF severity and congestion"), F.lit(1)))
    got = {r.request_id: r.text for r in requests(spark, portraits, rows).select("request_id", made.alias("text")).collect()}
    lines = got[20].split("\n")
    assert lines[:5] == ["1. Direct answer", "- intra-aortic devices.", "- transvalvular aortic (Impella).", "- left atrium to systemic artery (TandemHeart).", "- right atrium to systemic artery (veno-arterial extracorporeal memb."]
    assert "- The retrieved excerpts explicitly enumerate 4 items relevant to the question." in lines and f"- {answers.TRUNCATED}" in lines and lines[-1] == f"- {answers.EXACT}"
    assert got[21].split("\n")[:3] == ["1. Direct answer", "- Escalation may include ivabradine .", ""] and answers.PARTIAL in got[21]
    head = got[1].split("\n\n")
    assert head[0].split("\n")[1] == f"- {answers.POINTS['HF severity and congestion'][0]}" and len(head[0].split("\n")) == 6
    assert "especially because the abnormalities include elevated potassium." in head[1] and "- HF severity and congestion: Ejection fraction=28; NT-proBNP=2400" in head[1]
    assert "Guidance coverage is limited for: Cardio-renal and electrolyte safety." in head[2] and "blood pressure" not in head[2] and "current symptoms or functional status" in head[2]
    assert answers.SPECIALIST in head[3] and answers.UNCOVERED in head[3]
    assert answers.NO_POINT in got[3]


def test_normalised_answers(spark):
    text = "Main answer: the PDF says so. Guide.pdf and table A tell. Evidence-Based Recommendation\n\n\n\n###  Rationale Avoid hypokalemia now.  Good."
    row = spark.createDataFrame([(text, [("guide.pdf", "Table A")], 5.2)], "answer string, contexts array<struct<source_id:string,title:string>>, potassium double")
    assert row.select(answers.normalised_answer(F.col("answer"), F.col("contexts"), F.col("potassium")).alias("x")).first().x == "Direct answer: . the available evidence and the available evidence tell. Direct answer\n\n Good."
