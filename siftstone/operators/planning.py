"""From a question and a patient's findings to the queries of a search. All of it is columns over one row per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import GUIDANCE_STOPWORDS, terms

from .clinical import HEART_FAILURE_ORDER, has_any, prioritised, specialty

# Words that show that a question is about a patient, and words of questions about a text.
PATIENT_WORDS = "patient|symptom|symptoms|result|results|value|values|profile|management|follow-up|follow up|monitor|monitoring|safety|treat|treatment|prescribe|medication|dose|escalation".split("|")
LITERAL_WORDS = "table|figure|supplementary|appendix|section|described|listed".split("|")
# Terms that don't name a topic, and words of questions that ask for a list.
NO_TOPIC = "what which when where does stand mean means described describe context supplementary table tables figure figures".split()
LIST_WORDS = ["what are", "which are", "list", "enumerate", "configurations", "types", "categories"]
TABLE_WORDS = ["table", "figure"]
ACRONYM = r"\b([A-Z][A-Z0-9/+.-]{1,8})\b"


def literal_question(question: Column, has_patient: Column) -> Column:
    """Is a question about the wording of a text, not about a patient?"""
    low = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    about = has_any(low, PATIENT_WORDS)
    return (low != "") & ~about & (~has_patient | has_any(low, LITERAL_WORDS))


def explicit_question(question: Column, has_patient: Column) -> Column:
    """Is there a question and nothing known of a patient?"""
    return (F.trim(F.coalesce(question, F.lit(""))) != "") & ~has_patient


def question_queries(question: Column) -> Column:
    """Further queries for a question without a patient: its topic, its acronyms, tables and lists. Terms keep the order of the question."""
    topic = F.array_join(F.slice(F.array_except(terms(question, GUIDANCE_STOPWORDS), F.array(*map(F.lit, NO_TOPIC))), 1, 6), " ")
    acronyms = F.regexp_extract_all(question, F.lit(ACRONYM))
    some, low = topic != "", F.lower(question)
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    per = F.flatten(F.transform(F.slice(acronyms, 1, 2), lambda a: F.when(some, F.array(join(a, " abbreviation meaning definition in ", topic), join(topic, " glossary ", a))).otherwise(F.array(join(a, " abbreviation meaning definition")))))
    focus = F.coalesce(F.get(acronyms, F.lit(0)), topic)
    first = F.array(F.when(some, join(topic, " guidance")), F.when(some, join(topic, " definition glossary abbreviation")))
    last = F.array(F.when(has_any(low, TABLE_WORDS) & (focus != ""), join(focus, " exact wording glossary table definition")), F.when(has_any(low, LIST_WORDS) & some, join(topic, " categories list configurations")))
    return F.array_remove(F.array_distinct(F.array_compact(F.transform(F.concat(first, per, last), lambda x: F.trim(x)))), F.trim(question))


def patient_question(relevant_terms: Column) -> Column:
    """The question that a patient's data stand for."""
    focus = F.array_join(F.slice(relevant_terms, 1, 3), ", ")
    asked = F.concat(F.lit("What are the most relevant next-step priorities, safety checks, and interpretation points for this patient, especially regarding "), focus, F.lit("?"))
    return F.when(F.size(relevant_terms) > 0, asked).otherwise("What are the most relevant next-step priorities and safety checks for this patient based on the available variables?")


# By specialty the begin of a query and its end, the question and what it is about without any finding.
_BASE = {
    "heart_failure": ("heart failure guidance", ["congestion", "cardio-renal safety", "follow-up"]),
    "renal": ("renal function electrolyte safety guidance", ["monitoring"]),
    "metabolic": ("glycemic cardiometabolic guidance", ["follow-up"]),
}
_QUESTION = {
    "heart_failure": ("For this heart-failure-oriented profile, what near-term management priorities, safety checks, and escalation considerations are most relevant, especially for ", "congestion and cardio-renal safety"),
    "renal": ("For this renal-safety-oriented profile, what near-term monitoring priorities and treatment safety considerations are most relevant, especially for ", "renal function and electrolytes"),
    "metabolic": ("For this metabolic profile, what follow-up priorities and interpretation points are most relevant, especially for ", "glucose control"),
}
_HEART_QUERIES = [
    (HEART_FAILURE_ORDER[:2], "Heart failure monitoring and follow-up guidance for congestion, renal function, creatinine, potassium, sodium, and diuretic or RAAS-related safety."),
    (HEART_FAILURE_ORDER[2:3], "Heart failure rhythm or conduction guidance including QRS, atrial fibrillation, heart rate, and device-related considerations."),
]


def plans(requests: DataFrame, adaptive: bool = True) -> DataFrame:
    """(request_id, question, base_query, queries, clusters, specialty) of requests (request_id, question, and keys, recognised, abnormal, clusters, relevant_terms as clinical.portrait has them; null or empty without a patient).

    queries: the base query first, then distinct further ones.
    """
    texts = lambda name: F.coalesce(name, F.array().cast("array<string>"))
    none = "array<struct<label:string,value:string,cluster:string>>"
    r = requests.select(
        "request_id", F.trim(F.coalesce("question", F.lit(""))).alias("asked"), *(texts(n).alias(n) for n in ("keys", "recognised", "clusters", "relevant_terms")),
        F.coalesce(F.transform("abnormal", lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"), x["cluster"].alias("cluster"))), F.array().cast(none)).alias("abnormal"),
    )
    r = r.withColumn("specialty", specialty(F.array_distinct(F.concat(F.transform("keys", F.lower), "recognised")), F.lit(False)))
    labels = lambda n: F.transform(F.slice("abnormal", 1, n), lambda x: x["label"])
    heart = F.col("specialty") == "heart_failure"
    focus = lambda n: F.array_join(labels(n), ", ")
    question, base = patient_question(F.col("relevant_terms")), patient_question(F.col("relevant_terms"))
    for name, (begin, end) in _BASE.items():
        pieces = F.concat(F.array(F.lit(begin)), F.transform(prioritised(F.col("clusters"), heart), F.lower), F.transform(labels(4), F.lower), F.array(*map(F.lit, end)))
        base = F.when(F.col("specialty") == name, F.array_join(F.array_distinct(F.filter(pieces, lambda x: x != "")), " ")).otherwise(base)
        said, other = _QUESTION[name]
        question = F.when(F.col("specialty") == name, F.concat(F.lit(said), F.coalesce(F.nullif(focus(3), F.lit("")), F.lit(other)), F.lit("?"))).otherwise(question)
    given = F.col("asked") != ""
    r = r.withColumns({"question": F.when(given, F.col("asked")).otherwise(question), "base_query": F.trim(F.when(given, F.col("asked")).otherwise(base))})
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    some = F.size("abnormal") > 0
    named = F.transform(F.slice(F.array_sort("keys"), 1, 6), lambda k: F.replace(k, F.lit("_"), F.lit(" ")))
    own = F.array(F.when(F.size("keys") > 0, text(F.col("base_query"), " Patient variables: ", F.array_join(named, ", "), ".")), F.when(some, text(F.col("base_query"), " Focus on abnormal or clinically relevant findings: ", focus(4), ".")))
    of = lambda k: F.array_join(F.transform(F.slice(F.filter("abnormal", lambda x: x["cluster"] == k), 1, 3), lambda x: x["label"]), ", ")
    per = F.transform(F.slice("clusters", 1, 4), lambda k: text(F.when(heart, "Heart failure").otherwise("Clinical"), " management or follow-up guidance for ", k, " with focus on ", of(k), "."))
    about = [F.when(heart, text("Heart failure guidance for this patient profile, especially cardio-renal safety, congestion, and GDMT considerations for ", focus(4), "."))]
    about += [F.when(heart & F.arrays_overlap("clusters", F.array(*map(F.lit, names))), said) for names, said in _HEART_QUERIES]
    each = F.transform(F.slice("abnormal", 1, 3), lambda x: text("Clinical management or follow-up guidance for ", x["label"], " with patient value ", x["value"], "."))
    alone = F.when(given & (F.size("keys") == 0), question_queries(F.col("asked"))).otherwise(F.array().cast("array<string>"))
    more = F.concat(alone, own, per, F.array(*about), each) if adaptive else F.array().cast("array<string>")
    queries = F.array_distinct(F.filter(F.transform(F.array_compact(F.concat(F.array("base_query"), more)), F.trim), lambda x: x != ""))
    return r.select("request_id", "question", "base_query", queries.alias("queries"), "clusters", "specialty")
