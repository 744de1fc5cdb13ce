"""Checks of answers and answers made of what was found, as columns over one row per request.

A row has: question, answer, contexts (array of title and snippet, few), keys (names of the patient's variables),
potassium (a number), and known, recognised, abnormal and clusters as clinical.portrait has them. prepared() adds what the checks share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import GUIDANCE_STOPWORDS, terms

from .clinical import HEART_FAILURE_ORDER, HEART_FAILURE_WORDS, has_any, missing_details, prioritised, specialty
from .guidance import actionable, expected_items, focus_terms, numbered_items, says_unknown
from .planning import explicit_question, literal_question

# Phrases of answers that say nothing, sections an answer needs, words for its sources, and signs of uncertainty.
EMPTY_PHRASES = ["clinically relevant pattern", "interpreted as a whole rather than marker by marker", "prioritize the most abnormal findings first", "use the retrieved guidance to prioritize"]
SECTIONS = ["direct answer", "rationale", "caution", "general advice"]
SOURCE_WORDS = ["document", "pdf", "source", "chunk", "page", "retrieved context", "most relevant document"]
UNCERTAIN = "i don't know|missing|uncertain|limited|cautious|may miss|may be incomplete|relying only|relying on|adjacent text|exact wording matters|retrieve the adjacent excerpt|only on the supplied excerpts|only on the retrieved excerpts".split("|")
# Other words for a cluster.
ALIASES = {
    "HF severity and congestion": ["heart failure", "hf", "congestion", "decompensation", "natriuretic"],
    "Cardio-renal and electrolyte safety": ["renal", "kidney", "electrolyte", "potassium", "sodium", "creatinine", "cardio-renal"],
    "Rhythm and conduction": ["rhythm", "conduction", "heart rate", "qrs", "atrial fibrillation"],
    "Anemia and iron status": ["anemia", "iron", "hemoglobin", "ferritin", "transferrin"],
    "Inflammation and injury": ["inflammation", "injury", "crp", "troponin", "inflammatory"],
    "Glycemic and cardiometabolic risk": ["glycemic", "cardiometabolic", "glucose", "hba1c", "diabetes", "metabolic"],
}
UNSUPPORTED = "aliskiren"
SEVERE = ["empty", "missing the", "too short", "document-selection", "potassium value", "unsupported treatment-specific wording", "literal question"]
# Headings and the ones they stand for, and what is taken out of answers.
HEADINGS = {"Evidence-based recommendation": "Direct answer", "Main answer": "Direct answer", "Document-grounded general guidance": "General advice", "Uncertainty and missing data": "Caution"}
CLEANUP = [
    r"the most relevant (document|source|pdf)[^.\n]*[.\n]", r"the pdf says[^.\n]*", r"the document says[^.\n]*", r"the best (document|source|pdf)[^.\n]*", r"based on the retrieved context,?", r"retrieved context", r"this document provides",
    r"the pdf provides", r"the available evidence is the [^.\n]*", r"###\s*Direct\s*Answer", r"###\s*Rationale", r"###\s*Caution", r"###\s*General\s*Advice",
]


def _contains(words: Column, text: Column) -> Column:
    """How many of the words a text has anywhere."""
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


def relevant_sentences(focus: Column, snippets: Column, limit: int) -> Column:
    """Sentences of the snippets by focus terms, then length; after the first one only those that have a term."""
    cut = F.flatten(F.transform(snippets, lambda s: F.split(s, r"(?<=[.!?;])\s+", -1)))
    clean = F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    scored = F.array_sort(F.transform(clean, lambda s, i: F.struct((-F.size(F.array_intersect(terms(s, GUIDANCE_STOPWORDS), focus))).alias("n"), (-F.length(s)).alias("size"), i.alias("at"), s.alias("s"))))
    distinct = F.array_distinct(F.transform(scored, lambda x: F.struct(x["n"].alias("n"), x["s"].alias("s"))))
    return F.slice(F.transform(F.filter(distinct, lambda x, i: (i == 0) | (x["n"] < 0)), lambda x: x["s"]), 1, limit)


def prepared(rows: DataFrame) -> DataFrame:
    """rows with what several checks use, computed once: low, block, snippets, said, has_patient, literal, explicit, focus, expected, items, best, specialty, heart, priority."""
    rows = rows.withColumns({"snippets": F.transform("contexts", lambda c: F.coalesce(c["snippet"], F.lit(""))), "said": F.lower(F.array_join(F.transform("contexts", lambda c: F.concat(F.coalesce(c["title"], F.lit("")), F.lit(" "), F.coalesce(c["snippet"], F.lit("")))), " "))})
    asked = terms(F.col("question"), GUIDANCE_STOPWORDS)
    has_patient = (F.size("keys") > 0) | (F.size("known") > 0)
    name = specialty(F.array_distinct(F.concat(F.transform("keys", F.lower), "recognised")), (F.size("contexts") > 0) & has_any(F.col("said"), HEART_FAILURE_WORDS))
    rows = rows.withColumns({
        "low": F.lower(F.trim(F.coalesce("answer", F.lit("")))), "has_patient": has_patient, "literal": literal_question(F.col("question"), has_patient), "explicit": explicit_question(F.col("question"), has_patient),
        "asked": asked, "in_contexts": F.filter(asked, lambda t: (F.length(t) > 3) & F.contains("said", t)), "focus": focus_terms(asked, F.col("said")), "expected": expected_items(F.col("question")),
        "items": numbered_items(F.array_join("snippets", " ")), "specialty": name,
    })
    return rows.withColumns({"block": F.substring_index("low", "2. rationale", 1), "best": relevant_sentences(F.col("focus"), F.col("snippets"), 3), "heart": F.col("specialty") == "heart_failure", "priority": prioritised(F.col("clusters"), F.col("specialty") == "heart_failure")})


def _says_a_sentence(n: int) -> Column:
    return F.exists(F.slice("best", 1, n), lambda s: F.size(F.array_intersect(terms(s, GUIDANCE_STOPWORDS), terms(F.col("block"), GUIDANCE_STOPWORDS))) >= 3)


def _anchors(n: Column, least: int, each: int | None) -> Column:
    """Terms of more than four letters of the first n items, at most `each` of an item, in their order."""
    own = lambda x: F.filter(terms(x, GUIDANCE_STOPWORDS), lambda t: F.length(t) >= least)
    return F.array_distinct(F.flatten(F.transform(F.slice("items", F.lit(1), n), lambda x: own(x) if each is None else F.slice(own(x), 1, each))))


def addresses_literal() -> Column:
    """Does an answer of prepared() rows answer a question about the wording?"""
    lines = F.size(F.filter(F.transform(F.split("block", "\n", -1), lambda x: F.trim(x)), lambda x: x.rlike(r"^(-|[1-5]\.)")))
    few = F.col("expected").isNotNull() & (F.size("items") > 0) & (lines < F.least("expected", F.lit(3)))
    found = _contains(F.col("in_contexts"), F.col("block")) >= 2
    anchored = _contains(_anchors(F.greatest(F.coalesce("expected", F.lit(0)), F.lit(3)), 5, 2), F.col("block")) > 0
    return ~has_any(F.col("block"), EMPTY_PHRASES) & ~F.coalesce(few, F.lit(False)) & (found | anchored | _says_a_sentence(2))


def addresses_explicit() -> Column:
    """Does an answer of prepared() rows take up the question?"""
    focus = F.filter("focus", lambda t: F.length(t) > 3)
    found = _contains(focus, F.col("block")) >= F.least(F.lit(2), F.greatest(F.lit(1), F.size(focus)))
    return ~has_any(F.col("block"), EMPTY_PHRASES) & (found | _says_a_sentence(3) | (_contains(F.slice(_anchors(F.lit(4), 5, None), 1, 6), F.col("block")) > 0))


def issues() -> Column:
    """What is wrong with an answer of prepared() rows, in order of the texts; nothing with one that says that it doesn't know."""
    low = F.col("low")
    own = F.filter("priority", lambda k: F.lit(True))
    labels = lambda k: F.transform(F.slice(F.filter("abnormal", lambda x: x["cluster"] == k), 1, 3), lambda x: F.lower(x["label"]))
    other = F.create_map(*(x for k, words in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, words)))))
    targets = lambda k: F.concat(F.array(F.lower(k)), labels(k), F.coalesce(F.try_element_at(other, k), F.array().cast("array<string>")))
    silent = F.transform(F.filter(own, lambda k: _contains(targets(k), low) == 0), lambda k: F.concat(F.lit("Answer does not acknowledge the '"), k, F.lit("' abnormality cluster.")))
    text = lambda cond, said: F.when(cond, said)
    question = F.when(F.col("literal"), text(~addresses_literal(), "Answer does not directly answer the literal question.")).when(F.col("explicit"), text(~addresses_explicit(), "Answer does not directly address the explicit question."))
    question = question.when(~F.col("literal") & ~F.col("explicit") & ~actionable(F.col("block")), "Direct answer summarizes findings but does not provide actionable guidance.")
    found = F.array(
        text(low == "", "Answer is empty."),
        *(text(~F.contains(low, F.lit(s)), f"Answer is missing the '{s}' section.") for s in SECTIONS),
        text(F.regexp_count(low, F.lit(r"\S+")) < 35, "Answer is too short to be useful."),
        text(has_any(low, SOURCE_WORDS), "Answer mentions sources or document-selection language instead of giving direct guidance."),
        text(~has_any(F.substring_index(low, "4. general advice", 1), UNCERTAIN), "Answer may not clearly communicate uncertainty."),
        question,
        text((F.col("potassium") >= 5.0) & F.contains(low, F.lit("hypokalemia")), "Answer contradicts the patient potassium value."),
        text((F.size("contexts") > 0) & F.contains(low, F.lit(UNSUPPORTED)) & ~F.contains("said", F.lit(UNSUPPORTED)), "Answer introduces unsupported treatment-specific wording."),
    )
    return F.when(says_unknown(F.col("answer")), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.array_compact(F.concat(found, silent)))))


def needs_made_answer(found: Column, sufficient: Column) -> Column:
    """Must an answer with these issues give way to one that is made of the contexts?"""
    severe = F.exists(found, lambda x: has_any(F.lower(x), SEVERE))
    return severe | F.when(F.col("literal"), ~addresses_literal()).otherwise((F.col("explicit") & ~addresses_explicit()) | ~actionable(F.col("answer")) | (~sufficient & (F.size(found) >= 2)))


def verified(found: Column) -> Column:
    """(verdict, issues, confidence) by the rules alone."""
    bad = F.size(found) > 0
    return F.struct(F.when(bad, "fail").otherwise("pass").alias("verdict"), F.when(bad, found).otherwise(F.array(F.lit("none"))).alias("issues"), F.when(bad, "medium").otherwise("low").alias("confidence"))


def read_verdict(raw: Column) -> Column:
    """(verdict, issues, confidence) of a text with the lines VERDICT, ISSUES and CONFIDENCE; null without a verdict."""
    verdict = F.lower(F.regexp_extract(raw, r"(?i)VERDICT\s*:\s*(PASS|FAIL)", 1))
    sure = F.lower(F.regexp_extract(raw, r"(?i)CONFIDENCE\s*:\s*(HIGH|MEDIUM|LOW)", 1))
    lines = F.split(F.regexp_extract(raw, r"(?is)ISSUES\s*:(.*?)(?:CONFIDENCE\s*:|$)", 1), "\n", -1)
    told = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[\s\-•*]+", ""))), lambda x: x != "")
    return F.when(verdict != "", F.struct(verdict.alias("verdict"), F.when(F.size(told) > 0, told).otherwise(F.array(F.lit("none"))).alias("issues"), F.when(sure == "", "low").otherwise(sure).alias("confidence")))


def normalised_answer(answer: Column, contexts: Column, potassium: Column) -> Column:
    """An answer with the usual headings and without names of sources (source_id, title of contexts) and words about them; with a high potassium also without sentences on a low one."""
    out = F.trim(F.coalesce(answer, F.lit("")))
    for old, new in HEADINGS.items():
        out = F.regexp_replace(out, rf"(?i)\b{old}\b", new)
    names = F.filter(F.flatten(F.transform(contexts, lambda c: F.array(c["source_id"], c["title"]))), lambda x: F.coalesce(x, F.lit("")) != "")
    # A name may have what ends a quotation in an expression.
    quoted = lambda name: F.concat(F.lit(r"(?iu)\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    out = F.aggregate(F.array_distinct(names), out, lambda text, name: F.regexp_replace(text, quoted(name), F.lit("the available evidence")))
    for pattern in CLEANUP:
        out = F.regexp_replace(out, f"(?i){pattern}", "")
    out = F.when(potassium >= 5.0, F.regexp_replace(out, r"(?i)[^.\n]*hypokalemia[^.\n]*[.\n]?", "")).otherwise(out)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "), F.lit(" \t\n"))


# What a cluster's findings mean and what to do about them; those of heart failure only where that is the specialty, those of the rhythm only with a high rate.
POINTS = {
    "HF severity and congestion": ("The overall profile is compatible with significant heart-failure burden or congestion risk rather than an isolated laboratory abnormality.", "Assess heart-failure severity, congestion or volume status, and tolerance of current therapy as a near-term priority."),
    "Cardio-renal and electrolyte safety": ("Renal function and electrolyte safety appear clinically important in this case", "Monitor renal function, potassium, and sodium closely and review treatment tolerance or contributors that could worsen cardio-renal safety."),
    "Rhythm and conduction": ("The elevated heart rate may reflect hemodynamic stress, rhythm-related burden, or decompensation in the broader clinical picture.", "Reassess heart rate or rhythm together with blood pressure, symptoms, and overall hemodynamic status."),
    "Anemia and iron status": ("The low hemoglobin or iron markers suggest anemia or iron deficiency that may worsen symptoms, exercise tolerance, and overall cardiovascular risk.", "Work up iron deficiency or anemia in the broader clinical context instead of treating it as a minor incidental finding."),
    "Inflammation and injury": ("Inflammatory or injury markers are elevated, but the cause cannot be determined from biomarkers alone.", "Interpret inflammatory or injury markers together with symptoms, examination findings, and the rest of the clinical picture before drawing stronger conclusions."),
    "Glycemic and cardiometabolic risk": ("Glycemic or cardiometabolic abnormalities may be contributing comorbidity rather than the main driver, but they still add to overall risk and follow-up needs.", "Review glycemic and cardiometabolic control as part of follow-up, especially if these findings are persistent or already known."),
}
NO_POINT = "The main value abnormalities point to a clinically relevant pattern that should be interpreted as a whole rather than marker by marker."
NO_ACTION = "Use the retrieved guidance to prioritize the most abnormal findings first, while keeping uncertainty explicit where evidence is thin."


def synthesis() -> Column:
    """(points, actions) of prepared() rows, at most four each."""
    has = lambda names, status: F.exists("abnormal", lambda x: x["name"].isin(*names) & (x["status"] == status))
    high_k, low_na = has(["potassium"], "high"), has(["sodium"], "low")
    which = F.concat_ws(" and ", F.when(high_k, "elevated potassium"), F.when(low_na, "low sodium"))
    renal = F.concat(F.lit(POINTS[HEART_FAILURE_ORDER[1]][0]), F.when(high_k | low_na, F.concat(F.lit(", especially because the abnormalities include "), which)).otherwise(""), F.lit("."))
    holds = {k: F.array_contains("clusters", k) for k in HEART_FAILURE_ORDER}
    holds[HEART_FAILURE_ORDER[0]] = holds[HEART_FAILURE_ORDER[0]] & F.col("heart")
    holds[HEART_FAILURE_ORDER[2]] = holds[HEART_FAILURE_ORDER[2]] & has(["heart_rate", "heartrate", "pulse"], "high")
    of = lambda i, none: F.slice(F.when(F.size(F.array_compact(F.array(*(F.when(holds[k], F.lit(POINTS[k][i])) for k in POINTS)))) > 0, F.array_compact(F.array(*(F.when(holds[k], renal if i == 0 and k == HEART_FAILURE_ORDER[1] else F.lit(POINTS[k][i])) for k in POINTS)))).otherwise(F.array(F.lit(none))), 1, 4)
    return F.struct(of(0, NO_POINT).alias("points"), of(1, NO_ACTION).alias("actions"))


# What contexts that have one of the words support, for heart failure and otherwise.
EVIDENCE = {
    True: [
        (["creatinine", "urea", "electrolytes", "renal function"], "The grounded guidance supports close monitoring of renal function and electrolytes in the heart-failure setting"),
        (["nephrotoxic", "nsaid", "salt substitutes", "potassium supplements"], "The grounded guidance supports reviewing nephrotoxic or potassium-raising contributors when cardio-renal safety is a concern"),
        (["congestion", "euvolaemia", "euvolemia", "diuretic"], "The grounded guidance supports interpreting renal and electrolyte changes together with congestion status and diuretic therapy"),
        (["specialist advice", "advanced heart failure", "referral"], "The grounded guidance supports escalation or specialist review when severe or treatment-limiting features accumulate"),
    ],
    False: [
        (["creatinine", "renal function", "electrolytes"], "The grounded guidance supports close monitoring of renal function and electrolytes"),
        (["nephrotoxic"], "The grounded guidance supports reviewing nephrotoxic medicines or other contributors to renal stress"),
    ],
}
HIGH_POTASSIUM = "The grounded guidance supports follow-up of elevated potassium rather than assuming it is benign"
CAUTIOUS = "Treatment decisions should stay cautious because only part of the clinical picture is directly covered by the retrieved guidance."
PARTLY = "I cannot make a treatment-specific recommendation with confidence because the retrieved guidance only partially covers the dominant findings."
NO_HISTORY = "I do not have the full history, medication list, and trend data needed for a stronger patient-specific conclusion."
ADVICE = {
    "heart_failure": ["Review these results together with symptoms, blood pressure or volume status, medication history, and prior laboratory or imaging trends.", "In heart-failure-oriented cases, trend natriuretic peptides, renal function, potassium, sodium, congestion signs, and therapy tolerance when clinically appropriate."],
    "metabolic": ["Review these results together with symptoms, diabetes history, medication use, and whether the glucose value was fasting or random.", "Trend glucose and HbA1c over time rather than over-interpreting a single measurement in isolation."],
    "other": ["Review these results together with symptoms, medication history, and prior laboratory trends.", "Repeat or trend abnormal values when clinically appropriate."],
}
SPECIALIST = "If the overall picture suggests worsening heart failure, persistent congestion, or poor tolerance of guideline-directed therapy, seek specialist heart-failure review."
UNCOVERED = "Do not over-interpret findings that are not well covered by the retrieved guidance."
# Lines of answers that are made of the contexts alone.
UNAVAILABLE, TOO_LITTLE = "Unavailable from the retrieved evidence.", "The available excerpts do not provide enough detail for a stronger grounded answer."
PARTIAL, ONLY_EXCERPTS = "I cannot give a fuller answer with confidence because the retrieved excerpts appear partial or incomplete.", "I am relying only on the supplied excerpts and may miss detail that appears in adjacent text."
TRUNCATED, CUT_END = "One excerpt appears truncated, so the final item wording may be incomplete.", "memb"
EXACT, ADJACENT = "If exact wording matters, retrieve the adjacent excerpt or the full table entry before making the answer more specific.", "Retrieve adjacent text or the full table entry before making the answer more specific or treatment-prescriptive."
UNKNOWN_ANSWER = "Based on the provided context, I don't know."


def _listed(*lines: Column) -> Column:
    return F.array_compact(F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines)))


def _or(lines: Column, other: str) -> Column:
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(other)))


def _page(direct: Column, rationale: Column, caution: Column, advice: Column) -> Column:
    """The four sections of an answer; every line gets a dash."""
    dashed = lambda lines: F.transform(lines, lambda x: F.concat(F.lit("- "), x))
    parts = [("1. Direct answer", direct), ("2. Rationale", rationale), ("3. Caution", caution), ("4. General advice", advice)]
    return F.array_join(F.concat(*(F.concat(F.array(F.lit(("\n" if i else "") + head)), dashed(lines)) for i, (head, lines) in enumerate(parts))), "\n")


def _clinical_answer(assessed: dict[str, Column]) -> Column:
    heart, sufficient, points = F.col("heart"), assessed["sufficient"], synthesis()
    found = lambda kind: _listed(*(F.when(has_any(F.array_join(F.transform("snippets", F.lower), " "), words), said) for words, said in EVIDENCE[kind]))
    evidence = F.concat(F.when(heart, found(True)).otherwise(found(False)), _listed(F.when(has_any(F.lower(F.array_join("snippets", " ")), ["potassium"]) & F.coalesce(F.col("potassium") >= 5.0, F.lit(False)), HIGH_POTASSIUM)))
    direct = F.concat(F.slice(points["points"], 1, 1), F.slice(points["actions"], 1, 3), F.slice(evidence, 1, 2), _listed(F.when(~sufficient, CAUTIOUS)))
    order = F.array_union(F.array_intersect(F.array(*map(F.lit, HEART_FAILURE_ORDER)), "clusters"), F.col("clusters"))
    phrase = lambda x: F.concat(x["label"], F.lit(" "), x["status"], F.lit(" ("), x["value"], F.coalesce(F.concat(F.lit(" "), F.nullif(x["unit"], F.lit(""))), F.lit("")), F.lit(")"))
    named = lambda k: F.concat(k, F.lit(": "), F.array_join(F.transform(F.slice(F.filter("abnormal", lambda x: x["cluster"] == k), 1, 3), phrase), ", "), F.lit("."))
    of = F.when(heart, F.array_intersect(order, F.array(*map(F.lit, HEART_FAILURE_ORDER)))).otherwise(F.slice("clusters", 1, 4))
    direct = F.slice(F.when(F.size(direct) < 3, F.concat(direct, F.transform(of, named))).otherwise(direct), 1, 5)
    summed = lambda k: F.concat(k, F.lit(": "), F.array_join(F.transform(F.slice(F.filter("abnormal", lambda x: x["cluster"] == k), 1, 2), lambda x: x["summary"]), "; "))
    rationale = F.slice(F.concat(F.slice(points["points"], 1, 2), F.transform(F.slice(order, 1, 3), summed)), 1, 5)
    bare = F.filter("priority", lambda k: F.coalesce(F.try_element_at(assessed["coverage"], k), F.lit(0)) == 0)
    lacks = missing_details(F.col("keys"), F.col("specialty"), F.col("clusters"), F.transform("abnormal", lambda x: x["name"]))
    caution = _listed(
        F.when(F.size(assessed["reasons"]) > 0, PARTLY),
        F.when(F.size(bare) > 0, F.concat(F.lit("Guidance coverage is limited for: "), F.array_join(bare, ", "), F.lit("."))),
        F.when(F.size(lacks) > 0, F.concat(F.lit("Key missing context that could change the recommendation: "), F.array_join(F.slice(lacks, 1, 3), ", "), F.lit("."))),
    )
    lines = lambda name: F.array(*map(F.lit, ADVICE[name]))
    severe = F.exists("abnormal", lambda x: x["name"].isin("ef", "lvef", "bnp", "nt_pro_bnp", "nyha"))
    advice = F.when(heart, F.concat(lines("heart_failure"), _listed(F.when(severe, SPECIALIST)))).when(F.col("specialty") == "metabolic", lines("metabolic")).otherwise(lines("other"))
    return _page(direct, rationale, _or(caution, NO_HISTORY), F.concat(advice, _listed(F.when(~sufficient, UNCOVERED))))


def made_answer(sufficient: Column, reasons: Column, coverage: Column, unknown: bool = False) -> Column:
    """An answer made of what is known, for prepared() rows: of the wording of the contexts, of their sentences, or of the patient's findings.

    sufficient, reasons: as guidance.judged_contexts has them; coverage: a map of clusters and the number of contexts that speak for them.
    abnormal needs `summary` as well. unknown: say so instead of reading findings.
    """
    ended = lambda xs: F.transform(xs, lambda x: F.concat(x, F.lit(".")))
    items, n, best = F.col("items"), F.col("expected"), F.col("best")
    some = F.size(items) > 0
    most = F.coalesce(n, F.lit(4))
    combined = F.array_join("snippets", " ")
    direct = _or(F.when(some, ended(F.slice(items, F.lit(1), most))).otherwise(best), UNAVAILABLE)
    counted = F.when(some, F.concat(F.lit("The retrieved excerpts explicitly enumerate "), F.size(F.slice(items, F.lit(1), F.coalesce(n, F.size(items)))).cast("string"), F.lit(" items relevant to the question.")))
    cut = F.endswith(F.lower(F.rtrim(combined)), F.lit(CUT_END))
    literal = _page(F.slice(direct, F.lit(1), F.greatest(most, F.lit(4))), F.slice(_or(F.concat(_listed(counted), F.slice(best, 1, 2)), TOO_LITTLE), 1, 3), _or(_listed(F.when(~sufficient, PARTIAL), F.when(cut, TRUNCATED)), ONLY_EXCERPTS), F.array(F.lit(EXACT)))
    sentences = F.transform(best, lambda s: F.replace(F.concat(F.rtrim(s, F.lit(".")), F.lit(" .")), F.lit("  "), F.lit(" ")))
    explicit = _page(F.slice(_or(F.when(some, ended(items)).otherwise(sentences), UNAVAILABLE), 1, 4), _or(F.slice(best, 1, 2), TOO_LITTLE), _or(_listed(F.when(~sufficient, PARTIAL)), ONLY_EXCERPTS), F.array(F.lit(ADJACENT)))
    clinical = F.lit(UNKNOWN_ANSWER) if unknown else _clinical_answer({"sufficient": sufficient, "reasons": reasons, "coverage": coverage})
    return F.when(F.col("literal"), literal).when(F.col("explicit"), explicit).otherwise(clinical)
