"""Questions: how many items they ask for, and the sentences that answer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.text import GUIDANCE_STOPWORDS, terms

from .clinical import HEART_FAILURE_WORDS, has_any, prioritised, said_for, specialty
from .retrieval import first_of, top

#: Fixed values.
NUMBERS = "two three four five six seven eight nine ten".split()


def expected_items(question: Column) -> Column:
    """The first number from 2 to 10 in a question as digits, or else the least one as a word; null if there is none."""
    low = F.lower(F.coalesce(question, F.lit("")))
    alone = lambda x: rf"(?:^|[^\p{{L}}\p{{N}}_])({x})(?:$|[^\p{{L}}\p{{N}}_])"
    digit = F.regexp_extract(low, alone("[2-9]|10"), 1).try_cast("int")
    return F.coalesce(digit, *(F.when(low.rlike(alone(w)), F.lit(i)) for i, w in enumerate(NUMBERS, 2)))


def numbered_items(text: Column) -> Column:
    """What follows each of `1.` to `9.` that no letter, digit or underscore precedes, up to the next one, without marks at its ends."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"(?<![\p{L}\p{N}_])[1-9]\.\s*", "\x01")
    parts = F.split(marked, "\x01", -1)
    return F.filter(F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.trim(x, F.lit(" ;,.-"))), lambda x: x != "")


def _said(contexts: DataFrame) -> Column:
    """Title and snippet of a context in lower case."""
    return F.lower(F.concat(F.coalesce("title", F.lit("")) if "title" in contexts.columns else F.lit(""), F.lit(" "), F.coalesce("snippet", F.lit(""))))


def focus_terms(asked: Column, said: Column) -> Column:
    """Terms of more than three letters that the contexts' text has anywhere; if there is none, all terms."""
    there = F.filter(asked, lambda t: (F.length(t) > 3) & F.contains(said, t))
    return F.when(F.size(there) > 0, there).otherwise(asked)


def best_sentences(questions: DataFrame, contexts: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, sentence, overlap, rank): the sentences of each question's contexts (query_id, ord, title, snippet) that have most of its focus terms, longer ones first; after the first one only those that have one."""
    every = contexts.groupBy("query_id").agg(F.array_join(F.collect_list(_said(contexts)), " ").alias("said"))
    asked = questions.select("query_id", terms(F.col("text"), GUIDANCE_STOPWORDS).alias("q")).join(every, "query_id").select("query_id", focus_terms(F.col("q"), F.col("said")).alias("q"))
    said = contexts.select("query_id", "ord", F.posexplode(F.split(F.coalesce("snippet", F.lit("")), r"(?<=[.!?;])\s+", -1)).alias("at", "sentence"))
    said = said.withColumn("sentence", F.trim(F.regexp_replace("sentence", r"\s+", " "))).where("sentence <> ''").join(asked, "query_id")
    said = said.withColumn("overlap", F.size(F.array_intersect(terms(F.col("sentence"), GUIDANCE_STOPWORDS), "q")))
    order = [F.col("overlap").desc(), F.length("sentence").desc(), F.col("ord"), F.col("at")]
    ranked = top(first_of(said, ["query_id", "sentence"], order), ["query_id"], order, limit)
    return ranked.where("rank = 1 OR overlap > 0").select("query_id", "sentence", "overlap", "rank")


# Words of answers that name an action, beginnings of those that say they don't know, and phrases of generic ones.
ACTIONS = "monitor|review|assess|reassess|trend|follow-up|follow up|evaluate|check|prioritize|seek|consider|tolerance|contributors".split("|")
UNKNOWN = ("based on the provided context, i don't know", "based on the provided context i don't know", "i can't give a grounded answer from the provided context", "i cannot give a grounded answer from the provided context")
GENERIC = ("the main value abnormalities point to a clinically relevant pattern", "interpreted as a whole rather than marker by marker", "use the retrieved guidance to prioritize the most abnormal findings first", "review these results together with symptoms", "key missing context that could change the recommendation")


def actionable(answer: Column) -> Column:
    """Does an answer name an action?"""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(F.array(*map(F.lit, ACTIONS)), lambda x: F.contains(low, x))


def says_unknown(answer: Column) -> Column:
    low = F.regexp_replace(F.trim(F.lower(F.coalesce(answer, F.lit("")))), r"\s+", " ")
    return F.exists(F.array(*map(F.lit, UNKNOWN)), lambda x: F.startswith(low, x))


def generic(answer: Column) -> Column:
    """Has an answer two or more of the generic phrases?"""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, GENERIC)), lambda x: F.contains(low, x))) >= 2


_NO_FINDINGS = "array<struct<name:string,label:string,cluster:string>>"


def _asked(questions: DataFrame) -> DataFrame:
    """Questions with empty arrays for what they don't have: profile_terms, abnormal (name, label, cluster), clusters, recognised."""
    or_empty = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind)) if name in questions.columns else F.array().cast(kind)
    return questions.select(
        "query_id", terms(F.col("text"), GUIDANCE_STOPWORDS).alias("q"), F.transform(or_empty("profile_terms", "array<string>"), F.lower).alias("p"),
        F.coalesce(F.transform("abnormal", lambda x: F.struct(x["name"].alias("name"), x["label"].alias("label"), x["cluster"].alias("cluster"))) if "abnormal" in questions.columns else F.lit(None).cast(_NO_FINDINGS), F.array().cast(_NO_FINDINGS)).alias("abnormal"),
        or_empty("clusters", "array<string>").alias("clusters"), or_empty("recognised", "array<string>").alias("recognised"),
    )


def _covered(said: Column) -> Column:
    """The clusters, in their order, of which a context speaks for a finding."""
    return F.array_distinct(F.transform(F.filter("abnormal", lambda x: said_for(said, x["name"], x["label"])), lambda x: x["cluster"]))


def judged_contexts(questions: DataFrame, contexts: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, n, hits, cluster_coverage, reasons, sufficient, confidence, topical_terms): do a question's contexts (query_id, ord, title, snippet) cover it?

    questions (query_id, text, profile_terms; abnormal, clusters, recognised as clinical.portrait has them). A context is a hit
    if it shares a word with the question, or else names one of the profile's terms. A question's contexts are few.
    """
    c = contexts.select("query_id", _said(contexts).alias("said")).groupBy("query_id").agg(F.collect_list("said").alias("said"))
    met = _asked(questions).join(c, "query_id", "left").withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    hit = lambda s: F.arrays_overlap("q", terms(s, GUIDANCE_STOPWORDS)) | F.exists("p", lambda t: F.contains(s, t))
    spoken = F.flatten(F.transform("said", lambda s: _covered(s)))
    met = met.select("query_id", "q", "p", "abnormal", "clusters", F.size("said").alias("n"), F.size(F.filter("said", hit)).alias("hits"), spoken.alias("spoken"), (specialty(F.col("recognised"), F.exists("said", lambda s: has_any(s, HEART_FAILURE_WORDS))) == "heart_failure").alias("heart"))
    focus = prioritised(F.col("clusters"), F.col("heart"))
    out = met.withColumn("reasons", F.array_compact(F.array(
        F.when(F.col("n") < least, "too_few_context_chunks"),
        F.when(F.col("hits") == 0, "no_clear_query_term_overlap"),
        F.when((F.size("abnormal") > 0) & (F.size("p") == 0), "no_abnormal_terms_available"),
        F.when(F.size(F.array_except(focus, "spoken")) > 0, "incomplete_cluster_coverage"),
    )))
    bad = F.size("reasons")
    confidence = F.when(bad > 1, "low").when(bad == 1, "medium").when(F.col("n") >= max(3, least), "high").otherwise("medium")
    per_cluster = F.transform("clusters", lambda k: F.struct(k.alias("cluster"), F.size(F.filter("spoken", lambda x: x == k)).alias("n")))
    topical = F.slice(F.array_sort(F.array_distinct(F.when(F.size("p") > 0, F.col("p")).otherwise(F.col("q")))), 1, 8)
    return out.select("query_id", "n", "hits", per_cluster.alias("cluster_coverage"), "reasons", (bad == 0).alias("sufficient"), confidence.alias("confidence"), topical.alias("topical_terms"))


# Words of a context that count for a profile of heart failure.
_HEART = ["heart failure", "hf", "hfr ef", "hfref", "congestion", "diuretic", "raas", "arni", "mra", "sglt2"]


def ranked_contexts(questions: DataFrame, contexts: DataFrame, limit: int) -> DataFrame:
    """(query_id, ord, score, clusters, rank): first the contexts that speak for a cluster as the best ones of it, then the others that score, by score and `ord`; a context without score only if nothing else is there.

    Score: shared words, profile terms at one and a half, clusters, and one and a quarter for heart failure. Contexts of a
    question are distinct. A context is the first of a cluster exactly if no better one speaks for it, so picking needs no loop.
    """
    asked = _asked(questions)
    c = contexts.select("query_id", "ord", _said(contexts).alias("said"))
    about = c.groupBy("query_id").agg(F.max(has_any(F.col("said"), HEART_FAILURE_WORDS)).alias("about"))
    heart = specialty(F.col("recognised"), F.coalesce("about", F.lit(False))) == "heart_failure"
    met = c.join(asked.join(about, "query_id", "left").withColumn("heart", heart), "query_id")
    shared, named = F.size(F.array_intersect("q", terms(F.col("said"), GUIDANCE_STOPWORDS))), F.size(F.filter(F.array_distinct("p"), lambda t: F.contains(F.col("said"), t)))
    met = met.withColumn("covers", _covered(F.col("said")))
    score = shared + 1.5 * named + F.size("covers") + 1.25 * (F.col("heart") & has_any(F.col("said"), _HEART)).cast("int")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord")
    scored = met.select("query_id", "ord", score.alias("score"), "covers").withColumn("place", F.row_number().over(by_score))
    best = Window.partitionBy("query_id", "cluster")
    firsts = scored.select("query_id", "ord", "place", F.explode("covers").alias("cluster")).withColumn("first", F.min("place").over(best)).where("place = first").select("query_id", "ord").distinct().withColumn("picked", F.lit(True))
    chosen = scored.join(firsts, ["query_id", "ord"], "left").withColumn("picked", F.coalesce("picked", F.lit(False)))
    ranked = top(chosen.where("picked OR score > 0 OR place = 1"), ["query_id"], [F.col("picked").desc(), F.col("place")], limit)
    return ranked.where("picked OR score > 0 OR rank = 1").select("query_id", "ord", "score", F.col("covers").alias("clusters"), "rank")
