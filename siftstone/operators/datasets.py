"""Benchmark datasets: passages, mixes, anchors, summaries and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.functions.text import let, squeezed


def padded(n: Column) -> Column:
    """A number in three digits at least."""
    shown = n.cast("string")
    return F.lpad(shown, F.greatest(F.lit(3), F.length(shown)), F.lit("0"))


# Headings of sections, how lines of running heads begin, and words that tell a page of references.
SECTIONS = ["IN WHOM AND WHEN?", "HOW TO USE?", "PROBLEM SOLVING", "ADVICE TO PATIENT"]
RUNNING_HEAD = "esc guidelines"
REFERENCES, CITED = "references", ("doi", "et al")


def references_page(text: Column) -> Column:
    """Does a page list references: does it name them, and more than three works?"""
    low = F.lower(text)
    number = lambda w: (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
    return F.contains(low, F.lit(REFERENCES)) & (number(CITED[0]) + number(CITED[1]) > 3)


def line_blocks(text: Column, most: int) -> Column:
    """The lines of a page without paragraphs as blocks: a heading begins one, and so does the line after `most` words. Page numbers and running heads go."""
    # Not F.trim itself: it has a second parameter, for which transform would pass each line's place.
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\d+$") & ~F.startswith(F.lower(x), F.lit(RUNNING_HEAD)))
    heading = lambda x: ((F.upper(x) == x) & (F.lower(x) != x)) | F.array_contains(F.transform(F.array(*map(F.lit, SECTIONS)), lambda h: F.startswith(x, h)), True)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("words"))

    def step(s: Column, x: Column) -> Column:
        n = F.size(F.split(squeezed(x), " "))
        new = (s["words"] > 0) & (heading(x) | (s["words"] >= most))
        return F.struct(F.when(new, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"), F.when(new | (s["words"] == 0), x).otherwise(F.concat(s["now"], F.lit(" "), x)).alias("now"), (F.when(new, 0).otherwise(s["words"]) + n).alias("words"))

    return F.aggregate(kept, start, step, lambda s: F.when(s["words"] > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"]))


def section_title(text: Column) -> Column:
    """The section heading that a passage names, or else the begin of its first sentence; null if that is empty."""
    named = F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(h.lower())), h) for h in SECTIONS))
    return F.coalesce(named, F.nullif(F.substring(F.trim(F.substring_index(text, ".", 1)), 1, 80), F.lit("")))


def passages(pages: DataFrame, least: int = 40, most: int = 180, skip: int = 0, stop_at_references: bool = True) -> DataFrame:
    """(source_id, page_number, passage_id, text, words, section) of pages (source_id, page_number, text).

    The first `skip` pages are left out, and all from a document's first page of references on. A page's blocks are its
    paragraphs, or, if it has only one, its lines (line_blocks); blocks of at least `least` words count, longer ones are
    cut after every `most` words.
    """
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(""))
    read = pages.where(F.col("page_number") > skip).select("source_id", "page_number", text.alias("text")).where(F.trim("text") != "")
    if stop_at_references:
        last = read.where(references_page(F.col("text"))).groupBy("source_id").agg(F.min("page_number").alias("last"))
        read = read.join(last, "source_id", "left").where(F.col("last").isNull() | (F.col("page_number") < F.col("last"))).drop("last")
    whole = F.filter(F.transform(F.split("text", r"\n\s*\n+", -1), lambda p: F.trim(p, F.lit(" \t\n"))), lambda p: p != "")
    blocks = F.when(F.size(whole) > 1, whole).otherwise(line_blocks(F.col("text"), most))
    cut = read.select("source_id", "page_number", F.posexplode(blocks).alias("block", "p")).withColumn("w", F.split(squeezed(F.col("p")), " "))
    cut = cut.select("source_id", "page_number", "block", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / most).cast("int")), lambda i: F.slice("w", i * most + 1, most))).alias("part", "w"))
    kept = cut.where(F.size("w") >= least).withColumn("at", F.row_number().over(Window.partitionBy("source_id", "page_number").orderBy("block", "part")))
    name = F.concat("source_id", F.lit("_p"), padded(F.col("page_number")), F.lit("_"), padded(F.col("at")))
    said = kept.select("source_id", "page_number", name.alias("passage_id"), F.array_join("w", " ").alias("text"), F.size("w").alias("words"))
    return said.withColumn("section", section_title(F.col("text")))


def spread(rows: DataFrame, stratum: str, n: int, order: Column) -> DataFrame:
    """n rows, one of each stratum in turn, in the given order within strata."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return rows.withColumn("_turn", turn).orderBy("_turn", stratum).limit(n).drop("_turn")


def quotas(spark: SparkSession, mix: dict[str, float], total: int) -> DataFrame:
    """(name, n): the total shared by weight; what is left after rounding down goes to the heaviest, one each, in the order given."""
    rows = spark.createDataFrame([(i, k, float(v)) for i, (k, v) in enumerate(mix.items())], "at int, name string, weight double")
    every = Window.partitionBy(F.lit(0))
    part = F.floor(F.col("weight") / F.sum("weight").over(every) * total)
    rows = rows.withColumn("n", part).withColumn("left", total - F.sum("n").over(every))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("weight").desc(), "at"))
    kinds = F.count("*").over(every)
    more = F.floor(F.col("left") / kinds) + (place <= F.pmod(F.col("left"), kinds)).cast("int")
    return rows.withColumn("n", (F.col("n") + more).cast("long")).select("name", "n")


def anchors(text: Column, n: int = 8) -> Column:
    """(start, end, words, sha256): the first and the last n words of a passage, their number, and a hash of its words."""
    w = F.split(squeezed(text), " ")
    flat = squeezed(text)
    size = F.when(flat == "", 0).otherwise(F.size(w))
    return F.struct(F.array_join(F.slice(w, 1, n), " ").alias("start"), F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), n), " ").alias("end"), size.alias("words"), F.sha2(F.lower(flat), 256).alias("sha256"))


def counts(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n) for each of several columns, in one pass."""
    return rows.select(*(F.col(d).cast("string").alias(d) for d in dimensions)).unpivot([], dimensions, "dimension", "value").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def summary(cases: DataFrame, dimensions: list[str], words: str) -> DataFrame:
    """(dimension, value, n, average): counts as counts() gives them, beside the mean number of words of all cases, missing ones as 0, to one decimal. One pass over the cases."""
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    per = cases.select(F.explode(each).alias("_x"), F.coalesce(words, F.lit(0)).alias("_w")).groupBy("_x.dimension", "_x.value").agg(F.count("*").alias("n"), F.sum("_w").alias("_w"))
    # As many rows as there are values.
    mean = per.groupBy("dimension").agg(F.bround(F.sum("_w") / F.sum("n"), 1).alias("average"))
    return per.select("dimension", "value", "n").join(mean, "dimension")


def problems(cases: DataFrame, required: list[str], key: str = "case_id", answerable: str | None = None, gold: str | None = None, size: int | None = None) -> DataFrame:
    """(case, problem): empty required fields, repeated ids, answerable cases without a gold passage, and a wrong number of cases."""
    one = lambda cond, text: cases.where(cond).select(F.col(key).cast("string").alias("case"), F.lit(text).alias("problem"))
    out = [one(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"{c} is empty") for c in required]
    out.append(cases.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).cast("string").alias("case"), F.lit("id is repeated").alias("problem")))
    if answerable and gold:
        empty = F.trim(F.coalesce(F.col(gold), F.lit(""))) == ""
        out += [one(F.col(answerable) & empty, "answerable without gold passage"), one(~F.col(answerable) & ~empty, "unanswerable with gold passage")]
    if size is not None:
        out.append(cases.agg(F.count("*").alias("n")).where(F.col("n") != size).select(F.lit(None).cast("string").alias("case"), F.format_string("%d cases, not %d", F.col("n"), F.lit(size)).alias("problem")))
    return reduce(DataFrame.unionByName, out)


def appended(old: DataFrame, new: DataFrame, key: str, order: str, prefix: str = "case") -> DataFrame:
    """old and new rows; new ones whose ids are taken, by old rows or by new ones before them, get the next free numbers after all ids of the form prefix-number."""
    line = Window.partitionBy(key).orderBy(order)
    taken = old.select(key).distinct().withColumn("_taken", F.lit(True))
    marked = new.join(taken, key, "left").withColumn("_again", F.col("_taken").isNotNull() | (F.row_number().over(line) > 1))
    number = F.regexp_extract(F.col(key), rf"^{prefix}-(\d+)$", 1).try_cast("long")
    last = old.select(key).unionByName(new.select(key)).agg(F.coalesce(F.max(number), F.lit(0)).alias("_last"))
    # Only the rows that need one are numbered.
    place = F.row_number().over(Window.orderBy(order))
    renamed = marked.where("_again").withColumn("_n", place).crossJoin(F.broadcast(last)).withColumn(key, F.concat(F.lit(f"{prefix}-"), padded(F.col("_last") + F.col("_n"))))
    return old.unionByName(marked.where("NOT _again").select(old.columns)).unionByName(renamed.select(old.columns))


# Words that aren't key terms, kinds of reasoning by what a question has, and signs of a question that a passage answers.
TERM_STOPWORDS = "a an and are as at be by can do does for from if in is it of on or should that the their this to what when which with according passage patient patients".split()
REASONING = [("dose", "dosage-lookup"), ("dosing", "dosage-lookup"), ("contraind", "contraindication-check"), ("compared", "comparison"), ("difference", "comparison"), ("versus", "comparison"), ("what is", "definition"), ("what are", "single-hop"), ("define", "single-hop"), ("if a patient", "scenario-application"), ("if patient", "scenario-application"), ("what should be done", "scenario-application")]
ASKING = ["what should", "what is", "what are", "can "]


def refined(cases: DataFrame) -> DataFrame:
    """cases (question, passage, answerable, words) with reasoning_type, difficulty, key_terms and review_status.

    key_terms: up to six words of the question that the passage has anywhere. A case that is said to have no answer though
    the passage has most words of its question is flagged.
    """
    q = F.lower(F.coalesce("question", F.lit("")))
    flat = lambda x: squeezed(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9\\s]", " "))
    passage = flat(F.col("passage"))
    kind = F.when(~F.col("answerable"), "abstention")
    for sign, name in REASONING[:2]:
        kind = kind.when(F.contains(q, F.lit(sign)), name)
    kind = kind.when(F.startswith(q, F.lit("can ")), "contraindication-check")
    for sign, name in REASONING[2:]:
        kind = kind.when(F.contains(q, F.lit(sign)), name)
    words, size = F.coalesce("words", F.lit(0)), F.size(F.filter(F.split(squeezed(q), " "), lambda x: x != ""))
    hard = F.when(~F.col("answerable"), F.when(words < 120, "medium").otherwise("hard")).when((words < 70) & (size < 14), "easy").when(words < 120, "medium").otherwise("hard")
    own = F.filter(F.regexp_extract_all(q, F.lit("([a-z0-9]+)")), lambda t: ~t.isin(TERM_STOPWORDS))
    # The passage's plain form is made once per row, not for each word.
    met = let(passage, lambda p: F.filter(own, lambda t: (F.length(t) > 2) & F.contains(p, t)))
    cases = cases.select("*", F.inline(F.array(F.struct(met.alias("_met")))))
    asked = F.filter(own, lambda t: F.length(t) > 3)
    odd = ~F.col("answerable") & (F.size(F.filter("_met", lambda t: F.length(t) > 3)) >= F.greatest(F.lit(3), F.floor(F.size(asked) / 2))) & F.exists(F.array(*map(F.lit, ASKING)), lambda w: F.contains(q, w))
    return cases.withColumns({"reasoning_type": kind.otherwise("single-hop"), "difficulty": hard, "key_terms": F.slice(F.array_distinct("_met"), 1, 6), "review_status": F.when(odd, "flagged_suspicious_answerability").otherwise("auto_generated_unreviewed")}).drop("_met")


def synthetic_profiles(patients: DataFrame, markers: list[tuple[str, float | None, float | None, str]], seed: int = 42) -> DataFrame:
    """(patient_id, key, value, abnormal): for each patient five to eight of the markers (key, low, high, direction; those without bounds aren't used), of which two to four are out of range.

    Choices and values come from hashes of patient, marker and seed, so reruns agree and no task waits for another.
    """
    unit = lambda *parts: F.pmod(F.xxhash64(F.lit(seed), *map(F.lit, parts[:1]), *parts[1:]), F.lit(1_000_003)) / 1_000_003.0
    known = [F.struct(F.lit(k).alias("key"), F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high"), F.lit(d).alias("direction")) for k, lo, hi, d in markers if lo is not None or hi is not None]
    rows = patients.select("patient_id", F.inline(F.array(*known)))
    line = Window.partitionBy("patient_id").orderBy(F.xxhash64(F.lit(seed), "patient_id", "key"), "key")
    rows = rows.withColumn("place", F.row_number().over(line)).where(F.col("place") <= 5 + F.floor(4 * unit("n", "patient_id")))
    bad = F.col("place") <= 2 + F.floor(3 * unit("bad", "patient_id"))
    low, high = F.coalesce("low", F.col("high") / 2), F.coalesce("high", F.col("low") * 2)
    span = F.greatest(high - low, F.lit(0.1))
    share = unit("value", "patient_id", "key")
    down = (F.col("direction") == "low_is_bad") | ((F.col("direction") != "high_is_bad") & (unit("side", "patient_id", "key") < 0.5))
    out = F.when(bad & down, low - span * (0.05 + 0.45 * share)).when(bad, high + span * (0.05 + 0.45 * share)).otherwise(low + span * (0.05 + 0.9 * share))
    return rows.select("patient_id", "key", F.round(F.greatest(out, F.lit(0.0)), 2).alias("value"), bad.alias("abnormal"))
