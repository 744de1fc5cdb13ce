"""Scores of retrieved chunks and of answers, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.text import coverage, informative, jaccard, plain, runs, set_f1

#: What evidence of each label is worth.
WEIGHTS = {"direct_evidence": 1.0, "partial_direct_evidence": 0.8, "supporting": 0.5, "tangential": 0.2, "irrelevant": 0.0}
STRICT = ("direct_evidence", "partial_direct_evidence")
SIMILAR, REPEATED_WORTH = 0.75, 0.35
#: Shares of an answer's score, and least scores of its grades.
RUBRIC = {"required_fact": 0.35, "reference_alignment": 0.15, "gold_alignment": 0.10, "context_alignment": 0.15, "groundedness": 0.15, "verification": 0.10}
GRADES = ((0.85, "excellent"), (0.7, "good"), (0.5, "partial"))
VERDICTS = {"pass passed ok success": (1.0, 0.9, 0.8, 0.85), "partial warning mixed": (0.65, 0.55, 0.45, 0.55), "fail failed error": (0.1, 0.2, 0.3, 0.2)}


def worth(label: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = F.when(label == name, weight).otherwise(out)
    return out


def chunk_labels(evidence: DataFrame) -> DataFrame:
    """(case_id, chunk_id, label) of evidence (case_id, label, label_ord, item_ord, chunk_ids): of several labels the last one."""
    each = evidence.select("case_id", "label", F.struct("label_ord", "item_ord").alias("at"), F.explode("chunk_ids").alias("chunk_id"))
    return each.groupBy("case_id", "chunk_id").agg(F.max_by("label", "at").alias("label"))


def retrieval_scores(chunks: DataFrame, labels: DataFrame, ideal: DataFrame) -> DataFrame:
    """One row per case of chunks (case_id, rank, chunk_id, snippet): hits, reciprocal rank, soft NDCG, repeats and relevance.

    labels: (case_id, chunk_id, label); ideal: (case_id, weights), the worth of all items of the case's evidence. The chunks of a case are few:
    they are gathered into one row, in order of rank.
    """
    marked = chunks.join(labels, ["case_id", "chunk_id"], "left").withColumn("label", F.coalesce("label", F.lit("irrelevant")))
    rows = marked.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "label", F.array_distinct(runs(F.col("snippet"))).alias("words")))).alias("c"))
    rows = rows.join(ideal, "case_id", "left")
    of = F.col("c")
    held = F.filter(of, lambda x: x["chunk_id"].isNotNull())
    names = F.transform(held, lambda x: x["label"])
    strict = lambda x: x.isin(*STRICT)
    first = F.array_min(F.filter(F.transform(names, lambda x, i: F.when(strict(x), i + 1)), lambda i: i.isNotNull()))
    gain = lambda ws: F.aggregate(F.transform(ws, lambda w, i: w / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    best = F.sort_array(F.coalesce("weights", F.array().cast("array<double>")), asc=False)
    again = F.transform(of, lambda x, i: F.exists(F.slice(of, 1, i), lambda y: jaccard(x["words"], y["words"]) >= SIMILAR))
    rows = rows.withColumns({"names": names, "first": first, "n": F.size(of), "again": again, "ideal": gain(best), "dcg": gain(F.transform(names, worth))})
    kept = F.aggregate(F.zip_with(of, "again", lambda x, a: worth(x["label"]) * F.when(a, REPEATED_WORTH).otherwise(1.0)), F.lit(0.0), lambda s, x: s + x)
    repeats = F.size(F.filter("again", lambda x: x))
    top3, top5 = F.slice("names", 1, 3), F.slice("names", 1, 5)
    count = lambda xs, f: F.size(F.filter(xs, f))
    supports = lambda x: x == "supporting"
    lenient = (
        F.when(F.array_contains(top3, "direct_evidence"), 1.0)
        .when(F.exists(top3, strict) & F.exists(top5, supports), 0.9)
        .when(F.exists(top5, strict), 0.75)
        .when(count(top5, lambda x: strict(x) | supports(x)) >= 2, 0.6)
        .when(F.exists(top3, supports), 0.4)
        .otherwise(0.0)
    )
    raw = F.when(F.col("n") > 0, kept / F.col("n")).otherwise(0.0)
    size = F.size("names")
    rate = F.when(size > 0, repeats / size).otherwise(0.0)
    return rows.select(
        "case_id",
        *(F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias(f"hit_at_{k}") for k in (1, 3, 5)),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.col("first").alias("strict_hit_rank"),
        F.col("first").isNotNull().alias("strict_success"),
        lenient.alias("lenient_success_score"),
        F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("soft_ndcg"),
        repeats.alias("duplicate_chunk_count"),
        rate.alias("duplicate_chunk_rate"),
        (1 - rate).alias("context_diversity_score"),
        raw.alias("weighted_relevance_raw"),
        F.least(F.lit(1.0), raw * 0.8 + F.when(F.col("n") > 0, 1 - repeats / F.col("n")).otherwise(1.0) * 0.2).alias("weighted_relevance_score"),
    )


def fact_hits(answer: Column, facts: Column) -> Column:
    """How many facts an answer has, word by word."""
    said = plain(answer)
    return F.size(F.filter(F.transform(F.coalesce(facts, F.array().cast("array<string>")), plain), lambda f: (f != "") & F.contains(said, f)))


def verification_score(verdict: Column, confidence: Column) -> Column:
    out = F.lit(0.5)
    sure = F.lower(F.trim(F.coalesce(confidence, F.lit(""))))
    for names, (high, medium, low, other) in VERDICTS.items():
        value = F.when(sure == "high", high).when(sure == "medium", medium).when(sure == "low", low).otherwise(other)
        out = F.when(F.lower(F.trim(F.coalesce(verdict, F.lit("")))).isin(names.split()), value).otherwise(out)
    return out


def grade(score: Column) -> Column:
    out = F.lit("poor")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def answer_scores(cases: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Scores of cases (case_id, answer, reference, gold, context, required, forbidden, verdict, confidence, observed).

    observed: a case that is only looked at and gets no rubric. weights replace those of RUBRIC and are brought to a sum of 1.
    """
    w = RUBRIC | (weights or {})
    total = sum(w.values()) or 1.0
    a, ref, gold, ctx = (informative(F.col(c)) for c in ("answer", "reference", "gold", "context"))
    read = cases.withColumns({"a": a, "r": ref, "g": gold, "c": ctx, "need": F.size(F.coalesce("required", F.array().cast("array<string>"))), "hits": fact_hits(F.col("answer"), F.col("required")), "bad": fact_hits(F.col("answer"), F.col("forbidden"))})
    loose = F.array_sort(F.array_except("a", "c"))
    read = read.withColumns({"loose": loose, "rate": F.when(F.size("a") > 0, F.size(loose) / F.size("a")).otherwise(0.0), "recall": F.when(F.col("need") > 0, F.col("hits") / F.col("need")).otherwise(1.0), "sure": verification_score(F.col("verdict"), F.col("confidence"))})
    c = {n: F.col(n) for n in ("a", "r", "g", "c")}
    parts = {
        "required_fact": F.col("recall"),
        "reference_alignment": set_f1(c["a"], c["r"]),
        "gold_alignment": set_f1(c["a"], c["g"]),
        "context_alignment": F.greatest(coverage(c["a"], c["c"]), set_f1(c["a"], c["c"])),
        "groundedness": 1 - F.col("rate"),
        "verification": F.col("sure"),
    }
    rubric = sum((w[n] * x for n, x in parts.items()), F.lit(0.0)) / total
    rubric = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), rubric - F.least(F.lit(0.4), 0.2 * F.col("bad")))))
    judged = ~F.coalesce("observed", F.lit(False))
    score = F.when(judged, rubric)
    return read.select(
        "case_id",
        parts["reference_alignment"].alias("reference_token_f1"),
        parts["gold_alignment"].alias("gold_token_f1"),
        set_f1(c["a"], c["c"]).alias("context_token_f1"),
        F.col("recall").alias("required_fact_recall"),
        F.col("bad").alias("forbidden_fact_violations"),
        coverage(c["a"], c["g"]).alias("faithfulness_to_gold"),
        coverage(c["a"], c["c"]).alias("faithfulness_to_context"),
        parts["groundedness"].alias("groundedness"),
        F.col("sure").alias("verification_score"),
        F.size("loose").alias("unsupported_count"),
        F.slice("loose", 1, 25).alias("unsupported_tokens"),
        score.alias("score"),
        grade(score).alias("grade"),
        (judged & (F.col("recall") >= 0.999) & (F.col("bad") == 0) & (F.size("loose") == 0)).alias("exact_pass"),
    )


def _half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


#: Ranges into which a key's values are counted before any are put in order.
BINS = 4096


def graded(value: Column) -> Column:
    """A scale in the order of the values on which a few huge ones leave room for the others."""
    return F.signum(value) * F.log1p(F.abs(value))


def latency_summary(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """average, min, max, p50, p95, p99 and count of the values that aren't null, per key; percentiles are those of the nearest rank, at (n - 1) * p rounded half to even. Without values all are 0.

    Equal values count as one row. A key's values are counted in BINS ranges of a graded scale first, as latencies have long
    tails; only those of the ranges in which the three ranks lie are put in order, so a key with most rows is no single task's.
    """
    # Keys may be null: within a struct null equals null.
    kept = df.select((F.struct(*keys) if keys else F.lit(0)).alias("_k"), value.cast("double").alias("v"))
    counted = kept.where("v IS NOT NULL").groupBy("_k", "v").agg(F.count("*").alias("m"))
    per = counted.groupBy("_k").agg((F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("average"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("m").alias("count"))
    rank = lambda p: _half_even((F.col("count") - 1) * p)
    ranks = per.select("_k", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), rank(p).alias("rank")) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))).alias("x")).select("_k", "x.*")
    low, high = graded(F.col("min")), graded(F.col("max"))
    share = (graded(F.col("v")) - low) / (high - low)
    binned = counted.join(per.select("_k", "min", "max"), "_k").select("_k", "v", "m", F.when(high > low, F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(0).alias("bin"))
    upto = binned.groupBy("_k", "bin").agg(F.sum("m").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("_k").orderBy("bin")))
    wanted = ranks.join(upto, "_k").where((F.col("upto") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("upto"))).select("_k", "name", "bin", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
    inside = wanted.join(binned, ["_k", "bin"]).withColumn("upto", F.sum("m").over(Window.partitionBy("_k", "name").orderBy("v")))
    picked = inside.where((F.col("upto") - F.col("m") <= F.col("rank")) & (F.col("rank") < F.col("upto"))).groupBy("_k").agg(*(F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ("p50", "p95", "p99")))
    names = ["average", "min", "max", "p50", "p95", "p99"]
    every = kept.select("_k").distinct() if keys else df.sparkSession.range(1).select(F.lit(0).alias("_k"))
    found = every.join(per.join(picked, "_k"), "_k", "left")
    return found.select(*(F.col(f"_k.{k}").alias(k) for k in keys), *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names), F.coalesce("count", F.lit(0)).alias("count"))


def stage_latencies(stages: DataFrame) -> DataFrame:
    """Per name of stages (name, status, duration_ms): count, completed_count and latency_summary of the durations in seconds; also of those that have none."""
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("unknown"))
    named = stages.withColumn("name", name)
    counts = named.groupBy("name").agg(F.count("*").alias("stages"), F.count_if(F.col("status") == "completed").alias("completed_count"))
    return counts.join(latency_summary(named, ["name"], F.col("duration_ms").try_cast("double") / 1000.0), "name")


def ingestion_summary(chunks: DataFrame, documents_found: int | None = None) -> DataFrame:
    """One row about chunks (doc_id, text, page): lengths in words, chunks per document, and the share of documents that have a page."""
    read = chunks.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")).alias("doc"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?U)\S+")).alias("words"), F.col("page").try_cast("int").alias("page"))
    length = read.agg(F.count("*").alias("chunk_count"), *(F.coalesce(f("words"), F.lit(0)).cast("double").alias(f"{n}_chunk_length") for n, f in (("average", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))))
    per = read.groupBy("doc").agg(F.count("*").alias("n"), F.count("page").alias("pages"))
    docs = F.count("*") if documents_found is None else F.lit(documents_found)
    of = per.agg(F.count("*").alias("document_count"), *(F.coalesce(f("n"), F.lit(0)).cast("double").alias(f"{n}_chunks_per_document") for n, f in (("average", F.avg), ("min", F.min), ("max", F.max))), F.when(docs > 0, F.count_if(F.col("pages") > 0) / docs).otherwise(0.0).alias("page_coverage_ratio"))
    return length.crossJoin(of)


def summarised(cases: DataFrame, keys: list[str], means: list[str], rates: dict[str, Column], among: dict[str, Column] | None = None) -> DataFrame:
    """Averages and rates of cases, per keys or over all. Nulls aren't counted, and without any value the average is 0.

    rates: by name a condition whose share of all cases is given; among: by name of an average or a rate the cases that it is taken over.
    """
    of = lambda n, x: F.when((among or {})[n], x) if n in (among or {}) else x
    zero = F.lit(0.0)
    averages = [F.coalesce(F.avg(of(n, F.col(n).cast("double"))), zero).alias(n) for n in means]
    shares = [F.coalesce(F.avg(of(n, F.when(c, 1.0).otherwise(0.0))), zero).alias(n) for n, c in rates.items()]
    return cases.groupBy(*keys).agg(F.count("*").alias("case_count"), *averages, *shares)


def metric_rows(summaries: DataFrame, key: str, names: dict[str, str], seconds: tuple[str, ...] = ()) -> DataFrame:
    """(key, metric, value): columns by their metrics' names, nulls as 0, those in seconds as milliseconds."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * (1000.0 if c in seconds else 1.0)
    return summaries.select(key, *(value(c).alias(m) for c, m in names.items())).unpivot([key], [F.col(f"`{m}`") for m in names.values()], "metric", "value")
