import math
import uuid

import pytest
from pyspark.sql import functions as F

from siftstone.functions import text
from siftstone.operators import campaigns, chunking, cleaning, clinical, datasets, dosing, guidance, mapping, retrieval, scoring, telemetry
from siftstone.plans.queries import MARKERS


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- text ---


def test_tokens(spark):
    got = one(spark, text.tokens(F.col("t")), t="The ärzte use_it: ACE-I 50 mg, a b2 b2; naïve café.")
    assert got == ["ace", "50", "mg", "b2", "b2"]
    assert one(spark, text.tokens(F.lit(None).cast("string")), t="") == []


def test_set_measures(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, text.jaccard(a, b), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, text.set_f1(a, b), a=["x", "y"], b=["y"]) == pytest.approx(2 / 3)
    none = F.array().cast("array<string>")
    assert one(spark, text.set_f1(none, none), a="") == 1.0 and one(spark, text.set_f1(none, b), b=["y"]) == 0.0
    assert one(spark, text.coverage(a, b), a=["x", "x", "y"], b=["y"]) == 0.5
    assert one(spark, text.slug(F.col("t")), t=" Beta-Blockers & ACE ") == "beta-blockers-ace"


# --- cleaning ---


def clean(spark, strategy, t):
    return cleaning.cleaned(spark.createDataFrame([(t,)], "text string"), strategy).first().text


def test_basic_cleaning(spark):
    assert clean(spark, "basic", " a\x00\r\nb\t\t c\r\n\n\n\nd ") == "a\nb c\n\nd"
    assert clean(spark, "basic", None) == "" and clean(spark, "none", None) is None
    with pytest.raises(ValueError, match="unknown cleaning strategy"):
        clean(spark, "other", "")


def test_deep_cleaning(spark):
    noisy = "Title line\nESC Guidelines 2021\n12 / 40\nHeart fail-\nure is treated.\nsee www.example.org\nmail a@b.org\nIntroduction ........ 12\n* * *\n\nFooter X\nDose ( 5 mg ) , daily.\nFooter X\nNext.\nfooter x"
    assert clean(spark, "deep", noisy) == "Title line Heart failure is treated.\n\nDose (5 mg), daily.\nNext."
    references = "\n".join(f"{i}. Smith J, Lancet 2001;{i}:1-2." for i in range(1, 7))
    assert clean(spark, "deep", f"Text stays.\n\n{references}\n\nMore text.") == "Text stays.\n\nMore text."
    assert clean(spark, "medical_guideline_deep", "Body – text.\n17\n\nReferences\none\ntwo\nthree") == "Body - text."
    long = "word " * 40000
    assert clean(spark, "deep", long) == long.strip() and clean(spark, "deep", "") == ""


# --- chunks ---


def windows(spark, t, size, overlap):
    return [tuple(x) for x in spark.createDataFrame([(t,)], "t string").select(chunking.windows(F.col("t"), size, overlap).alias("w")).first().w]


@pytest.mark.parametrize(("t", "size", "overlap"), [("abcdefghij", 4, 1), ("abcdefghij", 4, 9), ("abc", 10, 2), ("a b c d e f", 3, 0), ("x" * 1001, 300, 100), ("", 5, 1)])
def test_windows(spark, t, size, overlap):
    overlap, out, at = max(0, min(overlap, size - 1)), [], 0
    while t:
        if part := t[at : at + size].strip():
            out.append((at, part))
        if at + size >= len(t):
            break
        at += size - overlap
    assert windows(spark, t, size, overlap) == out


def test_long_text_takes_linear_time(spark):
    """5 MB of short paragraphs; each chunk's page by plain search among the ends of paragraphs."""
    import bisect
    import time

    parts = [f"paragraph {i} {'x' * (i % 60)}é" for i in range(100_000)]
    docs = spark.createDataFrame([("d", "\n\n".join(parts))], "source_id string, text string")
    began = time.time()
    got = chunking.naive(docs, 300, 100).orderBy("chunk_index").collect()
    pages = docs.select(F.inline(chunking.page_ranges(F.split("text", "\n\n")))).collect()
    assert time.time() - began < 60
    flat, ends = " ".join(parts), []
    for p in parts:
        ends.append((ends[-1] + 1 if ends else 0) + len(p))
    assert [(r.start, r.end) for r in pages] == [(e - len(p), e) for p, e in zip(parts, ends, strict=True)]
    for r in got:
        assert r.text == flat[r.start : r.start + 300].strip()
        middle = r.start + len(r.text) // 2
        i = bisect.bisect_right(ends, middle)
        assert r.page_number == (i + 1 if i < len(ends) and flat_inside(ends, parts, i, middle) else len(parts))
    assert len(got) == -(-(len(flat) - 300) // 200) + 1


def flat_inside(ends, parts, i, middle):
    return ends[i] - len(parts[i]) <= middle


def test_pages_and_strategies(spark):
    docs = spark.createDataFrame([("d", "First page here.\n\n  \n\nSecond  page is longer than that.\n\nThird."), ("e", None), ("f", " ")], "source_id string, text string")
    ranges = docs.where("source_id = 'd'").select(F.inline(chunking.page_ranges(F.split("text", "\n\n")))).collect()
    assert [tuple(r) for r in ranges] == [(1, 0, 16), (3, 17, 49), (4, 50, 56)]
    got = chunking.naive(docs, 20, 5).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in got] == [f"d-chunk-{i}" for i in range(len(got))] and [r.page_number for r in got] == [1, 2, 2, 3]
    raw = docs.withColumn("raw_page_texts", F.when(F.col("source_id") == "d", F.array(F.lit("First page here."), F.lit(" "), F.lit("Second page"), F.lit("is longer than that. Third."))))
    assert [r.page_number for r in chunking.naive(raw, 20, 5).orderBy("chunk_index").collect()] == [1, 3, 4, 4]
    assert [r.page_number for r in chunking.late(raw, 30, 20).orderBy("chunk_index").collect()] == [1, 4, 4, 4]
    assert {r.page_number for r in chunking.naive(raw.withColumn("page_number", F.lit("7")), 20, 5).collect()} == {7}
    assert {r.page_number for r in chunking.naive(raw.withColumn("page_number", F.lit("vii")), 20, 5).collect()} == {None}
    assert {r.page_number for r in chunking.naive(raw.withColumn("raw_page_texts", F.array(F.lit(" "))), 20, 5).collect()} == {None}
    late = chunking.late(docs, 30, 20).orderBy("chunk_index").collect()
    assert [r.text for r in late] == ["First page here.", "Second page is longer than tha", "e is longer than that.", "Third."]
    assert chunking.chunked(docs, "late").count() == 1
    pages = spark.createDataFrame([("d", 3, "some text"), ("d", None, "more")], "source_id string, page_number int, text string")
    assert rows(chunking.page_indexed(pages), "chunk_id") == [("d-page-3-chunk-0",), ("d-page-chunk-0",)]
    with pytest.raises(ValueError, match="unknown chunking strategy"):
        chunking.chunked(docs, "other")


# --- retrieval ---


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "heart failure heart"), (2, "failure of kidneys"), (3, "the and of"), (4, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "heart heart failure"), (2, "of the")], "q long, text string")
    got = rows(retrieval.bm25(asked, docs, "q", "text", "id", "text", 3), "query_id", "id", "score", "rank")
    idf = lambda df: math.log(1 + (2 - df + 0.5) / (df + 0.5))
    part = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2.5))
    assert [(q, i, r) for q, i, _, r in got] == [(1, 1, 1), (1, 2, 2)]
    assert got[0][2] == pytest.approx(2 * idf(1) * part(2, 3) + idf(2) * part(1, 3)) and got[1][2] == pytest.approx(idf(2) * part(1, 2))


def test_scaling_and_fusion(spark):
    hits = lambda xs: spark.createDataFrame([(1, i, float(s), r) for r, (i, s) in enumerate(xs, 1)], "query_id long, id string, score double, rank int")
    assert rows(retrieval.normalised(hits([("a", 3), ("b", 1), ("c", 2)])), "id", "score") == [("a", 1.0), ("b", 0.0), ("c", 0.5)]
    assert rows(retrieval.normalised(hits([("a", 2), ("b", 2)])), "score") == [(1.0,), (1.0,)]
    assert rows(retrieval.normalised(hits([("a", 0), ("b", -1)])), "id", "score") == [("a", 0.5), ("b", 0.0)]
    fused = rows(retrieval.fused(hits([("a", 3), ("b", 1)]), hits([("c", 9), ("a", 1)]), 3), "rank", "id", "score")
    assert fused == [(1, "a", 0.65), (2, "c", 0.35), (3, "b", 0.0)]


def test_neighbours(spark):
    corpus = spark.createDataFrame([(1, "s", 0, "heart rate"), (2, "s", 1, "heart dose"), (3, "s", 5, "dose table"), (4, "t", 0, "dose")], "id long, source_id string, chunk_index int, text string")
    ranked = spark.createDataFrame([(1, 2, 1)], "query_id long, id long, rank int")
    query = spark.createDataFrame([(1, "dose")], "query_id long, text string")
    assert rows(retrieval.neighbours(ranked, corpus, query), "id", "relation", "score") == [(1, "prev", 2), (3, "next", 4)]
    assert rows(retrieval.neighbours(ranked, corpus, query, 0), "id") == [(3,)]


def test_dense_search_and_contexts(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "id long, v array<double>")
    got = rows(retrieval.dense(v.where("id = 1"), v, "id", "v", "id", "v", 2), "id", "rank")
    assert got == [(1, 1), (2, 2)]
    assert one(spark, retrieval.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0.0
    payloads = spark.createDataFrame([("", "s", None, "t"), ("c", "s", "T", None), (None, None, "", "x")], "chunk_id string, source_id string, title string, text string")
    assert rows(retrieval.contexts(payloads), "id", "title", "snippet") == [("c", "T", ""), ("s", "Untitled", "t"), ("unknown", "Untitled", "x")]


# --- scores ---


def test_retrieval_scores(spark):
    chunks = spark.createDataFrame([(1, 1, "x", "a b c d"), (1, 2, "y", "a b c d"), (1, 3, "z", "q"), (2, 1, None, "w")], "case_id long, rank int, chunk_id string, snippet string")
    evidence = spark.createDataFrame([(1, "direct_evidence", 0, 0, ["y"]), (1, "supporting", 2, 0, ["x", "y"]), (1, "partial_direct_evidence", 1, 0, ["z"])], "case_id long, label string, label_ord int, item_ord int, chunk_ids array<string>")
    labels = scoring.chunk_labels(evidence)
    assert rows(labels, "chunk_id", "label") == [("x", "supporting"), ("y", "supporting"), ("z", "partial_direct_evidence")]
    ideal = evidence.groupBy("case_id").agg(F.collect_list(scoring.worth(F.col("label"))).alias("weights"))
    got = {r.case_id: r for r in scoring.retrieval_scores(chunks, labels, ideal).collect()}
    r = got[1]
    assert (r.hit_at_1, r.hit_at_3, r.mrr, r.strict_hit_rank, r.duplicate_chunk_count, r.lenient_success_score) == (0.0, 1.0, pytest.approx(1 / 3), 3, 1, 0.9)
    dcg = lambda ws: sum(w / math.log2(i + 2) for i, w in enumerate(ws))
    assert r.soft_ndcg == pytest.approx(dcg([0.5, 0.5, 0.8]) / dcg([1.0, 0.8, 0.5]))
    assert r.weighted_relevance_raw == pytest.approx((0.5 + 0.5 * 0.35 + 0.8) / 3)
    assert (got[2].soft_ndcg, got[2].weighted_relevance_score, got[2].mrr) == (0.0, 0.2, 0.0)


def test_answer_scores(spark):
    schema = "case_id long, answer string, reference string, gold string, context string, required array<string>, forbidden array<string>, verdict string, confidence string, observed boolean"
    cases = [(1, "Give beta blockers daily", "beta blockers daily", "beta blockers", "give beta blockers daily now", ["Beta  blockers"], ["aspirin"], "pass", "high", False), (2, "", "x", None, None, None, None, None, None, True), (3, "use aspirin", "rest", "", "", ["rest"], ["aspirin"], "fail", "low", None)]
    got = {r.case_id: r for r in scoring.answer_scores(spark.createDataFrame(cases, schema)).collect()}
    assert got[1].exact_pass and got[1].grade == "excellent" and got[1].required_fact_recall == 1.0
    assert got[2].score is None and got[2].grade is None and got[2].groundedness == 1.0
    assert got[3].grade == "poor" and got[3].forbidden_fact_violations == 1 and got[3].unsupported_tokens == ["aspirin", "use"]


def test_latency_summary(spark):
    values = [("a", float(x)) for x in (5, 1, 3, 3)] + [("b", None), (None, 2.0)]
    got = {r.k: r for r in scoring.latency_summary(spark.createDataFrame(values, "k string, v double"), ["k"], F.col("v")).collect()}
    assert (got["a"].p50, got["a"].p95, got["a"].average, got["a"]["count"]) == (3.0, 5.0, 3.0, 4)
    assert (got["b"].max, got["b"]["count"], got[None].p99) == (0.0, 0, 2.0)
    assert tuple(scoring.latency_summary(spark.createDataFrame([], "v double"), [], F.col("v")).first()) == (0.0,) * 6 + (0,)
    every = sorted(x % 97 for x in range(1, 1001))
    df = spark.createDataFrame([("k", float(x)) for x in every], "k string, v double")
    r = scoring.latency_summary(df, ["k"], F.col("v")).first()
    assert [r.p50, r.p95, r.p99] == [every[round(999 * p)] for p in (0.5, 0.95, 0.99)]


# --- telemetry, campaigns, datasets, mapping ---


def test_durations_and_failures(spark):
    rec = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", "2024-01-01T00:00:01.5Z", None), (2, "2024-01-01T00:00:05Z", "2024-01-01T00:00:00Z", "no time")], "id long, created_at string, started_at string, completed_at string")
    assert rows(telemetry.derived(rec), "id", "queue_delay_ms", "total_duration_ms") == [(1, 1500.0, None), (2, 0.0, None)]
    f = lambda s, m, n, v, g: one(spark, telemetry.failure(F.lit(s), F.lit(m), F.lit(n), F.lit(v).cast("string"), F.lit(g)), a=1)
    assert f("failed", "Retrieval broke", 0, None, True) == "retrieval_failure" and f("failed", None, 1, None, False) == "ingestion_failure"
    assert f("completed", None, 0, None, True) == "empty_retrieval" and f("completed", None, 2, "warn", True) == "verification_failure" and f("completed", "", 2, "pass", True) is None


def test_grid_and_pareto(spark):
    got = campaigns.grid(spark, {"a": [1, 2], "b": ["x"]}, include=[{"a": 2, "b": "x"}, {"a": 3}], exclude=[{"a": 1}], most=5).orderBy("index").collect()
    assert [(r["index"], dict(r["settings"])) for r in got] == [(2, {"a": "2", "b": '"x"'}), (3, {"a": "3"})]
    runs = spark.createDataFrame([(1, 1.0, 5), (2, 2.0, 4), (3, 2.0, 6), (4, 3.0, 6), (5, 0.5, 1)], "id long, x double, y int")
    assert rows(campaigns.pareto(runs, "x", "y"), "id") == [(1,), (3,), (4,), (5,)]
    card = campaigns.scorecard(runs.withColumn("p95_latency", F.col("x")).withColumn("c", F.lit(7)), ["p95_latency", "y", "c"])
    assert dict(rows(card, "id", "composite_score"))[5] == pytest.approx((1 + 0 + 1) / 3, abs=1e-4)


def test_datasets(spark):
    assert dict(rows(datasets.quotas(spark, {"a": 2, "b": 1, "c": 1}, 10), "name", "n")) == {"a": 6, "b": 2, "c": 2}
    pages = spark.createDataFrame([("s", 1, " ".join(f"w{i}" for i in range(25)) + "\n\nshort one"), ("s", 2, None)], "source_id string, page_number int, text string")
    assert rows(datasets.passages(pages, 5, 10), "passage_id", "words") == [("s_p001_001", 10), ("s_p001_002", 10), ("s_p001_003", 5)]
    a = one(spark, datasets.anchors(F.col("t"), 2), t="One  two\nthree four")
    assert (a.start, a.end, a.words) == ("One two", "three four", 4)
    cases = spark.createDataFrame([("1", "q", True, ""), ("1", None, False, "g")], "case_id string, question string, ok boolean, gold string")
    assert [p for _, p in rows(datasets.problems(cases, ["question"], answerable="ok", gold="gold", size=3), "case", "problem")] == ["answerable without gold passage", "id is repeated", "question is empty", "unanswerable with gold passage", "2 cases, not 3"]
    assert [r.id for r in datasets.spread(spark.range(10).withColumn("s", F.col("id") % 2), "s", 3, F.col("id")).collect()] == [0, 1, 2]


def test_mapping(spark):
    chunks = spark.createDataFrame([("s", f"c{i}", i, t) for i, t in ((0, "alpha beta gamma"), (1, "delta epsilon"), (3, "zeta"))], "source_id string, chunk_id string, chunk_index int, text string")
    assert rows(mapping.units(chunks), "ids") == [(["c0", "c1"],), (["c0"],), (["c1"],), (["c3"],)]
    cases = spark.createDataFrame([(1, "s", "beta gamma delta")], "case_id long, source_id string, gold string")
    best = mapping.candidates(cases, mapping.units(chunks)).orderBy("rank").first()
    assert best.ids == ["c0", "c1"] and best.multiset_coverage == 1.0
    assert one(spark, mapping.multiset_coverage(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["x", "z"]) == pytest.approx(1 / 3)


# --- clinical reading, dosing, guidance ---


def test_profile(spark):
    seen = spark.createDataFrame([(1, "Sex", "F"), (1, "HB", "12.5"), (1, "k", "x"), (1, "odd", "1"), (2, "hb", "12.5"), (2, "gender", "man"), (2, "eGFR", "50"), (3, "egfr", "50"), (3, "age", "70")], "patient_id long, key string, value string")
    got = {(r.patient_id, r.key): r.status for r in clinical.profile(seen, spark.createDataFrame(MARKERS, clinical.MARKERS)).collect()}
    assert got == {(1, "Sex"): "informational", (1, "HB"): "normal", (1, "k"): "unknown", (1, "odd"): "unknown", (2, "hb"): "low", (2, "gender"): "informational", (2, "eGFR"): "low", (3, "egfr"): "normal", (3, "age"): "informational"}


def test_dosing(spark):
    said = {"24/26 mg": 24.0, "12,5 MG": 12.5, "nan": None, "": None, "none": None, "50mg": 50.0}
    assert {t: one(spark, dosing.number(F.col("t")), t=t) for t in said} == said
    assert one(spark, dosing.near_upper(F.lit(4.9), F.lit(5.0), F.lit(5.5), 0.2), a=1) and not one(spark, dosing.near_upper(F.lit(None).cast("double"), F.lit(5.0), F.lit(5.5), 0.2), a=1)


def test_questions(spark):
    asked = {"List the three drugs": 3, "Name 4 or 10 things": 4, "In 2021 what": None, "Which 12?": None, None: None, "Give ten": 10}
    assert {t: spark.createDataFrame([(t,)], "t string").select(guidance.expected_items(F.col("t")).alias("n")).first().n for t in asked} == asked
    assert one(spark, guidance.numbered_items(F.col("t")), t="Take: 1. Aspirin; 2. Rest, \n3. water.") == ["Aspirin", "Rest", "water"]
    q = spark.createDataFrame([(1, "dose of aspirin")], "query_id long, text string")
    c = spark.createDataFrame([(1, 1, "Nothing here. The aspirin dose is low! Also this."), (1, 2, "Aspirin.")], "query_id long, ord int, snippet string")
    assert [r.sentence for r in guidance.best_sentences(q, c).orderBy("rank").collect()] == ["The aspirin dose is low!", "Aspirin."]


MRA = "WHICH MRA? Eplerenone: starting dose 25 mg o.d., target dose 50 mg o.d.\nSpironolactone: starting dose 25 mg o.d., target dose 50 mg o.d.\nIf K rises above 5.5 mmol/L or creatinine rises to 2.5 mg/dL/eGFR <30, halve. If K rises to >6.0 mmol/L or creatinine to 3.5 mg/dL/eGFR <20, stop MRA."
BETA = "WHICH BETA-BLOCKER? Bisoprolol: starting dose 1.25 mg o.d., target dose 10 mg o.d. Double the dose at not less than 2-week intervals. In hypotension (SBP <90 mmHg), relieve congestion and achieve euvolaemia. If <50 b.p.m., halve the dose of beta-blocker."
RAS = "WHICH ACE-I? Enalapril: starting dose 2.5 mg b.i.d., target dose 10-20 mg b.i.d. Double the dose. Significant hyperkalaemia (K >5.0 mmol/L), creatinine >2.5 mg/dL or eGFR <30 and SBP <90 mmHg are cautions. If K rises to >5.5 mmol/L or creatinine to >3.5 mg/dL/eGFR <20, stop."
ARNI = "Sac/Val: starting dose 49/51 mg b.i.d., target dose 97/103 mg b.i.d. 24/26 mg b.i.d. in selected patients. A washout of at least 36 h. Significant hyperkalaemia (K >5.0 mmol/L). eGFR <30 and SBP <90 mmHg. If K rises to >5.5 mmol/L, stop."
SGLT2 = "Dapagliflozin: starting (and target) dose 10 mg o.d. eGFR <20 and SBP <95 mmHg are cautions."
LOOP = "Furosemide: starting dose 20-40 mg, usual dose 40-240 mg. A diuretic is not indicated if the patient has never had symptoms or signs of congestion. SBP <90 mmHg."
PATIENT = "request_id int, potassium double, creatinine double, egfr double, sbp double, heart_rate double, weight_gain_kg double, congestion_present boolean, volume_depleted boolean, switch_to_arni boolean, dose_mra_prev string, dose_bb_prev string, dose_ras_prev string, dose_arni_prev string, dose_sglt2_prev string, dose_loop_prev string, mra_agent string"


def test_dosing_of_all_families(spark):
    patients = spark.createDataFrame([
        (1, 4.6, 1.4, 52.0, 108.0, 72.0, None, None, None, True, "25", "1.25", "2.5", None, None, "40", None),
        (2, 5.8, 3.0, 24.0, 86.0, 48.0, None, None, None, None, "25", "2.5", "10", "49/51 mg b.i.d.", None, None, "Eplerenone"),
        (3, 4.2, 1.2, 65.0, 118.0, 76.0, None, True, None, None, None, None, None, None, None, None, "spironolacton"),
        (4, None, None, None, None, None, 2.0, None, None, None, "50", "10", "8", None, "10", None, None),
    ], PATIENT)
    said = [("chunk-mra", 12, MRA), ("chunk-bb", 11, BETA), ("chunk-ras", 9, RAS), ("chunk-arni", 14, ARNI), ("chunk-sglt2", 15, SGLT2), ("chunk-loop", 17, LOOP)]
    contexts = spark.createDataFrame([(q, i, c, p, "Table", t) for q in (1, 2, 3, 4) for i, (c, p, t) in enumerate(said)], "request_id int, ord int, chunk_id string, page_number int, title string, snippet string")
    grouped = dosing.by_family(contexts)
    assert set(rows(grouped.where("request_id = 1"), "family", "chunk_id")) >= {("arni", "chunk-arni"), ("ras", "chunk-ras"), ("loop_diuretic", "chunk-bb"), ("loop_diuretic", "chunk-loop")}
    own = contexts.withColumn("family", F.element_at(F.array(*map(F.lit, dosing.FAMILIES)), F.col("ord") + 1))
    known = dosing.evidence(patients, own)
    e = {r.family: r for r in known.where("request_id = 2").collect()}
    assert (e["mra"].drug, e["mra"].start_dose, e["mra"].stop_potassium, e["mra"].caution_egfr, e["mra"].stop_egfr) == ("eplerenone", "25 mg o.d.", 6.0, 30.0, 20.0)
    assert (e["ras"].target_dose, e["ras"].target_value, e["ras"].caution_potassium, e["ras"].stop_creatinine, e["ras"].doubles) == ("10-20 mg b.i.d.", 20.0, 5.0, 3.5, True)
    assert (e["arni"].start_dose, e["arni"].target_dose, e["arni"].reduced_dose, e["arni"].washout, e["arni"].chunk_ids) == ("49/51 mg b.i.d.", "97/103 mg b.i.d.", "24/26 mg b.i.d.", True, ["chunk-arni"])
    assert (e["sglt2"].start_dose, e["sglt2"].stop_egfr, e["loop_diuretic"].usual_range, e["loop_diuretic"].start_high) == ("10 mg o.d.", 20.0, "40-240 mg daily", 40.0)
    out = dosing.recommended(patients, known)
    got = {(r.request_id, r.family): (r.action, r.dose, r.status) for r in out.collect()}
    want = {
        (1, "mra"): ("increase", "50 mg o.d.", "eligible"), (1, "beta_blocker"): ("increase", "2.5 mg o.d.", "eligible"), (1, "ras"): ("do_not_combine", None, "not_applicable"),
        (1, "arni"): ("switch", "24/26 mg b.i.d.", "eligible"), (1, "sglt2"): ("start", "10 mg o.d.", "eligible"), (1, "loop_diuretic"): ("maintain", "40 mg daily", "maintain"),
        (2, "mra"): ("reduce", "25 mg o.d.", "caution"), (2, "beta_blocker"): ("reduce", "1.25 mg o.d.", "caution"), (2, "ras"): ("do_not_combine", None, "not_applicable"),
        (2, "arni"): ("stop", None, "contraindicated"), (2, "sglt2"): ("avoid_start", None, "caution"), (2, "loop_diuretic"): ("avoid_start", None, "caution"),
        (3, "mra"): ("start", "25 mg o.d.", "eligible"), (3, "beta_blocker"): ("defer_start", None, "caution"), (3, "ras"): ("start", "2.5 mg b.i.d.", "eligible"),
        (3, "arni"): ("start", "49/51 mg b.i.d.", "eligible"), (3, "sglt2"): ("start", "10 mg o.d.", "eligible"), (3, "loop_diuretic"): ("start", "40 mg daily", "eligible"),
        (4, "mra"): ("maintain", "50 mg o.d.", "at_target"), (4, "beta_blocker"): ("maintain", "10 mg o.d.", "at_target"), (4, "ras"): ("increase", "16 mg b.i.d.", "eligible"),
        (4, "arni"): ("switch", "49/51 mg b.i.d.", "eligible"), (4, "sglt2"): ("maintain", "10 mg o.d.", "at_target"), (4, "loop_diuretic"): ("start", "40 mg daily", "eligible"),
    }
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    families = spark.createDataFrame(list(dosing.PRIORITY.items()), "family string, priority int")
    shown = dosing.visible(out, families)
    assert rows(shown, "request_id", "rank", "family") == [(1, 1, "arni"), (1, 2, "sglt2"), (1, 3, "beta_blocker"), (3, 1, "sglt2"), (3, 2, "arni"), (3, 3, "ras"), (4, 1, "loop_diuretic"), (4, 2, "ras")]
    assert rows(dosing.verdicts(out, shown), "request_id", "verdict", "confidence") == [(1, "pass", "high"), (2, "pass", "high"), (3, "pass", "high"), (4, "pass", "high")]
    assert dosing.verdicts(out, shown).where("request_id = 2").first().reasons == ["grounded_safety_cautions_without_visible_uptitration"]
    none = dosing.recommended(patients, dosing.evidence(patients, own.limit(0)))
    assert {r.action for r in none.collect()} == {"unavailable", "do_not_combine"} and {r.verdict for r in dosing.verdicts(none, dosing.visible(none, families)).collect()} == {"pass"}
    asked = dosing.family_queries(patients.where("request_id = 3"), {"mra": "{agent} MRA dose", "arni": "sacubitril valsartan"})
    assert rows(asked, "family", "query") == [("arni", "sacubitril valsartan"), ("mra", "spironolactone MRA dose")]


def test_failures_and_stages(spark):
    why = telemetry.failure(F.col("s"), F.lit("no lease"), F.lit(1), F.lit(None).cast("string"), F.lit(True), F.col("e"), F.col("c"))
    rows_ = [("completed", "timeout", None), ("completed", "http", 422), ("completed", "http", 500), ("completed", "request", None), ("completed", "KeyError", None), ("failed", None, None), ("completed", None, None)]
    assert [r.why for r in spark.createDataFrame(rows_, "s string, e string, c int").select(why.alias("why")).collect()] == ["timeout", "validation_error", "request_error", "request_error", "unknown_error", "worker_anomaly", None]
    schema = "id int, created_at string, started_at string, completed_at string, status string, query_rewritten boolean, use_retrieval boolean, retrieval_mode string, attempts array<struct<returned:int,graph_nodes_added:int>>, dense_candidates int, sparse_candidates int, use_graph_augmentation boolean, assessed boolean, verdict string, verifies boolean, stages array<struct<name:string,status:string,duration_ms:double>>"
    records = spark.createDataFrame([
        (1, "2024-01-01T00:00:00", "2024-01-01T00:00:01", "2024-01-01T00:00:03", "completed", True, True, "hybrid", None, 10, None, True, True, "pass", None, None),
        (2, None, None, None, None, None, True, None, [(3, 1)], None, None, None, None, None, True, None),
        (3, None, None, None, "failed", None, None, None, None, None, None, None, None, None, None, [("own", "completed", 1.0)]),
    ], schema)
    got = {r.id: [(x.name, x.status, x.duration_ms) for x in r.stages] for r in telemetry.stages(records).collect()}
    assert got[1] == [("job_queue", "completed", 1000.0), ("query_rewrite", "completed", None), ("retrieval_dense", "completed", None), ("graph_augmentation", "requested", None), ("context_assessment", "completed", None), ("generation", "completed", 2000.0), ("verification", "completed", None)]
    assert got[2] == [("query_rewrite", "skipped", None), ("retrieval_planning", "completed", None), ("retrieval_default", "completed", None), ("graph_augmentation", "completed", None), ("generation", "unknown", None), ("verification", "skipped", None)]
    assert got[3] == [("own", "completed", 1.0)]
    assert [[x.name for x in r.stages] for r in telemetry.stages(records.where("id = 1"), ingestion=True).collect()] == [["job_queue", "ingestion_execution"]]


def test_passages(spark):
    words = lambda n, w="word": " ".join([w] * n)
    pages = spark.createDataFrame([
        ("d", 1, "skipped " + words(50)),
        ("d", 2, words(45, "a") + "\n \n" + words(3, "b") + "\n\n" + words(200, "c")),
        ("d", 3, "12\nESC Guidelines 2021\n" + "\n".join([words(30, "x")] * 7) + "\nPROBLEM SOLVING and more\n" + "\n".join([words(30, "y")] * 2)),
        ("d", 4, "References: doi doi et al. et al. " + words(60)),
        ("d", 5, words(60, "z")),
        ("e", 1, "references " + words(60, "q")),
    ], "source_id string, page_number int, text string")
    got = {r.passage_id: (r.words, r.text.split()[0], r.section) for r in datasets.passages(pages, skip=1).collect()}
    assert got == {"d_p002_001": (45, "a", words(45, "a")[:80].rstrip()), "d_p002_002": (180, "c", words(200, "c")[:80]), "d_p003_001": (180, "x", words(180, "x")[:80]), "d_p003_002": (63, "PROBLEM", "PROBLEM SOLVING")} or got["d_p003_002"][0] == 64
    assert {r.passage_id for r in datasets.passages(pages, skip=0, stop_at_references=False).collect()} >= {"e_p001_001", "d_p005_001", "d_p004_001"}


def test_point_ids(spark):
    from siftstone.sources import stores

    for name in ("a-chunk-0", "ä", ""):
        assert one(spark, stores.point_id(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_dose_lines(spark):
    line = F.lit("Bisoprolol: starting dose 1.25 mg o.d., target dose 5–10 mg O.D.; loop starting dose 20-40 mg; target dose 97/103 mg b.i.d.")
    got = spark.range(1).select(dosing.labelled_dose(line, "starting dose").alias("a"), dosing.target_dose(line).alias("b"), dosing.combined_dose(line, "target dose").alias("c"), dosing.dose_range(line, "loop starting dose").alias("d"), dosing.labelled_dose(line, "none").alias("e")).first()
    assert tuple(got.a) == ("1.25 mg o.d.", 1.25, "o.d.") and tuple(got.b) == ("5-10 mg o.d.", 10.0, "o.d.")
    assert tuple(got.c) == ("97/103 mg b.i.d.", 97.0, "b.i.d.") and tuple(got.d) == ("20-40 mg daily", 20.0, 40.0) and tuple(got.e) == (None, None, None)
    contexts = spark.createDataFrame([(1, 0, "Intro\nBeta: 1 mg"), (1, 1, "beta again"), (2, 0, "x"), (2, 1, "y")], "request_id long, ord int, snippet string")
    agents = spark.createDataFrame([(1, "beta"), (2, "beta"), (3, "beta")], "request_id long, agent string")
    assert rows(dosing.agent_line(contexts, agents), "request_id", "line") == [(1, "Beta: 1 mg"), (2, "x\ny"), (3, "")]


def test_judging_and_ranking(spark):
    q = spark.createDataFrame([(1, "potassium dose", ["eGFR"]), (2, "else", None)], "query_id long, text string, profile_terms array<string>")
    c = spark.createDataFrame([(1, 0, "T", "nothing"), (1, 1, "Potassium", "dose of egfr"), (1, 2, None, "egfr low")], "query_id long, ord int, title string, snippet string")
    got = {r.query_id: r for r in guidance.judged_contexts(q, c).collect()}
    assert (got[1].n, got[1].hits, got[1].sufficient, got[1].confidence) == (3, 2, True, "high")
    assert got[2].reasons == ["too_few_context_chunks", "no_clear_query_term_overlap"] and got[2].confidence == "low"
    assert rows(guidance.ranked_contexts(q, c, 3), "rank", "ord", "score") == [(1, 1, 3.5), (2, 2, 1.5)]
    hb = spark.createDataFrame([("a", "hb", "9", "Haemoglobin", None, 9.0, 12.0, None, "low"), ("a", "potassium", "5.9", "Potassium", None, 5.9, None, 5.0, "high"), ("a", "ef", "30", "EF", None, 30.0, 50.0, None, "normal")], "patient_id string, key string, value string, label string, unit string, number double, low double, high double, status string")
    who = clinical.portrait(hb).select(F.lit(1).alias("query_id"), F.lit("anything else").alias("text"), F.col("relevant_terms").alias("profile_terms"), "abnormal", "clusters", "recognised")
    seen = spark.createDataFrame([(1, 0, "A", "haemoglobin"), (1, 1, "B", "haemoglobin and ferritin, anything"), (1, 2, "C", "hyperkalaemia"), (1, 3, "D", "anything else")], "query_id int, ord int, title string, snippet string")
    judged = guidance.judged_contexts(who, seen).first()
    assert [(x.cluster, x.n) for x in judged.cluster_coverage] == [("Anemia and iron status", 2), ("Cardio-renal and electrolyte safety", 1)] and judged.sufficient and judged.confidence == "high"
    assert guidance.judged_contexts(who, seen.where("ord < 2"), 1).first().reasons == ["incomplete_cluster_coverage"]
    assert guidance.judged_contexts(who.withColumn("profile_terms", F.array().cast("array<string>")), seen, 9).first().reasons == ["too_few_context_chunks", "no_abnormal_terms_available"]
    # The best context of each cluster comes first, then the others that score.
    assert rows(guidance.ranked_contexts(who, seen, 3), "rank", "ord") == [(1, 1), (2, 2), (3, 0)]
    assert one(spark, guidance.numbered_items(F.col("t")), t="(1. x; a;2. b: 3.c a4. d 15. e") == ["x; a", "b:", "c a4. d 15. e"]
    assert one(spark, guidance.says_unknown(F.col("t")), t="Based on the  provided context, I don't know.") and not one(spark, guidance.generic(F.col("t")), t="Review these results together with symptoms")


def test_index(spark):
    from siftstone.operators import indexing

    docs = spark.createDataFrame([("a", "heart failure dose"), ("b", " "), ("c", "the of")], "source_id string, text string")
    index = indexing.indexed(indexing.prepared(docs))
    got = {r.source_id: r.embedding for r in index.collect()}
    assert set(got) == {"a", "c"} and sum(x * x for x in got["a"]) == pytest.approx(1) and not any(got["c"])
    assert indexing.index_model(index) == "hashed-256"
    with pytest.raises(ValueError, match="empty"):
        indexing.index_model(index.limit(0))
    with pytest.raises(ValueError, match="several"):
        indexing.index_model(index.unionByName(index.withColumn("embedding_model", F.lit("other"))))
