"""Runs of experiments: their cases summed up, their metrics under common names, their records flattened and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import top
from .scoring import metric_rows

# Measures of cases that a summary averages: those of retrieval, those of answers with missing ones as 0, and those of answers that are graded by rules, without missing ones.
RETRIEVAL = "hit_at_1 hit_at_3 hit_at_5 mrr lenient_success_score average_overlap_score average_semantic_score weighted_relevance_score soft_ndcg retrieved_average_overlap_score retrieved_average_semantic_score duplicate_chunk_rate context_diversity_score".split()
ANSWERS = "answer_similarity reference_token_f1 required_fact_recall groundedness_score faithfulness_to_retrieved_context hallucination_unsupported_token_count".split()
GRADED = "answer_quality_score deterministic_rubric_score faithfulness_to_gold_passage".split()
JUDGED = "judge_score llm_judge_score".split()
PASSED = ["pass", "passed", "ok", "success"]
# The common names of a run's metrics, and the columns of its summary and latencies that they stand for; seconds become milliseconds.
COMMON = {
    **{f"retrieval.{c}": f"retrieval_{c}" for c in "hit_at_1 hit_at_3 hit_at_5 mrr strict_success_rate lenient_success_score average_overlap_score average_semantic_score weighted_relevance_score soft_ndcg duplicate_chunk_rate context_diversity_score".split()},
    **{f"generation.{c}": f"generation_{c}" for c in "average_answer_similarity average_answer_quality_score average_judge_score average_deterministic_rubric_score average_llm_judge_score average_required_fact_recall forbidden_fact_violation_rate average_faithfulness_to_gold_passage average_groundedness_score average_faithfulness_to_retrieved_context hallucination_rate average_hallucination_unsupported_token_count average_warning_count verification_pass_rate exact_pass_rate".split()},
    **{f"latency.{c}_ms": f"latency_{c}" for c in "average p50 p95 p99 min max".split()},
    **{f"latency.{c}": f"latency_{c}" for c in "failure_rate timeout_rate completion_rate".split()},
    **{f"latency.{c}_ms": f"latency_{c}" for c in "queue_delay execution_duration".split()},
}
SECONDS = tuple(f"latency_{c}" for c in "average p50 p95 p99 min max queue_delay execution_duration".split())


def run_summaries(cases: DataFrame, keys: list[str]) -> DataFrame:
    """One row per keys of cases: how many there are, and averages and rates of their measures, 0 where no case has one.

    cases has keys, status, warnings (a number), verdict, retrieved and answered (whether the case has scores of either kind),
    graded (whether rules apply), profile, strict_success, exact_pass, forbidden_fact_violations, judged and judge_error, and
    the measures of RETRIEVAL, ANSWERS, GRADED and JUDGED.
    """
    c = F.col
    zero, share = F.lit(0.0), lambda x: F.when(F.coalesce(x, F.lit(False)), 1.0).otherwise(0.0)
    mean = lambda among, x: F.coalesce(F.avg(F.when(c(among), x)) if among else F.avg(x), zero)
    number = lambda name: F.coalesce(c(name).cast("double"), zero)
    graded = F.coalesce(c("graded"), F.lit(True)) & c("answered")
    rows = cases.withColumn("_graded", graded)
    averages = [mean("retrieved", number(m)).alias(f"retrieval_{m}") for m in RETRIEVAL]
    averages += [mean("answered", number(m)).alias(f"generation_average_{m}") for m in ANSWERS]
    averages += [mean("_graded", c(m).cast("double")).alias(f"generation_average_{m}") for m in GRADED]
    averages += [mean("answered", c(m).cast("double")).alias(f"generation_average_{m}") for m in JUDGED]
    rates = {
        "retrieval_strict_success_rate": ("retrieved", c("strict_success")),
        "generation_llm_judge_enabled_rate": ("answered", c("judged")),
        "generation_llm_judge_error_rate": ("answered", F.trim(F.coalesce("judge_error", F.lit(""))) != ""),
        "generation_forbidden_fact_violation_rate": ("answered", number("forbidden_fact_violations") > 0),
        "generation_hallucination_rate": ("answered", number("hallucination_unsupported_token_count") > 0),
        "generation_warning_case_rate": (None, number("warnings") > 0),
        "generation_verification_pass_rate": (None, F.lower(F.coalesce("verdict", F.lit(""))).isin(PASSED)),
        "generation_exact_pass_rate": ("_graded", c("exact_pass")),
    }
    counts = {"failed_case_count": c("status") == "failed", "completed_case_count": ~F.coalesce(c("status") == "failed", F.lit(False)), "retrieval_case_count": c("retrieved"), "generation_case_count": c("answered"), "deterministic_applicable_case_count": c("_graded"), "observation_only_case_count": c("answered") & (c("profile") == "observation_only")}
    return rows.groupBy(*keys).agg(
        F.count("*").alias("case_count"), *(F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in counts.items()), *averages,
        *(mean(among, share(x)).alias(n) for n, (among, x) in rates.items()), mean(None, number("warnings")).alias("generation_average_warning_count"),
    )


def common_metrics(summaries: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, metric, value): all metrics of COMMON, those that a summary lacks as 0, a missing completion rate as 1."""
    lacking = {c: F.lit(1.0 if c == "latency_completion_rate" else 0.0) for c in COMMON.values() if c not in summaries.columns}
    full = summaries.withColumns(lacking) if lacking else summaries
    return metric_rows(full, key, {c: m for m, c in COMMON.items()}, SECONDS)


# Parts that a run's record has to have, empty where it was written without them.
RUN_PARTS = ["cache", "ingestion_summary", "environment", "source_mapping_summary", "retrieval_summary", "generation_summary", "api_summary", "normalized_metrics"]
VERSION = "2.0"


def migrated(records: DataFrame, version: str = VERSION) -> DataFrame:
    """Records of runs (columns of JSON texts) with the parts of RUN_PARTS, per_case_results, notes and artifact_type that older ones lack, and the current version."""
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    defaults = {**dict.fromkeys(RUN_PARTS, "{}"), "per_case_results": "[]", "notes": "", "change_note": "", "artifact_type": "run"}
    return records.withColumns({**{c: F.coalesce(has(c), F.lit(v)) for c, v in defaults.items()}, "artifact_version": F.lit(version)})


# Columns of a run's overview, and where its record has them; of several places the first that isn't null.
OVERVIEW = {
    "chunking_strategy": ["config_overview.ingestion.chunking_strategy", "config.ingestion.chunking_strategy"],
    "retrieval_mode": ["config_overview.inference.retrieval_mode", "config.inference.retrieval_mode"],
    "llm_model": ["config_overview.inference.llm_model", "config.inference.llm_model"],
    "hit_at_1": ["retrieval_summary.hit_at_1"],
    "hit_at_3": ["retrieval_summary.hit_at_3"],
    "hit_at_5": ["retrieval_summary.hit_at_5"],
    "mrr": ["retrieval_summary.mrr"],
    "soft_ndcg": ["retrieval_summary.soft_ndcg"],
    "weighted_relevance": ["retrieval_summary.weighted_relevance_score"],
    "avg_answer_similarity": ["generation_summary.average_answer_similarity"],
    "avg_answer_quality": ["generation_summary.average_answer_quality_score"],
    "avg_deterministic_rubric": ["generation_summary.average_deterministic_rubric_score", "generation_summary.average_answer_quality_score"],
    "avg_fact_recall": ["generation_summary.average_required_fact_recall"],
    "avg_faithfulness": ["generation_summary.average_faithfulness_score", "generation_summary.average_faithfulness_to_context"],
    "exact_pass_rate": ["generation_summary.exact_pass_rate"],
    "verification_pass_rate": ["generation_summary.verification_pass_rate"],
    "hallucination_rate": ["generation_summary.hallucination_rate"],
    "avg_latency": ["api_summary.endpoint_summaries.guidance_endpoint.average", "api_summary.average"],
    "p50_latency": ["api_summary.endpoint_summaries.guidance_endpoint.p50", "api_summary.p50"],
    "p95_latency": ["api_summary.endpoint_summaries.guidance_endpoint.p95", "api_summary.p95"],
    "api_failure_rate": ["api_summary.endpoint_summaries.guidance_endpoint.failure_rate", "api_summary.failure_rate"],
    "queue_delay_avg": ["telemetry_summary.queue_delay.average"],
    "execution_duration_avg": ["telemetry_summary.execution_duration.average"],
    "chunks_created": ["ingestion_summary.chunks_created"],
    "vectors_upserted": ["ingestion_summary.vectors_upserted"],
    "source_map_cases": ["source_mapping_summary.case_count"],
    "direct_evidence_total": ["source_mapping_summary.label_totals.direct_evidence"],
}
TEXTS = ("chunking_strategy", "retrieval_mode", "llm_model")


def overview(runs: DataFrame, payload: str = "payload") -> DataFrame:
    """(run_id, label, at, case_count, and OVERVIEW) of runs' JSON records, newest first; what a record lacks is null."""
    at = lambda path: F.get_json_object(payload, f"$.{path}")
    found = {c: F.coalesce(*map(at, paths)) for c, paths in OVERVIEW.items()}
    count = F.coalesce(at("case_count").try_cast("int"), F.json_array_length(at("per_case_results")), F.lit(0))
    columns = [(x if c in TEXTS else x.try_cast("double")).alias(c) for c, x in found.items()]
    rows = runs.select(at("run_id").alias("run_id"), at("label").alias("label"), F.try_to_timestamp(at("datetime")).alias("at"), count.alias("case_count"), *columns)
    return rows.orderBy(F.col("at").desc_nulls_last(), "run_id")


def overview_cards(rows: DataFrame, filters: dict[str, list] | None = None) -> DataFrame:
    """One row about the runs whose columns have one of the wanted values: their number, best mrr and quality, and least latency that isn't 0."""
    for c, wanted in (filters or {}).items():
        rows = rows.where(F.col(c).isin(wanted)) if wanted else rows
    return rows.agg(F.count("*").alias("runs"), F.max("mrr").alias("best_mrr"), F.max("avg_answer_quality").alias("best_quality"), F.min(F.nullif(F.col("avg_latency"), F.lit(0.0))).alias("least_latency"))


def compared(metrics: DataFrame, runs: list[str], wanted: list[str] | None = None) -> DataFrame:
    """(metric, a value per run, a delta per later run) of (run_id, metric, value): all metrics that any of the runs has, the first run being the one to compare with."""
    rows = metrics.where(F.col("run_id").isin(runs))
    rows = rows.where(F.col("metric").isin(wanted)) if wanted else rows
    wide = rows.groupBy("metric").pivot("run_id", runs).agg(F.first("value"))
    return wide.select("metric", *(F.col(f"`{r}`") for r in runs), *((F.col(f"`{r}`") - F.col(f"`{runs[0]}`")).alias(f"{r} delta") for r in runs[1:]))


def best_metrics(summary: DataFrame, campaign: str = "campaign", k: int = 15) -> DataFrame:
    """The k metrics of each campaign (campaign, metric, average) with the highest averages."""
    return top(summary, [campaign], [F.col("average").desc_nulls_last(), F.col("metric")], k)


def response_shape(record: Column) -> Column:
    """What kind of answer a JSON record is, by the fields it has."""
    has = lambda *names: F.array_size(F.array_intersect(F.coalesce(F.json_object_keys(record), F.array().cast("array<string>")), F.array(*map(F.lit, names)))) > 0
    deep = F.coalesce(F.get_json_object(record, "$.metadata.retrieval_attempts"), F.get_json_object(record, "$.metadata.retrieval_ranking")).isNotNull()
    return F.when(has("job_id", "result_object_key", "worker_id", "callback_attempts"), "async_job_expanded").when(deep, "multistep_diagnostics").when(has("rag"), "api_job_status").when(has("retrieved_context"), "inference_response").otherwise("unknown")


_CONTEXT = "array<struct<chunk_id:string,source_id:string,title:string,snippet:string>>"


def normalised_records(records: DataFrame, record: str = "record") -> DataFrame:
    """records (JSON texts) with contexts (of `rag`, or else of `retrieved_context`), n_warnings, shape, and the texts of metadata and verification."""
    at = lambda path: F.get_json_object(record, f"$.{path}")
    items = lambda path: F.from_json(F.when(F.startswith(at(path), F.lit("[")), at(path)), _CONTEXT)
    return records.withColumns({
        "contexts": F.coalesce(items("rag"), items("retrieved_context"), F.array().cast(_CONTEXT)), "n_warnings": F.coalesce(F.json_array_length(at("warnings")), F.lit(0)), "shape": response_shape(F.col(record)),
        "metadata": F.coalesce(at("metadata"), F.lit("{}")), "verification": at("verification"),
    })


def label(template: str, settings: Column, campaign: Column, index: Column) -> Column:
    """A template's {campaign_label}, {index} and {path_of_a_setting} filled in; settings maps dotted paths to JSON values."""
    out = F.replace(F.replace(F.lit(template), F.lit("{campaign_label}"), campaign), F.lit("{index}"), index.cast("string"))
    return F.aggregate(F.map_entries(settings), out, lambda text, e: F.replace(text, F.concat(F.lit("{"), F.replace(e["key"], F.lit("."), F.lit("_")), F.lit("}")), F.replace(e["value"], F.lit('"'), F.lit(""))))


def reused(wanted: DataFrame, registry: DataFrame, key: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """Wanted runs that the registry (key, status) has completed, and those that have to be done."""
    done = registry.where("status = 'completed'").select(key).distinct()
    return wanted.join(done, key, "left_semi"), wanted.join(done, key, "left_anti")


# Columns of runs and of cases, their kinds, and where a record has them; of several places the first that has a value other than nothing, 0 and the empty text.
_CONFIG = lambda part, name: [f"config_overview.{part}.{name}", f"config.{part}.{name}"]
RUN_COLUMNS = {
    "text": {
        "label": ["label"], "datetime": ["datetime"], "dataset_version": ["dataset_version"], "documents_version": ["documents_version"], "artifact_type": ["artifact_type"],
        "chunking_strategy": _CONFIG("ingestion", "chunking_strategy"), "retrieval_mode": _CONFIG("inference", "retrieval_mode"), "llm_model": _CONFIG("inference", "llm_model"), "prompt_label": _CONFIG("inference", "prompt_engineering_label"),
    },
    "flag": {
        "query_rewriting": _CONFIG("inference", "enable_query_rewriting"), "verification": _CONFIG("inference", "enable_response_verification"),
        "graph_augmentation": _CONFIG("inference", "use_graph_augmentation"), "second_pass_mapping": _CONFIG("source_mapping", "llm_second_pass_enabled"),
    },
    "number": {
        "hit@1": ["retrieval_summary.hit_at_1"], "hit@3": ["retrieval_summary.hit_at_3"], "hit@5": ["retrieval_summary.hit_at_5"], "mrr": ["retrieval_summary.mrr"],
        "weighted_relevance": ["retrieval_summary.weighted_relevance_score"], "lenient_success_score": ["retrieval_summary.lenient_success_score"], "duplicate_chunk_rate": ["retrieval_summary.duplicate_chunk_rate"],
        "context_diversity_score": ["retrieval_summary.context_diversity_score"], "soft_ndcg": ["retrieval_summary.soft_ndcg"],
        "avg_answer_similarity": ["generation_summary.average_answer_similarity"], "avg_answer_quality": ["generation_summary.average_answer_quality_score"],
        "avg_deterministic_rubric": ["generation_summary.average_deterministic_rubric_score", "generation_summary.average_answer_quality_score"],
        "avg_judge_score": ["generation_summary.average_judge_score"], "avg_llm_judge_score": ["generation_summary.average_llm_judge_score", "generation_summary.average_judge_score"],
        "avg_fact_recall": ["generation_summary.average_required_fact_recall"], "avg_faithfulness": ["generation_summary.average_faithfulness_score", "generation_summary.average_faithfulness_to_context"],
        "exact_pass_rate": ["generation_summary.exact_pass_rate"], "verification_pass_rate": ["generation_summary.verification_pass_rate"],
        "forbidden_violation_rate": ["generation_summary.forbidden_fact_violation_rate"], "hallucination_rate": ["generation_summary.hallucination_rate"],
        "queue_delay_avg": ["telemetry_summary.queue_delay.average"], "execution_duration_avg": ["telemetry_summary.execution_duration.average"],
        "chunks_created": ["ingestion_summary.chunks_created"], "vectors_upserted": ["ingestion_summary.vectors_upserted"],
        "avg_chunk_length": ["ingestion_summary.ingestion_metrics.average_chunk_length"], "page_coverage_ratio": ["ingestion_summary.ingestion_metrics.page_coverage_ratio"],
        "normalized_strict_success_rate": ["normalized_metrics/retrieval.strict_success_rate"], "normalized_avg_answer_similarity": ["normalized_metrics/generation.average_answer_similarity"],
        "normalized_avg_answer_quality": ["normalized_metrics/generation.average_answer_quality_score"], "normalized_avg_deterministic_rubric": ["normalized_metrics/generation.average_deterministic_rubric_score"],
        "normalized_avg_judge_score": ["normalized_metrics/generation.average_judge_score"], "normalized_avg_llm_judge_score": ["normalized_metrics/generation.average_llm_judge_score"],
        "normalized_avg_latency": ["normalized_metrics/latency.average_ms"],
    },
    "whole": {"source_map_cases": ["source_mapping_summary.case_count"], "direct_evidence_total": ["source_mapping_summary.label_totals.direct_evidence"]},
}
API_COLUMNS = {"avg_latency": "average", "p50_latency": "p50", "p95_latency": "p95", "p99_latency": "p99", "api_failure_rate": "failure_rate", "api_timeout_rate": "timeout_rate", "api_completion_rate": "completion_rate"}
CASE_COLUMNS = {
    "text": {"case_id": ["case_id"], "question": ["question"], "answerability": ["answerability"], "api_failure_category": ["raw_endpoint_result.error"], "generated_answer": ["generated_answer"]},
    "number": {
        "retrieval_hit@1": ["retrieval_scores.hit_at_1"], "retrieval_hit@3": ["retrieval_scores.hit_at_3"], "mrr": ["retrieval_scores.mrr"], "weighted_relevance_score": ["retrieval_scores.weighted_relevance_score"],
        "lenient_success_score": ["retrieval_scores.lenient_success_score"], "duplicate_chunk_rate": ["retrieval_scores.duplicate_chunk_rate"], "answer_similarity": ["generation_scores.answer_similarity"],
        "answer_quality_score": ["generation_scores.answer_quality_score"], "judge_score": ["generation_scores.judge_score"], "fact_recall": ["generation_scores.required_fact_recall"],
        "faithfulness": ["generation_scores.faithfulness_score", "generation_scores.faithfulness_to_context"], "hallucination_rate": ["generation_scores.hallucination_rate"], "exact_pass": ["generation_scores.exact_pass"],
        "total_latency_ms": ["timings.total_latency_ms", "telemetry.derived.total_duration_ms"], "queue_delay_ms": ["telemetry.derived.queue_delay_ms"], "execution_duration_ms": ["telemetry.derived.execution_duration_ms"],
    },
}
#: Columns that take another place only if the first one is missing, and numbers of entries of lists.
CASE_NESTED = {"deterministic_rubric_score": ["generation_scores.deterministic_rubric.score", "generation_scores.answer_quality_score"], "llm_judge_score": ["generation_scores.llm_judge.score", "generation_scores.judge_score"]}
CASE_COUNTS = {"warning_count": "warnings", "retrieved_chunk_count": "retrieved_chunks", "direct_evidence_count": "source_list.direct_evidence", "supporting_count": "source_list.supporting"}


def names(place: str) -> tuple[str, ...]:
    """The names that lead to a place; a slash stands before one that has dots of its own."""
    dotted, *rest = place.split("/")
    return *dotted.split("."), *rest


def _path(place: str) -> str:
    return "$" + "".join(f'["{n}"]' for n in names(place))


def _picked(record: Column, columns: dict[str, dict[str, list[str]]]) -> list[Column]:
    get = lambda place, kind: F.try_variant_get(record, _path(place), kind)
    number = lambda place: F.coalesce(get(place, "double"), get(place, "boolean").cast("double"))
    how = {
        "text": lambda ps: F.coalesce(*(F.nullif(get(p, "string"), F.lit("")) for p in ps), F.lit("")),
        "flag": lambda ps: F.coalesce(*(F.nullif(F.coalesce(get(p, "boolean"), get(p, "double") != 0), F.lit(False)) for p in ps), F.lit(False)),
        "number": lambda ps: F.coalesce(*(F.nullif(number(p), F.lit(0.0)) for p in ps), F.lit(0.0)),
        "whole": lambda ps: F.coalesce(*(number(p).cast("long") for p in ps), F.lit(0)),
    }
    return [how[kind](places).alias(name) for kind, own in columns.items() for name, places in own.items()]


def run_rows(runs: DataFrame, payload: str = "payload") -> DataFrame:
    """A wide row for each run's JSON record: run_id, at, case_count, RUN_COLUMNS and API_COLUMNS, and what else runs has.

    A record is read once, to a VARIANT. What it lacks, or has as something that is no number where one is meant, is 0, false or the empty
    text. API columns are those of the guidance endpoint, or of the whole summary if it has none. A record that isn't JSON is an empty one.
    """
    rest = [c for c in runs.columns if c not in (payload, "run_id")]
    known = "run_id" in runs.columns
    read = runs.withColumn("_r", F.coalesce(F.try_parse_json(payload), F.parse_json(F.lit("{}"))))
    get = lambda place, kind: F.try_variant_get("_r", _path(place), kind)
    endpoint = F.coalesce(get("api_summary.endpoint_summaries.guidance_endpoint", "string"), F.lit("{}")) != "{}"
    api = [F.coalesce(F.when(endpoint, get(f"api_summary.endpoint_summaries.guidance_endpoint.{p}", "double")).otherwise(get(f"api_summary.{p}", "double")), F.lit(0.0)).alias(c) for c, p in API_COLUMNS.items()]
    name = F.coalesce(F.nullif(get("run_id", "string"), F.lit("")), *([F.col("run_id")] if known else []), F.lit(""))
    count = F.coalesce(F.nullif(get("case_count", "double").cast("int"), F.lit(0)), F.size(get("per_case_results", "array<variant>")), F.lit(0))
    return read.select(name.alias("run_id"), F.try_to_timestamp(get("datetime", "string")).alias("at"), count.alias("case_count"), *rest, *_picked(F.col("_r"), RUN_COLUMNS), *api)


def case_rows(runs: DataFrame, payload: str = "payload", run: str = "run_id") -> DataFrame:
    """A wide row for each case in runs' JSON records: the run, CASE_COLUMNS, CASE_NESTED and CASE_COUNTS. A case without status is completed."""
    cases = F.explode(F.try_variant_get(F.try_parse_json(payload), "$.per_case_results", "array<variant>"))
    read = runs.select(run, cases.alias("_c"))
    get = lambda place, kind: F.try_variant_get("_c", _path(place), kind)
    nested = [F.coalesce(*(get(p, "double") for p in places), F.lit(0.0)).alias(c) for c, places in CASE_NESTED.items()]
    counts = [F.coalesce(F.size(get(p, "array<variant>")), F.lit(0)).alias(c) for c, p in CASE_COUNTS.items()]
    status = F.coalesce(F.nullif(get("status", "string"), F.lit("")), F.lit("completed")).alias("status")
    return read.select(run, status, *_picked(F.col("_c"), CASE_COLUMNS), *nested, *counts)
