"""Durations, failures and summaries of recorded requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import latency_summary


#: Answers of a server that say that a request isn't fit.
UNFIT = (400, 404, 409, 422)


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two ISO times, 0 at least; null if one is missing or no time."""
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(b) - F.unix_micros(a)) / 1000.0))


def derived(records: DataFrame) -> DataFrame:
    """records with queue_delay_ms, execution_duration_ms and total_duration_ms of created_at, started_at, completed_at."""
    c = F.col
    return records.withColumns({"queue_delay_ms": duration_ms(c("created_at"), c("started_at")), "execution_duration_ms": duration_ms(c("started_at"), c("completed_at")), "total_duration_ms": duration_ms(c("created_at"), c("completed_at"))})


def failure(status: Column, message: Column, n_contexts: Column, verdict: Column, guidance: Column, error: Column | None = None, code: Column | None = None) -> Column:
    """Why a request counts as failed; null if it doesn't. The first reason that fits is named.

    error: what the call itself raised, as `timeout`, `http` (with a status code), `request` or any other name; null if it came back.
    """
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *xs: text.rlike("|".join(xs))
    failed = (
        F.when(has("validation", "422"), "validation_error")
        .when(has("retriev"), "retrieval_failure")
        .when(has("verif"), "verification_failure")
        .when(has("callback"), "callback_failure")
        .when(has("lease", "worker", "retry"), "worker_anomaly")
        .when(guidance, "generation_failure")
        .otherwise("ingestion_failure")
    )
    error, code = (F.lit(None).cast(kind) if c is None else c for c, kind in ((error, "string"), (code, "int")))
    return (
        F.when(error == "timeout", "timeout")
        .when((error == "http") & code.isin(*UNFIT), "validation_error")
        .when(error.isin("http", "request"), "request_error")
        .when(error.isNotNull(), "unknown_error")
        .when(F.lower(F.coalesce(status, F.lit(""))) == "failed", failed)
        .when(guidance & (n_contexts == 0), "empty_retrieval")
        .when(F.lower(F.coalesce(verdict, F.lit(""))).isin("fail", "failed", "warning", "warn"), "verification_failure")
    )


def endpoint_summary(attempts: DataFrame, success_only: bool = True) -> DataFrame:
    """Per endpoint of attempts (endpoint, status, latency_seconds, failure_category): latency_summary, counts, rates and requests per second."""
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    latency = F.when(done, F.col("latency_seconds")) if success_only else F.col("latency_seconds")
    n, good, busy = F.count("*"), F.count_if(done), F.sum("latency_seconds")
    counts = attempts.groupBy("endpoint").agg(
        n.alias("request_count"), good.alias("success_count"), (n - good).alias("failure_count"), (good / n).alias("completion_rate"), ((n - good) / n).alias("failure_rate"),
        F.when(busy > 0, good / busy).otherwise(0.0).alias("requests_per_second"), (F.count_if(F.col("failure_category") == "timeout") / n).alias("timeout_rate"),
    )
    return counts.join(latency_summary(attempts, ["endpoint"], latency), "endpoint")


def failure_taxonomy(attempts: DataFrame) -> DataFrame:
    return attempts.where("failure_category IS NOT NULL AND failure_category <> ''").groupBy("endpoint", "failure_category").agg(F.count("*").alias("n"))


def cycled(cases: DataFrame, requests: int, order: str = "case_id") -> DataFrame:
    """(request, case): cases in turn for each of a number of requests."""
    placed = cases.select(F.col(order).alias("case"), (F.row_number().over(Window.orderBy(order)) - 1).alias("at"))
    n = placed.agg(F.count("*").alias("n"))
    turns = cases.sparkSession.range(requests).withColumnRenamed("id", "request").crossJoin(F.broadcast(n)).where("n > 0")
    return turns.join(placed, F.pmod("request", "n") == F.col("at")).select("request", "case")


_STAGE = "array<struct<name:string,status:string,duration_ms:double>>"


def stages(records: DataFrame, ingestion: bool = False) -> DataFrame:
    """records with `stages` (name, status, duration_ms) and `stage_source`: those a record names itself, or else what its other fields tell, in the order in which they run.

    Read if there: stages, status, created_at, started_at, completed_at, and of guidance requests query_rewritten,
    use_retrieval, retrieval_mode, attempts (returned, graph_nodes_added), dense_candidates, sparse_candidates,
    graph_augmented, use_graph_augmentation, graph_nodes_added, graph_edges, ranking_count, assessed, verdict, verifies.
    """
    told = derived(records)
    has = lambda name, kind: F.col(name) if name in records.columns else F.lit(None).cast(kind)
    yes = lambda name: F.coalesce(has(name, "boolean"), F.lit(False))
    stage = lambda name, status="completed", ms=None: F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), (F.lit(None).cast("double") if ms is None else ms).alias("duration_ms"))
    state = F.coalesce(F.nullif(has("status", "string"), F.lit("")), F.lit("unknown"))
    queue = F.when(F.col("queue_delay_ms").isNotNull(), stage("job_queue", ms=F.col("queue_delay_ms")))
    if ingestion:
        made = F.array(queue, stage("ingestion_execution", state, F.col("execution_duration_ms")))
    else:
        rewritten, searches, mode = yes("query_rewritten"), yes("use_retrieval"), has("retrieval_mode", "string")
        attempts = F.coalesce(has("attempts", "array<struct<returned:int,graph_nodes_added:int>>"), F.array().cast("array<struct<returned:int,graph_nodes_added:int>>"))
        tried, named = F.size(attempts) > 0, F.concat(F.lit("retrieval_"), F.coalesce(F.nullif(mode, F.lit("")), F.lit("default")))
        dense, sparse = has("dense_candidates", "int"), has("sparse_candidates", "int")
        added = F.coalesce(has("graph_nodes_added", "int"), F.when(tried, F.aggregate(attempts, F.lit(0), lambda s, x: s + F.coalesce(x["graph_nodes_added"], F.lit(0)))), F.lit(0))
        grown = yes("graph_augmented") | (F.coalesce(has("graph_edges", "int"), F.lit(0)) > 0) | (added > 0)
        ranked, assessed = F.coalesce(has("ranking_count", "int"), F.lit(0)) > 0, yes("assessed")
        hybrid = F.coalesce(mode == "hybrid", F.lit(False)) & ~tried
        made = F.array(
            queue,
            F.when(rewritten, stage("query_rewrite")).when(searches, stage("query_rewrite", "skipped")),
            F.when(searches & tried, stage("retrieval_planning")),
            F.when(searches & hybrid & dense.isNotNull(), stage("retrieval_dense")),
            F.when(searches & hybrid & sparse.isNotNull(), stage("retrieval_sparse")),
            F.when(searches & ~hybrid, stage(named)),
            F.when(searches & (grown | yes("use_graph_augmentation")), stage("graph_augmentation", F.when(grown, "completed").otherwise("requested"))),
            F.when(searches & (ranked | assessed), stage("context_assessment", F.when(assessed, "completed").otherwise("unknown"))),
            stage("generation", state, F.col("execution_duration_ms")),
            F.when(has("verdict", "string").isNotNull(), stage("verification")).when(yes("verifies"), stage("verification", "skipped")),
        )
    given = F.coalesce(has("stages", _STAGE), F.array().cast(_STAGE))
    return told.withColumns({"stages": F.when(F.size(given) > 0, given).otherwise(F.array_compact(made)), "stage_source": F.when(F.size(given) > 0, "endpoint").otherwise("derived")})
