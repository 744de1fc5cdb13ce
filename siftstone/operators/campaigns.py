"""Experiment campaigns: grids of settings, and comparison of the runs' metrics.

Runs are rows, metrics are columns; unpivot() makes the long form where a summary wants it.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scoring import graded

#: Metrics of which less is better.
LOWER_IS_BETTER = ("avg_latency", "p95_latency", "api_failure_rate", "hallucination_rate")
#: From what on a case has which bottleneck.
HITS, QUALITY, UNGROUNDED, SLOW_MS = 0.5, 0.6, 0.15, 8000


def grid(spark: SparkSession, matrix: dict[str, list], include: list[dict] = (), exclude: list[dict] = (), most: int | None = None) -> DataFrame:
    """(index, settings): every combination of the matrix's values, then the included ones, each once; settings maps paths to JSON values.

    Combinations are numbered before those are left out that agree with an exclusion in all of its paths.
    """
    text = lambda v: json.dumps(v, sort_keys=True)
    names = list(matrix)
    axes = [spark.createDataFrame([(i, text(v)) for i, v in enumerate(matrix[n])], f"_i{k} int, _v{k} string") for k, n in enumerate(names)]
    none = spark.range(1).select()
    product = reduce(lambda a, b: a.crossJoin(b), axes, none) if axes else none
    pairs = [x for k, n in enumerate(names) for x in (F.lit(n), F.col(f"_v{k}"))]
    kind = "map<string,string>"
    rows = product.select(F.lit(0).alias("_part"), F.array(*(F.col(f"_i{k}") for k in range(len(names)))).cast("array<int>").alias("_at"), (F.create_map(*pairs) if pairs else F.create_map()).cast(kind).alias("settings"))
    if include:
        extra = spark.createDataFrame([(i, {k: text(v) for k, v in x.items()}) for i, x in enumerate(include)], f"i int, settings {kind}")
        rows = rows.unionByName(extra.select(F.lit(1).alias("_part"), F.array("i").alias("_at"), "settings"))
    rows = rows.withColumn("_key", F.to_json(F.array_sort(F.map_entries("settings"))))
    rows = rows.groupBy("_key").agg(F.min(F.struct("_part", "_at")).alias("_first"), F.first("settings").alias("settings"))
    rows = rows.withColumn("index", F.row_number().over(Window.orderBy("_first")))
    for x in exclude:
        same = reduce(lambda a, b: a & b, (F.col("settings")[k].eqNullSafe(F.lit(text(v))) for k, v in x.items()), F.lit(True))
        rows = rows.where(~same)
    rows = rows.select("index", "settings")
    return rows.orderBy("index").limit(most) if most is not None else rows


def long_form(runs: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return runs.select(*ids, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(ids, metrics, "metric", "value")


def campaign_summary(runs: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """(group, metric, runs, average): of each group, and of all runs, where group is null and `overall` true. One pass by grouping sets."""
    rows = long_form(runs.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("ungrouped"))), [group], metrics)
    sets = rows.groupingSets([["metric"], [group, "metric"]], group, "metric")
    return sets.agg(F.count("value").alias("runs"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("average"), (F.grouping(group) == 1).alias("overall"))


def scaled(value: Column, low: Column, high: Column) -> Column:
    """From 0 to 1 between the bounds; 1 where they are equal or missing."""
    return F.when(low.isNull() | (low == high), 1.0).otherwise((value - low) / (high - low))


def scorecard(runs: DataFrame, metrics: list[str], efficiency: list[str] = ()) -> DataFrame:
    """runs with composite_score, the mean of all metrics from 0 (worst run) to 1 (best), and efficiency_score, that of some; nulls aren't counted."""
    bounds = runs.agg(*(f(F.col(m).cast("double")).alias(f"_{n}_{i}") for i, m in enumerate(metrics) for n, f in (("lo", F.min), ("hi", F.max))))
    # One row of two numbers a metric.
    rows = runs.crossJoin(F.broadcast(bounds))
    each = {}
    for i, m in enumerate(metrics):
        v, lo, hi = F.col(m).cast("double"), F.col(f"_lo_{i}"), F.col(f"_hi_{i}")
        each[m] = scaled(-v, -hi, -lo) if m in LOWER_IS_BETTER else scaled(v, lo, hi)

    def mean(names):
        known = F.filter(F.array(*(each[m] for m in names)), lambda x: x.isNotNull())
        return F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known), 4))

    out = {"composite_score": mean(metrics)} | ({"efficiency_score": mean(efficiency)} if efficiency else {})
    return rows.withColumns(out).drop(*bounds.columns)


#: Ranges of x whose best y are put in order before the values within them.
BINS = 1024


def pareto(runs: DataFrame, x: str, y: str) -> DataFrame:
    """The runs to which none with less x has more y. Only the best y of each x counts; they are compared within ranges of x, and with the best of all ranges before."""
    best = runs.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_x")).agg(F.max(y).alias("_best"))
    # One row of two numbers.
    bounds = F.broadcast(best.agg(F.min("_x").cast("double").alias("_lo"), F.max("_x").cast("double").alias("_hi")))
    low, high = graded(F.col("_lo")), graded(F.col("_hi"))
    share = (graded(F.col("_x").cast("double")) - low) / (high - low)
    placed = best.crossJoin(bounds).select("_x", "_best", F.when(high > low, F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(0).alias("_bin"))
    earlier = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("_bin").agg(F.max("_best").alias("_top")).withColumn("_carried", F.max("_top").over(earlier)).select("_bin", "_carried")
    inside = F.max("_best").over(Window.partitionBy("_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1))
    before = F.greatest(inside, "_carried")
    kept = placed.join(carried, "_bin").withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_best") >= F.col("_before"))).select("_x", "_best")
    return runs.join(kept, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_best"))).drop("_x", "_best")


def deltas(runs: DataFrame, baseline: str, metrics: list[str], run: str = "run_id") -> DataFrame:
    """(run, metric, delta): each run's difference from the baseline run, and wins: 1, 0 or -1, more for what is better."""
    rows = long_form(runs, [run], metrics)
    base = rows.where(F.col(run) == baseline).select("metric", F.col("value").alias("base"))
    better = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -1).otherwise(1)
    return rows.where(F.col(run) != baseline).join(base, "metric").select(run, "metric", (F.col("value") - F.col("base")).alias("delta"), (F.signum(F.col("value") - F.col("base")) * better).cast("int").alias("win"))


def heatmap(runs: DataFrame, metrics: list[str], run: str = "run_id") -> DataFrame:
    """(run, metric, value, share): values from 0 to 1 per metric, 1 for the best."""
    rows = long_form(runs, [run], metrics)
    bounds = rows.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    share = scaled(F.col("value"), F.col("lo"), F.col("hi"))
    less = F.col("metric").isin(*LOWER_IS_BETTER) & (F.col("lo") != F.col("hi"))
    return rows.join(bounds, "metric").select(run, "metric", "value", F.when(less, 1 - share).otherwise(share).alias("share"))


def dimension_means(runs: DataFrame, dimension: str, metrics: list[str]) -> DataFrame:
    return runs.groupBy(dimension).agg(*(F.avg(m).alias(m) for m in metrics))


def leaders(runs: DataFrame, best: dict[str, Column], shown: list[str], run: str = "run_id") -> DataFrame:
    """(finding, run, metrics that are shown): for each finding the run whose value is largest; null is last, of equal values the smallest run counts. Of a single run there is only the first finding. One pass, of which each task keeps a row per finding."""
    at = lambda value: F.min(F.struct(value.isNull().alias("none"), (-value).alias("value"), F.col(run).alias(run), *shown))
    rows = runs.agg(F.count("*").alias("_n"), *(at(value).alias(f"_{i}") for i, value in enumerate(best.values())))
    told = F.array(*(F.struct(F.lit(i).alias("_i"), F.lit(name).alias("finding"), F.col(f"_{i}").alias("_x")) for i, name in enumerate(best)))
    out = rows.where("_n > 0").select("_n", F.inline(told)).where("_i = 0 OR _n > 1")
    return out.select("finding", *(F.col("_x")[c].alias(c) for c in (run, *shown)))


def leading_groups(runs: DataFrame, dimensions: list[str], metrics: list[str]) -> DataFrame:
    """(dimension, value, means of metrics): for each dimension with more than one value the group whose mean of the first metric is largest; a null value is a group but not a value, ties go to the smallest. All dimensions in one shuffle."""
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    means = runs.select(F.explode(each).alias("_x"), *metrics).groupBy("_x.dimension", "_x.value").agg(*(F.avg(m).alias(m) for m in metrics))
    # As many rows as there are groups.
    per = means.groupBy("dimension").agg(F.count("value").alias("_n"), F.min(F.struct(F.col(metrics[0]).isNull().alias("none"), (-F.col(metrics[0])).alias("mean"), F.col("value").isNull().alias("no"), "value", *[F.col(m).alias(f"m{i}") for i, m in enumerate(metrics)])).alias("_x"))
    return per.where("_n > 1").select("dimension", F.col("_x.value").alias("value"), *(F.col("_x")[f"m{i}"].alias(m) for i, m in enumerate(metrics)))


def hardest(cases: DataFrame, measures: list[str], key: str, k: int = 10) -> DataFrame:
    """The k cases with the lowest measures, compared one after another; null is last, ties go by key."""
    return cases.orderBy(*(F.col(m).asc_nulls_last() for m in measures), key).limit(k)


def bottleneck(hit_at_3: Column, quality: Column, recall: Column, ungrounded: Column, total_ms: Column) -> Column:
    return (
        F.when(hit_at_3 < HITS, "Retrieval bottleneck")
        .when((quality < QUALITY) | (recall < QUALITY), "Generation bottleneck")
        .when(ungrounded > UNGROUNDED, "Grounding risk")
        .when(total_ms > SLOW_MS, "Latency bottleneck")
        .otherwise("Healthy")
    )


def fingerprint(columns: list[str], prefix: str = "") -> Column:
    """sha256 of the columns as JSON, in order of their names, nulls included."""
    out = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    return F.concat(F.lit(f"{prefix}-"), out) if prefix else out
