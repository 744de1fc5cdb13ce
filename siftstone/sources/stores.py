"""Keyed tables: upserts, registries, versioned settings and archives. A table is a DataFrame; writers go to new paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.operators.retrieval import first_of

#: Fixed value: the name space of URLs for UUIDs of version 5.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def point_id(chunk_id: Column) -> Column:
    """UUID of version 5 of a chunk's id in the name space of URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(chunk_id, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of repeated keys in new the one with the highest order stays."""
    if order:
        new = first_of(new, keys, [F.col(order).desc()])
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def registered(old: DataFrame, new: DataFrame, key: str, created: str = "created_at") -> DataFrame:
    """A registry after an update: values of new where they aren't null, else the old ones; created stays as it was."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}") if c == created else F.coalesce(f"b.{c}", f"a.{c}")
    return both.select(*(pick(c).alias(c) for c in old.columns))


def current(versions: DataFrame) -> DataFrame:
    """The latest version of each name in a log (name, version_id, payload, deleted), unless that one deletes it."""
    return first_of(versions, ["name"], [F.col("version_id").desc()]).where(~F.coalesce("deleted", F.lit(False)))


def checksum(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def put(versions: DataFrame, change: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with changes (name, payload, deleted, expected) added as next versions, and the changes that conflict.

    expected: the checksum of the payload that the change was made from, or null to make it whatever there is now.
    """
    last = versions.groupBy("name").agg(F.max("version_id").alias("last"))
    now = current(versions).select("name", checksum(F.col("payload")).alias("sha"))
    met = change.join(last, "name", "left").join(now, "name", "left")
    clash = F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("sha"))
    fresh = met.where(~clash).select("name", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("version_id"), "payload", "deleted")
    return versions.unionByName(fresh), met.where(clash).select(*change.columns)


def rolled_back(versions: DataFrame, name: str, version_id: int) -> DataFrame:
    """The log with an earlier version of a name added as its next one."""
    old = versions.where((F.col("name") == name) & (F.col("version_id") == version_id))
    last = versions.where(F.col("name") == name).agg((F.max("version_id") + 1).alias("version_id"))
    return versions.unionByName(old.drop("version_id").withColumn("deleted", F.lit(False)).crossJoin(last))


def archive(results: DataFrame, path: str, day: str = "completed_at") -> None:
    """Adds results as JSON below y=/m=/d= of their day."""
    at = F.to_timestamp(day)
    parts = {"y": F.date_format(at, "yyyy"), "m": F.date_format(at, "MM"), "d": F.date_format(at, "dd")}
    results.withColumns(parts).write.mode("append").partitionBy("y", "m", "d").json(path)


def retained(results: DataFrame, day: str, now: Column, days: int = 7) -> DataFrame:
    return results.where(F.to_timestamp(day) >= now - F.expr(f"INTERVAL {days} DAYS"))


def metrics_text(samples: DataFrame) -> DataFrame:
    """(line) of samples (name, labels, kind, value, ts) in the text form of metrics: counters add up, gauges show the last value, histograms their sum and count."""
    per = samples.groupBy("name", F.to_json(F.array_sort(F.map_entries("labels"))).alias("key"), "kind").agg(F.first("labels").alias("labels"), F.sum("value").alias("sum"), F.max_by("value", "ts").alias("last"), F.count("*").cast("double").alias("n"))
    rows = F.when(F.col("kind") == "counter", F.array(F.struct(F.col("name").alias("n"), F.col("sum").alias("v")))).when(F.col("kind") == "gauge", F.array(F.struct(F.col("name").alias("n"), F.col("last").alias("v"))))
    rows = rows.otherwise(F.array(F.struct(F.concat("name", F.lit("_sum")).alias("n"), F.col("sum").alias("v")), F.struct(F.concat("name", F.lit("_count")).alias("n"), F.col("n").alias("v"))))
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.format_string('%s="%s"', e["key"], e["value"])), ",")
    shown = per.select(F.explode(rows).alias("x"), F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise("").alias("l"))
    return shown.select(F.concat("x.n", "l", F.lit(" "), F.col("x.v").cast("string")).alias("line")).orderBy("line")


def latest_runs(summaries: DataFrame, artifacts: DataFrame, key: str = "run_id", at: str = "started_at") -> DataFrame:
    """All runs that have a summary, and those that have an artifact alone, newest first."""
    return summaries.unionByName(artifacts.join(summaries.select(key), key, "left_anti"), allowMissingColumns=True).orderBy(F.col(at).desc_nulls_last(), key)


def numbered(rows: DataFrame, order: list, name: str = "ord") -> DataFrame:
    """rows with numbers from 0 on in a stated order; for small tables, as all of them meet in one task."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
