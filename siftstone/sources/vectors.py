"""Collections of vectors as tables of chunk_id, payload columns and an embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checked(points: DataFrame, size: int, vector: str = "embedding") -> DataFrame:
    """points whose vectors all have this size; a row with another one ends the job that reads it."""
    found = F.size(vector)
    return points.withColumn(vector, F.when(found == size, F.col(vector)).otherwise(F.raise_error(F.format_string("a vector has %d dimensions, not %d", found, F.lit(size)))))


def ensured(spark: SparkSession, name: str, points: DataFrame, size: int) -> DataFrame:
    """The collection of this name, made of points if there is none."""
    if not spark.catalog.tableExists(name):
        checked(points, size).write.saveAsTable(name)
    return checked(spark.table(name), size)


def payloads(points: DataFrame, vector: str = "embedding", text: str = "text") -> DataFrame:
    """Everything but the vectors, which aren't read, of points that have a payload."""
    return points.drop(vector).where(F.coalesce(F.col(text), F.lit("")) != "")


def size_of(spark: SparkSession, name: str) -> int:
    """How many points a collection has; none if it doesn't exist."""
    return spark.table(name).count() if spark.catalog.tableExists(name) else 0


def dropped(spark: SparkSession, name: str) -> bool:
    """Drops a collection; was there one?"""
    there = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return there


def readiness(points: DataFrame, ingesting: bool = False, model: str = "embedding_model") -> DataFrame:
    """(state, model): ingesting, empty, failed (no model or several) or ready."""
    found = points.agg(F.count("*").alias("n"), F.count_distinct(model).alias("models"), F.min(model).alias("model"))
    state = F.when(F.lit(ingesting), "ingesting").when(F.col("n") == 0, "empty").when(F.col("models") != 1, "failed").otherwise("ready")
    return found.select(state.alias("state"), F.when(state == "ready", F.col("model")).alias("model"))


def clamped(value: Column, low: float, high: float) -> Column:
    """An option of a request within the bounds that production sets."""
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
