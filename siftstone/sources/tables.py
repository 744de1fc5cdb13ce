"""Tables with keys on plain files: merges rewrite only the buckets that they touch, and come in once.

Rows are dealt into buckets by a hash of their key. A version (see versions) names, for each bucket, the folder that holds it. A
merge stages its changes, so they are computed once; joins the touched buckets' old rows with them, writes those
buckets anew, and commits. Where another writer committed meanwhile, it goes on from there if other buckets were touched, and
ends with Conflict if not. A writer that names itself and numbers its batches, as a stream does, has its last number in
the version: a batch that comes again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.operators.retrieval import first_of

from . import versions

BUCKETS = 64
_BUCKET, _GONE = "_bucket", "_gone"


def table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one unless it is stated."""
    number, content = versions.read(spark, path, version)
    if not number:
        raise ValueError(f"no table at {path}")
    return _rows(spark, path, content, None)


def _rows(spark: SparkSession, path: str, content: dict, buckets: list[int] | None) -> DataFrame:
    schema = T.StructType.fromJson(content["schema"])
    folders = [f"{path}/data/{folder}/{_BUCKET}={b}" for b, folder in content["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge(
    changes: DataFrame, path: str, keys: list[str], deleted: Column | None = None, order: list | None = None, writer: str | None = None, batch: int = 0, buckets: int = BUCKETS, before_commit: Callable[[], None] | None = None
) -> int:
    """The table at path with changes in place of rows with the same keys, or without them where `deleted` holds; gives the version that has them.

    Of changes that share a key the first one in order counts, or any one if no order is stated. Columns that only one side has are
    null on the other. Null keys are keys like others. before_commit is called when the files are there, for tests.
    """
    spark = changes.sparkSession
    number, content = versions.read(spark, path)
    if writer and content.get("writers", {}).get(writer, -1) >= batch:
        return number
    n = content.get("buckets", buckets)
    rows = changes.withColumn(_GONE, F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False))
    rows = first_of(rows, keys, order) if order else rows.dropDuplicates(keys)
    staging = f"{path}/data/{uuid.uuid4().hex}"
    rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")).write.parquet(staging)
    staged = spark.read.parquet(staging)
    # At most a row for each bucket.
    touched = sorted(r[0] for r in staged.select(_BUCKET).distinct().collect())
    while True:
        new = staged.where(~F.col(_GONE)).drop(_GONE)
        if number:
            old = _rows(spark, path, content, touched).withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
            same = [old[k].eqNullSafe(staged[k]) for k in keys]
            new = old.join(staged, same, "left_anti").unionByName(new, allowMissingColumns=True)
        folder = uuid.uuid4().hex
        new.repartition(max(1, len(touched)), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/data/{folder}")
        full = {x.split("=")[1] for x in versions.listed(spark, f"{path}/data/{folder}") if x.startswith(_BUCKET)}
        folders = {b: f for b, f in content.get("folders", {}).items() if int(b) not in touched} | dict.fromkeys(full, folder)
        writers = content.get("writers", {}) | ({writer: batch} if writer else {})
        after = {"schema": new.drop(_BUCKET).schema.jsonValue(), "keys": keys, "buckets": n, "folders": folders, "writers": writers}
        if before_commit:
            before_commit()
        try:
            return versions.commit(spark, path, number, after)
        except versions.Conflict:
            seen = content
            number, content = versions.read(spark, path)
            if writer and content["writers"].get(writer, -1) >= batch:
                return number
            if content["buckets"] != n or any(seen.get("folders", {}).get(str(b)) != content["folders"].get(str(b)) for b in touched):
                raise


def sink(path: str, keys: list[str], writer: str, deleted: Column | None = None, order: list | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls to have a stream's batches merged, each once."""

    def put(rows: DataFrame, batch: int) -> None:
        merge(rows, path, keys, deleted, order, writer, batch, buckets)

    return put


def swept(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes versions before the last `keep`, and files that only they or writers that died had; not while a writer is at work."""
    named: set[str] = set()
    for n in versions.numbers(spark, path)[-keep:]:
        named |= set(versions.read(spark, path, n)[1]["folders"].values())
    return versions.swept(spark, path, named, keep)
