"""A folder of objects kept as chunks: what is new or changed is read, what is gone is deleted, all else stays as it is.

Each run goes on until nothing is left to do, as a stream with an AvailableNow trigger would, but it also sees objects that changed
or went, which a file stream doesn't. The state is two keyed tables: objects (path, modified, length) and chunks. Objects go in
blocks of at most BLOCK. A block's chunks are merged first, its objects then, so a run that dies in between does that block
again, to the same result, and the blocks before it count. Spark doesn't list empty files: an object that became empty counts as
gone, as it has no chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siftstone.operators.indexing import prepared
from siftstone.sources import tables, versions

BLOCK = 10_000
OBJECTS, CHUNKS = ["path"], ["chunk_id"]


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of all objects in a folder and below; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def text_chunks(objects: DataFrame, **how) -> DataFrame:
    """Chunks of objects (path, content) that are UTF-8 texts, after indexing.prepared; a chunk's id is its object's path and place."""
    docs = objects.select(F.col("path").alias("source_id"), F.decode("content", "UTF-8").alias("text"))
    chunks = prepared(docs, **how)
    return chunks.select(F.concat_ws("#", "source_id", F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("source_id").alias("path"), "chunk_index", "text")


def _blocks(rows: DataFrame, size: int) -> Iterator[list[Row]]:
    block: list[Row] = []
    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def ingest(spark: SparkSession, folder: str, state: str, chunk: Callable[[DataFrame], DataFrame] = text_chunks, block: int = BLOCK, before_objects: Callable[[], None] | None = None) -> dict[str, int]:
    """Brings the chunks below state to what folder holds, and says how many objects were read and how many are gone.

    chunk makes chunks (chunk_id, path, and what else) of objects (path, content). before_objects is called between a block's
    two merges, for tests.
    """
    objects, chunks = f"{state}/objects", f"{state}/chunks"
    now = listed(spark, folder) if versions.listed(spark, folder) else spark.createDataFrame([], "path string, modified timestamp, length long")
    known = versions.read(spark, objects)[0] > 0
    old = tables.table(spark, objects) if known else now.limit(0)
    changed = now.join(old, ["path", "modified", "length"], "left_anti").withColumn("gone", F.lit(False))
    lost = old.join(now, "path", "left_anti").withColumn("gone", F.lit(True))
    done = {"read": 0, "gone": 0}
    for rows in _blocks(changed.unionByName(lost), block):
        paths = [r["path"] for r in rows if not r["gone"]]
        touched = spark.createDataFrame(rows, "path string, modified timestamp, length long, gone boolean")
        new = chunk(spark.read.format("binaryFile").load(paths).select("path", "content")).withColumn("_at", F.lit(1)) if paths else None
        before = None
        if versions.read(spark, chunks)[0]:
            # All chunks that touched objects had go, unless they come again.
            before = tables.table(spark, chunks).join(F.broadcast(touched.select("path")), "path", "left_semi").withColumn("_at", F.lit(0))
        every = new if before is None else before if new is None else new.unionByName(before, allowMissingColumns=True)
        if every is not None:
            tables.merge(every, chunks, CHUNKS, F.col("_at") == 0, [F.col("_at").desc()])
        if before_objects:
            before_objects()
        tables.merge(touched, objects, OBJECTS, F.col("gone"))
        done = {"read": done["read"] + len(paths), "gone": done["gone"] + len(rows) - len(paths)}
    return done
