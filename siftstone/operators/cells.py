"""Approximate vector search: an inverted file of cells around centroids, with short codes of the vectors.

k-means on a bounded sample gives the centroids. Every vector, brought to length 1, is stored in the cell of its nearest centroid,
as a directory of its own, with a code of four bits a dimension. A query probes the cells whose centroids are nearest to it, or
all. Cells that no query probes aren't read. With `wide`, a first scan reads codes alone, a sixteenth of the vectors' bytes, and
leaves that many candidates a query, whose vectors are then compared exactly; without it, and with all cells, the answer is
exact. Scans are matrix products of batches with the queries that probe their cell, and only so many rows a query leave a task.
Vectors don't move, so a cell of any size is as many tasks as it has splits. Where vectors form groups, few cells are enough;
where they don't, as random ones, all cells have to be probed, and codes are what saves work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import dot, top

SAMPLE, MOST_CELLS = 100_000, 4096
#: Bytes of query vectors that are sent to all tasks at a time.
QUERY_BYTES = 8 << 20
#: Codes go from 1 to 2 * LEVELS + 1, with LEVELS + 1 for zero; two make a byte.
LEVELS = 7


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """A batch's vectors as rows; each has to have the size of the index."""
    if len(column) and (column.null_count or not (column.value_lengths().to_numpy() == size).all()):
        raise ValueError(f"a vector has not {size} dimensions")
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), size)


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of vectors as bytes, a row each, and the size of a step of each."""
    step = np.abs(unit).max(axis=1, initial=0.0, keepdims=True) / LEVELS
    level = np.rint(np.divide(unit, step, out=np.zeros_like(unit), where=step > 0)).astype(np.int8) + (LEVELS + 1)
    if level.shape[1] % 2:
        level = np.pad(level, ((0, 0), (0, 1)), constant_values=LEVELS + 1)
    return (level[:, ::2] << 4 | level[:, 1::2]).astype(np.uint8), step[:, 0].astype(np.float32)


def decoded(codes: np.ndarray, step: np.ndarray, size: int) -> np.ndarray:
    level = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, :size]
    return (level.astype(np.float32) - (LEVELS + 1)) * step[:, None]


def fitted(points: DataFrame, vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """Centroids by k-means on a sample of about that many vectors; by default as many as the root of all vectors, at most MOST_CELLS."""
    n = points.count()
    if not n:
        raise ValueError("there are no vectors")
    cells = cells or min(MOST_CELLS, max(1, math.isqrt(n)))
    part = points.sample(min(1.0, sample / n), seed) if n > sample else points
    if cells == 1:
        return np.zeros((1, points.select(F.size(vector)).first()[0]))
    rows = part.where(F.exists(vector, lambda x: x != 0)).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(rows)
    return np.array(model.clusterCenters())


def stored(points: DataFrame, path: str, centroids: np.ndarray, id_col: str = "vec_id", vector: str = "embedding") -> None:
    """Writes points (id, vector) as a file of cells; the centroids with them."""
    spark = points.sparkSession
    sent = spark.sparkContext.broadcast(_unit(centroids))
    size = centroids.shape[1]

    def assign(batches):
        for batch in batches:
            unit = _unit(_matrix(batch.column(1), size))
            cell = np.argmax(unit @ sent.value.T, axis=1).astype(np.int32)
            codes, step = coded(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, size, dtype=np.int32)), pa.array(unit.ravel())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step), pa.array(cell)], names=["id", "unit", "code", "step", "cell"])

    kind = points.schema[id_col].dataType.simpleString()
    rows = points.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInArrow(assign, f"id {kind}, unit array<double>, code binary, step float, cell int")
    # Rows of a cell go to a few tasks by their ids, so that a cell with most vectors isn't one task's.
    rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(8))).repartition("cell", "part").drop("part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centroids)], "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")


def search(queries: DataFrame, path: str, query_id: str, query_vector: str, k: int = 3, probes: int | None = None, wide: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors by cosine among those of each query's `probes` nearest cells, or of all cells if it is None.

    With wide, only that many candidates by their codes are compared exactly. Queries go in blocks of at most about
    QUERY_BYTES, each sent to all tasks. Without a length, a vector is at 0 to any other.
    """
    spark = queries.sparkSession
    # As many rows as there are cells, at most MOST_CELLS unless more were asked for.
    centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])
    size, near = centroids.shape[1], _unit(centroids)
    total = queries.agg(F.sum(8 * F.size(query_vector)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // QUERY_BYTES))
    kind = queries.schema[query_id].dataType.simpleString()
    cells = spark.read.parquet(f"{path}/cells")
    id_kind = cells.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"query_id {kind}, id {id_kind}, score double, rank int")
    for block in range(blocks):
        own = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("v")).where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        ids, unit = own.column("query_id").to_pylist(), _unit(np.concatenate([_matrix(c, size) for c in own.column("v").chunks]))
        asked = np.zeros((len(unit), len(near)), dtype=bool)
        if probes is None or probes >= len(near):
            asked[:] = True
        else:
            np.put_along_axis(asked, np.argpartition(-(unit @ near.T), probes - 1, axis=1)[:, :probes], True, axis=1)
        probed = cells.where(F.col("cell").isin(np.flatnonzero(asked.any(axis=0)).tolist()))
        found = _scanned(probed, ids, unit, asked, wide or k, wide is not None, own.schema.field("query_id").type, f"query_id {kind}, id {id_kind}, score double")
        if wide is not None:
            # At most wide rows a query of the block; their vectors are compared exactly.
            some = top(found, ["query_id"], [F.col("score").desc(), F.col("id")], wide).select("query_id", F.col("id").alias("of"))
            vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, unit, strict=True)], f"query_id {kind}, q array<double>")
            rows = probed.select("id", "unit").join(F.broadcast(some), F.col("id").eqNullSafe(F.col("of"))).join(F.broadcast(vectors), "query_id")
            found = rows.select("query_id", "id", F.round(dot(F.col("q"), F.col("unit")), 9).alias("score"))
        out = out.unionByName(top(found, ["query_id"], [F.col("score").desc(), F.col("id")], k))
    return out


def _scanned(rows: DataFrame, ids: list, unit: np.ndarray, asked: np.ndarray, k: int, codes: bool, query_type: pa.DataType, schema: str) -> DataFrame:
    """(query_id, id, score): of each task the k best rows a query, among the cells that the query asked for; by codes or by vectors."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, unit, asked))
    size = unit.shape[1]

    def scan(batches):
        ids, unit, asked = sent.value
        best: list[list[tuple]] = [[] for _ in ids]
        id_type = pa.null()
        for batch in batches:
            id_type = batch.schema.field(0).type
            names, cell = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            if codes:
                raw = b"".join(batch.column(2).to_pylist())
                matrix = decoded(np.frombuffer(raw, np.uint8).reshape(batch.num_rows, -1), batch.column(3).to_numpy(), size)
            else:
                matrix = _matrix(batch.column(2), size)
            for c in np.unique(cell).tolist():
                at, q = np.flatnonzero(cell == c), np.flatnonzero(asked[:, c])
                scores = np.round(unit[q] @ matrix[at].T, 9)
                for n, i in enumerate(q.tolist()):
                    # All that tie with the k-th stay until ids decide.
                    least = np.partition(scores[n], len(at) - k)[len(at) - k] if len(at) > k else -np.inf
                    some = np.flatnonzero(scores[n] >= max(least, -best[i][-1][0] if len(best[i]) == k else -np.inf))
                    best[i] = sorted([*best[i], *((-scores[n][j], names[at[j]]) for j in some.tolist())], key=lambda x: (x[0], x[1] is None, x[1]))[:k]
        found = [(ids[i], name, -score) for i, own in enumerate(best) for score, name in own]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [query_type, id_type, pa.float64()], strict=True)], names=["query_id", "id", "score"])

    return rows.select("id", "cell", *(["code", "step"] if codes else ["unit"])).mapInArrow(scan, schema)


def pairs(queries: DataFrame, path: str, query_vector: str, probes: int) -> float:
    """The share of all pairs of queries and vectors that a search with so many probes compares."""
    spark = queries.sparkSession
    sizes = {r["cell"]: r["count"] for r in spark.read.parquet(f"{path}/cells").groupBy("cell").count().collect()}
    near = _unit(np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()]))
    sent = spark.sparkContext.broadcast((near, np.array([sizes.get(i, 0) for i in range(len(near))])))

    def count(batches):
        near, size = sent.value
        for batch in batches:
            scores = _unit(_matrix(batch.column(0), near.shape[1])) @ near.T
            probed = np.argpartition(-scores, min(probes, len(near)) - 1, axis=1)[:, :probes]
            yield pa.RecordBatch.from_arrays([pa.array([int(size[probed].sum())]), pa.array([len(scores)])], names=["compared", "queries"])

    r = queries.select(query_vector).mapInArrow(count, "compared long, queries long").agg(F.sum("compared").alias("c"), F.sum("queries").alias("q")).first()
    return r["c"] / max(1, r["q"] * sum(sizes.values())) if r["q"] else 0.0


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits (query_id, id) that were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
