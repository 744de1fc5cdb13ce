"""Keyword, vector and hybrid retrieval, and expansion to neighbouring chunks.

Queries are a small table next to the corpus; a search takes all of them at once. Every top-k keeps ties in a stated order.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.functions.text import let, tokens
from siftstone.session import written

K1, B = 1.5, 0.75


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).where("_at = 1").drop("_at")


def top(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their ranks from 1 on; Spark cuts each task's rows to k before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: joined by a shuffle on both sides, never sent through the driver.

    Spark guesses a side's size by that of the files that it is made of; exploded and computed columns can be many times that.
    """
    return df.hint("merge")


def postings(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, length) of the documents that have tokens."""
    read = corpus.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tokens")).where(F.size("tokens") > 0)
    return read.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def statistics(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: number of documents that have tokens, and their mean length, 1 at least."""
    size = F.size(tokens(F.col(text_col)))
    return corpus.select(size.alias("n")).where("n > 0").agg(F.count("*").alias("n_docs"), F.greatest(F.coalesce(F.avg("n"), F.lit(0.0)), F.lit(1.0)).alias("mean_length"))


#: Words of queries that are sent to all tasks; more are joined as Spark likes.
QUERY_WORDS = 1_000_000


def _few(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows, one per word of a query, sent to all tasks if there are few of them, whatever size Spark takes them for."""
    return F.broadcast(rows) if asked.limit(QUERY_WORDS + 1).count() <= QUERY_WORDS else rows


def with_rows(hits: DataFrame, corpus: DataFrame, key: str = "id") -> DataFrame:
    """hits with their rows of the corpus: hits are found once and, if they are few, sent to all tasks, so that texts are neither moved nor sorted to meet them."""
    kept = written(hits)
    return corpus.join(_few(kept, kept), key)


def bm25(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str, id_col: str, text_col: str, k: int = 3) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each query by BM25; repeated query terms count again, scores of 0 don't.

    Texts are read and cut once. Besides its words each document that has any counts as a posting of the empty word, so one
    aggregate over terms gives document frequencies, the number of documents and their mean length. Only postings of words
    that some query has are shuffled and kept; queries are expected to be far fewer than documents, and Spark sends them to all
    tasks if they are small enough.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # A range is a table whose size Spark knows; rows from Python would count as huge, and all words of the corpus be shuffled to meet them.
    wanted = asked.select("term").distinct().unionByName(queries.sparkSession.range(1).select(F.lit("").alias("term")))
    read = corpus.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tokens")).select("id", F.size("tokens").alias("length"), F.explode(F.when(F.size("tokens") > 0, F.array_append("tokens", F.lit("")))).alias("term"))
    # Kept as a table: filters on words would go down to the texts otherwise, and each of the three uses read and cut them for itself.
    found = written(read.join(wanted, "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length")))
    per = found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum("length").alias("total"))
    # One row of two numbers.
    all_ = F.broadcast(per.where("term = '' AND cf > 0").select(F.col("df").alias("n_docs"), F.greatest(F.col("total") / F.col("df"), F.lit(1.0)).alias("mean_length")))
    weighed = asked.join(per.where("term <> '' AND cf > 0 AND total > 0"), "term").crossJoin(all_).withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighed = weighed.select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"), "mean_length")
    tf = F.col("tf")
    part = F.col("weight") * tf * (K1 + 1) / F.greatest(tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")), F.lit(1e-9))
    # Dealt by document, the postings meet the queries' words where their sums are made: what doesn't move are the scores of all pairs.
    meets = found.where("term <> ''").repartition("id").join(_few(weighed, asked), "term")
    scored = meets.groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")
    return top(scored, ["query_id"], [F.round("score", 9).desc(), F.col("id")], k).select("query_id", "id", "score", "rank")


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


#: Bytes of query vectors that are sent to all tasks at a time.
QUERY_BYTES = 64 << 20


def dense(queries: DataFrame, corpus: DataFrame, query_id: str, query_vector: str, id_col: str, vector_col: str, k: int = 3) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors of each query by cosine.

    A stated set of queries against all rows: vectors are brought to length 1 once, each task meets a block of queries of at
    most about QUERY_BYTES as products of matrices (where ids are whole numbers), and only k rows per query leave it. More queries go in several blocks, whose results are joined.
    """
    unit = lambda v: let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))
    asked = queries.select(F.col(query_id).alias("query_id"), unit(F.col(query_vector)).alias("q"))
    rows = corpus.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("v"))
    size = queries.agg(F.sum(8 * F.size(query_vector)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // QUERY_BYTES))

    whole = all(isinstance(df.schema[0].dataType, T.IntegralType) for df in (asked, rows))

    def block(i: int) -> DataFrame:
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else asked
        if whole:
            scored = rows.where("v IS NOT NULL").mapInArrow(_nearest(own.where("q IS NOT NULL").toArrow(), k), T.StructType([asked.schema["query_id"], rows.schema["id"], T.StructField("score", T.DoubleType())]))
        else:
            scored = rows.join(F.broadcast(own), F.size("q") == F.size("v")).select("query_id", "id", F.coalesce(F.nanvl(dot(F.col("q"), F.col("v")), F.lit(0.0)), F.lit(0.0)).alias("score"))
        return top(scored, ["query_id"], [F.round("score", 9).desc(), F.col("id")], k)

    return reduce(DataFrame.unionByName, map(block, range(blocks)))


#: Rows and queries whose products a task holds at a time.
DENSE_ROWS, DENSE_QUERIES = 4096, 1024
_NONE = np.iinfo(np.int64).min


def _by_size(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors their places and a matrix of them."""
    size, flat = pc.list_value_length(vectors).to_numpy(zero_copy_only=False), pc.fill_null(vectors.flatten(), 0.0).to_numpy(zero_copy_only=False)
    start = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
    at = {int(n): np.flatnonzero(size == n) for n in np.unique(size)}
    return {n: (places, flat[start[places][:, None] + np.arange(n)].reshape(len(places), n)) for n, places in at.items()}


def _nearest(asked: pa.Table, k: int):
    """Batches (id, v) into the k nearest rows of each query (query_id, q) that the task has: products of matrices, ties to the smallest id. Ids are whole numbers; a null one comes first."""
    asked = asked.combine_chunks()
    names, sizes = asked["query_id"], _by_size(asked["q"].combine_chunks()) if asked.num_rows else {}

    def run(batches):
        best = {n: (np.full((len(at), k), -np.inf), np.zeros((len(at), k), np.int64)) for n, (at, _) in sizes.items()}
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            ids = pc.fill_null(batch.column(0).cast(pa.int64()), _NONE).to_numpy(zero_copy_only=False)
            for n, (place, rows) in _by_size(batch.column(1)).items():
                if n not in sizes:
                    continue
                order = np.argsort(ids[place], kind="stable")
                rows, own, queries = rows[order], ids[place][order], sizes[n][1]
                score, kept = best[n]
                for r in range(0, len(rows), DENSE_ROWS):
                    for q in range(0, len(queries), DENSE_QUERIES):
                        near = np.nan_to_num(queries[q : q + DENSE_QUERIES] @ rows[r : r + DENSE_ROWS].T, nan=0.0, posinf=np.inf, neginf=-np.inf)
                        place_ = np.arange(len(near))
                        shown, found, ours = np.round(near, 9), [], min(k, near.shape[1])
                        for _ in range(ours):
                            # The first of equal ones has the smallest id.
                            top_ = shown.argmax(axis=1)
                            found.append((near[place_, top_], own[r + top_]))
                            shown[place_, top_] = -np.inf
                        both = np.c_[score[q : q + len(near)], np.stack([x for x, _ in found], axis=1)]
                        which = np.c_[kept[q : q + len(near)], np.stack([x for _, x in found], axis=1)]
                        first = np.lexsort((which, -np.round(both, 9)), axis=1)[:, :k]
                        score[q : q + len(near)], kept[q : q + len(near)] = np.take_along_axis(both, first, 1), np.take_along_axis(which, first, 1)
        for n, (at, _) in sizes.items():
            score, kept = best[n]
            for q in range(0, len(at), DENSE_ROWS):
                there = np.isfinite(score[q : q + DENSE_ROWS]) | (score[q : q + DENSE_ROWS] == np.inf)
                query, values, found = np.repeat(at[q : q + DENSE_ROWS], there.sum(axis=1)), score[q : q + DENSE_ROWS][there], kept[q : q + DENSE_ROWS][there]
                if len(query):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(query)).combine_chunks(), pa.array(found, mask=found == _NONE).cast(kind), pa.array(values)], names=["query_id", "id", "score"])

    return run


def normalised(hits: DataFrame) -> DataFrame:
    """Hits (query_id, id, score, ...) with scores from 0 to 1 per query; if all are equal, 1. A largest score of exactly 0 counts as 1. Of repeated ids the last one counts, by `rank`."""
    per = Window.partitionBy("query_id")
    high = F.max("score").over(per)
    high, low = F.when(high == 0, 1.0).otherwise(high), F.min("score").over(per)
    scaled = F.when(high == low, 1.0).otherwise((F.col("score") - low) / F.greatest(high - low, F.lit(1e-9)))
    return first_of(hits.withColumn("score", scaled), ["query_id", "id"], [F.col("rank").desc()])


def fused(dense_hits: DataFrame, sparse_hits: DataFrame, limit: int = 3, dense_weight: float = 0.65, sparse_weight: float = 0.35) -> DataFrame:
    """(query_id, id, score, dense_score, sparse_score, rank): weighted sums of both normalised scores; ties go by dense, then by sparse rank."""
    a = normalised(dense_hits).select("query_id", "id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    b = normalised(sparse_hits).select("query_id", "id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    both = a.join(b, ["query_id", "id"], "full_outer").fillna(0.0, ["dense_score", "sparse_score"])
    both = both.withColumn("score", dense_weight * F.col("dense_score") + sparse_weight * F.col("sparse_score"))
    order = [F.round("score", 9).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last()]
    return top(both, ["query_id"], order, limit).select("query_id", "id", "score", "dense_score", "sparse_score", "rank")


def candidates(limit: int) -> int:
    """How many hits each side brings to the fusion."""
    return max(4 * limit, 10)


def neighbours(ranked: DataFrame, corpus: DataFrame, queries: DataFrame, extra: int = 2) -> DataFrame:
    """Chunks beside the ranked ones that share words with the query or the chunk: (query_id, id, anchor, relation, score, added).

    ranked (query_id, id, rank); corpus (id, source_id, chunk_index, text); queries (query_id, text). A neighbour scores
    three for each word of the query, one for each of the anchor and one if the index is the next; those without score, and
    those that are ranked already, are left out. At least one is added per query if there is any.
    """
    line = Window.partitionBy("source_id").orderBy(F.coalesce("chunk_index", F.lit(0)), "id")
    # Only ids move with the window; texts are fetched for the few chosen.
    placed = corpus.select("id", "source_id", "chunk_index").withColumns({"prev": F.lag(F.struct("id", "chunk_index")).over(line), "next": F.lead(F.struct("id", "chunk_index")).over(line)})
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.lit(n).alias("relation"), F.col(f"{n}.id").alias("candidate"), F.col(f"{n}.chunk_index").alias("at")) for i, n in enumerate(("prev", "next"))))
    edges = ranked.select("query_id", "id", "rank").join(placed, "id").select("query_id", F.col("id").alias("anchor"), "rank", "chunk_index", F.explode(sides).alias("e")).where("e.candidate IS NOT NULL")
    edges = edges.withColumn("id", F.col("e.candidate"))
    # Only texts of the few chosen are read into words.
    chosen = edges.select(F.explode(F.array("anchor", "id")).alias("id")).distinct()
    texts = corpus.select("id", "text").join(chosen, "id", "left_semi").select("id", F.array_distinct(tokens(F.col("text"))).alias("words"))
    edges = edges.join(texts.withColumnsRenamed({"id": "anchor", "words": "anchor_words"}), "anchor")
    edges = edges.join(texts, "id").join(queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("query_words")), "query_id")
    near = (F.abs(F.coalesce("chunk_index", F.lit(0)) - F.coalesce("e.at", F.lit(0))) == 1).cast("int")
    score = 3 * F.size(F.array_intersect("query_words", "words")) + F.size(F.array_intersect("anchor_words", "words")) + near
    edges = edges.select("query_id", "id", "anchor", "rank", F.col("e.side").alias("side"), F.col("e.relation").alias("relation"), score.alias("score")).where("score > 0")
    edges = edges.join(ranked.select("query_id", "id"), ["query_id", "id"], "left_anti")
    order = [F.col("score").desc(), F.col("rank"), F.col("side")]
    return top(first_of(edges, ["query_id", "id"], order), ["query_id"], order, max(1, extra), "added").select("query_id", "id", "anchor", "relation", "score", "added")


def contexts(payloads: DataFrame) -> DataFrame:
    """Payloads (chunk_id, source_id, title, text, ...) with `id` and the defaults of a retrieved context; empty counts as missing."""
    or_ = lambda *cols: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cols))
    return payloads.withColumns({"id": F.coalesce(or_("chunk_id", "source_id"), F.lit("unknown")), "title": F.coalesce(or_("title"), F.lit("Untitled")), "snippet": F.coalesce("text", F.lit(""))})


def distinct_contexts(items: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first of equal contexts (source_id, chunk_id, snippet) within keys, in a stated order; null equals null."""
    return first_of(items, [*keys, "source_id", "chunk_id", "snippet"], order)


def until_sufficient(hits: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """Contexts of a request's queries up to the first one whose contexts so far suffice, each context once.

    hits (request_id, query_index, rank, and keys that identify a context); judged (request_id, query_index, sufficient).
    All queries are run; which of them count is decided afterwards, so no request waits for its own last query.
    """
    stop = judged.where("sufficient").groupBy("request_id").agg(F.min("query_index").alias("_stop"))
    kept = hits.join(stop, "request_id", "left").where(F.col("_stop").isNull() | (F.col("query_index") <= F.col("_stop"))).drop("_stop")
    return first_of(kept, ["request_id", *keys], [F.col("query_index"), F.col("rank")])
