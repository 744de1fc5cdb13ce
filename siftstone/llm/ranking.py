"""Ranked lexical search: the best k documents of every query, by MaxScore over shards of an inverted index.

Terms are runs of letters and digits, A-Z lower-cased; bytes from 128 on are letters. A document's score is the sum, over the
query's terms, of weight times impact, in whole numbers: a term's weight falls with the number of documents that hold it,
its impact in a document grows with its count there and falls with the document's length.

The texts are read once per block of queries, which becomes a table of postings: of each document its length, and the counts of
those terms that a query of the block has. Corpus statistics are sums over that table. Then each batch of documents is a shard:
its postings are put in order of terms, and a list's upper bound is the weight times the largest impact in it. For each
query, lists are in order of bounds. Those first ones whose bounds together stay below the k-th best score so far are
non-essential: a document that has none of the others can't qualify. The documents of the essential lists are summed up; then
the non-essential lists are probed from the largest bound down, only for documents that still reach the threshold with all
that is left. Thresholds go on from shard to shard within a task, and each task hands on k documents a query at most, which are merged
in two steps.

A block has queries of at most QUERY_BYTES together (one query at least); its terms and weights are sent to all tasks.

Defined cases: a null or empty text, and one without a term, has no score and doesn't count as a document; texts of any
length are read whole; queries that share an id are one query with the terms of all; a query without an id is one with a null
id, one without terms has no rows; scores of 0 are left out; equal scores are in order of ids, null ids last; rows that
repeat an id are ranked each for itself; empty tables give no rows. Only ids and texts are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import MAX_ID, per_batch, released, releasing, small_batches, table, written
from .textcols import LOWER, Lookup, buffers, slices, word_hashes, words

TOP = 10
QUERY_BYTES = 4 << 20
#: Tasks over which the first step of the merge deals the rows of one query.
MERGE_SALTS = 64

INSIDE = np.zeros(256, dtype=bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the number of terms before each text and in all."""
    data, offsets = buffers(texts)
    hashes, before = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in slices(offsets):
        low = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, ahead = words(low, offsets[i : j + 1] - offsets[i], INSIDE)
        hashes.append(word_hashes(low, starts, ends))
        before.append(ahead[1:] + before[-1][-1])
    return np.concatenate(hashes), np.concatenate(before)


class Queries:
    """The queries of a block: their ids, and of each its terms as numbers of the block's vocabulary."""

    def __init__(self, rows: list):
        self.ids = list(dict.fromkeys(r.id for r in rows))
        number = {x: n for n, x in enumerate(self.ids)}
        hashes, before = terms(pa.array([r.text for r in rows], pa.string()))
        query = np.repeat([number[r.id] for r in rows], np.diff(before)).astype(np.int64)
        self.vocabulary, place = np.unique(hashes, return_inverse=True)
        pairs = np.unique(query * max(1, len(self.vocabulary)) + place) if len(hashes) else np.zeros(0, np.int64)
        self.query, self.term = np.divmod(pairs, max(1, len(self.vocabulary)))
        self.lists = np.searchsorted(self.query, np.arange(len(self.ids) + 1))


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, counts) of docs (doc_id, text) that have a term at all: n counts all of them, the lists have those of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        lookup, size = Lookup(sent.value), max(1, len(sent.value))

        def work(batch):
            hashes, before = terms(batch.column(1))
            number = np.diff(before)
            found = lookup.find(hashes).astype(np.int64)
            known = np.flatnonzero(found >= 0)
            text = np.searchsorted(before, known, "right") - 1
            pairs, counts = np.unique(text * size + found[known], return_counts=True)
            row, term = np.divmod(pairs, size)
            some = np.flatnonzero(number > 0)
            at = np.r_[np.searchsorted(row, some), len(row)].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(t))) for x, t in ((term, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(number[some]), *lists], names=["doc_id", "n", "terms", "counts"])

        return work

    return per_batch(docs, make, "doc_id long, n long, terms array<int>, counts array<long>")


class Shard:
    """The inverted lists of some documents: per term its documents in order, their impacts, and the list's upper bound."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, count: np.ndarray, weights: np.ndarray, documents: int, length: int):
        order = np.argsort(term, kind="stable")
        self.size = len(n)
        self.doc = np.repeat(np.arange(len(n)), sizes)[order]
        tf, m = count[order], 10 + 90 * n * documents // max(1, length)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.doc])
        self.lists = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.bound = np.zeros(len(weights), np.int64)
        full = np.flatnonzero(self.lists[1:] > self.lists[:-1])
        if len(full):
            self.bound[full] = weights[full] * np.maximum.reduceat(self.impact, self.lists[full])
        self.weights = weights

    def best(self, query: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all whose score reaches the threshold, by MaxScore."""
        query = query[self.bound[query] > 0]
        query = query[np.argsort(self.bound[query], kind="stable")]
        reach = np.cumsum(self.bound[query])
        first = int(np.searchsorted(reach, threshold))  # lists before it are non-essential
        score = np.zeros(self.size, np.int64)
        for t in query[first:]:
            s, e = self.lists[t], self.lists[t + 1]
            score[self.doc[s:e]] += self.weights[t] * self.impact[s:e]
        doc = np.flatnonzero(score)
        score = score[doc]
        for k in range(first - 1, -1, -1):
            able = score + reach[k] >= threshold
            doc, score = doc[able], score[able]
            if not len(doc):
                break
            t = query[k]
            s, e = self.lists[t], self.lists[t + 1]
            at = np.minimum(np.searchsorted(self.doc[s:e], doc), e - s - 1) + s
            score = score + np.where(self.doc[at] == doc, self.weights[t] * self.impact[at], 0)
        good = score >= threshold
        return doc[good], score[good]


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _searched(found: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(query, doc_id, score): of each task at most k documents a query."""
    total = found.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    documents, length = total["documents"], total["length"] or 0
    # At most a row for each term of the block.
    df = np.zeros(len(queries.vocabulary), np.int64)
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weights = np.array([weight(documents, x) for x in df.tolist()], np.int64)
    sent = found.sparkSession.sparkContext.broadcast((weights, queries.term, queries.lists))
    small_batches(found.sparkSession)

    def run(batches):
        weights, term, lists = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (len(lists) - 1)
        for batch in batches:
            ids = batch.column(0).fill_null(MAX_ID).to_numpy()
            shard = Shard(batch.column(1).to_numpy(), batch.column(2).value_lengths().to_numpy(), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy(), weights, documents, length)
            for q in range(len(lists) - 1):
                own, scores = best[q]
                doc, score = shard.best(term[lists[q] : lists[q + 1]], int(scores[-1]) if len(scores) == k else 1)
                if len(doc):
                    own, scores = np.r_[own, ids[doc]], np.r_[scores, score]
                    first = np.lexsort((own, -scores))[:k]
                    best[q] = own[first], scores[first]
        sizes = [len(x) for x, _ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)), *(pa.array(np.concatenate(x)) for x in zip(*best, strict=True))], names=["query", "doc_id", "score"])

    return found.mapInArrow(releasing(run), "query int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / query_bytes))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        queries = Queries(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect())
        if not len(queries.vocabulary):
            continue
        found = _searched(written(postings(texts, queries.vocabulary)), queries, k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item_id {kind}")
        order = [F.col("score").desc(), F.col("doc_id")]
        some = found.withColumn("salt", F.spark_partition_id() % MERGE_SALTS)
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= k)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        out = out.unionByName(ranked.join(F.broadcast(names), "query").select("item_id", "rank", F.nullif("doc_id", F.lit(MAX_ID)).alias("doc_id"), "score"))
    released()
    return out


def op11(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best of all of `documents` for each item of `benchmark`."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same by the definition, over all postings.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, any_value(n) AS n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
