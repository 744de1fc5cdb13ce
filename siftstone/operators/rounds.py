"""Searches in rounds: a request asks its next query only while what it has found doesn't suffice."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.session import written

from . import postings
from .guidance import judged_contexts, ranked_contexts
from .retrieval import first_of, with_rows

#: What makes a context the same as another one of its request; null equals null.
KEY = ["source_id", "chunk_id", "snippet"]
#: Ranks of one round stay below this, so a round and a rank make one number.
_ROUND = 1 << 32
_ALL = (1 << 31) - 1

Search = Callable[[DataFrame], DataFrame]


def _once(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """The first row of each context, without those that the request has already."""
    rows = first_of(rows, ["query_id", *KEY], [F.col("ord")])
    if before is None:
        return rows
    old = before.select("query_id", *KEY).withColumnsRenamed({c: f"_{c}" for c in ["query_id", *KEY]})
    same = reduce(Column.__and__, (rows[c].eqNullSafe(old[f"_{c}"]) for c in ["query_id", *KEY]))
    return rows.join(old, same, "left_anti")


def answered(requests: DataFrame, queries: DataFrame, search: Search, given: DataFrame | None = None, least: int = 3, k: int = 3, adaptive: bool = True) -> tuple[DataFrame, DataFrame]:
    """What each request has found after as many of its queries as it takes, ranked; and one row per request on how it went.

    requests (query_id, text, and what guidance.judged_contexts takes); queries (query_id, query_index, text), asked in order of
    their index; search: from (query_id, text) to hits (query_id, rank, source_id, chunk_id, title, snippet); given (query_id, ord,
    source_id, chunk_id, title, snippet): contexts that a request brings along, which come first.

    Round i runs the i-th query of requests whose contexts didn't suffice after round i - 1, all of them in one search; requests that
    are done are in no later search. Contexts are kept as tables round by round, once each, and judged against the query of
    the round; without `adaptive` there is one round. In the end they are ranked against the request's text, cut to the largest of
    k, least and the number of its clusters, and judged again. A request without queries has what it brought. The driver
    learns only whether any request is left.

    Returns contexts (query_id, rank, source_id, chunk_id, title, snippet, score, clusters) and
    requests (query_id, attempts, n, hits, cluster_coverage, reasons, sufficient, confidence, topical_terms).
    """
    columns = ["query_id", "ord", "source_id", "chunk_id", "title", "snippet"]
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("query_index"))
    numbered = written(queries.select("query_id", "query_index", "text").withColumn("round", at))
    last = numbered.agg(F.max("round")).first()[0] or 0
    kept = [written(_once(given.select(*columns), None))] if given is not None else []
    tried: list[DataFrame] = []
    left = requests.select("query_id")
    so_far = lambda: reduce(DataFrame.unionByName, kept) if kept else None
    for i in range(1, (last if adaptive else min(last, 1)) + 1):
        asked = numbered.where(F.col("round") == i).join(left, "query_id", "left_semi").select("query_id", "text")
        hits = search(asked).select("query_id", (F.lit(i * _ROUND) + F.col("rank")).alias("ord"), *columns[2:])
        kept.append(written(_once(hits, so_far())))
        own = so_far().join(left, "query_id", "left_semi")
        judged = judged_contexts(requests.drop("text").join(asked, "query_id"), own, least).select("query_id", F.lit(i).alias("attempts"), "sufficient")
        tried.append(written(judged))
        left = tried[-1].where(~F.col("sufficient")).select("query_id")
        if i < last and left.isEmpty():
            break
    if not kept:
        raise ValueError("neither queries nor given contexts")
    found = so_far()
    limit = requests.select("query_id", F.greatest(F.lit(max(k, least)), F.coalesce(F.size("clusters"), F.lit(0)) if "clusters" in requests.columns else F.lit(0)).alias("_limit"))
    ranked = ranked_contexts(requests, found, _ALL).join(limit, "query_id").where("rank <= _limit").drop("_limit")
    ranked = written(ranked.join(found, ["query_id", "ord"]).select("query_id", "rank", *columns[2:], "score", "clusters"))
    final = judged_contexts(requests, ranked.withColumnRenamed("rank", "ord"), least)
    counts = reduce(DataFrame.unionByName, tried).groupBy("query_id").agg(F.max("attempts").alias("attempts")) if tried else requests.select("query_id", F.lit(0).alias("attempts"))
    final = final.join(counts, "query_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return ranked, final.select("query_id", "attempts", *[c for c in final.columns if c not in ("query_id", "attempts")])


def by_index(path: str, corpus: DataFrame, k: int = 3) -> Search:
    """A search of the stored keyword index at path; corpus (id, source_id, chunk_id, title, snippet) gives the contexts of its ids, of which only those found are read. All rounds use the version that the index has when they begin."""
    from siftstone.sources import versions

    number = versions.read(corpus.sparkSession, path)[0]

    def search(asked: DataFrame) -> DataFrame:
        hits = postings.search(asked, path, "query_id", "text", k, number)
        return with_rows(hits, corpus).select("query_id", "rank", "source_id", "chunk_id", "title", "snippet")

    return search
