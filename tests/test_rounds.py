"""Searches in rounds."""

from pyspark.sql import functions as F

from siftstone.operators import rounds

_HITS = "query_id long, rank int, source_id string, chunk_id long, title string, snippet string"


def test_only_open_requests_ask_again(spark):
    """Request 1 suffices after its first query, 2 after its second, 3 never, 4 brings enough along but asks once, 5 has no query, 6 finds nothing."""
    requests = spark.createDataFrame([(i, "iron therapy") for i in range(1, 7)], "query_id long, text string")
    queries = spark.createDataFrame([(i, 10 * j, f"iron q{j}") for i in (1, 2, 3, 4, 6) for j in (1, 2, 3)], "query_id long, query_index int, text string")
    given = spark.createDataFrame([(i, n, "s", 100 + n, None, f"iron given {n}") for i, n in ((4, 1), (4, 2), (5, 1), (4, 1))], "query_id long, ord int, source_id string, chunk_id long, title string, snippet string")
    found = {
        (1, 1): [(1, "iron a"), (2, "iron b")], (2, 1): [(1, "iron a"), (1, "iron a")], (2, 2): [(1, "iron a"), (3, "iron therapy c")],
        (3, 1): [(1, "iron a")], (3, 2): [(1, "iron a")], (3, 3): [(1, "iron a")], (4, 1): [(101, "iron given 1")], (6, 1): [],
    }
    seen = []

    def search(asked):
        rows = [(r.query_id, int(r.text[-1])) for r in asked.collect()]
        seen.append(sorted(rows))
        return spark.createDataFrame([(q, n, "s", c, None, text) for q, j in rows for n, (c, text) in enumerate(found.get((q, j), []), 1)], _HITS)

    contexts, out = rounds.answered(requests, queries, search, given, least=2, k=1)
    assert seen == [[(i, 1) for i in (1, 2, 3, 4, 6)], [(2, 2), (3, 2), (6, 2)], [(3, 3), (6, 3)]]
    rows = {}
    for r in contexts.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append(r.chunk_id)
    assert rows == {1: [1, 2], 2: [3, 1], 3: [1], 4: [101, 102], 5: [101]}
    told = {r.query_id: (r.attempts, r.n, r.sufficient) for r in out.collect()}
    assert told == {1: (1, 2, True), 2: (2, 2, True), 3: (3, 1, False), 4: (1, 2, True), 5: (0, 1, False), 6: (3, 0, False)}

    seen.clear()
    _, out = rounds.answered(requests, queries, search, least=2, k=1, adaptive=False)
    assert len(seen) == 1 and {r.attempts for r in out.where("query_id <> 5").collect()} == {1}


def test_limits_and_equal_contexts(spark):
    """Null parts of a context's key are equal; the largest of k, least and the number of clusters is kept."""
    requests = spark.createDataFrame([(1, "iron", ["a", "b", "c"]), (2, "iron", None)], "query_id long, text string, clusters array<string>")
    queries = requests.select("query_id", F.lit(1).alias("query_index"), "text").union(requests.select("query_id", F.lit(2), "text"))
    hits = [(q, n, None, None, "t", f"iron {'x' * (n % 5)}") for q in (1, 2) for n in range(1, 11)]
    contexts, out = rounds.answered(requests, queries, lambda asked: spark.createDataFrame(hits, _HITS).join(asked, "query_id", "left_semi"), least=2, k=1)
    assert {r.query_id: r.n for r in contexts.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 2}
    empty = requests.where("false")
    contexts, out = rounds.answered(empty, queries.where("false"), lambda asked: asked, contexts.select("query_id", F.col("rank").alias("ord"), "source_id", "chunk_id", "title", "snippet").where("false"))
    assert contexts.count() == 0 and out.count() == 0
