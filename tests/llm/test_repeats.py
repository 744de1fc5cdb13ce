from pyspark.sql import functions as F

import hashlib
import random
import re

import pytest

from siftstone.llm import repeats


def brute(rows, window):
    """{id: (n_words, kept words)} with every window compared; the rows in order of ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone |= set(range(s, s + window))
            seen.add(w)
        out[i] = len(words), [w for k, w in enumerate(words) if k not in gone]
    return out


def same(got, want):
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: (n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for i, (n, k) in want.items()}


def test_query_against_all_windows(spark, docs):
    same(repeats.op4(spark, "/root/testdata/sf0.001").collect(), brute([(r.doc_id, r.text) for r in docs.collect()], 20))


@pytest.mark.parametrize("seed", range(3))
def test_few_words_repeat_within_and_across(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices("ab" if seed else "a", k=rng.randrange(60)))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " c " + rows[i + 1][1]) for i in range(20)]
    same(repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=8, seed=3).collect(), brute(rows, 8))


def test_odd_rows(spark, odd, empty):
    rows = repeats.without_repeats(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].n_words == by[3].n_words == by[4].n_words == 0
    assert by[5].n_words == 30000 and by[5].n_removed == 30000 - 1
    assert all(r.n_removed == 0 for r in rows if r.doc_id == 7)
    assert repeats.without_repeats(empty).count() == 0


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    from siftstone.llm import shared

    monkeypatch.setattr(shared, "LEAST_HOT", 20)
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id % 50) AS a", "id % 2 AS b", "id")
    few = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    got = shared.spread_join(rows, few, ["a", "b"], 3000)
    want = rows.join(few.drop("n"), ["a", "b"])
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert shared.spread_join(rows, few.where("a <> 7"), ["a", "b"], 3000, "left_semi").count() == rows.join(few.where("a <> 7"), ["a", "b"], "left_semi").count()
