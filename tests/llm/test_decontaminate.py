import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import decontaminate as d


def tokens(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items):
    """{(doc, item)} by scoring every passage against every segment."""
    words = {i: tokens(t) for i, t in items}
    segs = [(i, w[k : k + d.SEGMENT]) for i, w in words.items() for k in range(0, len(w), d.SEGMENT)]
    df = Counter(t for _, s in segs for t in set(s))
    mean = sum(len(s) for _, s in segs) / len(segs)
    weight = []
    for _, s in segs:
        w = {t: math.log(1 + (len(segs) - df[t] + 0.5) / (df[t] + 0.5)) * n * (d.K1 + 1) / (n + d.K1 * (1 - d.B + d.B * len(s) / mean)) for t, n in Counter(s).items()}
        weight.append({t: x / sum(w.values()) for t, x in w.items()})
    out = {}
    for doc, text in docs:
        t = tokens(text)
        best = Counter()
        for at in range(0, max(1, len(t)), d.STRIDE):
            have = set(t[at : at + d.PASSAGE])
            for (i, _), w in zip(segs, weight, strict=True):
                share = sum(x for k, x in w.items() if k in have)
                if share >= d.THRESHOLD - 1e-9:
                    best[i] = max(best[i], share)
        for i, share in best.items():
            w, raw = words[i], dict(items)[i]
            n = min(d.SHINGLE, len(w))
            has = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
            cover = {k + x for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in has for x in range(n)}
            cut = len(tokens(raw[: d.answer_begins(raw)]))
            q = sum(x in cover for x in range(cut)) / cut if cut else 1.0
            a = sum(x in cover for x in range(cut, len(w))) / (len(w) - cut) if cut < len(w) else 1.0
            if q >= d.QUESTION and a >= d.ANSWER:
                out[doc, i] = share
    return out


def test_query_against_all_pairs(spark):
    rows = d.op8(spark, "/root/testdata/sf0.001").collect()
    read = lambda n: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").select({"documents": "doc_id", "benchmark": "item_id"}[n], "text").collect()]
    want = brute(read("documents"), read("benchmark"))
    assert want and {(r.doc_id, r.item_id) for r in rows} == set(want)
    assert all(math.isclose(r.score, want[r.doc_id, r.item_id], rel_tol=1e-9) for r in rows)


def test_all_that_hold_an_item_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in d.op8(spark, "/root/testdata/sf0.01").collect()}
    held = {(r.doc_id, r.item_id) for r in docs.crossJoin(F.broadcast(items.withColumnRenamed("text", "item"))).where("contains(text, item)").collect()}
    assert held and held <= found
    assert len(found - held) <= 3


@pytest.mark.parametrize("index_bytes", [1 << 24, 600])
def test_retrieval_is_whole_and_parts_agree(spark, docs, index_bytes):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    some = docs.where("doc_id % 3 = 0").withColumn("leaks", F.lit(1))
    got = {r.doc_id: {x.item_id for x in r.leaks_} for r in d.find_leaks(some, items, index_bytes=index_bytes).collect()}
    want = brute([(r.doc_id, r.text) for r in some.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {(k, i) for k, v in got.items() for i in v} == set(want)


def test_bounds_leave_nothing_out(spark):
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 20) % 300)) for i in range(400)]
    index = next(d.indexes(spark.createDataFrame(items, "item_id long, text string")))
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, 128) % 300) for _ in range(60)]
    hashes = [np.unique(index.lookup.find(d.hashed(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0])) for t in texts]
    pairs = [(p, int(x)) for p, h in enumerate(hashes) for x in h if x >= 0]
    for threshold in (0.3, 0.5, 0.8):
        p, s, share = index.retrieve(np.array([x[0] for x in pairs]), np.array([x[1] for x in pairs]), threshold)
        want = {}
        for q, h in enumerate(hashes):
            total = np.zeros(len(index.own))
            for t in h[h >= 0]:
                lo, hi = index.post[index.lists[t]], index.post[index.lists[t + 1]]
                total[index.segment[lo:hi]] += index.share[lo:hi]
            want |= {(q, int(x)): total[x] for x in np.flatnonzero(total >= threshold - 1e-9)}
        assert {(a, b) for a, b in zip(p.tolist(), s.tolist(), strict=True)} == set(want)
        assert np.allclose(sorted(share), sorted(want.values()))


def test_near_and_long_items(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 7))
    long = [word() for _ in range(400)]
    short = [word() for _ in range(30)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short[:24]).title() + "? " + " ".join(short[24:])), (3, "tiny item"), (4, None), (5, "  ")], "item_id long, text string")
    filler = lambda n: [word() for _ in range(n)]
    edited = [*short[:11], "other", *short[12:]]
    rows = [(1, filler(77) + long + filler(5)), (2, filler(200) + edited + filler(50)), (3, short[:24] + filler(99)), (4, filler(300)), (5, filler(70) + ["tiny", "item"]), (6, long[:200])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, x.item_id) for r in d.find_leaks(docs, items).collect() for x in r.leaks}
    assert got == {(1, 1), (2, 2), (5, 3)}


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "the cat sat on the mat you utter moron")], "item_id long, text string")
    assert {r.key for r in d.find_leaks(odd, items).collect() if r.leaks} == {"k1", "k7"}
    assert d.find_leaks(odd, items).count() == odd.count() and d.find_leaks(empty, items).count() == 0
    assert d.find_leaks(odd, items.limit(0)).where("size(leaks) > 0").count() == 0


def test_items_that_share_an_id_or_have_none(spark):
    words = [f"w{i}x" for i in range(400)]
    cut = lambda a, n: " ".join(words[a : a + n])
    items = spark.createDataFrame([(1, cut(0, 30)), (1, cut(100, 70)), (1, cut(0, 30)), (None, cut(200, 30)), (None, None), (2, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see " + cut(0, 30)), (2, cut(100, 70) + " end"), (3, cut(200, 30)), (4, cut(300, 50)), (5, None)], "doc_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in d.find_leaks(docs, items).collect()}
    assert got == {1: [1], 2: [1], 3: [None], 4: [], 5: []}
