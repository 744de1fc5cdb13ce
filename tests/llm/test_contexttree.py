import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftstone.llm import contexttree

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def decisions(text, depth):
    """(prefix, context of the whole depth, nearest first, bit) of each decision of a text."""
    line = b"\0" * depth + (text or "").encode().translate(LOW) + b"\xff"
    for i in range(depth, len(line)):
        context = tuple(line[i - depth : i][::-1])
        for j in range(8, 0, -1):
            yield (256 + line[i]) >> j, context, line[i] >> (j - 1) & 1


def brute(train, texts, depth=contexttree.DEPTH):
    counts = defaultdict(lambda: [0, 0])
    for text in train:
        for prefix, context, bit in decisions(text, depth):
            for d in range(depth + 1):
                counts[prefix, context[:d]][bit] += 1
    below = defaultdict(float)
    own, share = {}, {}
    for node in sorted(counts, key=lambda n: -len(n[1])):
        a, b = counts[node]
        own[node] = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        weighted = own[node]
        if len(node[1]) < depth:
            share[node] = 1 / (1 + math.exp(min(700, below[node] - own[node])))
            weighted = math.log(0.5) + np.logaddexp(own[node], below[node])
        if node[1]:
            below[node[0], node[1][:-1]] += weighted
    out = []
    for text in texts:
        total = 0.0
        for prefix, context, bit in decisions(text, depth):
            p = None
            for d in range(depth, -1, -1):
                node = prefix, context[:d]
                if node in counts:
                    a, b = counts[node]
                    guess = ((a, b)[bit] + 0.5) / (a + b + 1)
                    p = guess if p is None else share[node] * guess + (1 - share[node]) * p
            total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


def unigrams(train, texts):
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOW)) + [None]
    c = Counter(x for t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t))) for t in texts]


@pytest.mark.parametrize(("block", "depth"), [(1 << 12, contexttree.DEPTH), (1 << 30, contexttree.DEPTH), (1 << 13, 2), (1 << 13, 7)])
def test_query_against_the_tree_by_hand(spark, docs, block, depth):
    some = docs.where("length(text) < 900").orderBy("doc_id").limit(60).withColumn("held_out", F.lit(1)).withColumn("key", F.lit("x"))
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    learns = contexttree.remainder(F.col("doc_id"), 7) != 2
    got = {r.doc_id: r for r in contexttree.code_lengths(some, learns=learns, block_bytes=block, depth=depth).collect()}
    rows = {r.doc_id: r.text for r in some.collect()}
    train = [t for i, t in rows.items() if not held(i)]
    assert {i for i, r in got.items() if r.held_out} == {i for i in rows if held(i)}
    for i, score, (n, known, tokens, base) in zip(rows, brute(train, rows.values(), depth), unigrams(train, rows.values()), strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=1e-6), (i, r.score, score)


def test_held_out_texts_get_shorter_than_by_words(spark):
    rows = contexttree.op2(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > 0.97 * rows[1]


def test_probabilities_of_all_next_bytes_sum_to_one(spark, docs):
    keys, n = np.unique(contexttree.grams(*contexttree.buffers(docs.select("text").toArrow()["text"].combine_chunks())), return_counts=True)
    seen = keys[:: len(keys) // 20] >> np.uint64(8) << np.uint64(8)
    every = (seen[:, None] | np.arange(256, dtype=np.uint64)[None, :]).ravel()
    more = np.unique(np.r_[keys, every])
    count = np.zeros(len(more))
    count[np.searchsorted(more, keys)] = n
    p, nodes = contexttree.subtrees(more, count)
    full = np.zeros((3, 1 << 16))
    for j, first, *values in nodes:
        at = (more[first] >> np.uint64(40)).astype(int) << 8 | (256 + (more[first] & np.uint64(255)).astype(int)) >> j
        for total, v in zip(full, values, strict=True):
            total += np.bincount(at, weights=v, minlength=1 << 16)
    logs = contexttree.Top(*(x.reshape(256, 256) for x in full)).log10(more, p)
    sums = (10 ** logs[np.searchsorted(more, every)]).reshape(-1, 256).sum(1)
    assert np.allclose(sums, 1)


def test_odd_rows(spark, odd, empty):
    rows = contexttree.code_lengths(odd).collect()
    assert len(rows) == odd.count() and all(r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert len({(r.score, r.base_score) for r in rows if r.doc_id == 7}) == 1
    assert contexttree.code_lengths(empty).count() == 0
    nothing = contexttree.code_lengths(odd, learns=F.lit(False)).where("doc_id = 9").first()
    assert math.isclose(nothing.score, 4 * 8 * math.log10(0.5)) and nothing.train_tokens == 0


def test_memory_of_a_task_is_bounded():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 1 << 20).astype(np.int64))
    batches = pa.table({"key": keys, "n": np.ones(len(keys), np.int64)}).to_batches(2000)
    tracemalloc.start()
    rows = sum(batch.num_rows for batch in contexttree._tops(contexttree.DEPTH)(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 256 << 20


def test_chunks_hold_whole_contexts():
    keys = np.sort(np.r_[np.arange(3 * contexttree.CHUNK), np.arange(9) << 40])
    chunks = list(contexttree._chunks(pa.table({"key": keys}).to_batches(2000), contexttree.DEPTH))
    contexts = [set((chunk["key"].to_numpy() >> 32).tolist()) for chunk in chunks]
    assert np.array_equal(np.concatenate([chunk["key"].to_numpy() for chunk in chunks]), keys)
    assert len(set.union(*contexts)) == sum(map(len, contexts))
