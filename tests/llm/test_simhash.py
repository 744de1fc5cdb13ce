import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftstone.llm import graph, simhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(texts):
    """{id: fingerprint}, by the definition."""
    out = {}
    for i, t in texts:
        words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        features = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in features]
        out[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out


def joined(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_query_against_all_pairs(spark):
    rows = simhash.op6(spark, "/root/testdata/sf0.01").collect()
    texts = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = brute(texts)
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == want
    ids = np.array(sorted(want))
    fps = np.array([want[i] for i in ids.tolist()], dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert {r.doc_id: r.component_id for r in rows} == joined(zip(ids[a].tolist(), ids[b].tolist(), strict=True), ids.tolist())


@pytest.mark.parametrize(("radius", "limit"), [(2, 2048), (4, 2048), (2, 5), (4, 5)])
def test_links_connect_what_all_pairs_do(spark, radius, limit):
    rng = random.Random(radius * limit)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x, 0, x) for x in signed], "fp long, other long, node long"), radius, limit=limit).collect()
    near = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
    assert joined(found, signed) == joined(near, signed)


def test_components_with_hubs(spark):
    links = [(5000, x) for x in range(1, 2500)] + [(2499, 9000)] + [(9000, x) for x in range(9001, 11000)] + [(20000, 20001)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[x] for x in found if x < 20000} == {1} and len(found) == 2 + 2500 + 2000 and found[20001] == 20000


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = graph.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {n: r for n, r in joined(chain, {x for p in chain for x in p}).items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd, empty):
    rows = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert rows[2, 0] == rows[3, 0] == rows[4, 0] == 2
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty).count() == 0


def test_stage_keeps_one_of_each_group(spark, odd, empty):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 9)))
    rows, groups = [], {}
    for g in range(30):
        words = [word() for _ in range(rng.randrange(100, 300))]
        for c in range(3 if g % 2 else 1):
            now = list(words)
            if c:
                now[rng.randrange(len(now))] = word()
            rows.append((len(rows), " ".join(now), "en", "s", 1))
            groups.setdefault(g, []).append(len(rows) - 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `_sd` int")
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(g[0] for g in groups.values())
    assert simhash.stage(spark, empty, "").count() == 0
    left = simhash.stage(spark, odd, "")
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 2, 5, 6, None, 9, 10], key=str)


@pytest.mark.parametrize("heads", [128, 3])
def test_stage_against_greedy_by_hand(spark, monkeypatch, heads):
    """Copies of all degrees of noise: those of 0.8 and more to an earlier document that stays go, all others stay, however many are judged at a time."""
    monkeypatch.setattr(simhash, "STAGE_HEADS", heads)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(4, 9)))
    base = [word() for _ in range(300)]
    rows = []
    for i in range(40):
        now = list(base)
        for _ in range(i % 14):
            now[rng.randrange(len(now))] = word()
        rows.append((i, " ".join(now)))
    kept = []
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
    for i, _ in rows:
        if all(len(sets[i] & sets[h]) < 0.8 * len(sets[i] | sets[h]) for h in kept):
            kept.append(i)
    got = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == kept
    assert 3 < len(kept) < 35


@pytest.mark.parametrize("common", [False, True])
def test_stage_finds_cut_extended_and_prefixed_copies(spark, monkeypatch, common):
    """Every pair of 0.8 and more counts, however the copy was made, whether its shingles are rare or common."""
    if common:
        monkeypatch.setattr(simhash, "STAGE_SAMPLE", 1)
        monkeypatch.setattr(simhash, "STAGE_OFTEN", 2)
        monkeypatch.setattr(simhash, "STAGE_PAIRS", 2)
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    license_ = [word() for _ in range(40)]
    rows = []
    for g in range(40):
        words = [word() for _ in range(rng.choice([6, 30, 120, 500]))] + license_ * (g % 3 == 0)
        more = [word() for _ in range(len(words))]
        part = rng.choice([0.05, 0.12, 0.17, 0.19, 0.22, 0.3])
        n = int(part * len(words))
        for text in (words, words[: len(words) - n], words[n:], words + more[:n], more[:n] + words, words[:9] + more[:n] + words[9:]):
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select(F.xxhash64("text").alias("_st"), "text")
    sign = {r.doc_id: r.st for r in docs.select("doc_id", F.xxhash64("text").alias("st")).collect()}
    top = joined([(r.a, r.b) for r in simhash.text_links(keyed).collect()], sign.values())
    assert len(near) > 100 and all(top[sign[a]] == top[sign[b]] for a, b in near)
    kept = []
    for i in sorted(sets):
        if all(len(sets[i] & sets[h]) < 0.8 * len(sets[i] | sets[h]) for h in kept):
            kept.append(i)
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == kept


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(2)
    for n in (1, 60, 65, 250, 260, 1000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for new in (0, 1, n // 8, n // 2):
            b = np.unique(np.r_[a[new:], rng.integers(0, 2**63, new + n // 20).astype(np.uint64)])
            assert simhash._apart(simhash._sketch(a), simhash._sketch(b)) <= len(np.setxor1d(a, b))


def test_stage_takes_no_step_without_effect(spark, docs, monkeypatch):
    want = sorted(r.doc_id for r in simhash.stage(spark, docs, "").select("doc_id").collect())
    monkeypatch.setattr(simhash, "links", None)
    monkeypatch.setattr(simhash, "fingerprints", None)
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").select("doc_id").collect()) == want and len(want) < docs.count()
