import random
import re
from collections import Counter

import numpy as np
import pytest

from siftstone.llm import phrases


def brute(rows, least, top=2000, most=4):
    """[(lang, rank, phrase, a, l, r, n, score)] with every phrase counted."""
    f: dict = {}
    n: Counter = Counter()
    for lang, text in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            own.update(tuple(w[s : s + k]) for k in range(1, most + 1) for s in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        often = {p: c for p, c in own.items() if c >= least}
        gone = {q for p, c in often.items() for k in range(2, len(p)) for s in range(len(p) - k + 1) if 100 * c >= 80 * own[q := p[s : s + k]]}
        scored = []
        for p, a in often.items():
            if len(p) > 1 and p not in gone:
                s, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, b" ".join(p), own[p[:k]], own[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def test_query_against_counting_all(spark, docs):
    want = brute([(r.lang, r.text) for r in docs.collect()], 30)
    assert sorted(tuple(r) for r in phrases.op13(spark, "/root/testdata/sf0.001").collect()) == want and want


@pytest.mark.parametrize("seed", range(3))
def test_buckets_blocks_and_parts(spark, seed, monkeypatch):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "ab", "b c", "é", "x-y", "中", "'s", "w|"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choices([" ", "  ", "\t", " . ", ",", "\n", "\r\n", " ! "], [20, 2, 2, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(80)))
    rows = [(rng.choice(["en", "en", "en", "fr", None, "und", "x'y"]), text()) for _ in range(80)]
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 1 << 10)
    monkeypatch.setattr(phrases, "HELD", 500)
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), least=4, most_cells=60, part_bytes=300)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4)


def test_covered_phrases_ties_and_top(spark):
    rows = [("en", "one two three. " * 5 + "two three. " + "alpha beta; beta gamma; " * 4 + "self self self self " * 2)]
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=4, top=3).collect())
    assert got == brute(rows, 4, 3)
    assert "two three" not in [r[2] for r in brute(rows, 4)] and "one two three" in [r[2] for r in brute(rows, 4)]


def test_odd_rows(spark, odd, empty):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(odd.withColumnRenamed("source", "phrase"), least=2).collect()) == brute(rows, 2)
    assert phrases.collocations(empty).count() == 0


def test_long_text_and_word(spark):
    rows = [("en", "ping pong " * 150_000 + "z" * 700_000 + " end"), ("en", "z" * 700_000 + " end")]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 2)


def test_readings_do_not_grow_with_the_frequent_phrases(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "fr"]), " ".join(f"w{rng.randrange(12)}" for _ in range(40))) for _ in range(60)]
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2).mapInArrow(counting, "lang string, text string")
    got = phrases.collocations(docs, least=4, part_bytes=200).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4)
    # Their size, the sketch and one count.
    assert read.value <= 3 * len(rows)


def test_cells_and_their_filter():
    keys = np.random.default_rng(1).integers(0, 2**64, 40_000, np.uint64)
    few, counts = keys[:3], [1, 65_535, 140_000]
    packed = phrases._packed(np.repeat(few, counts))
    cells = (packed >> np.uint64(16)).tolist()
    assert sum((packed & np.uint64(65_535)).tolist()) == sum(counts)
    assert {c: sum(int(p) & 65_535 for p in packed.tolist() if p >> 16 == c) for c in cells} == dict(zip((few >> np.uint64(16)).tolist(), counts, strict=True))
    own = keys[:10_000]
    sent = np.zeros(1 << 13, np.uint64)
    np.bitwise_or.at(sent, (own >> np.uint64(51)).astype(np.int64), phrases._bits(own))
    assert len(phrases.passing(own, sent, 0, 1)) == len(own)
    assert len(phrases.passing(keys[10_000:], sent, 0, 1)) < 30
    assert sorted(np.concatenate([phrases.passing(own, sent, b, 3) for b in range(3)]).tolist()) == list(range(len(own)))


def test_long_words_in_candidates(spark):
    long = ["é" * 200, "z" * 257, "z" * 256, "Y" * 1000]
    rows = [(lang, f"{w} a {v}, {v} {v} b. \t{w}\ta") for lang in ("en", "fr") for w in long for v in long]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=3).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3)
