import math
import re

import numpy as np
from pyspark.sql import functions as F

from siftstone.llm import toxicity
from siftstone.llm.textcols import buffers


def by_hand(model, text):
    """Noisy-or over sentences, each scored from its own words."""
    out = 1.0
    for sentence in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$", text or "") or [""]:
        buckets = toxicity.sentences(*as_buffers([sentence]))[0]
        out *= 1 - 1 / (1 + math.exp(-(model.base + model.weights[buckets].sum())))
    return 1 - out


def as_buffers(texts):
    import pyarrow as pa

    return buffers(pa.array(texts, pa.string()))


def test_scores_are_the_noisy_or_of_sentences(spark, docs, labels):
    model = toxicity.train(docs, labels)
    some = docs.where("length(text) < 3000")
    for r in toxicity.score(some, model).collect():
        assert math.isclose(r.score, by_hand(model, r.text), rel_tol=1e-4, abs_tol=1e-5)
        for x in r.offending:
            assert 0 <= x.start < x.end <= len(r.text) and x.score >= 0.5


def test_planted_sentences_are_learned_and_located(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    vocabulary, slurs = [word() for _ in range(300)], [word() for _ in range(6)]
    rows = []
    for i in range(400):
        sentences = [" ".join(rng.choice(vocabulary, 8)) + "." for _ in range(rng.integers(2, 9))]
        if i % 4 == 0:
            sentences[rng.integers(len(sentences))] = "xq " + " ".join([*rng.choice(vocabulary, 5), rng.choice(slurs)]) + "!"
        rows.append((i, " ".join(sentences), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(toxicity.remainder(F.col("doc_id"), 5) == 0).collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in scored) >= 0.95 * len(scored)
    found = [r for r in scored if r.toxic and r.offending]
    assert found and all(any("xq" in r.text[x.start : x.end] for x in r.offending) for r in found)


def test_odd_rows(spark, odd, empty, docs, labels):
    model = toxicity.train(docs, labels)
    rows = toxicity.score(odd.withColumn("score", F.lit("x")), model)
    assert rows.columns[-2:] == ["score_", "offending"]
    by = {r.key: r for r in rows.collect()}
    assert by[None].score_ == by["k2"].score_ and by["k1"].score_ == by["k7"].score_
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert len({r.score for r in toxicity.score(docs.where("text is null or length(text) < 5"), none).collect()}) <= 1
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, none).collect())


def test_training_against_plain_loops(spark, monkeypatch):
    """The same steps for one document, sentence and word after the other."""
    monkeypatch.setattr(toxicity, "STEPS", 25)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["ape", "boat", "cat", "idiot", "tree", "vile"], 5)) + ". " + " ".join(rng.choice(["sun", "moon", "vile", "star"], 3)) + "!" for _ in range(60)]
    bad = [int("idiot" in t or ("vile" in t and i % 3 == 0)) for i, t in enumerate(texts)]
    ids = list(range(60))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, b) for i, b in zip(ids, bad, strict=True)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    learn = [r.doc_id for r in labels.where(toxicity.remainder(F.col("doc_id"), 5) != 0).orderBy("doc_id").collect()]
    bags = [[toxicity.sentences(*as_buffers([x]))[0].tolist() for x in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$", texts[i])] for i in learn]
    y, n = [bad[i] for i in learn], len(learn)
    share = (sum(y) + 0.5) / (n + 1)
    words = sorted({w for d in bags for s in d for w in s})
    w, used = {}, []
    for x in words:
        have = [any(x in s for s in d) for d in bags]
        seen, ill = sum(have), sum(t for h, t in zip(have, y, strict=True) if h)
        spread, lean = math.sqrt(seen * share * (1 - share)), abs(ill - seen * share)
        if seen >= toxicity.LEAST_DOCS and lean > toxicity.SCREEN * spread:
            odds = math.log((ill + 0.1 * share) / (sum(y) + 0.1)) - math.log((seen - ill + 0.1 * (1 - share)) / (n - sum(y) + 0.1))
            used.append(x)
            w[x] = min(6, max(-3, odds)) if lean > 2.5 * spread else 0.0
    base = math.log(math.expm1(-math.log1p(-share) / (sum(map(len, bags)) / n)))
    m, v = dict.fromkeys([*used, None], 0.0), dict.fromkeys([*used, None], 0.0)
    for step in range(1, 26):
        g = dict.fromkeys([*used, None], 0.0)
        for d, t in zip(bags, y, strict=True):
            p = [1 / (1 + math.exp(-(base + sum(w.get(x, 0.0) for x in s)))) for s in d]
            whole = min(1 - 1e-9, max(1e-9, 1 - math.prod(1 - q for q in p)))
            for s, q in zip(d, p, strict=True):
                pull = (-(1 - whole) / whole if t else 1.0) * q / n
                g[None] += pull
                for x in s:
                    if x in w:
                        g[x] += pull
        size = toxicity.RATE / (1 + 0.02 * step)
        for x in g:
            m[x], v[x] = 0.9 * m[x] + 0.1 * g[x], 0.999 * v[x] + 0.001 * g[x] ** 2
            scale = math.sqrt(v[x] / (1 - 0.999**step)) + 1e-4
            move = size * (m[x] / (1 - 0.9**step)) / scale
            if x is None:
                base -= move
            else:
                to = w[x] - move
                w[x] = math.copysign(max(0.0, abs(to) - size * toxicity.PENALTY / scale), to)
    assert math.isclose(model.base, base, rel_tol=1e-6)
    assert all(math.isclose(model.weights[x], w[x], rel_tol=1e-6, abs_tol=1e-9) for x in used) and np.count_nonzero(model.weights) <= len(used)


def test_the_sample_is_bounded(spark, docs, labels):
    sizes = toxicity.training_sample(docs, labels, 40, 20000).select(F.octet_length("text").alias("n")).collect()
    assert 0 < len(sizes) <= 40 and sum(r.n or 0 for r in sizes) <= 20000


def test_a_text_longer_than_a_slice(spark, docs, labels):
    model = toxicity.train(docs, labels)
    text = docs.where("length(text) > 200").first().text
    long = ((text + " ") * (1 + 1_500_000 // len(text)))[:1_500_000]
    got = toxicity.score(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first()
    assert math.isclose(got.score, by_hand(model, long), rel_tol=1e-4, abs_tol=1e-5)
