import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from siftstone.llm import languages

N = languages.ORDER


def read(text):
    """The characters by which a text is judged, and its context in front."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return " " * (N - 1) + (" ".join(words) + " " if words else "")


class Brute:
    """Kneser-Ney by dictionaries."""

    def __init__(self, texts, alphabet):
        self.c = [Counter() for _ in range(N + 1)]
        for t in map(read, texts):
            self.c[N].update(t[i - N + 1 : i + 1] for i in range(N - 1, len(t)))
        for k in range(N - 1, 0, -1):
            self.c[k].update(g[1:] for g in self.c[k + 1])
        self.total, self.kinds = defaultdict(float), defaultdict(float)
        self.d = [0.0]
        for k in range(1, N + 1):
            ones, twos = (sum(v == x for v in self.c[k].values()) for x in (1, 2))
            self.d.append(min(0.95, max(0.05, ones / max(1, ones + 2 * twos) if ones else 0.5)))
            for g, v in self.c[k].items():
                self.total[k, g[:-1]] += v
                self.kinds[k, g[:-1]] += 1
        self.alphabet = alphabet

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / self.alphabet
        total = self.total[k, gram[:-1]]
        if not total:
            return self.p(gram[1:])
        return max(self.c[k][gram] - self.d[k], 0) / total + self.d[k] * self.kinds[k, gram[:-1]] / total * self.p(gram[1:])

    def bits(self, text):
        t = read(text)
        return sum(-math.log2(self.p(t[i - N + 1 : i + 1])) for i in range(N - 1, len(t)))


def test_models_against_dictionaries(docs):
    rows = [(r.lang, r.text[:400]) for r in docs.where("text IS NOT NULL AND lang IS NOT NULL").limit(40).collect()]
    names = sorted({x for x, _ in rows})
    grams = Counter((names.index(x), t[i - N + 1 : i + 1]) for x, raw in rows for t in [read(raw)] for i in range(N - 1, len(t)))
    keys = sorted(grams)
    models = languages.fit(names, np.array([k[0] for k in keys]), np.array([[ord(c) for c in k[1]] for k in keys], np.uint32), np.array([float(grams[k]) for k in keys]))
    alphabet = len({k[1][-1] for k in keys}) + 1
    brute = [Brute([t for x, t in rows if x == n], alphabet) for n in names]
    texts = [t for _, t in rows[:8]] + ["Zwölf Boxkämpfer, 12!", "日本語 x", None, "", "?!", "  a--b  "]
    bits, number = models.bits(texts)
    assert number.tolist() == [len(read(t)) - N + 1 for t in texts]
    for i, t in enumerate(texts):
        for x, b in enumerate(brute):
            assert math.isclose(bits[i, x], b.bits(t), rel_tol=1e-4, abs_tol=1e-3), (t, x)


def test_held_out_accuracy_and_rejection(spark):
    found = languages.op5(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("i"), "lang", "text")
    rows = found.join(docs, found.doc_id == docs.i).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    known = [r for r in held if r.lang and re.search(r"[^\W\d_]", r.text or "")]
    assert sum(r.lang_pred == r.lang for r in known) > 0.97 * len(known)
    assert sum(r.accepted for r in known) > 0.9 * len(known)
    assert all(0 <= r.score <= 1 for r in rows)
    other = spark.createDataFrame([(1, "qqq xxx zzz 日本語日本語 ъъъ"), (2, known[0].text)], "doc_id long, text string")
    judged = {r.doc_id: r for r in languages.identify(other, languages.train(docs.withColumnRenamed("i", "doc_id"))).collect()}
    assert not judged[1].accepted and judged[2].accepted


def test_odd_rows(spark, odd, empty, docs):
    model = languages.train(docs)
    rows = languages.identify(odd.withColumn("Score", F.lit(1)), model)
    assert rows.columns[-4:] == ["lang_pred", "score_", "bits_per_char", "accepted"]
    by = {r.key: r for r in rows.collect()}
    assert all(by[k].lang_pred == "und" and by[k].score_ == 0 and not by[k].accepted for k in (None, "k2", "k4"))
    assert by["k1"].score_ == by["k7"].score_ and by["k9"].lang_pred in model.models.names
    assert languages.identify(empty, model).count() == 0
    none = languages.train(empty)
    assert {r.lang_pred for r in languages.identify(odd, none).collect()} == {"und"}
    one = languages.train(docs.where("lang = 'en'"))
    assert {(r.lang_pred, r.score) for r in languages.identify(docs.where("length(text) > 99"), one).collect()} == {("en", 1.0)}
