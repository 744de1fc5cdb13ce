"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is a logistic function of the summed weights of its words (runs of letters, in lower case) and of the
words' beginnings of PREFIXES bytes, which carry over to other forms of a word; both are hashed to BUCKETS. A document is toxic unless every sentence is harmless, so sentence scores combine by noisy-or:
1 - prod(1 - p). Weights start at shrunken log-odds of the words' document counts and are trained on document labels
through the noisy-or, by proximal gradient steps whose L1 penalty leaves most words without weight. The sentences that
score at least 0.5 are located in the text.

Training takes at most TRAIN_DOCS labelled documents of at most TRAIN_BYTES together, those with the lowest hash of their
id: a bounded sample. Tasks count in how many of them each word is, and send the driver only words that lean to one side.
Everything else runs over all documents. Labels, language, source and id are no inputs of a score.

Defined cases: a text of any length is scored whole; of sentences that score alike each is located; a null or empty text has one sentence without words and thus the model's base
score; a null label, or a label without a document, isn't learned from; several labels of a document count as toxic if
one does; without any toxic or any harmless document to learn from all weights are zero and the base score is the share
of toxic ones; repeated rows score alike; an empty table gives no rows; other columns pass through `score` unread, and where they have the names of its own columns
those get underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, per_batch, releasing, remainder, swept, table, with_columns, written
from .textcols import LOWER, U, buffers, mixed, slices, word_hashes, words

BUCKETS = 1 << 18
TRAIN_DOCS, TRAIN_BYTES = 6000, 64 << 20
PREFIXES = (5, 6, 7, 8)
FOLDS, HELD_OUT = 5, 0
STEPS, RATE, PENALTY = 300, 0.3, 2e-4
#: Occurrences of words that a step of training works on at a time.
CHUNK = 1 << 20
#: Words take part in training if at least so many documents have them, and if they lean to one side by so many standard deviations.
LEAST_DOCS, SCREEN = 2, 1.0

LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = LETTERS[128:] = True
#: Bytes that end a sentence: . ! ? and the line feed.
ENDS = np.zeros(256, dtype=bool)
ENDS[[33, 46, 63, 10]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features; the number of features before each sentence; the number of sentences before each text; where sentences begin.

    Every text has at least one sentence; what follows its last mark is one of its own.
    """
    low = LOWER[data]
    starts, ends, _ = words(low, offsets, LETTERS)
    # Each word and its beginnings stand together; a beginning that is the whole word counts with it.
    forms = [word_hashes(low, starts, ends), *(word_hashes(low, starts, np.minimum(ends, starts + n)) ^ U(n) for n in PREFIXES)]
    buckets = (mixed(np.stack(forms, axis=1).ravel()) >> U(64 - 18)).astype(np.int64)
    marks = np.flatnonzero(ENDS[data]) + 1
    marks = marks[~np.isin(marks, offsets)] if len(marks) else marks
    begin = np.sort(np.r_[offsets[:-1], marks], kind="stable")
    # An empty text begins where the next one does; marks inside texts never coincide with a text's begin.
    before = np.searchsorted(marks, offsets, "left") + np.arange(len(offsets))
    return buckets, len(forms) * np.r_[np.searchsorted(starts, begin), len(starts)], before, begin


class Model:
    def __init__(self, weights: np.ndarray, base: float):
        self.weights, self.base = weights, base

    def scores(self, data: np.ndarray, offsets: np.ndarray):
        """Score of each text; for each sentence its score and begin; sentences before each text."""
        buckets, word_at, sent_at, begin = sentences(data, offsets)
        total = np.r_[0.0, np.cumsum(self.weights[buckets])]
        z = self.base + total[word_at[1:]] - total[word_at[:-1]]
        harmless = -np.logaddexp(0.0, z)
        # Sums of each text's own sentences, not differences of running sums, so equal texts score alike.
        out = np.add.reduceat(harmless, sent_at[:-1]) if len(harmless) else np.zeros(0)
        return -np.expm1(out), -np.expm1(harmless), begin, sent_at


class Screen:
    """Which words take part in training, and the weights they start with, from the numbers of documents and of toxic ones that have them."""

    def __init__(self, seen: np.ndarray, bad: np.ndarray, n: int, toxic: int):
        self.share = (toxic + 0.5) / (n + 1.0)
        spread, lean = np.sqrt(seen * self.share * (1 - self.share)), np.abs(bad - seen * self.share)
        self.known = np.flatnonzero((seen >= LEAST_DOCS) & (lean > SCREEN * spread))
        seen, bad, sure = seen[self.known], bad[self.known], lean[self.known] > 2.5 * spread[self.known]
        odds = np.log((bad + 0.1 * self.share) / (toxic + 0.1)) - np.log((seen - bad + 0.1 * (1 - self.share)) / (n - toxic + 0.1))
        # Only words that lean clearly to one side start with a weight.
        self.start = np.where(sure, np.clip(odds, -3, 6), 0.0)
        self.place = np.full(BUCKETS, -1, dtype=np.int32)
        self.place[self.known] = np.arange(len(self.known))


def fit(at: np.ndarray, sent: np.ndarray, sent_doc: np.ndarray, toxic: np.ndarray, screen: Screen) -> Model:
    """Weights and base. at, sent: places among the known words and numbers of the sentences that have them; sent_doc: the document of each sentence."""
    n, first = len(toxic), len(sent_doc)
    base = float(np.log(np.expm1(-np.log1p(-screen.share) / max(1.0, first / max(1, n)))))
    if not n or not toxic.any() or toxic.all():
        return Model(np.zeros(BUCKETS), base)
    w = screen.start
    chunks = [slice(i, i + CHUNK) for i in range(0, len(at), CHUNK)]
    # Sums over the occurrences by sentence or by word, chunk by chunk.
    added = lambda to, value, size: sum((np.bincount(to[c], weights=value(c), minlength=size) for c in chunks), np.zeros(size))
    m1, m2, v1, v2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = base + added(sent, lambda c: w[at[c]], first)  # noqa: B023
        harmless = np.bincount(sent_doc, weights=-np.logaddexp(0.0, z), minlength=n)
        p = np.clip(-np.expm1(harmless), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: its share of what the noisy-or got wrong.
        pull = np.where(toxic > 0, -(1 - p) / p, 1.0)[sent_doc] * np.exp(-np.logaddexp(0.0, -z)) / n
        g, g0 = added(at, lambda c: pull[sent[c]], len(w)), pull.sum()  # noqa: B023
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        v1, v2 = 0.9 * v1 + 0.1 * g0, 0.999 * v2 + 0.001 * g0 * g0
        size = RATE / (1 + 0.02 * step)
        scale = np.sqrt(m2 / (1 - 0.999**step)) + 1e-4
        w = w - size * (m1 / (1 - 0.9**step)) / scale
        w = np.sign(w) * np.maximum(0.0, np.abs(w) - size * PENALTY / scale)
        base -= size * (v1 / (1 - 0.9**step)) / (np.sqrt(v2 / (1 - 0.999**step)) + 1e-4)
    weights = np.zeros(BUCKETS)
    weights[screen.known] = w
    return Model(weights, float(base))


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, limit_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, toxic, text) of at most `limit` labelled documents outside the held-out fold, as many as have at most limit_bytes together."""
    graded = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # At most `limit` rows of two numbers, so they can be sent to every task.
    sample = F.broadcast(graded.orderBy(*order).limit(limit))
    sizes = docs.select("doc_id", F.octet_length("text").alias("bytes")).join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    # One row per document of the sample again.
    fits = sizes.withColumn("upto", F.sum("bytes").over(Window.orderBy(*order))).where(F.col("upto") <= limit_bytes).select("doc_id", "toxic")
    return written(docs.select("doc_id", "text").join(F.broadcast(fits), "doc_id").select("doc_id", "toxic", "text"))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, limit_bytes: int = TRAIN_BYTES) -> Model:
    """The model of labelled documents outside the held-out fold."""
    chosen = training_sample(docs, labels, limit, limit_bytes)

    def count(batches):
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            buckets, word_at, sent_at, _ = sentences(data, offsets)
            of = np.repeat(np.arange(batch.num_rows), np.diff(word_at[sent_at]))
            own = np.unique(of << 32 | buckets)
            found, bad = own & 0xFFFFFFFF, batch.column(1).to_numpy()[own >> 32]
            sums += np.bincount(found, minlength=BUCKETS), np.bincount(found, weights=bad, minlength=BUCKETS).astype(np.int64)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0][used]), pa.array(sums[1][used])], names=["bucket", "seen", "bad"])

    totals = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    counts = chosen.mapInArrow(releasing(count), "bucket long, seen long, bad long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).toArrow()
    seen, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    seen[counts["bucket"].to_numpy()], bad[counts["bucket"].to_numpy()] = counts["seen"].to_numpy(), counts["bad"].to_numpy()
    screen = Screen(seen, bad, totals["n"], totals["toxic"])
    sent_place = chosen.sparkSession.sparkContext.broadcast(screen.place)

    def make():
        place = sent_place.value

        def work(batch):
            data, offsets = buffers(batch.column(2))
            buckets, word_at, sent_at, _ = sentences(data, offsets)
            own = place[buckets]
            number = np.repeat(np.arange(len(word_at) - 1), np.diff(word_at))
            of = np.searchsorted(sent_at, number, "right") - 1
            number = (number - sent_at[of]).astype(np.int32)
            keep = own >= 0
            before = np.r_[0, np.cumsum(np.bincount(of[keep], minlength=batch.num_rows))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(before), pa.array(x[keep])) for x in (own, number)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *lists, pa.array(np.diff(sent_at).astype(np.int32))], names=["doc_id", "toxic", "at", "sent", "sentences"])

        return work

    rows = per_batch(chosen, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, at array<int>, sent array<int>, sentences int").orderBy("doc_id").toArrow()
    toxic, size = rows["toxic"].to_numpy().astype(float), rows["sentences"].to_numpy()
    column = lambda name: np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy() for x in rows[name].chunks)])
    at, sent = column("at"), column("sent")
    number = np.concatenate([np.zeros(0, np.int64), *(x.value_lengths().to_numpy() for x in rows["at"].chunks)])
    del rows
    sent += np.repeat((np.cumsum(size) - size).astype(np.int32), number)
    model = fit(at, sent, np.repeat(np.arange(len(toxic), dtype=np.int32), size), toxic, screen)
    del at, sent, number
    swept(docs.sparkSession)
    return model


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5, located: bool = True) -> DataFrame:
    """docs with columns score and offending (code point ranges and scores of sentences of at least the threshold; null if not located)."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.base))
    fields = [T.StructField(free_name(docs, "score"), T.DoubleType()), T.StructField(free_name(docs, "offending"), SPANS)]

    def make():
        weights, base = held.value
        ready = Model(weights.astype(np.float64), base)

        def work(texts):
            data, offsets = buffers(texts)
            scores, found = [np.zeros(0)], []
            for i, j in slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                total, each, begin, sent_at = ready.scores(part, at)
                scores.append(total)
                found += [[] for _ in range(j - i)] if located else [None] * (j - i)
                if located:
                    for k in np.flatnonzero(each >= threshold).tolist():
                        d = int(np.searchsorted(sent_at, k, "right")) - 1
                        stop = begin[k + 1] if k + 1 < sent_at[d + 1] else at[d + 1]
                        chars = lambda b: int(np.count_nonzero((part[at[d] : b] & 0xC0) != 0x80))  # noqa: B023, E731
                        found[i + d].append({"start": chars(begin[k]), "end": chars(stop), "score": float(each[k])})
            return [pa.array(np.concatenate(scores)), pa.array(found, _ARROW)]

        return work

    return with_columns(docs, text_col, fields, make)


def op1(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending and where the offending sentences are (start-end, comma-joined) of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), F.array_join(F.transform("offending", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("offending"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose score is 0.5 and more. A null or empty text has the base score; repeated rows stay or go together; an empty table gives no rows; extra columns stay."""
    swept(spark)
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), located=False)
    return scored.where(F.col(scored.columns[-2]) < 0.5).select(docs.columns)
