"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is read as its letters in lower case; everything between letters is one space, as are both ends. Each language has
a model of ORDER characters: the highest order discounts counts, lower ones discount the number of different characters
that stand before, and each order is interpolated with the next lower one, down to equal shares of all characters. The
models stand together: per order one sorted array of 64-bit hashes of the character sequences that any language has, and
beside it a column of log2 probabilities per language, and likewise the weights of contexts that pass on to the next order.
A hash is found by its upper bits in a directory of the sorted array, then by stepping on.

The language whose model needs the fewest bits per character is chosen. Rejection is calibrated on labelled documents that
the models didn't learn from: a text whose bits per character are above what KEEP of those of the chosen language need is
rejected. So is the score's sharpness: it is the share of the chosen language among 2**(-bits * characters * sharpness),
over at most SCORED characters, with the sharpness that gives the calibration documents' languages the highest probability.

Models learn from a bounded sample, of about SAMPLE_DOCS documents of each language by a hash of id and text, of which one
in CALIBRATE calibrates. All documents are read to draw it, and every whole text is scored.

Defined cases: a text that is null or has no letter is `und`, with score 0, and rejected; ties go to the first language in
order of names; one language alone scores 1; nothing to learn from gives `und` throughout; documents without language or
letters aren't learned from; a text of any length is read whole; repeated rows score alike; an empty table gives no rows.
Other columns pass by unread, and those that have the names of new ones make these get underscores.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, per_batch, remainder, table, with_columns, written
from .textcols import U, mixed, summed

ORDER = 5
SAMPLE_DOCS = 1000
CALIBRATE, KEEP = 4, 0.995
SCORED = 200
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Characters that are worked on at a time; a longer text is taken as a whole.
SLICE = 1 << 20

_STEP = U(0x9E3779B97F4A7C15)


@functools.cache
def letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts as they are read, and where each text begins. Each begins with ORDER - 1 spaces that are context only and ends with one; a text without letters has the former alone."""
    lead = " " * (ORDER - 1)
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer((lead + f" {lead}".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begin = np.r_[0, np.cumsum(np.array([len(t) for t in lowered], dtype=np.int64) + ORDER)]
    ok = letters()[points]
    # Of the characters between letters the first one stays, as a space.
    keep = ok.copy()
    keep[1:] |= ok[:-1]
    keep[(begin[:-1, None] + np.arange(ORDER - 1)[None, :]).ravel()] = True
    return np.where(ok, points, np.uint32(32))[keep], np.r_[0, np.cumsum(keep)][begin]


def sequences(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` characters up to each place; places with fewer have no meaning."""
    wide = points.astype(np.uint64) + U(1)
    with np.errstate(over="ignore"):
        out = wide.copy()
        for k in range(1, order):
            out[k:] += wide[:-k] * U(pow(int(_STEP), k, 2**64))
        return mixed(out + U(order))


class Sorted:
    """Positions of hashes in a sorted array of distinct ones."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(1, len(keys).bit_length())
        self.keys = np.r_[keys, U(2**64 - 1)]
        self.begin = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << U(64 - self.bits)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """-1 where a hash isn't there."""
        at = self.begin[(hashes >> U(64 - self.bits)).astype(np.int64)]
        rest = np.flatnonzero(self.keys[at] < hashes)
        while len(rest):
            at[rest] += 1
            rest = rest[self.keys[at[rest]] < hashes[rest]]
        return np.where((self.keys[at] == hashes) & (at < len(self.keys) - 1), at, -1)


class Models:
    """Per order k from 1 on: `grams[k - 1]`, hashes of k characters with log2 probabilities of the last one; `contexts[k - 1]`, hashes of k - 1 characters with log2 weights of the next lower order."""

    def __init__(self, names: list[str], grams: list, contexts: list, unseen: np.ndarray):
        self.names, self.unseen = names, unseen
        self.grams = [(Sorted(k), v) for k, v in grams]
        self.contexts = [(Sorted(k), v) for k, v in contexts]

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Total bits of each text under each language, and its number of characters; 0 without letters."""
        out, number, i = [], [], 0
        while i < len(texts):
            size, j = 0, i
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= SLICE):
                size += len(texts[j] or "")
                j += 1
            points, at = characters(texts[i:j])
            real = np.ones(len(points), dtype=bool)
            real[(at[:-1, None] + np.arange(ORDER - 1)[None, :]).ravel()] = False
            place = np.flatnonzero(real)
            logs = self._logs(points, place)
            before = np.searchsorted(place, at)
            out.append(-np.stack([summed(logs[:, x].astype(np.float64), before) for x in range(len(self.names))], axis=1))
            number.append(np.diff(before))
            i = j
        return (np.concatenate(out), np.concatenate(number)) if out else (np.zeros((0, len(self.names))), np.zeros(0, np.int64))

    def _logs(self, points: np.ndarray, place: np.ndarray) -> np.ndarray:
        logs = np.zeros((len(place), len(self.names)), dtype=np.float32)
        rest = np.arange(len(place))
        for k in range(ORDER, 0, -1):
            keys, values = self.grams[k - 1]
            found = keys.find(sequences(points, k)[place[rest]] if len(rest) > len(points) // 8 else _some(points, place[rest], k))
            hit = found >= 0
            logs[rest[hit]] += values[found[hit]]
            rest = rest[~hit]
            if not len(rest):
                return logs
            if k > 1:
                keys, values = self.contexts[k - 1]
                found = keys.find(_some(points, place[rest] - 1, k - 1))
                hit = found >= 0
                logs[rest[hit]] += values[found[hit]]
        logs[rest] += self.unseen
        return logs


def _some(points: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """sequences() at these places only."""
    with np.errstate(over="ignore"):
        out = points[place].astype(np.uint64) + U(1)
        for k in range(1, order):
            out += (points[place - k].astype(np.uint64) + U(1)) * U(pow(int(_STEP), k, 2**64))
        return mixed(out + U(order))


def fit(names: list[str], language: np.ndarray, chars: np.ndarray, count: np.ndarray) -> Models:
    """Models from rows (language number, ORDER code points, count) of the distinct highest-order sequences of each language."""
    n = len(names)
    keys = [sequences(chars[:, ORDER - k :].ravel(), k).reshape(len(chars), k)[:, -1] if len(chars) else np.zeros(0, np.uint64) for k in range(1, ORDER + 1)]
    heads = [np.full(len(chars), U(0))] + [sequences(chars[:, ORDER - k : ORDER - 1].ravel(), k - 1).reshape(len(chars), k - 1)[:, -1] if len(chars) else np.zeros(0, np.uint64) for k in range(2, ORDER + 1)]
    every = [np.unique(k, return_index=True, return_inverse=True) for k in keys]
    # Counts of the highest order; of lower ones the number of different characters before.
    counts = []
    for k in range(ORDER, 0, -1):
        _, first, inverse = every[k - 1]
        size = (len(first), n)
        if k == ORDER:
            now = np.zeros(size)
            np.add.at(now, (inverse, language), count)
        else:
            longer = every[k][1]
            now = np.zeros(size)
            np.add.at(now, inverse[longer], counts[-1] > 0)
        counts.append(now)
    counts.reverse()
    alphabet = len(every[0][0]) + 1
    lower = np.full((1, n), 1.0 / alphabet)
    grams, contexts, unseen = [], [], None
    for k in range(1, ORDER + 1):
        hashes, first, _ = every[k - 1]
        now = counts[k - 1]
        ones, twos = (now == 1).sum(0), (now == 2).sum(0)
        discount = np.where(ones > 0, ones / np.maximum(1, ones + 2 * twos), 0.5).clip(0.05, 0.95)
        heads_, head = np.unique(heads[k - 1][first], return_inverse=True)
        total, kinds = np.zeros((len(heads_), n)), np.zeros((len(heads_), n))
        np.add.at(total, head, now)
        np.add.at(kinds, head, now > 0)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        below = lower[every[k - 2][2][first]] if k > 1 else lower
        p = np.maximum(now - discount, 0) / np.maximum(total, 1)[head] + weight[head] * below
        if k == 1:
            unseen = np.log2((weight * lower)[0] if len(weight) else lower[0]).astype(np.float32)
        grams.append((hashes, np.log2(p).astype(np.float32)))
        contexts.append((heads_, np.log2(weight).astype(np.float32)))
        lower = p
    return Models(names, grams, contexts, unseen)


class Identifier:
    """Models with the calibrated limits of bits per character and the sharpness of scores."""

    def __init__(self, models: Models, limits: np.ndarray, sharpness: float):
        self.models, self.limits, self.sharpness = models, limits, sharpness

    def decide(self, texts: list[str | None]):
        """Language number (-1: none), score, bits per character and acceptance of each text."""
        if not self.models.names:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        bits, number = self.models.bits(texts)
        each = bits / np.maximum(number, 1)[:, None]
        best = each.argmin(1)
        low = each[np.arange(len(best)), best]
        share = _shares(each, number, self.sharpness)[np.arange(len(best)), best]
        none = number == 0
        return np.where(none, -1, best), np.where(none, 0.0, share), low, ~none & (low <= self.limits[best])


def _shares(each: np.ndarray, number: np.ndarray, sharpness: float) -> np.ndarray:
    z = -each * np.minimum(number, SCORED)[:, None] * sharpness
    z = np.exp2(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Identifier:
    """Fits to a sample of docs: about sample_docs documents of each language."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    # One row per language; the rows of a language never meet.
    shares = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    names = [r.lang for r in shares]
    spark = docs.sparkSession
    if not names:
        return Identifier(fit([], np.zeros(0, int), np.zeros((0, ORDER), np.uint32), np.zeros(0)), np.zeros(0), 1.0)
    most = spark.createDataFrame([(i, r.lang, min(1.0, sample_docs / r.n)) for i, r in enumerate(shares)], "number int, lang string, share double")
    dice = F.xxhash64("text", "id")
    draw = F.shiftrightunsigned(dice, 12).cast("double") / float(1 << 52)
    chosen = named.join(F.broadcast(most), "lang").where(draw < F.col("share"))
    chosen = written(chosen.select("number", "text", (F.pmod(dice, F.lit(CALIBRATE)) == 0).alias("calibrates")))

    def count():
        def work(batch):
            languages = batch.column(0).to_numpy()
            for x in np.unique(languages).tolist():
                points, at = characters(batch.column(1).filter(pa.array(languages == x)).to_pylist())
                real = np.ones(len(points), dtype=bool)
                real[(at[:-1, None] + np.arange(ORDER - 1)[None, :]).ravel()] = False
                place = np.flatnonzero(real)
                _, first, n = np.unique(_some(points, place, ORDER), return_index=True, return_counts=True)
                chars = np.stack([points[place[first] - k] for k in range(ORDER - 1, -1, -1)], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), x, np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in chars.T), pa.array(n)], names=["number", *(f"c{k}" for k in range(ORDER)), "n"])

        return work

    columns = [f"c{k}" for k in range(ORDER)]
    learn = chosen.where("not calibrates").select("number", "text")
    rows = per_batch(learn, count, f"number int, {', '.join(f'{c} int' for c in columns)}, n long").groupBy("number", *columns).agg(F.sum("n").alias("n")).toArrow()
    models = fit(names, rows["number"].to_numpy().astype(int), np.stack([rows[c].to_numpy() for c in columns], axis=1).astype(np.uint32), rows["n"].to_numpy().astype(float))
    sent = spark.sparkContext.broadcast(models)

    def measure():
        def work(batch):
            bits, number = sent.value.bits(batch.column(1).to_pylist())
            each = bits / np.maximum(number, 1)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(each.tolist(), pa.list_(pa.float64()))], names=["number", "chars", "each"])

        return work

    seen = per_batch(chosen.where("calibrates").select("number", "text"), measure, "number int, chars long, each array<double>").where("chars > 0").toArrow()
    if not seen.num_rows:
        return Identifier(models, np.full(len(names), np.inf), 1.0)
    each, of, chars = np.array(seen["each"].to_pylist()), seen["number"].to_numpy(), seen["chars"].to_numpy()
    own = each[np.arange(len(of)), of]
    limits = np.array([np.quantile(own[of == x], KEEP) if (of == x).any() else np.inf for x in range(len(names))])
    told = {s: float(np.log(np.maximum(_shares(each, chars, s)[np.arange(len(of)), of], 1e-12)).sum()) for s in (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)}
    return Identifier(models, limits, max(told, key=told.get))


def identify(docs: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """docs with columns lang_pred, score, bits_per_char and accepted (not rejected)."""
    sent = docs.sparkSession.sparkContext.broadcast(identifier)
    names = [*identifier.models.names, UNKNOWN]
    fields = [T.StructField(free_name(docs, n), k) for n, k in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits_per_char", T.DoubleType()), ("accepted", T.BooleanType()))]

    def make():
        def work(texts):
            best, score, low, accepted = sent.value.decide(texts.to_pylist())
            return [pa.array([names[b] for b in best.tolist()], pa.string()), pa.array(score), pa.array(low), pa.array(accepted)]

        return work

    return with_columns(docs, text_col, fields, make)


def op5(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_char, accepted of all of `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    found = identify(docs.select("doc_id", "text"), train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_char", "accepted")
