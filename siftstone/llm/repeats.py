"""Substring dedup by seed and extend: repeats of at least `window` words, across and within documents.

Seeds are winnowed: of every `window` consecutive words, the sequence of `seed` words with the smallest hash is chosen (the
last one of equals), so equal windows choose the same seed at the same place. The windows that choose a seed are its
stretch. Documents are joined on seeds that occur more than once. A stretch that occurs earlier as a whole extends the
match as far as it goes at once: all its windows are repeats. Where a seed's stretches differ, the match ends somewhere
inside, and there the windows are compared one by one. Neighbouring repeated windows merge to maximal repeats, whose words
are removed.

Groups of any size cost one row per occurrence: each occurrence is compared with the first of its group only, and firsts
are aggregated before the shuffle. Rows carry hashes and places; texts are read again, partitioned by document, to compare
windows and to cut words out.

Earlier means a smaller id, or the same document and an earlier start. Defined cases: a text of any length is cut and
read whole; of stretches with equal hashes the later seed is chosen; a null or empty text has no words; a
null id is later than all others; rows that repeat an id are ordered by a hash of their text, and rows that repeat both
count as one document, as none is earlier than the other; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MAX_ID, per_batch, spread_join, table, written
from .textcols import SLICE, Sequences, U, buffers, mixed, slices, word_hashes, words

WINDOW, SEED = 20, 6

#: A place packs 28 bits of the text's hash, 31 of the first window's word and 4 of the number of windows after it.
SIGN_BITS, MORE_BITS = 28, 4


def _stretches(data: np.ndarray, offsets: np.ndarray, window: int, seed: int):
    """Per seed chosen in each text: text, first window, last window, hash of the seed, hash of the stretch; also the words and their hashes."""
    starts, ends, before = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    seq = Sequences(hashes)
    number = np.diff(before)
    count = np.maximum(0, number - window + 1)
    text = np.repeat(np.arange(len(count)), count)
    first = np.arange(len(text)) + np.repeat(before[:-1] - np.r_[0, np.cumsum(count)[:-1]], count)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), (starts, ends, before, seq)
    at = np.arange(len(hashes) - seed + 1)
    seeds = seq.of(at, at + seed)
    # The smallest of a window's seeds by hash, then by the later place.
    low = (seeds & ~U(0xFFFFFFFF)) | (U(0xFFFFFFFF) - at.astype(np.uint64))
    width, have = window - seed + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    chosen = (U(0xFFFFFFFF) - (low[first] & U(0xFFFFFFFF))).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    begin, last, where = first[edge], first[np.r_[edge[1:], len(first)] - 1], chosen[edge]
    shape = ((where - begin) << 32 | (last - begin)).astype(np.uint64)
    return text[edge], begin, last, seeds[where], mixed(seq.of(begin, last + window) ^ mixed(shape + U(1))), (starts, ends, before, seq)


def _places(sign: np.ndarray, first: np.ndarray, more: np.ndarray) -> np.ndarray:
    return sign.astype(np.int64) << 35 | first.astype(np.int64) << MORE_BITS | more.astype(np.int64)


def _seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(seed, stretch, id, place) of docs (id, sign, text)."""

    def make():
        def work(batch):
            ids, signs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = buffers(batch.column(2))
            for i, j in slices(offsets, SLICE):
                text, begin, last, h, s, (_, _, before, _) = _stretches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, seed)
                place = _places(signs[i:j][text], begin - before[text], last - begin)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(ids[i:j][text]), pa.array(place)], names=["seed", "stretch", "id", "place"])

        return work

    return per_batch(docs, make, "seed long, stretch long, id long, place long")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(window, id, place) of the windows that docs (id, sign, text, places) name as ranges."""

    def make():
        def work(batch):
            ids, signs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = buffers(batch.column(2))
            lists = batch.column(3)
            for i, j in slices(offsets, SLICE):
                starts, ends, before = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                seq = Sequences(word_hashes(data[offsets[i] : offsets[j]], starts, ends))
                part = lists.slice(i, j - i)
                text = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                first, more = _unpacked(part.flatten().to_numpy())
                text, first = np.repeat(text, more + 1), _filled(first, more)
                at = first + before[text]
                yield pa.RecordBatch.from_arrays([pa.array(seq.of(at, at + window).view(np.int64)), pa.array(ids[i:j][text]), pa.array(_places(signs[i:j][text], first, np.zeros_like(first)))], names=["window", "id", "place"])

        return work

    return per_batch(docs, make, "window long, id long, place long")


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> MORE_BITS & (1 << 31) - 1, place & (1 << MORE_BITS) - 1


def _filled(first: np.ndarray, more: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., first + more of each range."""
    size = more + 1
    return np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _not_first(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows that an equal key precedes, in order of id and place."""
    firsts = rows.groupBy(*key).agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return spread_join(rows, firsts, key, rows.count()).where((F.col("first.id") != F.col("id")) | (F.col("first.place") != F.col("place"))).drop("first")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The keyed documents (id, sign, doc_id, text), and (id, sign, places): ranges of windows of each document that occur earlier."""
    if window - seed >= 1 << MORE_BITS:
        raise ValueError("a stretch has too many windows")
    number, sign = F.coalesce(F.col(id_col), F.lit(MAX_ID)), F.hash(F.coalesce(text_col, F.lit(""))).bitwiseAND(F.lit((1 << SIGN_BITS) - 1)).cast("long")
    keyed = docs.select(number.alias("id"), sign.alias("sign"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _seeds(keyed.select("id", "sign", "text"), window, seed)
    often = written(found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"))
    total = often.agg(F.sum("n").alias("n")).first()["n"] or 0
    shared = written(spread_join(found, often, ["seed"], total, "left_semi"))
    whole = _not_first(shared.select("stretch", "id", "place", "seed"), ["seed", "stretch"]).select("id", "place")
    # Of every stretch the first occurrence, where the seed has several stretches.
    kinds = shared.groupBy("seed", "stretch").agg(F.min(F.struct("id", "place")).alias("first"))
    several = kinds.groupBy("seed").count().where("count > 1").select("seed")
    doubt = kinds.join(several, "seed", "left_semi").select("first.id", "first.place")
    signed = lambda rows: rows.select("id", F.shiftrightunsigned("place", 35).alias("sign"), "place").groupBy("id", "sign").agg(F.collect_set("place").alias("places"))
    compared = _windows(keyed.select("id", "sign", "text").join(signed(doubt), ["id", "sign"]), window)
    single = _not_first(written(compared), ["window"]).select("id", "place")
    return keyed, signed(whole.unionByName(single))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, kept (words joined by a space), n_words, n_removed, spans (maximal repeats as word ranges), kept_sha256."""
    keyed, places = repeats(docs, id_col, text_col, window, seed)
    joined = keyed.join(places, ["id", "sign"], "left").select("doc_id", "text", "places")

    def make():
        def work(batch):
            out = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                parts = (text.as_py() or "").encode().split()
                spans = []
                if found.is_valid:
                    first, more = _unpacked(np.sort(found.values.to_numpy()))
                    for s, e in zip(first.tolist(), (first + more + window).tolist(), strict=True):
                        if spans and s <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], e)
                        else:
                            spans.append([s, e])
                kept, done = [], 0
                for s, e in spans:
                    kept += parts[done:s]
                    done = e
                body = b" ".join([*kept, *parts[done:]] if spans else parts)
                out.append((body.decode(), len(parts), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], hashlib.sha256(body).hexdigest()))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "kept", "n_words", "n_removed", "spans", "kept_sha256"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(joined, make, f"doc_id {kind}, kept string, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string")


def op4(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of all of `documents`."""
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same by the definition, over all windows.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20),
wins AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 19], ' ')) AS h FROM starts),
marked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1 AS again FROM wins),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM marked WHERE again) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(coalesce(places, []), i)), lambda i: words[i]), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
