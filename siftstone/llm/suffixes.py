"""Suffix-array dedup: bytes that lie in a string of `window` bytes which also starts in a document with a smaller id.

Suffixes are sorted over the cluster as a sample sort does it: splitters are taken from a bounded sample, each task sorts its
suffixes and cuts them at the splitters, and each bucket is sorted again by multikey quicksort: by the leading eight bytes,
then what ties by the next key, and so on. Equal strings are neighbours then, the one with the smallest id first. Splitters
are whole keys down to the id, so a string that a third of all rows have is dealt over several buckets like any other; where a
run of equal strings goes on in the next bucket, the buckets' edges are compared at the end.

Not every suffix is sorted twice over. The first sort has, of every `window` bytes, the suffix whose first `seed` bytes have the
smallest hash (the last one of equals), so equal strings choose a suffix at the same place. Its keys are the leading bytes, a
hash of the other bytes of the seed, one of the whole stretch of bytes that the suffix was chosen for, and the id. A stretch
that is a neighbour of an equal one with a smaller id is gone with all its strings. Where suffixes with one seed differ in
their stretches, a shorter string may still be common: of every such stretch the first occurrence is cut into all of its
strings, and the second sort has the suffixes that begin with those, by leading bytes, a hash of all `window` bytes, and id.

Rows carry keys and places only, packed by bucket; texts are read again, by document, to cut stretches and to remove bytes.
Hashes have 64 bits and stand for what they are taken of. A bucket has about BUCKET_ROWS suffixes at any size of the input,
and the sample SAMPLE_ROWS of them; it only decides where buckets end.

Defined cases: texts are their UTF-8 bytes and of any length; a null or empty text, and one shorter than the window, has
nothing removed; a null id is later than all others, and null ids are equal; rows that repeat an id, with the same text or
another one, are not earlier than each other; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .shared import MAX_ID, per_batch, releasing, small_batches, swept, table, written
from .textcols import SLICE, U, buffers, byte_hashes, mixed, slices

WINDOW, SEED = 50, 20
BUCKET_ROWS, SAMPLE_ROWS, SAMPLE_DOCS = 1_000_000, 100_000, 2_000
#: Suffixes that a task sorts and cuts at a time.
HELD = 1 << 19
#: A place packs 26 bits of the text's hash, 31 of the first string's byte and 6 of the number of strings after it.
SIGN_BITS, FIRST_BITS, MORE_BITS = 26, 31, 6

#: Keys of a suffix in order: leading bytes, what follows in the seed, the whole string or stretch, id; and its place.
COLUMNS = ["lead", "rest", "tail", "id", "place"]
PACKED = ["lead", "rest", "tail", "number", "place", "ids", "signs"]
GONE, DOUBT, PENDING, EDGE = range(4)


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order by several keys: by the first, then in each run of equals by the next, and only there."""
    order = np.argsort(keys[0], kind="stable")
    value = keys[0][order]
    tied = np.r_[False, value[1:] == value[:-1]] if len(order) else np.zeros(0, bool)
    for key in keys[1:]:
        at = np.flatnonzero(tied | np.r_[tied[1:], False])
        if not len(at):
            break
        run = np.cumsum(~tied[at])
        inner = np.lexsort((key[order[at]], run))
        order[at] = order[at][inner]
        value = key[order[at]]
        tied[at] &= np.r_[False, value[1:] == value[:-1]]
    return order


def _words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers in the order of the bytes; beyond the end there are zeros."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    return padded[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)


def _anchors(data: np.ndarray, offsets: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of the suffixes chosen in each text: text, first and last string that chose it, and the keys lead, rest, tail."""
    hashed = byte_hashes(data)
    count = np.maximum(0, np.diff(offsets) - window + 1)
    text = np.repeat(np.arange(len(count)), count)
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, none, *[none.view(np.uint64)] * 3
    first = np.arange(len(text)) + np.repeat(offsets[:-1] - np.r_[0, np.cumsum(count)[:-1]], count)
    at = np.arange(len(data) - seed + 1)
    low = (hashed(at, at + seed) & ~U(0xFFFFFFFF)) | (U(0xFFFFFFFF) - at.astype(np.uint64))
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
    tail = mixed(hashed(begin, last + window) ^ mixed(shape + U(1)))
    return text[edge], begin, last, _words_at(data, where), hashed(where + 8, where + seed) >> U(32), tail


def _places(sign, first, more) -> np.ndarray:
    return sign.astype(np.int64) << FIRST_BITS + MORE_BITS | first.astype(np.int64) << MORE_BITS | more.astype(np.int64)


def _keyed(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers in the same order; done twice, it gives the ids."""
    return ids.view(np.uint64) ^ U(1 << 63)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> MORE_BITS & (1 << FIRST_BITS) - 1, place & (1 << MORE_BITS) - 1


def _signed(rows: DataFrame) -> DataFrame:
    """rows (id, place) as (id, sign, places), a row for each text."""
    return rows.select("id", F.shiftrightunsigned("place", FIRST_BITS + MORE_BITS).alias("sign"), "place").groupBy("id", "sign").agg(F.collect_list("place").alias("places"))


def _chosen(window: int, seed: int):
    """A batch (id, sign, text) as the columns of its chosen suffixes."""

    def work(batch):
        ids, signs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = buffers(batch.column(2))
        for i, j in slices(offsets, SLICE):
            own = offsets[i : j + 1] - offsets[i]
            text, begin, last, *keys = _anchors(data[offsets[i] : offsets[j]], own, window, seed)
            yield [*keys, _keyed(ids[i:j][text]), _places(signs[i:j][text], begin - own[text], last - begin).view(np.uint64)]

    return work


def _strings(window: int):
    """A batch (id, place, stretch) as the columns of the suffixes that begin with each string of a stretch."""

    def work(batch):
        ids, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        raw = batch.column(2).cast(pa.large_binary())
        _, offsets, data = raw.buffers()
        offsets = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data, offsets = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
        for i, j in slices(offsets, SLICE):
            own, part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            count = np.diff(part) - window + 1
            row = np.repeat(np.arange(j - i), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = part[:-1][row] + step
            first, _ = _unpacked(places[i:j][row])
            sign = places[i:j][row] >> FIRST_BITS + MORE_BITS
            yield [_words_at(own, at), np.zeros(len(at), np.uint64), byte_hashes(own)(at, at + window), _keyed(ids[i:j][row]), _places(sign, first + step, np.zeros_like(step)).view(np.uint64)]

    return work


def _pack(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes: of sorted and of small ones, most planes shrink to nothing when they are shuffled."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _cuts(keys: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """Where sorted rows of keys would have each splitter (a row of as many keys)."""
    out = np.empty(len(splitters), np.int64)
    lows, highs = np.searchsorted(keys[0], splitters[:, 0]), np.searchsorted(keys[0], splitters[:, 0], "right")
    for n, (s, lo, hi) in enumerate(zip(splitters, lows.tolist(), highs.tolist(), strict=True)):
        for key, value in zip(keys[1:], s[1:], strict=True):
            if lo == hi:
                break
            part = key[lo:hi]
            lo, hi = lo + int(np.searchsorted(part, value)), lo + int(np.searchsorted(part, value, "right"))
        out[n] = lo
    return out


def _splitters(source: DataFrame, work, rows: float, share: float) -> np.ndarray:
    """Keys that part all rows, of which there are about so many, into buckets of BUCKET_ROWS; from a sample of that share of source."""
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    if buckets == 1:
        return np.zeros((0, 4), np.uint64)
    step = max(1, int(rows * share) // SAMPLE_ROWS)

    def make():
        def run(batch):
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c[::step].view(np.int64)) for c in columns[:4]], names=COLUMNS[:4])

        return run

    part = source.sample(share, 42) if share < 1 else source
    found = [c.to_numpy().view(np.uint64) for c in per_batch(part, make, ", ".join(f"{c} long" for c in COLUMNS[:4])).toArrow().columns]
    if not len(found[0]):
        return np.zeros((0, 4), np.uint64)
    order = multikey_order(found)
    return np.stack(found, axis=1)[order[np.linspace(0, len(order), buckets + 1)[1:-1].astype(np.int64)]]


def _judged(columns: list[np.ndarray], below: np.ndarray | None, above: np.ndarray | None, several: bool):
    """A bucket's rows (kind, columns): what is gone, in doubt, or to be compared across the boundaries, which the splitters below and above are."""
    order = multikey_order(columns[:4])
    lead, rest, tail, ids, place = (c[order] for c in columns)
    n = len(lead)
    seed = np.r_[True, (lead[1:] != lead[:-1]) | (rest[1:] != rest[:-1])]
    run = seed | np.r_[True, tail[1:] != tail[:-1]]
    number, start = np.cumsum(run) - 1, np.flatnonzero(run)
    lowest = ids[start]
    yield GONE, [c[ids > lowest[number]] for c in (lead, rest, tail, ids, place)]
    own = ids == lowest[number]
    same = lambda at, splitter, keys: splitter is not None and all(c[at] == s for c, s in zip((lead, rest, tail), splitter[:keys], strict=False))
    if same(0, below, 3):
        at = np.flatnonzero(own & (number == 0))
        yield PENDING, [c[at] for c in (lead, rest, tail, ids, place)]
    if same(n - 1, above, 3):
        at = start[-1:]
        yield EDGE, [c[at] for c in (lead, rest, tail, ids, place)]
    if several:
        group = np.flatnonzero(seed[start])
        doubt = np.minimum.reduceat(lowest, group) < np.maximum.reduceat(lowest, group)
        doubt[0] |= same(0, below, 2)
        doubt[-1] |= same(n - 1, above, 2)
        at = np.flatnonzero(own & doubt[np.cumsum(seed) - 1])
        yield DOUBT, [c[at] for c in (lead, rest, tail, ids, place)]


def _sorted(source: DataFrame, work, splitters: np.ndarray, several: bool) -> tuple[DataFrame, DataFrame]:
    """What is gone, and what is in doubt, as (id, place), of the suffixes that work makes of source. several: rows with one seed can differ in tail."""
    small_batches(source.sparkSession)

    def cut(batches):
        held, size = [], 0

        def emit():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            order = multikey_order(columns[:4])
            columns = [c[order] for c in columns]
            at = np.r_[0, _cuts(columns[:4], splitters), len(order)]
            for bucket in np.flatnonzero(at[1:] > at[:-1]).tolist():
                *keys, ids, place = (c[at[bucket] : at[bucket + 1]] for c in columns)
                sign = place >> U(FIRST_BITS + MORE_BITS)
                # Each document once, and its number with each suffix.
                _, some, number = np.unique(mixed(ids) ^ sign, return_index=True, return_inverse=True)
                yield bucket, *map(_pack, (*keys, number.astype(np.uint64), place & U((1 << FIRST_BITS + MORE_BITS) - 1), ids[some], sign[some]))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * len(PACKED)], strict=True)], names=["bucket", *PACKED])

        for batch in batches:
            for columns in work(batch):
                held.append(columns)
                size += len(columns[0])
                if size >= HELD:
                    yield batch_of(list(emit()))
                    held, size = [], 0
        if size:
            yield batch_of(list(emit()))

    def judge(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *keys, number, place, ids, sign = (_unpack(x) for x in raw)
                number = number.astype(np.int64)
                held.setdefault(bucket, []).append([*keys, ids[number], sign[number] << U(FIRST_BITS + MORE_BITS) | place])
        for bucket in sorted(held):
            columns = [np.concatenate(c) for c in zip(*held.pop(bucket), strict=True)]
            below, above = splitters[bucket - 1] if bucket else None, splitters[bucket] if bucket < len(splitters) else None
            for kind, found in _judged(columns, below, above, several):
                found[3] = _keyed(found[3])
                for s in range(0, len(found[0]), 1 << 16):
                    part = [pa.array(c[s : s + (1 << 16)].view(np.int64)) for c in found]
                    if kind in (GONE, DOUBT):
                        part[:3] = [pa.nulls(len(part[0]), pa.int64())] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *part], names=["kind", *COLUMNS])

    packed = source.mapInArrow(releasing(cut), "bucket int, " + ", ".join(f"{c} binary" for c in PACKED))
    dealt = packed.repartitionById(len(splitters) + 1, F.col("bucket")) if len(splitters) else packed.coalesce(1)
    found = written(dealt.mapInArrow(releasing(judge), "kind int, " + ", ".join(f"{c} long" for c in COLUMNS)))
    swept(source.sparkSession)
    # At most a row for each boundary.
    edges = found.where(F.col("kind") == EDGE).groupBy("lead", "rest", "tail").agg(F.min("id").alias("lowest"))
    late = found.where(F.col("kind") == PENDING).join(F.broadcast(edges), ["lead", "rest", "tail"]).where("id > lowest")
    return found.where(F.col("kind") == GONE).select("id", "place").unionByName(late.select("id", "place")), found.where(F.col("kind") == DOUBT).select("id", "place")


def _stretches(docs: DataFrame, window: int) -> DataFrame:
    """(id, place, stretch) of the places of docs (id, sign, text, places)."""

    def make():
        def work(batch):
            data, offsets = buffers(batch.column(2))
            data, lists = data.tobytes(), batch.column(3)
            count = lists.value_lengths().to_numpy()
            places = lists.flatten().to_numpy()
            first, more = _unpacked(places)
            at = offsets[:-1].repeat(count) + first
            ids = batch.column(0).to_numpy().repeat(count)
            for s in range(0, len(at), 1 << 15):
                e = s + (1 << 15)
                cut = [data[x:y] for x, y in zip(at[s:e].tolist(), (at[s:e] + more[s:e] + window).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e]), pa.array(places[s:e]), pa.array(cut, pa.binary())], names=["id", "place", "stretch"])

        return work

    return per_batch(docs, make, "id long, place long, stretch binary")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The keyed documents (id, sign, doc_id, text), and (id, sign, places): strings of each document that start in an earlier one."""
    if not 8 <= seed <= window or window - seed >= 1 << MORE_BITS:
        raise ValueError("the seed has to have 8 bytes and fit in the window, and a stretch few enough strings")
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID))
    sign = F.hash(F.coalesce(text_col, F.lit(""))).bitwiseAND(F.lit((1 << SIGN_BITS) - 1)).cast("long")
    keyed = docs.select(number.alias("id"), sign.alias("sign"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    source = keyed.select("id", "sign", "text")
    size: Row = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    suffixes = (size["bytes"] or 0) * 2 / (window - seed + 2)
    work = _chosen(window, seed)
    gone, doubt = _sorted(source, work, _splitters(source, work, suffixes, min(1.0, SAMPLE_DOCS / max(1, size["n"]))), True)
    cut = written(_stretches(source.join(_signed(doubt), ["id", "sign"]), window))
    swept(docs.sparkSession)
    n = cut.agg(F.count("*").alias("n"), F.sum(F.octet_length("stretch") - window + 1).alias("strings")).first()
    work = _strings(window)
    share = min(1.0, 10 * SAMPLE_DOCS / max(1, n["n"]))
    single, _ = _sorted(cut, work, _splitters(cut, work, n["strings"] or 0, share), False)
    return keyed, _signed(gone.unionByName(single))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, kept: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed ranges of bytes), and with kept what is left, as bytes."""
    keyed, places = repeats(docs, id_col, text_col, window, seed)
    joined = keyed.join(places, ["id", "sign"], "left").select("doc_id", "text", "places")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def work(batch):
            data, offsets = buffers(batch.column(1))
            out = []
            for i, found in enumerate(batch.column(2)):
                own = data[offsets[i] : offsets[i + 1]]
                spans: list[tuple[int, int]] = []
                if found.is_valid:
                    first, more = _unpacked(found.values.to_numpy())
                    depth = np.zeros(len(own) + 1, np.int64)
                    np.add.at(depth, first, 1)
                    np.add.at(depth, first + more + window, -1)
                    inside = np.cumsum(depth[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
                    spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                    body = own[~inside].tobytes()
                else:
                    body = own.tobytes()
                out.append((len(own), len(own) - len(body), len(spans), hashlib.sha256(body).hexdigest(), [{"start": s, "end": e} for s, e in spans], *([body] if kept else [])))
            kinds = [pa.int64()] * 3 + [pa.string(), span, *([pa.binary()] if kept else [])]
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

        return work

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if kept else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(joined, make, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>" + ", kept binary" * kept)


def op12(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all of `documents`."""
    found = without_repeats(table(spark, sf_dir, "documents"), kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The same by the definition, over all strings; bytes are pairs of hexadecimal digits.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS s FROM d WHERE length(h) >= 100),
wins AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 100)) AS w FROM starts),
firsts AS (SELECT w, min(doc_id) AS first FROM wins GROUP BY w HAVING count(*) > 1),
gone AS (SELECT doc_id, s FROM wins JOIN firsts USING (w) WHERE first < doc_id),
marked AS (SELECT doc_id, s, coalesce(s > 50 + lag(s) OVER (PARTITION BY doc_id ORDER BY s), true) AS new FROM gone),
grouped AS (SELECT doc_id, s, sum(CAST(new AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM marked),
spans AS (SELECT doc_id, g, min(s) AS s, max(s) + 50 AS e FROM grouped GROUP BY doc_id, g),
gaps AS (SELECT doc_id, g, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM spans),
cut AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY g) || substr(any_value(h), 2 * max(e) + 1) AS kept, sum(e - s) AS n_removed, count(*) AS n_spans
        FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
