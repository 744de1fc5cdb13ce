"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint has 64 bits, each the majority of that bit over the hashes of the text's features. Two texts are linked
when their fingerprints differ in at most `radius` bits; a class is a connected component of links.

Pigeonring: split into m segments on a ring. If two fingerprints differ in at most r bits, then from some segment on,
every chain of l consecutive segments differs in at most l*r/m bits. With m > r the first segment of that chain is equal,
and the second differs in at most 2r/m bits, so (start, first, second) is the key of the candidate search; the longer
chains prune candidates before the full Hamming check.

Only distinct fingerprints are compared, so copies cost nothing. A key's fingerprints are compared in one task, and leave
it as a spanning forest, never as all pairs. Keys with more than KEY_LIMIT fingerprints go another exact way: every
fingerprint in them is joined on all points within half the radius of it, since two are within the radius exactly when
they share such a point; each point links its fingerprints to the smallest.

Defined cases: a text of any length is one fingerprint of all its words; a null or empty text, and one without words, has fingerprint zero and links like any other; ties of a bit
(exactly half) give 0; null ids belong to classes but never name one that has another id; repeated rows are in one class;
an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shared import MAX_ID, free_name, releasing, small_batches, swept, table, with_columns, written
from .textcols import LOWER, Sequences, U, buffers, mixed, slices, word_hashes, words

RADIUS, SHINGLE = 2, 3
SEGMENTS = 5
KEY_LIMIT = 2048
#: Of the pipeline's stage: the words of a shingle, and the similarity of shingle sets from which texts are near copies.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
#: Common shingles come last in prefixes: those that STAGE_OFTEN texts and more have of one in STAGE_SAMPLE, at most MOST_COMMON.
#: They only set the order, so which ones are known changes no result.
STAGE_SAMPLE, STAGE_OFTEN, MOST_COMMON = 16, 16, 500_000
#: Texts with one shingle in their prefixes that are compared as pairs; more are linked to the first.
STAGE_PAIRS = 512
#: Documents of a class that are judged at a time, and tasks over which the others of a class are spread.
STAGE_HEADS, STAGE_SALTS = 128, 64

def _majority(hashes: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """The fingerprint of each range of hashes; 0 where it is empty."""
    out = np.zeros(len(pointers) - 1, dtype=np.uint64)
    full = np.flatnonzero(pointers[1:] > pointers[:-1])
    if len(full):
        bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1)  # the same order of bits as in packbits below
        ones = np.add.reduceat(bits, pointers[:-1][full], axis=0, dtype=np.int32)
        size = (pointers[1:] - pointers[:-1])[full]
        out[full] = np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64).ravel()
    return out


def shingle_fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Features: k words in lower case, joined by a space, by their XXH64 with seed 42; fewer words count as one feature."""
    low = LOWER[data]
    starts, ends, before = words(low, offsets)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.uint64)
    size = ends - starts
    begin = np.r_[0, np.cumsum(size + 1)[:-1]]
    line = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    inside = np.repeat(starts - begin, size)
    place = np.repeat(begin, size) + np.arange(len(inside)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
    line[place] = low[place + inside]
    end = begin + size
    number = np.diff(before)
    count = np.where(number >= k, number - k + 1, np.minimum(number, 1))
    at = np.r_[0, np.cumsum(count)]
    first = np.repeat(before[:-1] - at[:-1], count) + np.arange(at[-1])
    last = first + np.repeat(np.minimum(number, k), count) - 1
    whole, hashed = line.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((hashed(whole[s:e], 42) for s, e in zip(begin[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
    return _majority(hashes, at)


def fingerprints(df: DataFrame, text_col: str = "text", **hows) -> DataFrame:
    """df with columns of fingerprints as signed longs, by name how each is made. All are made in one pass, by one Python worker."""

    def make():
        def work(texts):
            data, offsets = buffers(texts)
            parts = [[how(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for how in hows.values()] for i, j in slices(offsets)]
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0, np.uint64)] * len(hows)
            return [pa.array(c.view(np.int64)) for c in columns]

        return work

    return with_columns(df, text_col, [T.StructField(n, T.LongType()) for n in hows], make)


def _bounds(m: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / m) for i in range(m + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _segment(fp, bounds: tuple[int, int]):
    return F.shiftrightunsigned(fp, bounds[0]).bitwiseAND(F.lit((1 << bounds[1] - bounds[0]) - 1))


def _keys(fps: DataFrame, radius: int, m: int, probes: bool) -> DataFrame:
    """(key, fp, node) for each start of a chain; with probes also for the second segments that differ in as many bits as the chain allows."""
    bounds = _bounds(m)
    rows = []
    for i, own in enumerate(bounds):
        nxt = bounds[(i + 1) % m]
        for flip in [0, *(1 << b for b in range(nxt[1] - nxt[0]))] if probes and 2 * radius // m else [0]:
            rows.append(F.shiftleft(_segment(F.col("fp"), own), 24).bitwiseOR(_segment(F.col("fp"), nxt).bitwiseXOR(F.lit(flip))).bitwiseOR(F.lit(i << 56)))
    return fps.select(F.explode(F.array(*rows)).alias("key"), "fp", "node")


def _near(fp: np.ndarray, start: int, radius: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions whose fingerprints, sharing the key of this start, are within radius."""
    bounds, n = _bounds(m), len(fp)
    a, b = [], []
    block = max(1, (1 << 21) // n)
    for top in range(0, n, block):
        x, y = np.nonzero(np.arange(top, min(n, top + block))[:, None] < np.arange(n)[None, :])
        x += top
        differ, spent = fp[x] ^ fp[y], 0
        for length in range(2, m + 1):
            low, high = bounds[(start + length - 1) % m]
            spent = spent + np.bitwise_count(differ >> U(low) & U((1 << high - low) - 1))
            ok = spent <= length * radius // m
            if not ok.all():
                x, y, differ, spent = x[ok], y[ok], differ[ok], spent[ok]
        ok = np.bitwise_count(differ) <= radius
        a.append(x[ok])
        b.append(y[ok])
    return np.concatenate(a), np.concatenate(b)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the first position of each component to its others."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = np.flatnonzero(low != np.arange(n))
    return low[moved], moved


def _compared(radius: int, m: int):
    """Rows (key, fp, node), sorted by key, into links (a, b) of nodes."""

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            cols = [np.concatenate([h, c.view(h.dtype)]) for h, c in zip(held, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            held = tuple(c[last:] for c in cols)
            yield from found(*(c[:last] for c in cols))
        yield from found(*held)

    def found(key, fp, node):
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[at, len(key)])
        two = at[size == 2]
        pair = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        a, b = [node[two[pair]]], [node[two[pair] + 1]]
        for s, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = _near(fp[s : s + n], int(key[s]) >> 56, radius, m)
            if len(x):
                x, y = _forest(n, x, y)
                a.append(node[s + x])
                b.append(node[s + y])
        a, b = np.concatenate(a), np.concatenate(b)
        keep = a != b
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def star_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links of the nodes of fingerprints (fp, node) by shared points within half the radius; radius is even."""
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    signed = [x - 2**64 if x >= 2**63 else x for x in masks]
    points = fps.select("fp", "node", F.explode(F.transform(F.array(*map(F.lit, signed)), lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    lowest = points.groupBy("point").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    return points.join(lowest, "point").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def links(prints: DataFrame, radius: int = RADIUS, m: int = SEGMENTS, limit: int = KEY_LIMIT) -> DataFrame:
    """Links (a, b) of nodes that connect the rows (fp, node) as all pairs do that are within radius. Keys with more than limit rows go the other exact way."""
    if radius % 2 or m <= radius or 2 * radius // m > 1:
        raise ValueError("the radius has to be even, the segments more than the radius")
    data, probes = _keys(prints, radius, m, False), _keys(prints, radius, m, True)
    compare = lambda rows: rows.select("key", "fp", "node").repartition("key").sortWithinPartitions("key").mapInArrow(releasing(_compared(radius, m)), "a long, b long")
    hot = written(data.groupBy("key").count().where(F.col("count") > limit).select("key"))
    if hot.isEmpty():
        return compare(probes)
    return compare(probes.join(hot, "key", "left_anti")).unionByName(star_links(probes.join(hot, "key", "left_semi").select("fp", "node").distinct(), radius))


def classes(prints: DataFrame, radius: int = RADIUS, m: int = SEGMENTS, limit: int = KEY_LIMIT) -> DataFrame:
    """(fp, first, component_id) of each distinct fingerprint of (doc_id, fp): the smallest id with it, and of its class."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp", F.col("fp").alias("node")), radius, m, limit)).select(F.col("node").alias("fp"), "root")
    labelled = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return labelled.join(names, "root").select("fp", "first", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how=shingle_fingerprints, radius: int = RADIUS, m: int = SEGMENTS) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    prints = written(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", fp=how).select("doc_id", "fp"))
    return prints.join(classes(prints, radius, m).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op6(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all of `documents`."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: pa.Array, k: int = STAGE_SHINGLE) -> list[np.ndarray]:
    """The set of hashes of k-word shingles of each text, in lower case and in order; a shorter text is one shingle."""
    data, offsets = buffers(texts)
    low = LOWER[data]
    starts, ends, before = words(low, offsets)
    seq, out = Sequences(word_hashes(low, starts, ends)), []
    for s, e in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        first = np.arange(s, max(e - k + 1, min(s + 1, e)))
        out.append(np.unique(seq.of(first, np.minimum(first + k, e))))
    return out


class Heads:
    """Shingle sets with postings, to tell whether a set has a Jaccard similarity of SIMILARITY and more to any of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        keys, of = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(keys, kind="stable")
        self.keys, self.of = keys[order], of[order]

    def has_similar(self, own: np.ndarray) -> bool:
        if not len(own):
            return bool((self.sizes == 0).any())
        begin, end = np.searchsorted(self.keys, own), np.searchsorted(self.keys, own, "right")
        size = end - begin
        hits = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        both = np.bincount(self.of[hits], minlength=len(self.sizes))
        return bool((both >= SIMILARITY * (self.sizes + len(own) - both) - 1e-9).any())


def first_ones(texts: pa.Array) -> np.ndarray:
    """Which texts aren't similar to any text before them that isn't so itself."""
    sets, heads, out = shingle_sets(texts), [], []
    for own in sets:
        out.append(not heads or not Heads(heads).has_similar(own))
        if out[-1]:
            heads.append(own)
    return np.array(out, dtype=bool)


def _prefix(n):
    """How many shingles of n, in any order that all texts share, hold one that a text of SIMILARITY or more also has among its own first ones."""
    return n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1


def _may_be_similar(n, m, differ):
    """Whether sets of n and m shingles, of which at least differ are in one only, can reach SIMILARITY."""
    return (np.minimum(n, m) >= SIMILARITY * np.maximum(n, m) - 1e-9) & ((1 + SIMILARITY) * differ <= (1 - SIMILARITY) * (n + m) + 1e-9)


def _sketch(own: np.ndarray) -> bytes:
    """For each residue of the hashes whether an odd number of them has it; a power of two of bits, as many as hashes at least.

    Sketches of two sets differ in no more bits than there are hashes in one set only.
    """
    size = max(64, 1 << max(0, len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & U(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the other."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    short, long, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        long = long >> bits ^ long & (1 << bits) - 1
    return (short ^ long).bit_count()


#: Rows of the candidate search, by kind: a shingle in a prefix (x: shingle, y: text, z: its place and the number of shingles),
#: one that is common (x, y), a link to judge without further look (x, y: texts), a pair (x < y), a sketch (x: text, y: number of shingles).
_RARE, _COMMON, _LINK, _PAIR, _SKETCH = range(5)
_ROWS = "kind int, x long, y long, z long, sketch binary"


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    """One batch of (kind, x, y, z or None, sketches or None)."""
    size = [len(x) for _, x, *_ in parts]
    column = lambda k: np.concatenate([np.zeros(0, np.int64), *(np.zeros(n, np.int64) if p[k] is None else np.ascontiguousarray(p[k]).view(np.int64) for p, n in zip(parts, size, strict=True))])
    sketches = pa.chunked_array([pa.array([None] * n if p[4] is None else p[4], pa.binary()) for p, n in zip(parts, size, strict=True)], pa.binary()).combine_chunks()
    kinds = np.repeat(np.array([p[0] for p in parts], np.int32), size)
    return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(column(k)) for k in (1, 2, 3)), sketches], names=["kind", "x", "y", "z", "sketch"])


def _to_first(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys with the smallest node of each, and distinct links of the other nodes to it."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    first = np.repeat(node[at], np.diff(np.r_[at, len(key)]))
    own = first != node
    pairs = np.unique(np.c_[first[own], node[own]], axis=0)
    return key[at], node[at], pairs[:, 0], pairs[:, 1]


def common_shingles(bodies: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of the texts of a sample, in order of their hashes, and how many texts of the sample have each."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch["text"])
            sign = np.repeat(batch["_st"].to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)), pa.array(sign)], names=["x", "st"])

    some = bodies.where(F.pmod("_st", F.lit(STAGE_SAMPLE)) == 0).select("_st", "text").dropDuplicates(["_st"])
    counts = some.mapInArrow(releasing(run), "x long, st long").groupBy("x").count().where(F.col("count") >= STAGE_OFTEN)
    found = counts.orderBy(F.desc("count"), "x").limit(MOST_COMMON).toArrow()
    key, count = found["x"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(key)
    return key[order], count[order]


def _posted(common: tuple[np.ndarray, np.ndarray]):
    """Texts (_st, text) into rows of their prefixes and sketches. Of a common shingle, the texts of a batch are linked to the first of them, which alone is posted."""
    keys, counts = common

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            signs, fresh = batch["_st"].to_pylist(), []
            for i, s in enumerate(signs):
                if s not in seen:
                    seen.add(s)
                    fresh.append(i)
            if not fresh:
                continue
            sets = shingle_sets(batch["text"].take(pa.array(fresh)))
            node = np.array([signs[i] for i in fresh], dtype=np.int64)
            size = np.array([len(x) for x in sets], dtype=np.int64)
            # Texts without words are one: they share a key that no shingle has but by chance.
            rare, hot = [], []
            for own, n in zip(sets, _prefix(size).tolist(), strict=True):
                if not len(own):
                    own, n = np.zeros(1, np.uint64), 1
                often = np.zeros(len(own), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    often = np.where(keys[at] == own, counts[at], 0)
                first = own[np.argsort(often, kind="stable")[:n]] if often.any() else own[:n]
                cut = min(n, int(np.count_nonzero(often == 0)))
                rare.append(first[:cut])
                hot.append(first[cut:])
            long = np.array([len(x) for x in rare])
            place = np.concatenate([np.arange(n) for n in long])
            key, first, a, b = _to_first(np.concatenate(hot).view(np.int64), np.repeat(node, [len(x) for x in hot]))
            yield _rows([
                (_RARE, np.concatenate(rare), np.repeat(node, long), np.repeat(size, long) << 32 | place, None),
                (_COMMON, key, first, None, None),
                (_LINK, a, b, None, None),
                (_SKETCH, node, size, None, [_sketch(x) for x in sets]),
            ])

    return run


def _paired(batches):
    """Rows of prefixes, sorted by kind, shingle and text, into pairs and links; links and sketches pass."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        kind, x = now["kind"].to_numpy(), now["x"].to_numpy()
        last = len(kind) and int(np.flatnonzero((kind != kind[-1]) | (x != x[-1]))[-1] + 1) if len(kind) and ((kind != kind[-1]) | (x != x[-1])).any() else 0
        yield _pairs_of(now.slice(0, last))
        held = now.slice(last).combine_chunks()
        held = held.to_batches()[0] if held.num_rows else None
    if held is not None:
        yield _pairs_of(pa.Table.from_batches([held]))


def _pairs_of(rows: pa.Table) -> pa.RecordBatch:
    kind, x, y, z = (rows[c].to_numpy() for c in ("kind", "x", "y", "z"))
    passing = np.flatnonzero(kind == _LINK), np.flatnonzero(kind == _SKETCH)
    parts = [(_LINK, x[passing[0]], y[passing[0]], None, None), (_SKETCH, x[passing[1]], y[passing[1]], None, rows["sketch"].combine_chunks().take(pa.array(passing[1])))]
    common = kind == _COMMON
    parts.append((_LINK, *_to_first(x[common], y[common])[2:], None, None))
    rare = np.flatnonzero(kind == _RARE)
    rare = rare[np.r_[True, (x[rare][1:] != x[rare][:-1]) | (y[rare][1:] != y[rare][:-1])]] if len(rare) else rare
    key, node, size, place = x[rare], y[rare], z[rare] >> 32, z[rare] & 0xFFFFFFFF
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    number = np.diff(np.r_[at, len(key)])
    two = at[number == 2]
    left, right = [two], [two + 1]
    for s, n in zip(at[number > 2].tolist(), number[number > 2].tolist(), strict=True):
        if n > STAGE_PAIRS:
            parts.append((_LINK, np.full(n - 1, node[s]), node[s + 1 : s + n], None, None))
        else:
            i, j = np.triu_indices(n, 1)
            # The shingles before the first that two texts share are in one of them only.
            ok = _may_be_similar(size[s + i], size[s + j], place[s + i] + place[s + j])
            left.append(s + i[ok])
            right.append(s + j[ok])
    left, right = np.concatenate(left), np.concatenate(right)
    ok = _may_be_similar(size[left], size[right], place[left] + place[right])
    pairs = np.unique(np.c_[node[left[ok]], node[right[ok]]], axis=0)
    parts.append((_PAIR, pairs[:, 0], pairs[:, 1], None, None))
    return _rows(parts)


def _verified(batches):
    """Pairs (a, n, own, b, m, other) with sketches into the links (a, b) of those that may be similar."""
    for batch in batches:
        apart = np.array([_apart(p, q) for p, q in zip(batch["own"].to_pylist(), batch["other"].to_pylist(), strict=True)], dtype=np.int64)
        ok = _may_be_similar(batch["n"].to_numpy(), batch["m"].to_numpy(), apart)
        yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])


def text_links(bodies: DataFrame) -> DataFrame:
    """Links (a, b) between the texts of (_st, text), by their signs, that connect all pairs of SIMILARITY and more.

    Exact prefix filter: of shingle sets in one order, two that similar share a shingle among their first ones. Pairs that
    share one are held to what their places, sizes and sketches allow, none of which leaves out a similar pair.
    """
    small_batches(bodies.sparkSession)
    posted = bodies.select("_st", "text").mapInArrow(releasing(_posted(common_shingles(bodies))), _ROWS)
    found = written(posted.repartition("kind", "x").sortWithinPartitions("kind", "x", "y").mapInArrow(releasing(_paired), _ROWS))
    pairs = written(found.where(F.col("kind") == _PAIR).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    # Copies of a text in several tasks have equal sketches.
    sketches = found.where(F.col("kind") == _SKETCH).groupBy("x").agg(F.first("y").alias("n"), F.first("sketch").alias("own"))
    rows = pairs.join(sketches.withColumnRenamed("x", "a"), "a").join(sketches.select(F.col("x").alias("b"), F.col("n").alias("m"), F.col("own").alias("other")), "b")
    near = rows.mapInArrow(releasing(_verified), "a long, b long")
    return near.unionByName(found.where(F.col("kind") == _LINK).select(F.col("x").alias("a"), F.col("y").alias("b")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one of each group of near copies: in order of ids, a document goes if its five-word shingles have a similarity
    of 0.8 and more with those of an earlier document of its class that stays.

    Classes are components of links that connect every pair of that similarity, whatever its fingerprints (text_links, by an exact
    prefix filter); links of near fingerprints would only join classes that have no such pair between them. Documents of a class
    that aren't similar to any of its first ones are judged again among themselves until none is left. Of repeated rows, one stays; null
    texts are empty ones, null ids the last ones; an empty table gives no rows; extra columns stay.
    """
    swept(spark)
    number, sign = F.coalesce(F.col("doc_id"), F.lit(MAX_ID)), F.xxhash64(F.coalesce("text", F.lit("")))
    bodies = docs.select(number.alias("_sd"), sign.alias("_st"), "text")
    prints = bodies.select("_sd", "_st")
    # One row per text: all its further documents are copies.
    texts = written(prints.groupBy("_st").agg(F.min("_sd").alias("_sd")))
    roots = components(text_links(bodies.withColumn("text", F.coalesce("text", F.lit("")))))
    open_ = written(texts.join(roots.select(F.col("node").alias("_st"), F.col("root").alias("class")), "_st").select("class", "_sd", "_st"))
    dropped = []
    if not open_.isEmpty():
        open_ = written(open_.join(bodies.dropDuplicates(["_sd", "_st"]), ["_sd", "_st"]).select("class", "_sd", "_st", F.coalesce("text", F.lit("")).alias("text")))
    kind = "class long, _sd long, _st long, text string, stays boolean"

    def among(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_sd", "ascending"), ("_st", "ascending")]).combine_chunks()
        return rows.append_column("stays", pa.array(first_ones(rows["text"].combine_chunks())))

    def against(rows: pa.Table, heads: pa.Table) -> pa.Table:
        known = Heads(shingle_sets(heads["text"].combine_chunks())) if heads.num_rows else None
        stays = [known is None or not known.has_similar(x) for x in shingle_sets(rows["text"].combine_chunks())] if rows.num_rows else []
        return rows.drop_columns("salt").append_column("stays", pa.array(stays, pa.bool_()))

    # Of each class the first STAGE_HEADS documents are judged among themselves, then all others against those that stay.
    while not open_.isEmpty():
        rank = F.row_number().over(Window.partitionBy("class").orderBy("_sd", "_st"))
        first = written(open_.withColumn("rank", rank).where(F.col("rank") <= STAGE_HEADS).drop("rank").groupBy("class").applyInArrow(among, kind))
        others = open_.join(first.select("class", "_sd", "_st"), ["class", "_sd", "_st"], "left_anti").withColumn("salt", F.pmod("_st", F.lit(STAGE_SALTS)))
        # A large class meets its heads in many tasks; they are sent to those where it has documents.
        others = written(others.select("class", "_sd", "_st", "text", "salt"))
        heads = others.select(F.col("class").alias("of"), F.col("salt").alias("at")).distinct().join(first.where("stays").select(F.col("class").alias("of"), F.col("text").alias("text")), "of")
        rest = written(others.groupBy("class", "salt").cogroup(heads.groupBy("of", "at")).applyInArrow(against, kind))
        dropped += [part.where("not stays").select("_sd", "_st") for part in (first, rest)]
        open_ = rest.where("stays").drop("stays")
    # What stays: the first document of each text, unless it was found similar.
    keep = texts.select("_sd", "_st")
    if dropped:
        keep = keep.join(reduce(DataFrame.unionByName, dropped), ["_sd", "_st"], "left_anti")
    sd, st = free_name(docs, "_sd"), free_name(docs, "_st")
    keyed = docs.withColumns({sd: number, st: sign})
    kept = keyed.join(keep.select(F.col("_sd").alias(sd), F.col("_st").alias(st)), [sd, st], "left_semi")
    repeated = written(prints.groupBy(F.col("_sd").alias(sd), F.col("_st").alias(st)).count().where("count > 1").drop("count"))
    if not repeated.isEmpty():
        kept = kept.join(repeated, [sd, st], "left_anti").unionByName(kept.join(repeated, [sd, st], "left_semi").dropDuplicates([sd, st]))
    return kept.select(docs.columns)
