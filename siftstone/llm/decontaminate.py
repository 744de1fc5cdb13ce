"""Benchmark decontamination: every training passage queries a BM25 index of test items by block-max WAND.

Test items are cut into segments of at most SEGMENT words, the documents of the index. Training texts are cut into passages
of PASSAGE words that begin every STRIDE words, so each stretch of SEGMENT words lies within a passage. A passage's
distinct words are the query; a segment's score is the sum of its BM25 impacts for them, over that of all its own words: the
share of its weight that the passage covers. All segments of at least THRESHOLD are retrieved:

- a word's upper bound is its largest impact in any segment. Passages whose words' bounds don't reach the threshold end here;
- pivot: of a passage's words in order of their bounds, those before the sum reaches the threshold can't bring a segment in
  alone; only lists of the others are opened;
- lists have blocks of BLOCK segments with their largest impacts; only blocks whose sum over all the passage's words
  reaches the threshold are scored.

All of it works on arrays of many passages at a time, and leaves out nothing that reaches the threshold. What was retrieved
is verified: of the item's question, then of its answer, the share of words that lie in sequences of SHINGLE words which the
text has as well. The answer is what follows the last question mark, or else the last sentence; an item that is one
sentence is all question.

The index goes to every task in parts of at most INDEX_BYTES of test items, one after another; word statistics are
those of all items together. Texts are never moved.

Defined cases: words are runs of letters and digits, in lower case (A-Z); a text or item that is null or without words
matches nothing; texts and items of any length are read whole; items of fewer than SHINGLE words are compared as one
sequence; items that share an id are all found, of those in one text the best overlap counts; items without an id are one
item with a null id; items that tie are in order of ids; repeated rows match alike; empty tables give no rows. Other columns
pass by unread, and one that has the name of the new column makes that get an underscore.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import MAX_ID, free_name, per_batch, swept, table, with_columns
from .textcols import LOWER, Lookup, Sequences, U, buffers, slices, word_hashes, words

PASSAGE, STRIDE, SEGMENT = 128, 64, 60
K1, B = 1.2, 0.75
THRESHOLD, BLOCK = 0.5, 64
SHINGLE, QUESTION, ANSWER = 5, 0.8, 0.5
INDEX_BYTES = 16 << 20

INSIDE = np.zeros(256, dtype=bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words before each text."""
    low = LOWER[data]
    starts, ends, before = words(low, offsets, INSIDE)
    return word_hashes(low, starts, ends), before


def answer_begins(text: str) -> int:
    """Where the answer of an item begins; its length if it has none."""
    end = text.rstrip()
    marks = [m.end() for m in re.finditer(r"\?", end)]
    if marks and marks[-1] < len(end):
        return marks[-1]
    marks = [m.end() for m in re.finditer(r"[.!?](?=\s)", end)]
    return marks[-1] if marks else len(text)


def segments(items: DataFrame) -> DataFrame:
    """(item_id, part, number, term, tf, length): words of each segment of items (item_id, part, text, variant); segments are numbered within an item, apart for each of its texts."""

    def make():
        def work(batch):
            hashes, before = hashed(*buffers(batch.column(2)))
            ids, parts, variants = (batch.column(i).to_pylist() for i in (0, 1, 3))
            rows = []
            for i, (s, e) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
                for number, at in enumerate(range(s, e, SEGMENT), variants[i] << 24):
                    terms, tf = np.unique(hashes[at : min(e, at + SEGMENT)], return_counts=True)
                    rows += [(ids[i], parts[i], number, t, n, int(tf.sum())) for t, n in zip(terms.view(np.int64).tolist(), tf.tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item_id", "part", "number", "term", "tf", "length"])

        return work

    return per_batch(items, make, "item_id long, part int, number long, term long, tf int, length int")


class Index:
    """Impacts by word and segment, as shares of what the segment's own words add up to; largest ones by word and by block; and the items' words for verification."""

    def __init__(self, rows: pa.Table, items: list[tuple[int, str]], segments_in_all: int, mean_length: float):
        keys = list(zip(rows["item_id"].to_pylist(), rows["number"].to_pylist(), strict=True))
        order = {k: i for i, k in enumerate(sorted(set(keys)))}
        self.item_of = np.array([k[0] for k in order], dtype=np.int64)
        segment = np.array([order[k] for k in keys], dtype=np.int64)
        term, tf, length, df = (rows[c].to_numpy() for c in ("term", "tf", "length", "df"))
        idf = np.log(1 + (segments_in_all - df + 0.5) / (df + 0.5))
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean_length, 1e-9)))
        self.own = np.bincount(segment, weights=impact, minlength=len(order))
        terms, place = np.unique(term.view(np.uint64), return_inverse=True)
        self.lookup = Lookup(terms)
        at = np.lexsort((segment, place))
        self.segment, self.share = segment[at], (impact / self.own[segment])[at]
        self.blocks = max(1, -(-len(order) // BLOCK))
        key = place[at] * self.blocks + self.segment // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        #: Blocks of all lists in order of word and block: key, largest share, first posting and the end.
        self.key, self.most = key[first], np.maximum.reduceat(self.share, first) if len(first) else np.zeros(0)
        self.post = np.r_[first, len(key)]
        self.lists = np.searchsorted(self.key, np.arange(len(terms) + 1) * self.blocks)
        self.bound = np.maximum.reduceat(self.most, self.lists[:-1]) if len(terms) else np.zeros(0)
        self.texts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            cut = len(text[: answer_begins(text)].encode())
            hashes, _ = hashed(data, np.array([0, len(raw)]))
            self.texts.setdefault(item, []).append((hashes, len(hashed(data[:cut], np.array([0, cut]))[0])))

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, segment, share) of all segments that reach the threshold; input: distinct pairs in order of passage."""
        # The passages whose bounds reach the threshold.
        new = np.r_[True, passage[1:] != passage[:-1]] if len(passage) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        enough = np.bincount(group, weights=self.bound[term])[group] >= threshold - 1e-9 if len(group) else new
        passage, term = passage[enough], term[enough]
        none = np.zeros(0, np.int64)
        if not len(passage):
            return none, none, np.zeros(0)
        # Pivot: words of each passage in order of their bounds.
        at = np.lexsort((self.bound[term], passage))
        passage, term = passage[at], term[at]
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        total = np.cumsum(self.bound[term])
        before = np.repeat(np.r_[0.0, total[first[1:] - 1]], np.diff(np.r_[first, len(passage)]))
        opens = np.flatnonzero(total - before >= threshold - 1e-9)
        # Blocks of the opened lists, each once per passage.
        size = self.lists[term[opens] + 1] - self.lists[term[opens]]
        block = self.key[_ranges(self.lists[term[opens]], size)] % self.blocks
        pair = np.unique(np.repeat(passage[opens], size) * self.blocks + block)
        out = [(none, none, np.zeros(0))]
        step = max(1, (1 << 22) // (2 * PASSAGE))
        begin, end = np.searchsorted(passage, pair // self.blocks), np.searchsorted(passage, pair // self.blocks, "right")
        for lo in range(0, len(pair), step):
            now, s, n = pair[lo : lo + step], begin[lo : lo + step], (end - begin)[lo : lo + step]
            row, words_ = np.repeat(np.arange(len(now)), n), term[_ranges(s, n)]
            key = words_ * self.blocks + (now % self.blocks)[row]
            place = np.searchsorted(self.key, key).clip(max=len(self.key) - 1)
            ok = self.key[place] == key
            row, place = row[ok], place[ok]
            live = np.bincount(row, weights=self.most[place], minlength=len(now)) >= threshold - 1e-9
            row, place = row[live[row]], place[live[row]]
            size = self.post[place + 1] - self.post[place]
            posting = _ranges(self.post[place], size)
            key, number = np.unique(np.repeat(now[row] // self.blocks, size) * len(self.own) + self.segment[posting], return_inverse=True)
            share = np.bincount(number, weights=self.share[posting], minlength=len(key))
            good = share >= threshold - 1e-9
            out.append((key[good] // len(self.own), key[good] % len(self.own), share[good]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def verified(self, item: int, text: np.ndarray) -> tuple[float, float]:
        """Shares of the words of an item's question and answer that lie in sequences which the text (hashes of words) has; of repeated items the best."""
        best = (0.0, 0.0)
        for hashes, cut in self.texts[item]:
            n = min(SHINGLE, len(hashes))
            if not n or len(text) < n:
                continue
            at, here = np.arange(len(hashes) - n + 1), np.arange(len(text) - n + 1)
            found = np.isin(Sequences(hashes).of(at, at + n), Sequences(text).of(here, here + n))
            covered = np.convolve(found, np.ones(n)) > 0
            question = float(covered[:cut].mean()) if cut else 1.0
            best = max(best, (question, float(covered[cut:].mean()) if cut < len(hashes) else 1.0))
        return best


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """The index in parts, made one after another; each holds at most about index_bytes of items, and one item at least."""
    texts = items.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID)).alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    parts = max(1, math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / index_bytes))
    texts = texts.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int"))
    # Texts that share an id are all indexed, each once.
    variant = F.row_number().over(Window.partitionBy("item_id").orderBy(F.xxhash64("text"), "text"))
    postings = segments(texts.select("item_id", "part", "text", variant.cast("long").alias("variant")))
    lengths = postings.select("item_id", "number", "length").distinct().agg(F.count("*"), F.avg("length")).first()
    weighed = postings.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term")
    for part in range(parts):
        rows = weighed.where(F.col("part") == part).select("item_id", "number", "term", "tf", "length", "df").toArrow()
        own = [(r.item_id, r.text) for r in texts.where(F.col("part") == part).select("item_id", "text").distinct().collect()]
        if rows.num_rows:
            yield Index(rows, own, lengths[0], lengths[1])


def leaks(index: Index, texts: pa.Array) -> list[list[dict]]:
    """Verified items of each text."""
    data, offsets = buffers(texts)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for i, j in slices(offsets):
        hashes, before = hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if not len(hashes):
            continue
        found = index.lookup.find(hashes)
        number = np.diff(before)
        # Passages: stretches of STRIDE words in a text; a passage is a stretch and the next one.
        stretches = np.maximum(1, -(-number // STRIDE))
        base = np.r_[0, np.cumsum(stretches)]
        known = np.flatnonzero(found >= 0)
        text = np.searchsorted(before, known, "right") - 1
        own, term = base[text] + (known - before[text]) // STRIDE, found[known].astype(np.int64)
        # Bounds with repeated words counted: too high, but cheap.
        loose = np.bincount(own, weights=index.bound[term], minlength=base[-1])
        last = np.zeros(base[-1], dtype=bool)
        last[base[1:] - 1] = True
        loose[~last] += loose[1:][~last[:-1]]
        live = loose >= THRESHOLD - 1e-9
        first = np.zeros(base[-1], dtype=bool)
        first[base[:-1]] = True
        here, back = live[own], np.r_[False, live[:-1]][own] & ~first[own]
        pairs = np.unique(np.r_[own[here] << 32 | term[here], own[back] - 1 << 32 | term[back]])
        passage, segment, share = index.retrieve(pairs >> 32, pairs & 0xFFFFFFFF)
        best: dict[tuple[int, int], float] = {}
        for d, item, s in zip((np.searchsorted(base, passage, "right") - 1).tolist(), index.item_of[segment].tolist(), share.tolist(), strict=True):
            best[d, item] = max(best.get((d, item), 0.0), s)
        for (d, item), s in sorted(best.items()):
            question, answer = index.verified(item, hashes[before[d] : before[d + 1]])
            if question >= QUESTION and answer >= ANSWER:
                out[i + d].append({"item_id": None if item == MAX_ID else item, "score": s, "question_overlap": question, "answer_overlap": answer})
    return out


LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("score", "question_overlap", "answer_overlap"))]))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.float64()) for n in ("score", "question_overlap", "answer_overlap"))]))


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", out: str = "leaks", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs with an array of the test items that each text contains: item_id, score (largest share of a segment's weight), question_overlap, answer_overlap."""
    name = free_name(docs, out)
    k = 0
    # The driver holds one part at a time; what it sent is on its disk and with the tasks.
    for index in indexes(items, index_bytes=index_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        del index

        def make(sent=sent):
            return lambda texts: [pa.array(leaks(sent.value, texts), _ARROW)]

        part = free_name(docs, f"{out}_part")
        docs = with_columns(docs, text_col, [T.StructField(part if k else name, LEAKS)], make)
        if k:
            docs = docs.withColumn(name, F.array_sort(F.concat(name, part))).drop(part)
        k += 1
    swept(docs.sparkSession)
    return docs if k else docs.withColumn(name, F.array().cast(LEAKS))


def op8(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of all items of `benchmark` that documents contain."""
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that contain a test item. A null text stays; repeated rows stay or go together; without items all stay; extra columns stay."""
    swept(spark)
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size(found.columns[-1]) == 0).select(docs.columns)
