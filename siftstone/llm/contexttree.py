"""Context-tree weighting over bytes: code lengths of whole texts, from a tree trained on the corpus.

A text is coded byte by byte in lower case (A-Z), with one end symbol behind it. A byte is eight binary decisions, from
its highest bit on; each decision has a tree of its own over the DEPTH bytes before it. Every node estimates its
decision by Krichevsky-Trofimov, (n1 + 1/2) / (n + 1), and mixes its own estimate with that of the longer context by the
weight that context-tree weighting gives it: P_w = (P_e + product of the children's P_w) / 2, so all depths are mixed.
A text is scored by the trained tree as it stands; where a longer context never occurred, the path ends at the last one
that did.

How it is spread: a gram is a byte with its context, packed in 64 bits at most, the nearest context byte on top.
1. Documents fall into blocks of about BLOCK_BYTES by a hash. Each block counts its grams and its words once, in sorted
   arrays, so a frequent gram is one row per block, however often it occurs.
2. Counts are added up by gram, which keeps the list of its blocks. The tree's depths from KEY_DEPTH on are made where
   all grams of one KEY_DEPTH-byte context meet; what is above has at most 256 * 255 nodes and is sent to all.
3. Each gram's logarithm of probability goes back to its blocks, and each block adds up its documents' grams.

The base figure is a unigram model of words with one added to each count, computed along the same way.

Defined cases: a text of any length is counted and scored whole, in slices that don't change its grams; texts that tie
score alike; a null text counts as empty; an empty one is the end symbol alone; without documents to learn from each
decision costs one bit, and the base uses counts of zero; repeated rows score alike; a null id counts as the empty text
for the fold; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import released, releasing, remainder, small_batches, table, written
from .textcols import LOWER, Lookup, U, buffers, counted, merged, slices, summed, word_hashes, words

DEPTH = 5
KEY_DEPTH = 2
BLOCK_BYTES = 32 << 20
FOLDS, HELD_OUT = 7, 2
#: Entries that a task counts before it adds equal ones up, and grams of which a task makes subtrees at a time.
HELD_ENTRIES, CHUNK = 2 << 20, 1 << 17
#: Bytes that are counted at a time: larger pieces repeat more.
PIECE = 1 << 20
#: Never part of UTF-8.
END = 255
GRAM, WORD = 0, 1


def grams(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """All grams of the texts in order; text i has those from offsets[i] + i on, one more than it has bytes."""
    n, size = len(offsets) - 1, np.diff(offsets)
    line = np.zeros(len(data) + n * (depth + 1), dtype=np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(n) * (depth + 1) + depth, size)
    line[place] = LOWER[data]
    ends = offsets[1:] + np.arange(n) * (depth + 1) + depth
    line[ends] = END
    wide = line.astype(np.uint64)
    out = wide[depth:].copy()
    for k in range(1, depth + 1):
        out |= wide[depth - k : len(wide) - k] << U(8 * (depth + 1 - k))
    real = np.ones(len(out), dtype=bool)
    # What stands before a text's first byte is context only.
    pad = (offsets[1:-1] + np.arange(1, n) * (depth + 1))[:, None] + np.arange(depth)[None, :] - depth
    real[pad.ravel()] = False
    return out[real]


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""

    def gamma(x):
        y = x + 4.0
        return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(x * (x + 1) * (x + 2) * (x + 3))

    return gamma(zeros + 0.5) + gamma(ones + 0.5) - gamma(zeros + ones + 1.0) - math.log(math.pi)


def own_share(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Weight of a node's own estimate against those of longer contexts, from the logarithms of both probabilities."""
    return 1.0 / (1.0 + np.exp(np.clip(below - own, -700, 700)))


class _Decisions:
    """The nodes of one depth, by decision: rows are distinct (context, byte), in order; each decision's nodes are runs of rows."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, count: np.ndarray):
        self.first, self.run, self.zeros, self.ones = [], [], [], []
        self.symbol, self.count = symbol, count
        for j in range(1, 9):
            prefix = symbol >> j
            new = np.r_[True, (context[1:] != context[:-1]) | (prefix[1:] != prefix[:-1])]
            first = np.flatnonzero(new)
            bit = symbol >> (j - 1) & 1
            self.first.append(first)
            self.run.append(np.cumsum(new) - 1)
            self.ones.append(np.add.reduceat(count * bit, first))
            self.zeros.append(np.add.reduceat(count * (1 - bit), first))

    def estimate(self, j: int) -> np.ndarray:
        """By row: the probability of its bit, nan where the node was never trained."""
        ones, total = self.ones[j - 1], self.ones[j - 1] + self.zeros[j - 1]
        p = np.where(total > 0, (ones + 0.5) / (total + 1), np.nan)[self.run[j - 1]]
        return np.where(self.symbol >> (j - 1) & 1, p, 1 - p)


def subtrees(keys: np.ndarray, count: np.ndarray, depth: int = DEPTH, key_depth: int = KEY_DEPTH):
    """For distinct grams in order, all of whose key contexts are complete: per decision each gram's probability at key_depth (nan: never trained), and the nodes there (number of the decision, first gram, zeros, ones, log P_w)."""
    symbol = (keys & U(255)).astype(np.int64)
    rows, p, below, last = None, [None] * 8, [None] * 8, None
    for d in range(depth, key_depth - 1, -1):
        context = keys >> U(8 * (depth + 1 - d))
        number = np.cumsum(np.r_[False, context[1:] != context[:-1]])
        if d == depth:
            place, level = np.arange(len(keys)), _Decisions(number, symbol, count)
        else:
            pair, place = np.unique(number << 8 | symbol, return_inverse=True)
            level = _Decisions(pair >> 8, pair & 255, np.bincount(place, weights=count, minlength=len(pair)))
            above = np.empty(len(last[0].symbol), np.int64)  # rows of the depth below to rows of this one
            above[rows] = place
        for j in range(1, 9):
            own = log_kt(level.zeros[j - 1], level.ones[j - 1])
            guess = level.estimate(j)[place]
            if d == depth:
                p[j - 1], weighted = guess, own
            else:
                longer = np.bincount(level.run[j - 1][above[last[0].first[j - 1]]], weights=below[j - 1], minlength=len(own))
                share = own_share(own, longer)[level.run[j - 1]][place]
                p[j - 1] = np.where(np.isnan(p[j - 1]), guess, share * guess + (1 - share) * p[j - 1])
                weighted = math.log(0.5) + np.logaddexp(own, longer)
            below[j - 1] = weighted
        rows, last = place, (level,)
    gram = np.empty(len(last[0].symbol), np.int64)
    gram[rows[::-1]] = np.arange(len(keys))[::-1]  # the first gram of each row
    nodes = [(j, gram[last[0].first[j - 1]], last[0].zeros[j - 1], last[0].ones[j - 1], below[j - 1]) for j in range(1, 9)]
    return p, nodes


class Top:
    """The depths 0 and 1, in full arrays by nearest context byte and node (256 + byte) >> j."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray):
        own = log_kt(zeros, ones)
        weighted = math.log(0.5) + np.logaddexp(own, longer)
        root = zeros.sum(0), ones.sum(0)
        share = own_share(log_kt(*root), weighted.sum(0))
        self.nodes = [(zeros, ones, own_share(own, longer)), (root[0][None, :], root[1][None, :], share[None, :])]

    def log10(self, keys: np.ndarray, p: list[np.ndarray], depth: int = DEPTH) -> np.ndarray:
        """log10 of each gram's probability, from those at depth 2."""
        nearest, symbol = (keys >> U(8 * depth)).astype(np.int64), (keys & U(255)).astype(np.int64)
        out = np.zeros(len(keys))
        for j in range(1, 9):
            now = p[j - 1]
            for (zeros, ones, share), at in zip(self.nodes, (nearest, 0 * nearest), strict=True):
                h, bit = (256 + symbol) >> j, symbol >> (j - 1) & 1
                n0, n1, s = zeros[at, h], ones[at, h], share[at, h]
                guess = (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1)
                now = np.where(n0 + n1 > 0, np.where(np.isnan(now), guess, s * guess + (1 - s) * now), now)
            out += np.log10(np.where(np.isnan(now), 0.5, now))
        return out


def _counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(block, kind, key, n) of docs (block, held, text): n occurrences in training texts, which may be zero."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}

        def flush():
            for (block, kind), parts in held.items():
                keys, n = merged(parts)
                size = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block, np.int32)), pa.array(np.full(size, kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["block", "kind", "key", "n"])
            held.clear()

        entries = 0
        for batch in batches:
            blocks, out = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for block in np.unique(blocks).tolist():
                for off in (False, True):
                    data, offsets = buffers(batch.column(2).filter(pa.array((blocks == block) & (out == off))))
                    for i, j in slices(offsets, PIECE):
                        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                        low = LOWER[part]
                        starts, ends, _ = words(low, at)
                        for kind, values in ((GRAM, grams(part, at, depth)), (WORD, word_hashes(low, starts, ends))):
                            keys, n = counted(values)
                            held.setdefault((block, kind), []).append((keys, 0 * n if off else n))
                            entries += len(keys)
            if entries > HELD_ENTRIES:
                for at, parts in held.items():
                    held[at] = [merged(parts)]
                entries = sum(len(parts[0][0]) for parts in held.values())
                if entries > HELD_ENTRIES // 2:
                    yield from flush()
                    entries = 0
        yield from flush()

    return docs.repartition("block").mapInArrow(releasing(run), "block int, kind int, key long, n long")


def _chunks(batches, depth: int):
    """Batches of (key, n, blocks) in order of keys, as tables in which every key context is complete."""
    kept: list[pa.RecordBatch] = []
    size, enough = 0, CHUNK
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        size += batch.num_rows
        if size >= enough:
            whole = pa.Table.from_batches(kept)
            context = whole["key"].to_numpy() >> 8 * (depth + 1 - KEY_DEPTH)
            cut = int(np.searchsorted(context, context[-1]))
            if cut:
                yield whole.slice(0, cut)
            kept = whole.slice(cut).combine_chunks().to_batches()
            size -= cut
            enough = max(CHUNK, 2 * size)  # a context that is larger is put together a few times only
    if size:
        yield pa.Table.from_batches(kept)


def _tops(depth: int):
    """Sums of the nodes at depth 2 by nearest byte: (at, zeros, ones, weighted), at = nearest * 256 + node."""

    def run(batches):
        sums = np.zeros((3, 1 << 16))
        for chunk in _chunks(batches, depth):
            keys = chunk["key"].to_numpy().view(np.uint64)
            for j, first, *values in subtrees(keys, chunk["n"].to_numpy().astype(float), depth)[1]:
                at = (keys[first] >> U(8 * depth)).astype(np.int64) << 8 | (256 + (keys[first] & U(255)).astype(np.int64)) >> j
                for total, v in zip(sums, values, strict=True):
                    total += np.bincount(at, weights=v, minlength=1 << 16)
        used = np.flatnonzero(sums[0] + sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(x[used]) for x in sums)], names=["at", "zeros", "ones", "weighted"])

    return run


def log_probabilities(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, value, blocks) of (key, n, blocks): each gram's log10 of its probability under the tree of all counts."""
    spark = counts.sparkSession
    context = F.shiftright("key", 8 * (depth + 1 - KEY_DEPTH))
    met = counts.repartition(context).sortWithinPartitions("key")
    rows = met.select("key", "n").mapInArrow(releasing(_tops(depth)), "at long, zeros double, ones double, weighted double")
    top = rows.groupBy("at").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).toArrow()
    full = np.zeros((3, 1 << 16))
    full[:, top["at"].to_numpy()] = [top[c].to_numpy() for c in ("zeros", "ones", "weighted")]
    sent = spark.sparkContext.broadcast(full)

    def run(batches):
        tree = Top(*(x.reshape(256, 256) for x in sent.value))
        for chunk in _chunks(batches, depth):
            keys = chunk["key"].to_numpy().view(np.uint64)
            value = tree.log10(keys, subtrees(keys, chunk["n"].to_numpy().astype(float), depth)[0], depth)
            yield from pa.table({"key": chunk["key"], "value": value, "blocks": chunk["blocks"]}).to_batches()

    return met.mapInArrow(releasing(run), "key long, value double, blocks array<int>")


def code_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learns=None, block_bytes: int = BLOCK_BYTES, depth: int = DEPTH) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    learns: a condition on docs' columns, true for documents to learn from; all by default. depth: bytes of context, from 2 to 7.
    """
    if not KEY_DEPTH <= depth <= 7:
        raise ValueError("the depth has to be from 2 to 7, so that a gram fits 64 bits")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = ~F.coalesce(learns, F.lit(False)) if learns is not None else F.lit(False)
    keyed = docs.select(F.col(id_col).alias("id"), held.alias("held"), text.alias("text"))
    about = keyed.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held")).alias("docs")).first()
    n_blocks, train_docs = max(1, math.ceil((about["bytes"] or 0) / block_bytes)), about["docs"]
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int"))
    # A key's blocks are at most one per BLOCK_BYTES of input.
    summed_up = written(_counts(keyed.select("block", "held", "text"), depth).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks")))
    known = summed_up.where(f"kind = {WORD}")
    vocabulary = known.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    tokens, distinct = (vocabulary["n"] or 0) + train_docs, vocabulary["v"] + (train_docs > 0)
    values = log_probabilities(summed_up.where(f"kind = {GRAM}").select("key", "n", "blocks"), depth).withColumn("kind", F.lit(GRAM))
    values = values.unionByName(known.select(F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value"), "blocks"))
    values = values.select(F.explode(F.array_distinct("blocks")).alias("block"), "kind", "key", "value")

    def work(texts: pa.Table, found: pa.Table) -> pa.Table:
        kind = found["kind"].to_numpy()
        keys, value = found["key"].to_numpy().view(np.uint64), found["value"].to_numpy()
        by_gram, by_word = (Lookup(keys[kind == k]) for k in (GRAM, WORD))
        length, count = value[kind == GRAM], np.r_[value[kind == WORD], 0.0]
        logs = np.log10((count + 1) / (tokens + distinct + 1))
        end = math.log10((train_docs + 1) / (tokens + distinct + 1))
        out = []
        for batch in texts.combine_chunks().to_batches():
            data, offsets = buffers(batch.column(batch.schema.get_field_index("text")))
            for i, j in slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                n = np.arange(j - i + 1)
                score = summed(length[by_gram.find(grams(part, at, depth))], at + n)
                low = LOWER[part]
                starts, ends, before = words(low, at)
                place = by_word.find(word_hashes(low, starts, ends))
                base = summed(logs[place], before) + end
                seen = summed((count[place] > 0).astype(np.int64), before) + int(train_docs > 0)
                out.append((np.diff(before) + 1, seen, np.full(j - i, tokens), base, score, np.diff(at), score / -math.log10(2) / (np.diff(at) + 1)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 7
        del by_gram, by_word, keys, value, kind, length, count, logs
        released()
        names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
        return pa.table({"id": texts["id"], "held_out": texts["held"], **{k: pa.array(c, pa.float64() if k in ("base_score", "score", "bits_per_byte") else pa.int64()) for k, c in zip(names, columns, strict=True)}})

    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType)]).simpleString()[7:-1]
    schema = f"{kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return keyed.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(work, schema).withColumnRenamed("id", id_col)


def op2(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of all of `documents`."""
    return code_lengths(table(spark, sf_dir, "documents"), learns=remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
