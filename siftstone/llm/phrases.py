"""Phrase collocation mining: of each language the phrases of two to four words that hold together best, with exact counts.

Texts are split into pieces at punctuation and line ends, pieces into words at blanks. A phrase's count is the number of its
contiguous occurrences within pieces, overlaps included; languages are counted apart.

- Sketch: all phrases of one to four words fall into cells of a count-min sketch of one row, by 48 bits of a hash of 64; it is kept
  sparse, so bounds stay close at any size. Tasks send their cells and counts as packed arrays, a row for each of the buckets into
  which cells are dealt by their leading bits; a bucket adds them up. A cell's sum is an upper bound of each of its phrases: those
  below the least count are out.
- Filter: the other cells go to all tasks as a Bloom filter of 64-bit words, four bits of one word for each cell. It has 32 bits or more
  for a cell up to FILTER_BYTES in all; what it lets through in error is counted with the candidates, exactly, and dropped.
- Counting: a second reading takes the phrases that pass. A task gathers those of its own texts until they are PART_BYTES, or
  the texts TEXT_BYTES; they compile to one pyahocorasick automaton for each language, which scans just these texts. Counts go packed to
  buckets, as cells do, where they are added up by phrase. Patterns begin and end with a blank, and so does each word of the texts,
  with a line end between pieces: a match is a run of whole words of one piece. Words that are in no candidate are left out of the
  scanned text, with a line end in their place; single words, which are no candidates, are counted without an automaton.
- Thresholds, cuts, scores and ranks are sums and joins on phrases. A part of a candidate is as frequent as it at least, so it was
  counted too. Scores are exact: the product is a decimal.

Texts are read twice, however many phrases are frequent, until there are more than CELLS cells: each further CELLS take one more reading.

Defined cases: A-Z are lower-cased, nothing else; a null or empty text has no words; texts and words of any length are taken
whole; a null language is `und`, also for texts that say so; ties of scores go by count, then by the phrase's bytes; rows that
repeat an id or a text count each; an empty table gives no rows. Only text and language are read.
"""

from __future__ import annotations

import math
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import released, releasing, small_batches, swept, table, written
from .textcols import LOWER, Sequences, U, buffers, mixed, slices, word_hashes, words

MOST_WORDS, LEAST, TOP, COVERED = 4, 30, 2000, 80
#: Bytes of text for a bucket of the sketch; phrases that a task holds before it sends them.
BUCKET_BYTES, HELD = 8 << 20, 4 << 20
#: Bits of a packed cell that hold its count; the others are the cell.
COUNT_BITS = 16
MOST_COUNT = (1 << COUNT_BITS) - 1
#: Bytes of a word from which a key stands for it in patterns. Cells of a reading; bytes of the filter; bytes of the patterns, and of the texts, that a task scans at a time.
LONG = 256
CELLS, FILTER_BYTES, PART_BYTES, TEXT_BYTES = 32 << 20, 64 << 20, 8 << 20, 32 << 20

PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
ENDS = np.zeros(256, dtype=bool)
ENDS[list(PIECE_ENDS)] = True
INSIDE = ~ENDS
INSIDE[[0x20, 9]] = False
NONE = "und"


def _language(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 7)


class Grams:
    """The phrases of one to MOST_WORDS words of some texts: hash, first word and number of words; begin and end of all words in lower-case bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: np.ndarray):
        self.low = LOWER[data]
        self.starts, self.ends, self.before = words(self.low, offsets, INSIDE)
        seq = Sequences(word_hashes(self.low, self.starts, self.ends))
        text = np.searchsorted(self.before, np.arange(len(self.starts)), "right") - 1
        # A word's piece: no two pieces of any text share a number.
        piece = np.r_[0, np.cumsum(ENDS[data])][self.starts] + text
        of = mixed(languages[text] + U(1))
        keys, first, size = [], [], []
        for n in range(1, MOST_WORDS + 1):
            at = np.arange(max(0, len(self.starts) - n + 1))
            at = at[piece[at] == piece[at + n - 1]]
            keys.append(mixed(seq.of(at, at + n) ^ of[at]))
            first.append(at)
            size.append(np.full(len(at), n, np.int8))
        self.keys, self.first, self.size = np.concatenate(keys), np.concatenate(first), np.concatenate(size)

    def phrase(self, i: int) -> str:
        at, n = int(self.first[i]), int(self.size[i])
        raw = self.low.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True)).decode()


def _grams(batch):
    """For slices of a batch (lang, text): its languages, and Grams."""
    langs = batch.column(0).to_pylist()
    numbers = {x: _language(x) for x in set(langs)}
    of = np.array([numbers[x] for x in langs], np.uint64)
    data, offsets = buffers(batch.column(1))
    for i, j in slices(offsets):
        yield langs[i:j], Grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], of[i:j])


def _planes(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes: of sorted and of small ones, some planes shrink to nothing when they are shuffled."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _packed(keys: np.ndarray) -> np.ndarray:
    """The cells of some phrases in order, with how many fall into each; a cell of more than MOST_COUNT comes several times."""
    keys = np.sort(keys) >> U(COUNT_BITS)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    number = np.diff(np.r_[at, len(keys)])
    times = -(-number // MOST_COUNT)
    out = np.repeat(keys[at] << U(COUNT_BITS) | U(MOST_COUNT), times)
    out[np.cumsum(times) - 1] -= (times * MOST_COUNT - number).astype(np.uint64)
    return out


def sketch(texts: DataFrame, least: int, lead: int) -> tuple[DataFrame, DataFrame]:
    """(bucket, cells, number) of texts (lang, text): the cells in which phrases can reach least, for each bucket packed, and how many there are; and (lang, n) with the words of each language. A bucket is the lead leading bits of a cell."""
    inner = U(64 - lead)
    small_batches(texts.sparkSession)

    def add(batches):
        held, number, totals = [], 0, {}

        def rows():
            cells = _packed(np.concatenate(held))
            at = np.r_[np.searchsorted(cells, np.arange(1 << lead, dtype=np.uint64) << inner) if lead else 0, len(cells)]
            some = np.flatnonzero(at[1:] > at[:-1]).tolist()
            blobs = [_planes(cells[at[b] : at[b + 1]]) for b in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.int64())], names=["bucket", "cells", "lang", "n"])

        for batch in batches:
            for langs, grams in _grams(batch):
                for lang, n in zip(langs, np.diff(grams.before).tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + n
                held.append(grams.keys)
                number += len(grams.keys)
                if number >= HELD:
                    yield rows()
                    held, number = [], 0
        if number:
            yield rows()
        if totals:
            names, n = list(totals), len(totals)
            yield pa.RecordBatch.from_arrays([pa.array([_language(x) % (1 << lead) for x in names], pa.int32()), pa.nulls(n, pa.binary()), pa.array(names), pa.array(list(totals.values()), pa.int64())], names=["bucket", "cells", "lang", "n"])

    def hot(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, cells, lang, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cells is None:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.nulls(1, pa.binary()), pa.array([lang]), pa.array([n], pa.int64())], names=["bucket", "cells", "lang", "n"])
                else:
                    held.setdefault(bucket, []).append(_numbers(cells))
        for bucket in sorted(held):
            cells = np.sort(np.concatenate(held.pop(bucket)))
            number, cells = (cells & U(MOST_COUNT)).astype(np.int64), cells >> U(COUNT_BITS)
            at = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            found = cells[at[np.add.reduceat(number, at) >= least]] << U(COUNT_BITS)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_planes(found)], pa.binary()), pa.nulls(1, pa.string()), pa.array([len(found)], pa.int64())], names=["bucket", "cells", "lang", "n"])

    schema = "bucket int, cells binary, lang string, n long"
    found = written(texts.mapInArrow(releasing(add), schema).repartitionById(1 << lead, F.col("bucket")).mapInArrow(releasing(hot), schema))
    swept(texts.sparkSession)
    return found.where("cells IS NOT NULL").select("bucket", "cells", F.col("n").alias("number")), found.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))


def _bits(keys: np.ndarray) -> np.ndarray:
    """The bits that a key's cell has in its word of the filter: four, of bits that don't choose the word."""
    one = U(1)
    out = one << (keys >> U(COUNT_BITS) & U(63))
    for i in (6, 12, 18):
        out |= one << (keys >> U(COUNT_BITS + i) & U(63))
    return out


def _of_block(keys: np.ndarray, block: int, blocks: int) -> np.ndarray:
    return mixed(keys >> U(COUNT_BITS)) % U(blocks) == U(block)


def passing(keys: np.ndarray, sent: np.ndarray, block: int, blocks: int) -> np.ndarray:
    """Where the keys are that a filter lets through: all of its own cells, and few others."""
    bits = _bits(keys)
    # One word at least: a shift by all 64 bits isn't defined.
    at = (keys >> U(65 - len(sent).bit_length())).astype(np.int64) if len(sent) > 1 else np.zeros(len(keys), np.int64)
    found = np.flatnonzero(sent[at] & bits == bits)
    return found[_of_block(keys[found], block, blocks)] if blocks > 1 else found


def filters(cells: DataFrame, lead: int, most_cells: int):
    """(block, blocks, filter) for cells (bucket, cells, number) in blocks of about most_cells. A word of the filter is chosen by a cell's leading bits, so each bucket has words of its own."""
    number = cells.agg(F.sum("number")).first()[0] or 0
    blocks = max(1, math.ceil(number / most_cells))
    wide = min(max(1, math.ceil(number / blocks) // 2).bit_length(), (FILTER_BYTES // 8).bit_length() - 1)
    wide = max(wide, lead)
    for block in range(blocks):

        def fill(batches, block=block):
            for batch in batches:
                for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = _numbers(packed)
                    own = own[_of_block(own, block, blocks)]
                    out = np.zeros(1 << (wide - lead), np.uint64)
                    if len(own):
                        at = (own >> U(64 - wide)).astype(np.int64) - (bucket << (wide - lead)) if wide else np.zeros(len(own), np.int64)
                        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                        out[at[first]] = np.bitwise_or.reduceat(_bits(own), first)
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["bucket", "words"])

        parts = cells.select("bucket", "cells").mapInArrow(releasing(fill), "bucket int, words binary").toArrow()
        sent = np.zeros((1 << lead, 1 << (wide - lead)), np.uint64)
        for bucket, raw in zip(parts["bucket"].to_pylist(), parts["words"], strict=True):
            sent[bucket] = np.frombuffer(raw.as_buffer(), np.uint64)
        yield block, blocks, sent.ravel()


class Numbered:
    """Numbers of 64-bit keys in the order in which they came."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of sorted distinct keys, and where those are that are new."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inner = at < len(self.keys)
        known[inner] = self.keys[at[inner]] == keys[inner]
        new = np.flatnonzero(~known)
        out = np.empty(len(keys), np.int64)
        out[known] = self.numbers[at[known]]
        out[new] = len(self.keys) + np.arange(len(new))
        self.keys, self.numbers = np.insert(self.keys, at[new], keys[new]), np.insert(self.numbers, at[new], out[new])
        return out, new


def _copied(out: np.ndarray, to: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
    """Copies ranges of bytes from data to their places in out."""
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + inside] = data[np.repeat(begin, size) + inside]


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[str]:
    """The words in these ranges of bytes."""
    size = end - begin
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    _copied(out, np.cumsum(size + 1) - size - 1, data, begin, size)
    return out.tobytes().decode().split(" ")[:-1]


def _guarded(grams: Grams, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words that are in phrases `longer` as bytes, each between single blanks, with a line end before a word that isn't in a phrase with the one before; these words, and where each begins and ends there. A tab, which no word has, and its key stand for a word of more than LONG bytes: automata are as deep as their longest pattern."""
    linked = np.zeros(len(grams.starts) + 1, bool)  # a word with the one before it
    for n in range(2, MOST_WORDS + 1):
        first = grams.first[longer[grams.size[longer] == n]]
        for i in range(1, n):
            linked[first + i] = True
    own = np.flatnonzero(linked[:-1] | linked[1:])
    opens = ~linked[own]
    size = grams.ends[own] - grams.starts[own]
    long = np.flatnonzero(size > LONG)
    size[long] = 17
    ends = np.cumsum(size + 1 + 2 * opens) - 1
    begins = ends - size
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    out[begins[opens] - 2] = 0x0A
    _copied(out, begins, grams.low, grams.starts[own], size)
    for i in long.tolist():
        out[begins[i] : ends[i]] = np.frombuffer(b"\t%016x" % int(grams.keys[own[i]]), np.uint8)
    return out, own, begins, ends


class Part:
    """What a task counts at a time: texts and candidates of each language, and how often each word occurs."""

    def __init__(self):
        self.words, self.phrases = Numbered(), Numbered()
        self.names: list[tuple[list, list]] = [([], []), ([], [])]  # languages and strings by number, of words and of phrases
        self.times: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of words, and how often each occurs
        self.texts: dict[str, list[str]] = {}
        self.whole: dict[str, str] = {}  # phrases of patterns in which a key stands for a long word
        self.pattern_bytes = self.text_bytes = 0

    def add(self, langs: list[str], grams: Grams, found: np.ndarray) -> None:
        """Adds the phrases `found` of texts that are in order of their languages."""
        single, longer = found[grams.size[found] == 1], found[grams.size[found] > 1]
        text_of = lambda word: np.searchsorted(grams.before, word, "right") - 1
        keys, first, times = np.unique(grams.keys[single], return_index=True, return_counts=True)
        numbers, new = self.words.add(keys)
        self.times.append((numbers, times))
        at = grams.first[single[first[new]]]
        self.text_bytes += numbers.nbytes + times.nbytes + int((grams.ends[at] - grams.starts[at]).sum())
        self.names[0][0].extend(langs[t] for t in text_of(at).tolist())
        self.names[0][1].extend(_strings(grams.low, grams.starts[at], grams.ends[at]))
        if not len(longer):
            return
        data, own, begins, ends = _guarded(grams, longer)
        plain = data.tobytes().decode()
        if len(plain) != len(data):
            character = np.cumsum((data & 0xC0) != 0x80) - 1
            begins, ends = character[begins], character[ends]
        keys, first = np.unique(grams.keys[longer], return_index=True)
        _, new = self.phrases.add(keys)
        at = longer[first[new]]
        begin = np.searchsorted(own, grams.first[at])
        start, end = begins[begin] - 1, ends[begin + grams.size[at] - 1] + 1
        self.names[1][0].extend(langs[t] for t in text_of(grams.first[at]).tolist())
        patterns = [plain[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        self.names[1][1].extend(patterns)
        if (grams.ends[own] - grams.starts[own] > LONG).any():
            self.whole.update((p, grams.phrase(i)) for p, i in zip(patterns, at.tolist(), strict=True) if "\t" in p)
        self.pattern_bytes += int((end - start).sum())
        self.text_bytes += len(plain)
        # Where the language changes, the text is cut; a run of words has one language.
        text = text_of(own)
        opens = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        names = [langs[t] for t in text[opens].tolist()]
        cuts = [(begin - 2, lang) for i, (begin, lang) in enumerate(zip(begins[opens].tolist(), names, strict=True)) if not i or lang != names[i - 1]]
        for (i, lang), (j, _) in zip(cuts, [*cuts[1:], (len(plain), "")], strict=True):
            self.texts.setdefault(lang, []).append(plain[i:j])

    def _sent(self, kind: int, seen: Numbered, n: np.ndarray, lead: int) -> pa.RecordBatch:
        """(bucket, lang, phrases, counts) of all words or all candidates."""
        langs, strings = self.names[kind]
        names = sorted(set(langs))
        code = {lang: i for i, lang in enumerate(names)}
        group = (seen.keys >> U(64 - lead)).astype(np.int64) * len(names) if lead else np.zeros(len(seen.keys), np.int64)
        group += np.fromiter(map(code.__getitem__, langs), np.int64, len(langs))[seen.numbers]
        order = np.argsort(group, kind="stable")
        group, order = group[order], seen.numbers[order]
        at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends, group = [*at[1:].tolist(), len(order)], group[at]
        strings, n = list(map(strings.__getitem__, order.tolist())), n[order]
        phrases = ["\n".join(strings[i:j]) for i, j in zip(at.tolist(), ends, strict=True)]
        blobs = [_planes(n[i:j]) for i, j in zip(at.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(group // len(names), pa.int32()), pa.array([names[g % len(names)] for g in group.tolist()], pa.string()), pa.array(phrases, pa.string()), pa.array(blobs, pa.binary())], names=["bucket", "lang", "phrases", "counts"])

    def counted(self, lead: int):
        """How often each word and candidate occurs: a row for each language and bucket of lead bits, packed."""
        times = np.zeros(len(self.words.keys), np.int64)
        for numbers, n in self.times:
            times[numbers] += n
        if len(times):
            yield self._sent(0, self.words, times, lead)
        langs, patterns = self.names[1]
        if not patterns:
            return
        own: dict[str, list[int]] = {}
        for number, lang in enumerate(langs):
            own.setdefault(lang, []).append(number)
        times = np.zeros(len(patterns), np.int64)
        for lang, numbers in own.items():
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for number in numbers:
                automaton.add_word(patterns[number], number)
            automaton.make_automaton()
            for plain in self.texts[lang]:
                times += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(plain)), np.int64), minlength=len(times))
        self.names[1] = langs, [self.whole.get(p) or p[1:-1] for p in patterns] if self.whole else [p[1:-1] for p in patterns]
        yield self._sent(1, self.phrases, times, lead)


def counts(texts: DataFrame, filtered: np.ndarray, block: int, blocks: int, part_bytes: int, lead: int) -> DataFrame:
    """(bucket, lang, phrases, counts): how often the phrases that pass a filter occur in texts (lang, text), packed; a phrase comes from each part of a task that has it."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(filtered)
    small_batches(spark)

    def scan(batches):
        part = Part()
        for batch in batches:
            for langs, grams in _grams(batch.sort_by("lang")):
                part.add(langs, grams, passing(grams.keys, sent.value, block, blocks))
                if part.pattern_bytes >= part_bytes or part.text_bytes >= TEXT_BYTES:
                    yield from part.counted(lead)
                    part = Part()
        yield from part.counted(lead)

    return texts.mapInArrow(releasing(scan), "bucket int, lang string, phrases string, counts binary")


def summed(packed: DataFrame, lead: int, least: int) -> DataFrame:
    """(lang, phrase, f) of packed counts: phrases that occur least times."""

    def add(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for lang, phrases, n in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                own = pc.split_pattern(pa.array([phrases]), "\n").flatten()
                held.setdefault(lang, []).append(pa.table({"phrase": own, "n": _numbers(n).view(np.int64)}))
        for lang in sorted(held):
            total = pa.concat_tables(held.pop(lang)).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
            total = total.filter(pc.greater_equal(total["n_sum"], least))
            for batch in total.select(["phrase", "n_sum"]).to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * batch.num_rows, pa.string()), *batch.columns], names=["lang", "phrase", "f"])

    return packed.repartitionById(1 << lead, F.col("bucket")).mapInArrow(releasing(add), "lang string, phrase string, f long")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most_cells: int = CELLS, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f): all phrases of one to MOST_WORDS words that occur least times, with their exact counts; and (lang, n), all words of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)).alias("lang"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lead = (max(1, math.ceil(size / BUCKET_BYTES)) - 1).bit_length()
    cells, totals = sketch(texts, least, lead)
    packed, fewer = None, max(0, lead - 2)
    for block, blocks, own in filters(cells, lead, most_cells):
        part = counts(texts, own, block, blocks, part_bytes, fewer)
        packed = part if packed is None else packed.unionByName(part)
    out = written(summed(packed, fewer, least))
    swept(docs.sparkSession)
    released()
    return out, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, covered: int = COVERED, **bounds) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    score is a's share of what its two parts occur, in millionths and doubled, at the worst cut; a phrase goes if a longer one holds it and has covered percent of its count.
    """
    frequent, totals = phrase_counts(docs, text_col, lang_col, least, **bounds)
    split = frequent.withColumn("words", F.split("phrase", " ", -1)).withColumn("size", F.size("words"))
    joined = lambda begin, length: F.array_join(F.slice("words", begin, length), " ")
    longer = split.where("size > 2")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda s: joined(s, n))))
    holds = longer.select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = split.where("size > 1").join(holds, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < covered * F.col("f")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", (F.lit(2_000_000).cast("decimal(7,0)") * wide("a", 19)).alias("up"), (wide("l", 19) + wide("r", 19)).alias("down")).withColumn("score", F.expr("up div down"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of all of `documents`."""
    return collocations(table(spark, sf_dir, "documents"))


#: The same by the definition, over all phrases.
SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, range(1, 5) AS t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
holds AS (SELECT lang, phrase, max(f) AS longest FROM (
    SELECT lang, f, array_to_string(words[s:s + n - 1], ' ') AS phrase FROM (SELECT lang, f, words, k, n, unnest(range(1, k - n + 2)) AS s FROM f, range(2, 4) AS t(n) WHERE n < k)) GROUP BY lang, phrase),
kept AS (SELECT f.* FROM f LEFT JOIN holds USING (lang, phrase) WHERE k > 1 AND (longest IS NULL OR 100 * longest < 80 * f)),
cuts AS (SELECT kept.lang, kept.phrase, kept.f AS a, c, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * kept.f) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
         FROM kept JOIN range(1, 4) AS t(c) ON c < kept.k
         JOIN f x ON x.lang = kept.lang AND x.phrase = array_to_string(kept.words[1:c], ' ') JOIN f y ON y.lang = kept.lang AND y.phrase = array_to_string(kept.words[c + 1:], ' ')),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM cuts),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM worst WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
