"""Chunks of documents: character windows, windows per page, and packed paragraphs; pages of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.functions.text import let, squeezed

DEFAULTS = {"naive": (300, 100), "late": (300, 100), "page_indexed": (1200, 150)}


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, part): windows of size characters that share overlap, over the text with single blanks. The last one ends with the text.

    The text is cut once into pieces as long as a step, and a window is put together from those that it spans: looking up each
    window's place from the beginning of the text would take quadratic time.
    """
    size = max(1, size)
    step = size - max(0, min(overlap, size - 1))

    def cut(flat: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.length(flat) - size) / step).cast("int"))
        part = lambda pieces, i: F.trim(F.substring(F.array_join(F.slice(pieces, i + 1, -(-size // step)), ""), 1, size))
        pieces = F.regexp_extract_all(flat, F.lit(f"(?s).{{1,{step}}}+"), F.lit(0))
        return let(pieces, lambda x: F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), part(x, i).alias("part"))))

    return F.filter(let(squeezed(text), cut), lambda x: x["part"] != "")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _ends(lengths: pd.Series) -> pd.Series:
    return lengths.map(lambda n: None if n is None else np.cumsum(np.asarray(n, dtype="int64") + 1) - 1)


def page_ranges(pages: Column) -> Column:
    """Array of (page_number, start, end) of the pages that aren't blank, as they follow each other with one blank between; numbers count blank pages. Only lengths leave the JVM, for their prefix sums."""
    flat = F.filter(F.transform(pages, lambda p, i: F.struct((i + 1).alias("page_number"), F.length(squeezed(p)).alias("n"))), lambda x: x["n"] > 0)
    ends = _ends(F.transform(flat, lambda x: x["n"]))
    return F.zip_with(flat, ends, lambda x, end: F.struct(x["page_number"].alias("page_number"), (end - x["n"]).alias("start"), end.alias("end")))


def _page_at(number, length, middle) -> list[int | None]:
    """The pages of places: that which has the place, or the last one."""
    if number is None or not len(number):
        return [None] * len(middle)
    ends = np.cumsum(np.asarray(length, dtype="int64") + 1) - 1
    # A middle without a place is null, which arrives as NaN beside numbers.
    at = np.asarray([-1 if m is None or m != m else m for m in middle], dtype="int64")
    i = np.searchsorted(ends, at, side="right")
    inside = np.minimum(i, len(ends) - 1)
    inside = np.where((i < len(ends)) & (at >= ends[inside] - np.asarray(length)[inside]), inside, len(ends) - 1)
    return [None if m < 0 else int(number[j]) for m, j in zip(at, inside, strict=True)]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _found(numbers: pd.Series, lengths: pd.Series, middles: pd.Series) -> pd.Series:
    return pd.Series([None if m is None else _page_at(n, s, m) for n, s, m in zip(numbers, lengths, middles, strict=True)], dtype=object)


def pages_at(pages: Column, middles: Column) -> Column:
    """The page of each place in the text that the pages make with single blanks between them: that which has the place, or the last one; null for null places, and without pages that aren't blank. By binary search among prefix sums."""
    flat = _numbered(pages)
    return _found(F.transform(flat, lambda x: x["number"]), F.transform(flat, lambda x: x["n"]), middles)


def _numbered(pages: Column) -> Column:
    """Array of (number, n) of the pages that aren't blank: their lengths with single blanks."""
    return F.filter(F.transform(pages, lambda p, i: F.struct((i + 1).alias("number"), F.length(squeezed(p)).alias("n"))), lambda x: x["n"] > 0)


def paragraphs(text: Column) -> Column:
    """What stands between empty lines."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda p: squeezed(p) != "")


def _pages_of(docs: DataFrame) -> Column:
    """The raw pages of a document where it brings any, else its paragraphs."""
    own = paragraphs(F.col("text"))
    return F.when(F.size("raw_page_texts") > 0, F.col("raw_page_texts")).otherwise(own) if "raw_page_texts" in docs.columns else own


def _paged(docs: DataFrame, middles: Column) -> Column:
    """The page of each chunk: the document's own number if it has one (null if that is no number), or that of the chunk's middle."""
    found = pages_at(_pages_of(docs), middles)
    if "page_number" not in docs.columns:
        return found
    return F.when(F.col("page_number").isNotNull(), F.transform(middles, lambda _: F.col("page_number").try_cast("int"))).otherwise(found)


def naive(docs: DataFrame, size: int = 300, overlap: int = 100) -> DataFrame:
    """(source_id, chunk_id, chunk_index, start, text, page_number) of docs (source_id, text, optional page_number, optional raw_page_texts).

    A document's own page number comes first, then its raw pages, then its paragraphs as pages.
    """
    cut = docs.withColumn("_w", windows(F.col("text"), size, overlap))
    middles = F.transform("_w", lambda x: x["start"] + F.floor(F.length(x["part"]) / 2).cast("int"))
    cut = cut.withColumn("_p", _paged(docs, middles)).select("source_id", F.posexplode(F.zip_with("_w", "_p", lambda w, p: F.struct(w["start"].alias("start"), w["part"].alias("text"), p.alias("page_number")))).alias("chunk_index", "_x"))
    return cut.select("source_id", F.concat(F.col("source_id"), F.lit("-chunk-"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "_x.*")


def page_indexed(pages: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """(source_id, chunk_id, chunk_index, text, page_number) of pages (source_id, page_number, text); indexes begin anew on each page."""
    cut = pages.select("source_id", "page_number", F.posexplode(windows(F.col("text"), size, overlap)).alias("chunk_index", "_x"))
    # A page 0 has no number in the id.
    suffix = F.when(F.col("page_number") != 0, F.concat(F.lit("-page-"), F.col("page_number"))).otherwise("-page")
    return cut.select("source_id", F.concat(F.col("source_id"), F.coalesce(suffix, F.lit("-page")), F.lit("-chunk-"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", F.col("_x.part").alias("text"), "page_number")


def _packed(text: str, size: int, overlap: int) -> Iterator[tuple[str, bool]]:
    """Paragraphs packed into chunks of at most size characters, each beginning with the last whole paragraphs of up to overlap characters; and whether a chunk is part of one long paragraph."""
    held: list[str] = []
    for block in filter(None, (b.strip() for b in text.split("\n\n"))):
        if len(block) > size:
            if held:
                yield "\n\n".join(held), False
                held = []
            flat = " ".join(block.split())
            step = max(1, size - overlap)
            for at in range(0, max(1, len(flat) - size + step), step):
                if part := flat[at : at + size].strip():
                    yield part, True
            continue
        if held and len("\n\n".join([*held, block])) > size:
            yield "\n\n".join(held), False
            while held and len("\n\n".join(held)) > overlap:
                held = held[1:]
        held.append(block)
    if held:
        yield "\n\n".join(held), False


def _placed(text: str, size: int, overlap: int) -> list[dict]:
    """Chunks with the middles of where they are looked up: a packed one where the last found chunk ended, part of a long paragraph where it is found, if it is."""
    flat, at, out = " ".join(text.split()), 0, []
    for chunk, part in _packed(text, size, overlap):
        wanted = " ".join(chunk.split())
        found = flat.find(wanted, at)
        found = found if found >= 0 else flat.find(wanted)
        start = found if part else at
        out.append({"text": chunk, "middle": start + len(wanted) // 2 if start >= 0 else None})
        at = found + len(wanted) if found >= 0 else at
    return out


#: Characters of texts whose chunks a task holds at a time.
LATE_CHARS = 1 << 20


def late(docs: DataFrame, size: int = 300, overlap: int = 100) -> DataFrame:
    """(source_id, chunk_id, chunk_index, text, page_number) of docs (source_id, text, optional page_number, optional raw_page_texts). How paragraphs pack goes by what was packed before, so it runs in Arrow batches, which leave a task as soon as they have the chunks of LATE_CHARS characters. Pages are found as those of naive()."""
    flat = _numbered(_pages_of(docs))
    given = "page_number" in docs.columns
    rows = docs.select("source_id", "text", F.transform(flat, lambda x: x["number"]).alias("numbers"), F.transform(flat, lambda x: x["n"]).alias("lengths"), (F.col("page_number").isNotNull() if given else F.lit(False)).alias("given"), (F.col("page_number").try_cast("int") if given else F.lit(None).cast("int")).alias("page"))
    kind = T.StructType([docs.schema["source_id"], T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("page_number", T.IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, own, at, texts, numbers, held = batch.column(0), [], [], [], [], 0
            names = [f.name for f in kind]

            def done():
                return pa.RecordBatch.from_arrays([source.take(pa.array(own, pa.int64())), pa.array(at, pa.int32()), pa.array(texts, pa.string()), pa.array(numbers, pa.int32())], names=names)  # noqa: B023

            for i in range(len(batch)):
                text = batch.column(1)[i].as_py() or ""
                placed = _placed(text, size, overlap)
                own += [i] * len(placed)
                at += range(len(placed))
                texts += [x["text"] for x in placed]
                numbers += [batch.column(5)[i].as_py()] * len(placed) if batch.column(4)[i].as_py() else _page_at(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), [x["middle"] for x in placed])
                held += len(text)
                if held >= LATE_CHARS:
                    yield done()
                    own, at, texts, numbers, held = [], [], [], [], 0
            if own:
                yield done()

    return rows.mapInArrow(cut, kind).select("source_id", F.concat(F.col("source_id"), F.lit("-chunk-"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "text", "page_number")


def chunked(docs: DataFrame, strategy: str, size: int | None = None, overlap: int | None = None) -> DataFrame:
    """Chunks by the name of a strategy, with its own sizes unless others are given."""
    if strategy not in DEFAULTS:
        raise ValueError(f"unknown chunking strategy {strategy!r}; there are {', '.join(DEFAULTS)}")
    own = DEFAULTS[strategy]
    return {"naive": naive, "late": late, "page_indexed": page_indexed}[strategy](docs, own[0] if size is None else size, own[1] if overlap is None else overlap)
