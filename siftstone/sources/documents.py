"""Documents from object stores and folders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of files that are read, and the content types of names.
SUFFIXES = ("txt", "md", "pdf")
TYPES = {"txt": "text/plain", "md": "text/markdown", "pdf": "application/pdf"}


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(object_name, size, last_modified) of all files below path that can be read. Contents aren't read."""
    return _files(spark, path).select(F.col("path").alias("object_name"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(SUFFIXES)})$"))


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda b: b.decode("utf-8", "ignore"))


def loaded(spark: SparkSession, path: str, pdf=None) -> DataFrame:
    """(object_name, title, text) of the text files below path that aren't blank; bytes that are no UTF-8 are left out.

    pdf: a function from the bytes of a PDF to the texts of its pages. With it, each page that isn't blank is a row with
    page_number and page_count, named object#page-N; without it PDFs are skipped.
    """
    files = _files(spark, path).select(F.col("path").alias("object_name"), "content")
    is_pdf = F.lower("object_name").endswith(".pdf")
    none = F.lit(None).cast("int")
    texts = files.where(~is_pdf).select("object_name", _decoded("content").alias("text"), none.alias("page_number"), none.alias("page_count"))
    if pdf is not None:
        cut = files.where(is_pdf).withColumn("pages", _pages(pdf)("content"))
        cut = cut.select("object_name", F.size("pages").alias("page_count"), F.posexplode("pages").alias("at", "text"))
        texts = texts.unionByName(cut.select(F.concat("object_name", F.lit("#page-"), F.col("at") + 1).alias("object_name"), "text", (F.col("at") + 1).alias("page_number"), "page_count"))
    return texts.where(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "").withColumn("title", title(F.col("object_name")))


def _pages(pdf):
    @F.pandas_udf("array<string>")
    def pages(content: pd.Series) -> pd.Series:
        return content.map(lambda b: list(pdf(b)))

    return pages


def title(object_name):
    """The name of the file without folders, page and suffix."""
    return F.regexp_extract(object_name, r"([^/]+?)(?:\.[^./#]*)?(?:#.*)?$", 1)


def content_type(object_name):
    kind = F.lower(F.regexp_extract(object_name, r"\.([^./]+)$", 1))
    out = F.lit("application/octet-stream")
    for suffix, name in TYPES.items():
        out = F.when(kind == suffix, name).otherwise(out)
    return out


def page_of_list(listing: DataFrame, offset: int = 0, limit: int = 100) -> tuple[DataFrame, int, bool]:
    """One page of a listing in order of names; how many there are in all, and whether more follow."""
    total = listing.count()
    return listing.orderBy("object_name").offset(offset).limit(limit), total, offset + limit < total
