"""From documents to an index of chunks: cleaning, chunking, embedding and keyed storage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.functions.text import tokens

from .chunking import chunked
from .cleaning import cleaned


def hashed_vector(text: Column, size: int = 256) -> Column:
    """A vector of length 1 by hashed tokens, signs included: an embedding that needs no model, for tests and as a fallback. Zero without tokens. In time that grows with the tokens and with size, not with both at once."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def unit(places: pd.Series) -> pd.Series:
        out = []
        for place in places:
            at = np.asarray(place, dtype=np.int64)
            # Whole numbers, so neither sums nor squares are rounded.
            sums = np.bincount(at >> 1, weights=1.0 - 2.0 * (at & 1), minlength=size)
            n = np.sqrt(np.dot(sums, sums))
            out.append(sums / n if n > 0 else np.zeros(size))
        return pd.Series(out, dtype=object)

    # A token's place, with its sign as the last bit.
    return unit(F.transform(tokens(text), lambda t: (2 * F.pmod(F.xxhash64(t), F.lit(size)) + F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 0).otherwise(1)).cast("int")))


def prepared(docs: DataFrame, cleaning: str = "basic", chunking: str = "naive", size: int | None = None, overlap: int | None = None) -> DataFrame:
    """Chunks of docs (source_id, text, ...) after cleaning."""
    return chunked(cleaned(docs, cleaning), chunking, size, overlap)


def indexed(chunks: DataFrame, embed: Callable[[Column], Column] = hashed_vector, model: str = "hashed-256") -> DataFrame:
    """chunks that aren't blank, with `embedding` and the name of the model that made it; embed is a function of columns, such as a pandas UDF that calls a model."""
    return chunks.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumns({"embedding": embed(F.col("text")), "embedding_model": F.lit(model)})


def index_model(index: DataFrame) -> str:
    """The one model of an index; an index that is empty, unnamed or mixed is an error."""
    found = [r[0] for r in index.select("embedding_model").distinct().limit(2).collect()]
    if not found:
        raise ValueError("the index is empty")
    if len(found) > 1 or found[0] is None:
        raise ValueError("the index has vectors of several models or of none")
    return found[0]
