"""Records in JSON: strict and lenient readers, and settings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.operators.clinical import MARKERS
from siftstone.operators.retrieval import first_of


def strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines in which each line has to fit the schema; reading fails at the first that doesn't."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient(spark: SparkSession, path: str, schema: str | T.StructType, key: str, order: str | None = None) -> DataFrame:
    """JSON lines without those that don't parse; of a repeated key the row with the highest order stays, or any one."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())
    return first_of(rows, [key], [F.col(order).desc()]) if order else rows.dropDuplicates([key])


def split_failed(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    bad = F.coalesce(F.col(error), F.lit("")) != ""
    return rows.where(~bad).drop(error), rows.where(bad)


def first_object(text: Column) -> Column:
    """The first balanced JSON object in an answer, fences around it removed; null if there is none that parses."""

    def parsed(value: str | None) -> str | None:
        value = re.sub(r"```(?:json)?", "", value or "")
        for start in (m.start() for m in re.finditer(r"\{", value)):
            try:
                return json.dumps(json.JSONDecoder().raw_decode(value[start:])[0], sort_keys=True, ensure_ascii=False)
            except ValueError:
                continue
        return None

    @F.pandas_udf(T.StringType())
    def found(values: pd.Series) -> pd.Series:
        return values.map(parsed)

    return found(text)


def markers(spark: SparkSession, path: str) -> DataFrame:
    """The table of markers from a JSON file {key: {label, unit, kind, direction, aliases, low, high, bands: [...]}}. It is small: settings, not data."""
    settings = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    rows = []
    for key, x in settings.items():
        for i, band in enumerate(x.get("bands") or [{"low": x.get("low"), "high": x.get("high")}]):
            genders = band.get("gender") or band.get("genders") or []
            number = lambda n, b=band: float(b[n]) if b.get(n) is not None else None
            rows.append((key.strip().lower().replace(" ", "_"), x.get("label") or key.replace("_", " ").title(), x.get("unit"), x.get("kind") or "numeric", band.get("direction") or x.get("direction") or "outside_range", x.get("aliases") or [], i, number("low"), number("high"), [genders] if isinstance(genders, str) else list(genders), number("age_min"), number("age_max")))
    return spark.createDataFrame(rows, MARKERS)
