"""JSON lines whose places are known: errors name file and line, of a repeated key the last one counts, and what fails is kept as dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.operators.retrieval import first_of
from siftstone.session import written

_BAD = "_bad"


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, modified, line, value) of all lines of text files, numbers from 1 on in each file; blank lines count.

    Files are read in splits as always. A task numbers the lines of a split as they come, so the number of a line is its place in
    the split and the lines of the file's splits before it: a sum over one row per split. The lines are kept as a table, since
    another reading might be cut into other splits.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_modification_time"].alias("modified"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    rows = written(rows)
    splits = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.select("file", "split", (before + 1 - F.col("first")).alias("shift")), ["file", "split"]).select("file", "modified", (F.col("at") + F.col("shift")).alias("line"), "value")


def checked(lines: DataFrame, schema: T.StructType | str, required: tuple[str, ...] = (), closed: bool = False) -> DataFrame:
    """Lines that aren't blank, with `record` as a struct of the schema, and `reason`, null where nothing is wrong with the line.

    Reasons: no JSON object; another type than the schema has; required fields that aren't there or null; and, if the schema is
    closed, fields that it doesn't have. The record of a line with a reason is null. Of a
    field that an object has twice the last value counts.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    value = F.trim("value")
    rows = lines.where(value != "").withColumn("_r", F.from_json(value, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "allowSingleQuotes": "false"}))
    names = F.array(*(F.lit(f.name) for f in schema.fields))
    # Spark's parsers stop behind the first value of a text. What is whole as the only item of an array and as the only field of an object has nothing behind it.
    alone = (F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1) & (F.size(F.json_object_keys(F.concat(F.lit('{"x":'), value, F.lit("}")))) == 1)
    is_object = F.startswith(value, F.lit("{")) & F.coalesce(alone, F.lit(False))
    lacks = F.array_compact(F.array(*(F.when(F.col("_r")[n].isNull(), n) for n in required))) if required else F.array().cast("array<string>")
    more = F.array_except(F.json_object_keys(value), names)
    reason = F.when(~is_object, "no JSON object").when(F.col("_r").isNull() | F.col("_r")[_BAD].isNotNull(), "not of the schema").when(F.size(lacks) > 0, F.concat(F.lit("missing: "), F.array_join(lacks, ", ")))
    if closed:
        reason = reason.when(F.size(more) > 0, F.concat(F.lit("unknown: "), F.array_join(more, ", ")))
    record = F.struct(*(F.col("_r")[f.name].alias(f.name) for f in schema.fields))
    # Columns of a generator are computed once, also where a later filter reads them.
    rows = rows.select("file", "modified", "line", "value", F.inline(F.array(F.struct(reason.alias("reason"), record.alias("_s")))))
    return rows.select("file", "modified", "line", "value", "reason", F.when(F.col("reason").isNull(), F.col("_s")).alias("record"))


def strict(spark: SparkSession, path: str | list[str], schema: T.StructType | str, required: tuple[str, ...] = (), closed: bool = False) -> DataFrame:
    """The records of all lines; ValueError with file, line and reason of the first line that is wrong, files in order of their names."""
    rows = written(checked(numbered(spark, path), schema, required, closed))
    bad = rows.where("reason IS NOT NULL").agg(F.min(F.struct("file", "line", "reason")).alias("x")).first()["x"]
    if bad:
        raise ValueError(f"{bad['file']}, line {bad['line']}: {bad['reason']}")
    return rows.select("record.*")


def lenient(spark: SparkSession, path: str | list[str], schema: T.StructType | str, key: str, required: tuple[str, ...] = (), closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records by key, and dead letters (file, line, reason, value).

    Of records that share a key the last one stays: that of the file that was changed last, by name where that is equal, and
    of its last line. A record without key is a dead letter.
    """
    rows = written(checked(numbered(spark, path), schema, tuple(dict.fromkeys((*required, key))), closed))
    good = rows.where("reason IS NULL").select("record.*", F.struct("modified", "file", "line").alias("_place"))
    return first_of(good, [key], [F.col("_place").desc()]).drop("_place"), rows.where("reason IS NOT NULL").select("file", "line", "reason", "value")


def append(rows: DataFrame, path: str) -> None:
    """rows as further JSON lines of the folder, null fields included. What was there stays as it is, and a job that fails adds nothing."""
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def append_split(rows: DataFrame, path: str, failed_path: str, error: str = "error") -> None:
    """Rows without an error to one folder, and the others with `failed_at` to another one. They are computed once."""
    rows = written(rows)
    bad = F.coalesce(F.col(error), F.lit("")) != ""
    append(rows.where(~bad).drop(error), path)
    append(rows.where(bad).withColumn("failed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")), failed_path)
