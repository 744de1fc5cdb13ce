"""The session that the engine expects, and tables that it keeps between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, name: str = "siftstone", **conf: str) -> SparkSession:
    """A session in UTC with run-time re-planning; master and further settings only where they are given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    return builder.config(map=conf).getOrCreate() if conf else builder.getOrCreate()


_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path below the folder that `spark.checkpoint.dir` names, in the application's own folder, which goes when the driver ends. Only a local session that names none gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="siftstone-"))
        named = _own[0]
    path = f"{named}/siftstone/{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{path}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the scratch folder: computed once, whoever reads it and however often."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
