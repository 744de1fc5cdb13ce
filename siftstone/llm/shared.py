"""What several operators need from Spark: shared tables, Arrow columns, free names."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ID = 2**63 - 1
#: Rows of an Arrow batch. Documents are wide: Spark's default of 10,000 makes batches of tens of megabytes, several copies of which are held at a time.
BATCH_SETTING, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and has no executors elsewhere, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="siftstone-"))
    return _own[0]


_own: list[str] = []
_made: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/siftstone/{spark.sparkContext.applicationId}"
    if path not in _made:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _made.add(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, safe when executors are lost."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys with more than one in MOST_HOT of all rows are hot, so there are fewer than MOST_HOT of them; their rows are dealt over SALTS tasks.
MOST_HOT, SALTS, LEAST_HOT = 1000, 64, 10_000


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows, of which there are `total`, joined with few: its keys are distinct and `n`, which goes, is how many rows have each. Hot keys' rows don't meet in one task."""
    hot = F.col("n") > max(LEAST_HOT, total // MOST_HOT)
    hubs = F.broadcast(few.where(hot).select(*keys, F.lit(True).alias("_hot")))
    dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = rows.join(hubs, keys, "left").withColumn("_salt", dealt).drop("_hot")
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(few.withColumn("_salt", F.explode(salts)).drop("n"), [*keys, "_salt"], how).drop("_salt")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def small_batches(spark: SparkSession) -> None:
    """Has the session make batches of BATCH_ROWS, unless it was given another size than Spark's default."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def released() -> None:
    """Gives memory that is free again back to the system: Python workers stay for the tasks of later stages, with what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def swept(spark: SparkSession) -> None:
    """Has the driver let go of what nothing refers to any more, so that Spark's cleaner deletes shuffle files and broadcasts of finished steps now and not some time later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    released()


def releasing(run: Callable) -> Callable:
    """run, a function of mapInArrow, that gives memory back when its task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return task


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow; make() runs once in a task and returns what turns a batch into batches."""

    small_batches(df.sparkSession)

    def run(batches):
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(releasing(run), schema)


def with_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """df with columns added that are computed from its text column, in Arrow batches; all other columns pass through."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)
    names = [*df.columns, *(f.name for f in fields)]

    def run(batches):
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch.column(at))], names=names)

    return df.mapInArrow(releasing(run), T.StructType([*(T.StructField(f.name, f.dataType, True) for f in df.schema.fields), *fields]))
