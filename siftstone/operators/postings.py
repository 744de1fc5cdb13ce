"""A stored keyword index: texts are cut once, and later searches read postings only.

The index is a folder of segments. A segment has the documents of one refresh: dealt into blocks of about BLOCK documents, a row
per block and word holds the block's postings, their largest count and their shortest document. Rows lie in buckets by
word and are sorted by it, so a search reads the buckets of its words, and skips what the files' statistics exclude. The
signature of the corpus is a row per document with a hash of its text: a refresh compares it, appends a segment with what is new or
changed, and marks what is gone as dead in the segment that had it. Nothing is rewritten, and each refresh is one version.

A search scores by BM25 like retrieval.bm25 and gives the same rows. With the rarest word of each query alone it finds a score
that k documents reach for certain; blocks whose largest counts and shortest documents can't reach it with all words of the
query together aren't opened.
"""

from __future__ import annotations

import uuid
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.functions.text import tokens
from siftstone.sources import versions

from .retrieval import QUERY_WORDS, K1, B, dealt, top

BLOCK, BUCKETS = 128, 32
#: Blocks whose lists a task makes, so that they fit into its memory.
TASK_BLOCKS = 64
#: The folder of a segment's documents while it is made.
_DOCUMENTS = -1


def _tables(spark: SparkSession, path: str, content: dict, kind: str) -> DataFrame | None:
    """The rows of one kind (postings, documents, dead) of all segments of a version, with `segment`."""
    names = [s["name"] for s in content.get("segments", []) if s[kind]]
    if not names:
        return None
    schema = T.StructType.fromJson(content["schemas"][kind])
    # The segment's name is a part of the folder's.
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/segment={n}/kind={kind}" for n in names])
    return rows.select(*schema.fieldNames(), *(["bucket"] if kind == "postings" else []), "segment")


def _live(spark: SparkSession, path: str, content: dict) -> DataFrame | None:
    """(id, sign, length, segment) of the documents that count."""
    there, dead = _tables(spark, path, content, "documents"), _tables(spark, path, content, "dead")
    if there is None or dead is None:
        return there
    gone = dead.select(F.col("id").alias("_id"), F.col("of").alias("_of"))
    return there.join(gone, there["id"].eqNullSafe(gone["_id"]) & (there["segment"] == gone["_of"]), "left_anti")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), blocks).cast("int")


def _dead(spark: SparkSession, path: str, content: dict) -> DataFrame | None:
    """(segment, block, gone, none): the ids of each block that no longer count, and whether null is one of them."""
    dead = _tables(spark, path, content, "dead")
    if dead is None:
        return None
    blocks = F.create_map(*chain.from_iterable((F.lit(s["name"]), F.lit(s["blocks"])) for s in content["segments"]))
    by_block = dead.select("id", F.col("of").alias("segment"), _block(F.element_at(blocks, F.col("of"))).alias("block"))
    return by_block.groupBy("segment", "block").agg(F.collect_list("id").alias("gone"), (F.count_if(F.col("id").isNull()) > 0).alias("none"), F.count("*").alias("n"))


def refreshed(corpus: DataFrame, path: str, id_col: str, text_col: str) -> int:
    """The index at path brought to the state of corpus, as the version that has it; without a change that is the one there was.

    A null text is an empty one; documents without words are remembered, so that they aren't read again, but don't count. Of rows that
    share an id, null included, the one whose text has the largest hash is taken.
    """
    spark = corpus.sparkSession
    number, content = versions.read(spark, path)
    rows = corpus.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("sign", F.xxhash64("text"))
    # Only ids and hashes move to find out what changed.
    now = rows.groupBy("id").agg(F.max("sign").alias("sign"))
    live = _live(spark, path, content)
    name = f"s{uuid.uuid4().hex}"
    here = f"{path}/data/segment={name}"
    if live is None:
        now.write.parquet(f"{here}/kind=changes")
        fresh, gone = spark.read.schema(now.schema).parquet(f"{here}/kind=changes"), None
    else:
        old = live.select(F.col("id").alias("_id"), F.col("sign").alias("_sign"), "length", "segment")
        met = now.join(old, now["id"].eqNullSafe(old["_id"]), "full_outer")
        met.where(~F.col("sign").eqNullSafe(F.col("_sign"))).select("id", "sign", "_id", "_sign", "length", "segment").write.parquet(f"{here}/kind=changes")
        changes = spark.read.parquet(f"{here}/kind=changes")
        if changes.isEmpty():
            versions._files(spark, here)[1].delete(versions._files(spark, here)[0], True)
            return number
        fresh = changes.where("sign IS NOT NULL").select("id", "sign")
        gone = changes.where("_sign IS NOT NULL").select(F.col("_id").alias("id"), F.col("segment").alias("of"), "length")
    # Each id that is fresh has one document.
    blocks = max(1, -(-fresh.count() // BLOCK))
    block = _block(F.lit(blocks)).alias("block")
    own = rows.select("id", "sign", "text")
    if live is not None:
        key = F.xxhash64("id", "sign").alias("_key")
        if fresh.limit(QUERY_WORDS + 1).count() <= QUERY_WORDS:
            # Few enough to be sent to the texts: all others stay where they are.
            own = own.withColumn("_key", key).join(F.broadcast(fresh.select(key).distinct()), "_key", "left_semi").drop("_key")
        own = own.unionByName(fresh.select("id", "sign", F.lit(None).cast("string").alias("text")))
    # Texts move once, to their block; which of them are taken, their words and the lists of these are found where they lie.
    there = own.withColumn("block", block).repartition(max(spark.sparkContext.defaultParallelism, -(-blocks // TASK_BLOCKS)), "block")
    per_id = Window.partitionBy("block", "id")
    added = there.withColumn("_at", F.row_number().over(per_id.orderBy(F.col("text").isNull(), F.col("sign").desc())))
    if live is not None:
        added = added.withColumn("_fresh", F.max(F.col("text").isNull()).over(per_id)).where("_fresh AND text IS NOT NULL")
    added = added.where("_at = 1").select("block", "id", "sign", tokens(F.col("text")).alias("tokens"))
    # Each document counts as a posting of no word, too; their list is the block's documents.
    words = added.select("block", "id", "sign", F.size("tokens").alias("length"), F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("term"))
    per = words.groupBy("block", "term", "id").agg(F.count("*").cast("int").alias("tf"), F.first("length").alias("length"), F.first("sign").alias("sign"))
    lists = per.groupBy("block", "term").agg(F.collect_list(F.struct("id", "tf", "length")).alias("postings"), F.max("tf").alias("most"), F.min("length").alias("shortest"), F.collect_list(F.when(F.col("term").isNull(), F.col("sign"))).alias("signs"))
    bucket = F.when(F.col("term").isNull(), _DOCUMENTS).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")
    lists = lists.select("term", "block", "postings", "most", "shortest", "signs", bucket.alias("bucket"))
    lists.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{here}/kind=postings")
    each = spark.read.schema(lists.drop("bucket").schema).parquet(f"{here}/kind=postings/bucket={_DOCUMENTS}") if fresh.limit(1).count() else lists.where("false")
    each = each.select(F.explode(F.arrays_zip(F.col("postings"), F.col("signs"))).alias("x")).select("x.postings.id", F.col("x.signs").alias("sign"), "x.postings.length")
    each.write.parquet(f"{here}/kind=documents")
    total = spark.read.parquet(f"{here}/kind=documents").agg(F.count("*").alias("rows"), F.count_if(F.col("length") > 0).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    if gone is not None:
        gone.write.parquet(f"{here}/kind=dead")
        lost = spark.read.parquet(f"{here}/kind=dead").agg(F.count("*").alias("rows"), F.count_if(F.col("length") > 0).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    schemas = {"postings": lists.drop("bucket", "signs").schema.jsonValue(), "documents": each.schema.jsonValue()}
    schemas["dead"] = T.StructType([each.schema["id"], T.StructField("of", T.StringType())]).jsonValue()
    segment = {"name": name, "blocks": blocks, "postings": total["n"] > 0, "documents": total["rows"] > 0, "dead": gone is not None and lost["rows"] > 0}
    n, length = (content.get("n", 0), content.get("length", 0)) if gone is None else (content["n"] - lost["n"], content["length"] - lost["length"])
    out = {"segments": [*content.get("segments", []), segment], "schemas": schemas, "n": n + total["n"], "length": length + total["length"]}
    for left in (f"postings/bucket={_DOCUMENTS}", "changes"):
        where, files = versions._files(spark, f"{here}/kind={left}")
        files.delete(where, True)
    return versions.commit(spark, path, number, out)


def _part(weight: Column, tf: Column, length: Column, mean: float) -> Column:
    return weight * tf * (K1 + 1) / F.greatest(tf + K1 * (1 - B + B * length / F.lit(mean)), F.lit(1e-9))


def search(queries: DataFrame, path: str, query_id: str, query_text: str, k: int = 3, version: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the rows of retrieval.bm25 over the corpus that the index was last brought to."""
    spark = queries.sparkSession
    number, content = versions.read(spark, path, version)
    if not number:
        raise ValueError(f"no index at {path}")
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    stored, dead = _tables(spark, path, content, "postings"), _dead(spark, path, content)
    if stored is None:
        kind = T.StructType.fromJson(content["schemas"]["documents"])["id"].dataType.simpleString() if content["schemas"] else "long"
        return asked.select("query_id", F.lit(None).cast(kind).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    mean = max(content["length"] / max(1, content["n"]), 1.0)
    sent = F.broadcast if asked.limit(QUERY_WORDS + 1).count() <= QUERY_WORDS else lambda rows: rows
    lists = stored.join(sent(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    if dead is not None:
        # Documents that are gone still stand in the lists of their segments; what is gone meets whole lists by their block, never single postings.
        few = (dead.agg(F.sum("n")).first()[0] or 0) <= QUERY_WORDS
        lists = (lists if few else dealt(lists)).join(F.broadcast(dead.drop("n")) if few else dealt(dead.drop("n")), ["segment", "block"], "left")
        alive = F.filter("postings", lambda p: F.when(p["id"].isNull(), ~F.col("none")).otherwise(~F.array_contains("gone", p["id"])))
        lists = lists.withColumn("postings", F.when(F.col("none").isNull(), F.col("postings")).otherwise(alive)).drop("gone", "none").where(F.size("postings") > 0)
    # Blocks with one or more of the words; the lists are opened later, for those that can matter.
    heads = lists.select("segment", "block", "bucket", "term", F.size("postings").alias("df"), "most", "shortest")
    df = heads.groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(content["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").select("query_id", "bucket", "term", (F.col("times") * idf).alias("weight"))

    rarest = top(weighed, ["query_id"], [F.col("weight").desc(), F.col("term")], 1).drop("rank")
    parts = _parts(lists.join(sent(rarest), ["bucket", "term"]), mean)
    sure = top(parts, ["query_id"], [F.col("part").desc()], k).where(F.col("rank") == k).select("query_id", F.col("part").alias("least"))
    bounds = heads.join(sent(weighed), ["bucket", "term"]).withColumn("part", _part(F.col("weight"), F.col("most"), F.col("shortest"), mean))
    able = bounds.groupBy("query_id", "segment", "block").agg(F.sum("part").alias("bound")).join(sure, "query_id", "left")
    able = able.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") * (1 - 1e-9))).groupBy("segment", "block").agg(F.collect_list("query_id").alias("able"))
    # Lists move once, whole, to their block: all of a document's postings meet there, so its scores needn't move.
    opened = dealt(lists.select("segment", "block", "bucket", "term", "postings")).join(dealt(able), ["segment", "block"])
    opened = opened.join(sent(weighed), ["bucket", "term"]).where(F.array_contains("able", F.col("query_id")))
    scored = _parts(opened, mean).groupBy("query_id", "segment", "block", "id").agg(F.sum("part").alias("score")).where("score > 0")
    return top(scored, ["query_id"], [F.round("score", 9).desc(), F.col("id")], k).select("query_id", "id", "score", "rank")


def _parts(lists: DataFrame, mean: float) -> DataFrame:
    """(query_id, segment, block, id, part): what each posting of lists (query_id, weight, segment, block, postings) adds to a score."""
    each = lists.select("query_id", "segment", "block", "weight", F.explode("postings").alias("p")).select("query_id", "segment", "block", "weight", "p.*")
    return each.select("query_id", "segment", "block", "id", _part(F.col("weight"), F.col("tf"), F.col("length"), mean).alias("part"))


def swept(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes versions before the last `keep`, and segments of writers that died; not while a writer is at work."""
    named: set[str] = set()
    for n in versions.numbers(spark, path)[-keep:]:
        named |= {f"segment={s['name']}" for s in versions.read(spark, path, n)[1]["segments"]}
    return versions.swept(spark, path, named, keep)
