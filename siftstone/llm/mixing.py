"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets.

Every document gets an exponential key, -ln(u) / quality weight, where u comes from its id alone, so reruns agree.
Within a source, documents stand in order of their keys, and the prefix of that order whose words come nearest to the
budget is taken; a weight twice as large is twice as likely to be drawn next. A budget of more than the source's own
words first takes the complete source as often as it fits (whole epochs), and only the rest is selected.

Prefix sums never pass through one task: keys fall into KEY_BINS bins, the words of each bin are summed before the
shuffle, and only the one bin per source in which the budget ends is put in order.

Defined cases: a null or empty text has size 0 and is taken 0 words; a text of any length is counted whole; a null source is a source of its own, last in
order; a null id has the key of the empty text; repeated rows are drawn one by one; ties of keys go by id, size and a hash of the text; a source
without words has target 0; an empty table gives no rows. Columns other than id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, table, written

WORD = r"[^\x20\x09-\x0D]+"
SOURCE_WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
KEY_BINS = 4096
#: Rows of source budgets that are broadcast, of about a hundred bytes each.
MOST_SENT = 100_000
#: Weight of a document by its label `quality`; without a label 1.
QUALITY = {1: 2.0, 0: 0.5}


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of the id."""
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source (name null last): source, source_size, target. The rows of all sources, not of documents, meet in one task."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*map(F.lit, SOURCE_WEIGHTS))
    ranked = by_source.withColumn("rank", rank).withColumn("w", F.element_at(weights, (F.col("rank") % len(SOURCE_WEIGHTS) + 1).cast("int")))
    cap = F.lit(MOST_EPOCHS) * F.col("source_size")
    ranked = ranked.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("w"))
    before = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level if all sources that fill up before this one are at their caps; it is the final one for the first source it doesn't fill.
    left = F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("full_at"))
    final = F.max(F.when(F.col("open"), F.col("level"))).over(every)
    return ranked.select("source", "source_size", F.when(F.col("open"), final * F.col("w")).otherwise(F.col("cap")).alias("target"))


def mix(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, sign (a hash of the text), source_size, target, copies, taken."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("sign"))
    if labels is None:
        weighed = sized.withColumn("weight", F.lit(1.0))
    else:
        graded = labels.where(F.col("quality").isin(*QUALITY)).groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"))
        factor = F.when(F.col("quality") == 1, QUALITY[1]).when(F.col("quality") == 0, QUALITY[0]).otherwise(1.0)
        weighed = sized.join(graded, F.col("doc_id") == F.col("labelled"), "left").withColumn("weight", factor).drop("labelled", "quality")
    keyed = weighed.withColumn("key", -F.log(uniform(F.col("doc_id"))) / F.col("weight"))
    keyed = written(keyed.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * KEY_BINS).cast("int")))
    budgets = source_targets(keyed)
    budgets = budgets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    budgets = budgets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # Where each source's rest ends: its bin, and the words of the bins before.
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin")).alias("upto")
    bins = bins.select("source", "bin", "words", upto)
    ends = bins.alias("b").join(budgets.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
    ends = ends.where(F.col("upto") > F.col("rest")).groupBy("s.source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    budgets = budgets.alias("s").join(ends.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
    budgets = budgets.select(F.col("s.source").alias("of"), "source_size", "target", "epochs", "rest", F.coalesce(F.col("cut.bin"), F.lit(KEY_BINS + 1)).alias("cut"), F.coalesce(F.col("cut.before"), F.lit(0)).alias("before"))
    budgets = written(budgets)
    # The join follows the hot source unless the budgets are few enough to send; beyond that, skewed joins are split at run time.
    placed = keyed.join(F.broadcast(budgets) if budgets.count() <= MOST_SENT else budgets, F.col("source").eqNullSafe(F.col("of")))
    clear = placed.where(F.col("bin") != F.col("cut")).withColumn("chosen", (F.col("bin") < F.col("cut")).cast("int"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size", "sign").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = placed.where(F.col("bin") == F.col("cut")).withColumn("ahead", F.col("before") + ahead)
    last = last.withColumn("chosen", (F.col("ahead") + F.col("size") / 2 <= F.col("rest")).cast("int")).drop("ahead")
    copies = F.col("epochs") + F.col("chosen")
    return clear.unionByName(last).select("doc_id", "source", "size", "sign", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op9(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all of `documents`."""
    mixed = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (`copies`): the last stage of a pipeline.

    Rows that repeat id, source and text become one, with the copies of all; rows that share an id alone are taken or left
    each for itself. Null ids and texts are values like others; an empty table gives no rows; extra columns stay.
    """
    found = mix(docs, table(spark, sf_dir, "labels")).where("copies > 0").groupBy("doc_id", "source", "sign").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("n"))
    name, sign = free_name(docs, "copies"), free_name(docs, "sign")
    of = [free_name(docs, f"_{c}") for c in ("doc_id", "source", "sign", "n")]
    chosen = written(found.toDF(*of[:3], name, of[3]))
    joined = docs.withColumn(sign, F.xxhash64("text")).join(chosen, F.col("doc_id").eqNullSafe(F.col(of[0])) & F.col("source").eqNullSafe(F.col(of[1])) & (F.col(sign) == F.col(of[2])))
    if not chosen.where(F.col(of[3]) > 1).isEmpty():
        joined = joined.where(F.col(of[3]) == 1).unionByName(joined.where(F.col(of[3]) > 1).dropDuplicates(["doc_id", "source", sign]))
    return joined.select(*docs.columns, name)


SQL = """
WITH sized AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CASE WHEN q.quality = 1 THEN 2.0 WHEN q.quality = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) q ON d.doc_id = q.doc_id),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / weight AS key FROM sized),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM by_source),
levels AS (
  SELECT *, cap / w AS full_at,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN level <= full_at THEN max(CASE WHEN level <= full_at THEN level END) OVER () * w ELSE cap END AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN ahead + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM placed
"""
