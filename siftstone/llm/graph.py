"""Connected components of a link table by alternating large and small stars, entirely in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


#: Nodes with more than one in MOST_HUBS of all links are hubs, so there are fewer than MOST_HUBS of them.
MOST_HUBS = 1000


def _with_lowest(pairs: DataFrame, links_: int) -> DataFrame:
    """(u, v, m) of pairs (u, v), of which there are at most 2 * links_: m is the smallest v of each u.

    A hub's pairs don't meet in one task: its smallest neighbour is sent to them, and only other nodes' pairs are shuffled.
    """
    per = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(1000, 2 * links_ // MOST_HUBS)
    marked = pairs.join(F.broadcast(per.where(hub).select("u", F.col("m").alias("hub_m"))), "u", "left")
    others = marked.where("hub_m IS NULL").select("u", "v").join(per.where(~hub).select("u", "m"), "u")
    return others.unionByName(marked.where("hub_m IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that can be reached.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest; a chain of n nodes takes about
    log(n) rounds. Rounds end when the links stay as they are. Links from a node to itself and null ones are left out.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = _signature(now)
    while sign[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both, sign[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # u is the larger node of each link here.
        small = _with_lowest(large, sign[0])
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        now = written(small.select("x.u", "x.v").where("u <> v").distinct())
        last, sign = sign, _signature(now)
        if sign == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
