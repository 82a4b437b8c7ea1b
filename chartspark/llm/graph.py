"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark.llm.common import cut_lineage


def _least(arcs: DataFrame) -> DataFrame:
    """Least of each node and its neighbours.  ``min`` of a long combines before the shuffle, so hubs are no burden."""
    return arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    arcs = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = arcs.join(_least(arcs), "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), "u")
    lower = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    upper = joined.select("u", F.col("m").alias("v"))
    return lower.union(upper).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of every node with a link; the component is its smallest node.

    ``a`` and ``b`` are longs.  Self-links, repeated and null links change nothing.  Rounds are
    logarithmic in the longest chain; each is cut by a reliable checkpoint and only two
    numbers reach the driver.
    """
    now = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = cut_lineage(now.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(sign) or sign[0] == 0:
            break
        state = tuple(sign)
        now = cut_lineage(_small_star(_large_star(now)))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
