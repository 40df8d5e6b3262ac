"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links of integer ids to (id, component_id): the least id that links reach.

    Only linked ids are returned. Self links and repeated links change nothing; an empty table
    gives an empty one. Each round is written to the shared folder, so a lost executor costs a
    round at most; the number of rounds grows with the logarithm of the longest chain.
    """
    now = written(edges.where("u <> v").select("u", "v").distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
        now = written(_small_star(_large_star(now)))
    tails = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return tails.union(tails.select("component_id", "component_id").distinct())
