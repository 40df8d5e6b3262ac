"""Running sums over large groups in two levels.

A window with an order puts a whole group into one task. Here the rows are dealt by ranges of
(group, order), so a group spreads over as many tasks as its size asks for; a window within each
range and the sums of the ranges before it make up the running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch


def running_before(rows: DataFrame, group: list[str], order: list[Column], value: str, name: str = "before", total: str | None = None, ranges: int | None = None) -> DataFrame:
    """rows with the sum of `value` over the rows of the group before each one in `order`, null values as 0.

    `order` has to tell all rows of a group apart for one result. With `total`, the group's sum too.
    Ranges are cut by a sample of the order, so rows that tie in its first columns still spread. The
    dealt rows are written once, so that each keeps its range; there are at most `ranges` + groups
    range sums.
    """
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "ranges")
    rows.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    own = F.coalesce(F.col(value), F.lit(0))
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "_range").agg(F.sum(own).alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = {"_start": F.coalesce(F.sum("_sum").over(ahead), F.lit(0))}
    if total:
        starts[total] = F.sum("_sum").over(Window.partitionBy(*group))
    starts = sums.withColumns(starts).drop("_sum")
    placed = dealt.withColumn("_own", F.coalesce(F.sum(own).over(within), F.lit(0))).join(starts, [*group, "_range"])
    return placed.withColumn(name, F.col("_own") + F.col("_start")).drop("_own", "_start", "_range")
