"""Quantiles of any span of periods from small sketches kept by period.

A sketch of a group's values in a period is a few kilobytes whatever their number, and sketches
merge. So values are read once, when their period closes; quantiles of a quarter or a year come from
the sketches, and no task holds a group's values.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: sketch size: ranks are right to about one in a hundred, within twice that nearly always
K = 400
RANK_ERROR = 0.02


class SketchStore:
    """Sketches of `value` by `group` columns and period, in a folder, a partition for each period."""

    def __init__(self, spark: SparkSession, folder: str, group: list[str], value: str, period: str) -> None:
        self.spark, self.folder, self.group, self.value, self.period = spark, folder, group, value, period

    def stored(self) -> DataFrame | None:
        """Group columns, period and sketch of what is stored; nothing of a new store."""
        try:
            return self.spark.read.parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def add(self, rows: DataFrame) -> DataFrame:
        """Sketch the periods of rows(group, value, period) that the store lacks; returns the sketches added.

        The stored periods are a filter on the input, so a source partitioned by period is read for
        the new ones only. A period is added whole, once.
        """
        stored = self.stored()
        if stored is not None:
            done = [r[0] for r in stored.select(self.period).distinct().collect()]  # a row for each period
            rows = rows.where(~F.col(self.period).isin(done))
        made = rows.groupBy(*self.group, self.period).agg(F.kll_sketch_agg_double(F.col(self.value).cast("double"), K).alias("sketch"), F.count(self.value).alias("n"))
        made.repartition(self.period).write.mode("append").partitionBy(self.period).parquet(self.folder)
        return made

    def quantiles(self, levels: list[float], where: str = "true") -> DataFrame:
        """group, n and q (an array by level) of the periods that `where` picks."""
        stored = self.stored()
        if stored is None:
            raise ValueError(f"{self.folder} holds no period yet")
        merged = stored.where(where).groupBy(*self.group).agg(F.kll_merge_agg_double("sketch", K).alias("_s"), F.sum("n").alias("n"))
        return merged.select(*self.group, "n", F.array(*(F.kll_sketch_get_quantile_double("_s", F.lit(q)) for q in levels)).alias("q"))


def fallback(quantiles: DataFrame, whole: DataFrame, group: list[str], least: int) -> DataFrame:
    """Groups with fewer than `least` values take the quantiles of all; `own` tells which have theirs."""
    one = whole.select(F.col("q").alias("_q"))  # one row
    own = F.col("n") >= least
    return quantiles.crossJoin(F.broadcast(one)).select(*group, "n", F.when(own, F.col("q")).otherwise(F.col("_q")).alias("q"), own.alias("own"))
