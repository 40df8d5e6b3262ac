"""Sums over networks of several levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch


def roll_up(values: DataFrame, edges: DataFrame, measures: list[str], keys: list[str] = [], *, most_levels: int = 16, tasks: int | None = None) -> DataFrame:  # noqa: B006
    """node, keys and measures of every node: its own values(node, keys, measures) and those of all that it supplies.

    edges(child, parent) has an edge once; a child may have several parents and then counts in full at
    each. Level by level, what has arrived at the nodes moves on to their parents, added up first, so a
    step's rows are nodes and keys, never paths; each level is written before the next reads it. Edges
    that run in a circle would never end: values that still move after `most_levels` levels raise. With
    `tasks`, rows are dealt by keys to so many, for keys that are many more than the tasks.
    """
    spark = values.sparkSession

    def sums(rows: DataFrame) -> DataFrame:
        dealt = rows if tasks is None else rows.repartition(tasks, *keys)
        return dealt.groupBy("node", *keys).agg(*(F.sum(m).alias(m) for m in measures))

    step = sums(values)
    arrived = None
    for _ in range(most_levels):
        path = scratch(spark, "level")
        step.write.parquet(path)
        here = spark.read.parquet(path)
        arrived = here if arrived is None else arrived.unionByName(here)
        if here.isEmpty():
            return sums(arrived)
        up = here.join(edges.select(F.col("child").alias("node"), "parent").distinct(), "node").drop("node").withColumnRenamed("parent", "node")
        step = sums(up)
    names = [r["node"] for r in step.select("node").distinct().orderBy("node").limit(5).collect()]
    if names:
        raise ValueError(f"values still move after {most_levels} levels: edges run in a circle at or below {', '.join(map(str, names))}")
    return sums(arrived)
