"""Files in and out: scans by format and sinks in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import scratch


def scan_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files united by column name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def scan_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All columns as text, united by name over the paths."""
    frames = [spark.read.option("header", "true").csv(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_json(spark: SparkSession, paths: list[str], schema: StructType | None = None, *, lines: bool = True) -> DataFrame:
    """One JSON object a line, or one document a file; a declared schema saves a pass."""
    reader = spark.read.option("multiLine", str(not lines).lower())
    return (reader.schema(schema) if schema else reader).json(paths)


def land(df: DataFrame, kind: str) -> str:
    """Write as `kind` and return the folder."""
    path = scratch(df.sparkSession, f"land-{kind}")
    writer = df.write.option("compression", "zstd") if kind == "parquet" else df.write.option("header", "true") if kind == "csv" else df.write
    writer.format(kind).save(path)
    return path


def land_partitioned(df: DataFrame, columns: list[str]) -> str:
    path = scratch(df.sparkSession, "land-by")
    df.write.option("compression", "zstd").partitionBy(*columns).parquet(path)
    return path


def land_by_month(df: DataFrame, day: str) -> str:
    """Partitioned by year and month; rows of a month are brought together so that files stay few."""
    marked = df.withColumns({"year": F.year(day), "month": F.month(day)})
    return land_partitioned(marked.repartition("year", "month"), ["year", "month"])
