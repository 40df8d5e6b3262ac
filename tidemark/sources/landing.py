"""Integrity of landed objects against a manifest that is kept apart from them.

An object is a partition folder of a landing. Its digest is taken over its rows, whatever files and
order they lie in: their number, and the exclusive or and the sum of two 64-bit hashes of a row. All
three merge, so an object is digested by many tasks as its rows stream by, and none holds a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import scratch


def _row_hash(columns: list[str], salt: int) -> Column:
    # a null and the lack of a value must not hash alike, which xxhash64 alone lets them
    return F.xxhash64(F.lit(salt), F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"}))


def object_digests(rows: DataFrame, name: str = "object") -> DataFrame:
    """object, rows and digest of each object of rows(object, ...)."""
    columns = sorted(c for c in rows.columns if c != name)
    a, b = F.bit_xor(_row_hash(columns, 1)), F.sum(_row_hash(columns, 2).cast("decimal(20,0)"))
    found = rows.groupBy(F.col(name).cast("string").alias("object")).agg(F.count("*").alias("rows"), a.alias("_a"), b.alias("_b"))
    return found.select("object", "rows", F.concat_ws(":", F.hex("_a"), F.col("_b").cast("string")).alias("digest"))


def land_objects(rows: DataFrame, name: str = "object") -> str:
    """Write rows as one folder for each object; returns the landing."""
    path = scratch(rows.sparkSession, "landing")
    rows.repartition(name).write.partitionBy(name).parquet(path)
    return path


def declare(rows: DataFrame, name: str = "object") -> str:
    """Write the manifest of what is sent; returns its folder, apart from any landing."""
    path = scratch(rows.sparkSession, "manifest")
    object_digests(rows, name).write.parquet(path)
    return path


def check_objects(manifest: DataFrame, landed: DataFrame, name: str = "object") -> DataFrame:
    """object, declared, landed and status of every object of either side: intact, altered, missing or extra."""
    found = object_digests(landed, name).withColumnsRenamed({"rows": "landed", "digest": "_found"})
    both = manifest.withColumnsRenamed({"rows": "declared", "digest": "_sent"}).join(found, "object", "full")
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("_sent").isNull(), "extra").when((F.col("_sent") == F.col("_found")) & (F.col("declared") == F.col("landed")), "intact").otherwise("altered")
    return both.select("object", "declared", "landed", status.alias("status"))
