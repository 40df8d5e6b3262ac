"""Versioned serving tables: a version is written whole, then one manifest row makes it the one that is read.

A folder holds `versions/<id>`, `written` (a row for each version whose write came to its end) and `manifest`. Readers resolve the manifest first, so a version
whose write broke off, or that was never activated, is not seen; a rollback is one more row. The
manifest is append-only: its row of the largest sequence number rules. Versions are never changed
after their activation, so a reader that resolved one goes on reading it while the next is written.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "seq long, version string, rows long, at timestamp"
WRITTEN = "version string, rows long"


class ServingTable:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _rows(self, name: str, shape: str) -> DataFrame:
        try:
            return self.spark.read.schema(shape).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], shape)

    def manifest(self) -> DataFrame:
        """The activations so far, in any order; none of a new folder."""
        return self._rows("manifest", MANIFEST)

    def active(self) -> str | None:
        """The version that readers see, by the last activation."""
        return self.manifest().agg(F.max_by("version", "seq").alias("v")).first()["v"]  # one row

    def write(self, rows: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write a new version without activating it; returns its id."""
        version = uuid.uuid4().hex
        path = f"{self.folder}/versions/{version}"
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(path)
        counted = self.spark.read.parquet(path).agg(F.count("*").alias("rows"))
        counted.select(F.lit(version).alias("version"), "rows").write.mode("append").parquet(f"{self.folder}/written")
        return version

    def activate(self, version: str) -> None:
        """Make a written version the one that is read: the last step of a publication, and the whole of a rollback."""
        whole = self._rows("written", WRITTEN).where(F.col("version") == version).limit(1)
        if whole.isEmpty():
            raise ValueError(f"version {version} was not written to its end")
        last = self.manifest().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))
        row = whole.crossJoin(F.broadcast(last))  # one row each
        row.select((F.col("seq") + 1).alias("seq"), "version", "rows", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.folder}/manifest")

    def publish(self, rows: DataFrame, partition_by: list[str] | None = None) -> str:
        version = self.write(rows, partition_by)
        self.activate(version)
        return version

    def read(self) -> DataFrame:
        version = self.active()
        if version is None:
            raise ValueError(f"no version of {self.folder} is active")
        return self.spark.read.parquet(f"{self.folder}/versions/{version}")
