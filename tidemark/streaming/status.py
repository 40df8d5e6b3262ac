"""Status events as a stream: windows by event type, kept current from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read, scratch


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; its schema is declared by the table itself."""
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events.parquet*")


def status_windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and values by type and window; the watermark lets go of the state of windows that no event can change."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum((F.col("value").cast("decimal(18,2)") * 100).cast("long")).alias("value_minor")
    )


def drained(windows: DataFrame) -> DataFrame:
    """Run over all that is there and return each window's last state.

    In update mode a batch brings the windows that it changed; they are written under its number, so
    a batch that is run again replaces its own rows only, and readers take a window's newest ones.
    """
    spark = windows.sparkSession
    target, state = scratch(spark, "windows"), scratch(spark, "state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    running = windows.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start()
    running.awaitTermination()
    changed = spark.read.schema(windows.schema.add("batch", "long")).parquet(target)
    values = [c for c in windows.columns if c not in ("w", "event_type")]
    return changed.groupBy("w", "event_type").agg(F.max_by(F.struct(*values), "batch").alias("x")).select("w", "event_type", *(F.col(f"x.{c}").alias(c) for c in values))
