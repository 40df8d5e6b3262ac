"""Streaming queries; each drains what its table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import status
from .registration import Registry

query = Registry()


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS value_minor FROM events GROUP BY ALL", base=False)
def stream_status_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of the status stream."""
    found = status.drained(status.status_windows(status.event_stream(spark, sf_dir)))
    return found.selectExpr("cast(w.start as date) as day", "event_type", "n", "value_minor")


QUERIES, ORACLES = query.queries, query.oracles
