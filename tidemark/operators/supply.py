"""Supply-side source frames read from the star-schema tables, and the crosswalk of their sites.

A line is an inbound shipment of its product to its site: received where it is fulfilled, expected
at its ship date otherwise. Costs, lead times, lots, lanes and terms are what the lines show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import locations, products, read, sale_lines

AS_OF = "2000-12-31"
#: The currency of each market; the last one has none.
CURRENCIES = {"AFRICA": "USD", "AMERICA": "USD", "ASIA": "GBP", "EUROPE": "EUR"}


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """location, market, location_key and currency of each site."""
    sites = locations(spark, sf_dir)
    return sites.select("location", "market", "nation", text.compose_key("/", "market", "nation", "location").alias("location_key"), text.value_map(F.col("market"), CURRENCIES).alias("currency"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbound lines with state, received and outstanding units, unit cost and lead days as of the decision day."""
    due = F.col("known_as_of").cast("date")
    rows = sale_lines(spark, sf_dir).where(F.col("business_date") <= as_of())
    state = F.when(F.col("fulfilled"), "received").when(due < as_of(), "late").otherwise("open")
    return rows.select(
        "order_id", "line_no", "sku", "location", "customer", "channel", "business_date", due.alias("due_date"), "units", "net_minor", "returned", state.alias("state"),
        F.when(F.col("fulfilled"), F.col("units")).otherwise(0).alias("received_units"), F.when(F.col("fulfilled"), 0).otherwise(F.col("units")).alias("outstanding_units"),
        F.expr("net_minor div units").alias("unit_cost"), F.datediff(due, "business_date").cast("long").alias("lead_days"),
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received lines as lots; a product keeps thirty days for each unit of its pack size."""
    goods = products(spark, sf_dir).select("sku", "pack_qty", "category", "dept")
    rows = shipments(spark, sf_dir).where("state = 'received'").join(goods, "sku")
    return rows.select("order_id", "line_no", "sku", "location", "category", "dept", "units", "unit_cost", "returned", F.col("due_date").alias("received_on"), F.expr("date_add(due_date, cast(30 * pack_qty as int))").alias("expires_on"))


def depots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site of each nation that received most units, the least of equal ones: nation, market, location, location_key."""
    received = shipments(spark, sf_dir).groupBy("location").agg(F.sum("received_units").alias("u"))
    sites = crosswalk(spark, sf_dir).join(received, "location", "left")
    first = F.min_by(F.struct("market", "location", "location_key"), F.struct(-F.coalesce("u", F.lit(0)), F.col("location")))
    return sites.groupBy("nation").agg(first.alias("x")).select("nation", "x.*")


SUPPLY_SQL = f"""
, xwalk AS (SELECT location, market, nation, market || '/' || nation || '/' || location AS location_key, CASE {" ".join(f"WHEN market = '{m}' THEN '{c}'" for m, c in CURRENCIES.items())} END AS currency FROM locations),
ship AS (SELECT order_id, line_no, sku, location, customer, channel, business_date, CAST(known_as_of AS DATE) AS due_date, units, net_minor, returned,
  CASE WHEN fulfilled THEN 'received' WHEN CAST(known_as_of AS DATE) < DATE '{AS_OF}' THEN 'late' ELSE 'open' END AS state, CASE WHEN fulfilled THEN units ELSE 0 END AS received_units,
  CASE WHEN fulfilled THEN 0 ELSE units END AS outstanding_units, net_minor // units AS unit_cost, date_diff('day', business_date, CAST(known_as_of AS DATE)) AS lead_days FROM sales WHERE business_date <= DATE '{AS_OF}'),
lot AS (SELECT order_id, line_no, sku, location, category, dept, units, unit_cost, returned, due_date AS received_on, due_date + CAST(30 * pack_qty AS INTEGER) AS expires_on FROM ship JOIN products USING (sku) WHERE state = 'received'),
depot AS (SELECT nation, market, location, location_key FROM (SELECT x.*, row_number() OVER (PARTITION BY nation ORDER BY coalesce(u, 0) DESC, x.location) AS r
  FROM xwalk x LEFT JOIN (SELECT location, CAST(sum(received_units) AS BIGINT) AS u FROM ship GROUP BY location) s ON s.location = x.location) WHERE r = 1)
"""
