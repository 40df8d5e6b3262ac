"""Readers, writers and the canonical frames derived from the star-schema tables.

Monetary columns arrive as doubles; they become exact integer minor units through a decimal here
and stay integers from then on. Every fact carries its business date and the instant it is known.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: order lines that a task takes where its rows grow with them
TASK_LINES = 100_000


def line_tasks(spark: SparkSession, sf_dir: str, lines: int = TASK_LINES) -> int:
    """Tasks for work by order line, so that one task's share stays the same whatever the table: read from its row counts."""
    return max(1, -(-read(spark, sf_dir, "lineitem").count() // lines))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder; a temporary one only in local mode where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def minor(amount: Column | str) -> Column:
    """Exact minor units of a two-decimal amount."""
    value = F.col(amount) if isinstance(amount, str) else amount
    return (value.cast("decimal(18,2)") * 100).cast("long")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("sku"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("dept"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("long").alias("pack_qty"),
        minor("p_retailprice").alias("price_minor"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier sites as stores, with their market; markets are few, suppliers are not broadcast."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    markets = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("market"))
    site = read(spark, sf_dir, "supplier").join(markets, F.col("s_nationkey") == F.col("n_nationkey"))
    return site.select(F.col("s_suppkey").alias("location"), F.col("s_name").alias("location_name"), "market", F.col("n_name").alias("nation"))


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with header dates and channel, in units and minor units."""
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    percent = F.round(F.col("l_discount") * 100).cast("long")
    rate = F.round(F.col("l_tax") * 100).cast("long")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("sku"),
        F.col("l_suppkey").alias("location"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_orderdate").cast("date").alias("business_date"),
        F.col("l_shipdate").alias("known_as_of"),
        F.col("l_quantity").cast("long").alias("units"),
        minor("l_extendedprice").alias("gross_minor"),
        percent.alias("discount_pct"),
        rate.alias("tax_pct"),
        (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_linestatus") == "F").alias("fulfilled"),
    )
    rows = rows.withColumn("discount_minor", F.expr("(gross_minor * discount_pct) div 100"))
    rows = rows.withColumn("net_minor", F.col("gross_minor") - F.col("discount_minor"))
    return rows.withColumn("tax_minor", F.expr("(net_minor * tax_pct) div 100"))


def weekly_series(sales: DataFrame) -> DataFrame:
    """Units and money by sku, location and Monday week."""
    return (
        sales.groupBy("sku", "location", F.to_date(F.date_trunc("week", "business_date")).alias("week"))
        .agg(F.sum("units").alias("units"), F.sum("net_minor").alias("net_minor"), F.count("*").alias("lines"), F.max("known_as_of").alias("known_as_of"))
    )


def category_weeks(sales: DataFrame, goods: DataFrame) -> DataFrame:
    """Units, money, lines and promoted lines by category, market and Monday week; weeks without sales have no row."""
    return (
        sales.join(goods.select("sku", "category"), "sku")
        .groupBy("category", "market", F.to_date(F.date_trunc("week", "business_date")).alias("week"))
        .agg(F.sum("units").alias("units"), F.sum("net_minor").alias("net_minor"), F.count("*").alias("lines"), F.count_if(F.col("discount_pct") >= 8).alias("promo_lines"))
    )


#: The same frames in DuckDB SQL, to be followed by a query.
BASE_SQL = """
WITH products AS (
  SELECT p_partkey AS sku, p_name AS product_name, p_brand AS dept, p_type AS category, CAST(p_size AS BIGINT) AS pack_qty,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS price_minor FROM part),
locations AS (
  SELECT s_suppkey AS location, s_name AS location_name, r_name AS market, n_name AS nation
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
lines0 AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS sku, l_suppkey AS location, o_custkey AS customer, o_orderpriority AS channel,
         CAST(o_orderdate AS DATE) AS business_date, l_shipdate AS known_as_of, CAST(l_quantity AS BIGINT) AS units,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS gross_minor, CAST(round(l_discount * 100) AS BIGINT) AS discount_pct,
         CAST(round(l_tax * 100) AS BIGINT) AS tax_pct, l_returnflag = 'R' AS returned, l_linestatus = 'F' AS fulfilled
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
lines1 AS (SELECT *, (gross_minor * discount_pct) // 100 AS discount_minor, gross_minor - (gross_minor * discount_pct) // 100 AS net_minor FROM lines0),
sales AS (SELECT *, (net_minor * tax_pct) // 100 AS tax_minor FROM lines1),
msales AS (SELECT s.*, market FROM sales s JOIN locations l USING (location)),
weeks AS (
  SELECT sku, location, CAST(date_trunc('week', business_date) AS DATE) AS week, CAST(sum(units) AS BIGINT) AS units, CAST(sum(net_minor) AS BIGINT) AS net_minor,
         count(*) AS lines, max(known_as_of) AS known_as_of FROM sales GROUP BY ALL),
cweeks AS (
  SELECT category, market, CAST(date_trunc('week', business_date) AS DATE) AS week, CAST(sum(units) AS BIGINT) AS units, CAST(sum(net_minor) AS BIGINT) AS net_minor,
         count(*) AS lines, count(*) FILTER (WHERE discount_pct >= 8) AS promo_lines FROM msales JOIN products USING (sku) GROUP BY ALL)
"""
