"""Canonical transforms: staging projections, bitemporal facts, densified series and stock cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in `order`: the newest visible version."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def canon_sales(lines: DataFrame) -> DataFrame:
    """Fulfilled units and money per sku, location, channel and day, with the latest evidence."""
    done = lines.where("fulfilled")
    sums = [F.sum(c).alias(c) for c in ("units", "gross_minor", "discount_minor", "net_minor", "tax_minor")]
    return done.groupBy("sku", "location", "channel", "business_date").agg(
        *sums,
        F.round(F.sum("net_minor").cast("decimal(20,0)") / F.sum("units"), 0).cast("long").alias("net_price"),
        F.bool_or(F.col("discount_minor") > 0).alias("promo_flag"),
        F.max("known_as_of").alias("known_as_of"),
    )


def adjustments(lines: DataFrame) -> DataFrame:
    """Returns and cancellations as typed, positive events."""
    kind = F.when(F.col("returned"), "return").when(~F.col("fulfilled") & (F.col("units") <= 2), "cancellation")
    return lines.withColumn("event_type", kind).where("event_type is not null").select(
        "order_id", "line_no", "sku", "location", "event_type", "business_date", F.abs("units").alias("units"), F.abs("net_minor").alias("amount_minor"), "known_as_of"
    )


def calendar(facts: DataFrame, keys: list[str], day: str) -> DataFrame:
    """One row per key and day between its first and last fact."""
    span = facts.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("date"))
    return days.withColumns({"weekday": F.date_format("date", "EEEE"), "working": F.weekday("date") < 5, "month": F.month("date").cast("long"), "year": F.year("date").cast("long")})


#: The day of the stock snapshot.
SNAPSHOT = "2000-12-31"
#: Buckets of a cell as sums of its lines' units, in Spark's and DuckDB's SQL alike: what was
#: received within a year or came back lies there, what is overdue or not yet due is promised or expected.
BUCKETS = {
    "on_hand": "fulfilled AND due <= snapshot AND (returned OR age < 365)",
    "committed": "NOT fulfilled AND due <= snapshot AND age < 365",
    "reserved": "NOT fulfilled AND returned AND due > snapshot",
    "damaged": "fulfilled AND returned AND due <= snapshot AND age >= 730",
    "on_order": "NOT fulfilled AND NOT returned AND due > snapshot",
    "in_transit": "fulfilled AND due > snapshot",
}


def stock_cells(lines: DataFrame, **more: Column) -> DataFrame:
    """Stock buckets of each sku and location that ever sold, from the states of its lines at the snapshot.

    `more` has further aggregates of units, fulfilled, returned and business_date, taken in the same pass.
    """
    day = F.lit(SNAPSHOT).cast("date")
    due = F.col("known_as_of").cast("date")
    rows = lines.select("sku", "location", "units", "fulfilled", "returned", "business_date", due.alias("due"), day.alias("snapshot"), F.datediff(day, due).alias("age"))
    sums = [F.coalesce(F.sum(F.when(F.expr(rule), F.col("units"))), F.lit(0)).cast("long").alias(name) for name, rule in BUCKETS.items()]
    active = F.max("business_date") > F.date_sub(day, 730)
    return rows.groupBy("sku", "location").agg(*sums, active.alias("active"), *(v.alias(k) for k, v in more.items()))


def positions(cells: DataFrame) -> DataFrame:
    """Available to promise and position units; buckets are disjoint and never negative."""
    free = F.greatest(F.lit(0), F.col("on_hand") - F.col("committed") - F.col("reserved") - F.col("damaged"))
    return cells.withColumn("atp", free).withColumn("position", F.col("atp") + F.col("on_order") + F.col("in_transit"))


def reject_split(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows with the code of the first rule that fires as _reject_reason, null where accepted."""
    chain = F.lit(None).cast("string")
    for code, fires in reversed(rules):
        chain = F.when(fires, F.lit(code)).otherwise(chain)
    return rows.withColumn("_reject_reason", chain)


def violations(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """Number of rows by rule, zero where none; each frame holds the rows that break its rule."""
    out = None
    for rule, rows in checks:
        n = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = n if out is None else out.unionByName(n)
    return out


#: Stock cells and canonical sales in DuckDB SQL, after the base frames.
CANON_SQL = f"""
, cells0 AS (
  SELECT sku, location, {", ".join(f"CAST(coalesce(sum(units) FILTER (WHERE {rule}), 0) AS BIGINT) AS {name}" for name, rule in BUCKETS.items())}, max(business_date) > DATE '{SNAPSHOT}' - 730 AS active
  FROM (SELECT *, CAST(known_as_of AS DATE) AS due, DATE '{SNAPSHOT}' AS snapshot, date_diff('day', CAST(known_as_of AS DATE), DATE '{SNAPSHOT}') AS age FROM sales) GROUP BY sku, location),
cells1 AS (SELECT *, greatest(0, on_hand - committed - reserved - damaged) AS atp FROM cells0),
cells AS (SELECT *, atp + on_order + in_transit AS position FROM cells1),
csales AS (
  SELECT sku, location, channel, business_date, CAST(sum(units) AS BIGINT) AS units, CAST(sum(gross_minor) AS BIGINT) AS gross_minor, CAST(sum(discount_minor) AS BIGINT) AS discount_minor,
         CAST(sum(net_minor) AS BIGINT) AS net_minor, CAST(sum(tax_minor) AS BIGINT) AS tax_minor, CAST(round(sum(net_minor)::DOUBLE / sum(units)) AS BIGINT) AS net_price,
         bool_or(discount_minor > 0) AS promo_flag, max(known_as_of) AS known_as_of FROM sales WHERE fulfilled GROUP BY ALL),
adj AS (
  SELECT order_id, line_no, sku, location, CASE WHEN returned THEN 'return' WHEN NOT fulfilled AND units <= 2 THEN 'cancellation' END AS event_type, business_date,
         abs(units) AS units, abs(net_minor) AS amount_minor, known_as_of FROM sales WHERE returned OR (NOT fulfilled AND units <= 2))
"""
