"""Queries of further staging projections, crosswalks, quality rules and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import canonical as canon
from ..operators import inventory as inv
from ..operators import supply, versions
from ..sources import files
from ..sources.tables import locations, products, read, sale_lines, scratch
from .basics import market_sales
from .inventory import INV_SQL, _cells, _health, _lots
from .registration import Registry
from .supply import _TERMS, _terms

query = Registry(INV_SQL)


@query("SELECT sku, min(price_minor) AS price_minor, min(business_date) AS effective_from, max(business_date) AS effective_to FROM sales JOIN products USING (sku) GROUP BY sku")
def stage_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sale_lines(spark, sf_dir).join(products(spark, sf_dir).select("sku", "price_minor"), "sku")
    return rows.groupBy("sku").agg(F.min("price_minor").alias("price_minor"), F.min("business_date").alias("effective_from"), F.max("business_date").alias("effective_to"))


@query("SELECT order_id, line_no, sku, location, units AS returned_units, net_minor, known_as_of FROM sales WHERE returned")
def stage_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).where("returned").select("order_id", "line_no", "sku", "location", F.col("units").alias("returned_units"), "net_minor", "known_as_of")


@query("SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY c_mktsegment", base=False)
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"))


@query("SELECT sku, c.location, CASE WHEN d.location IS NULL THEN 'store' ELSE 'warehouse' END AS kind, on_hand, committed FROM cells c LEFT JOIN depot d ON d.location = c.location")
def stage_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of warehouses, which are the nations' depots, and of stores in one role."""
    cells = canon.stock_cells(sale_lines(spark, sf_dir)).select("sku", "location", "on_hand", "committed")
    depots = supply.depots(spark, sf_dir).select("location", F.lit("warehouse").alias("role"))
    return cells.join(depots, "location", "left").select("sku", "location", F.coalesce("role", F.lit("store")).alias("kind"), "on_hand", "committed")


@query("SELECT s.order_id, s.line_no, s.sku, s.location, s.units AS received_units, o_orderstatus AS order_status, gross_minor // s.units AS unit_cost FROM sales s LEFT JOIN orders ON o_orderkey = s.order_id WHERE fulfilled")
def stage_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("order_status"))
    rows = sale_lines(spark, sf_dir).where("fulfilled").join(heads, "order_id", "left")
    return rows.select("order_id", "line_no", "sku", "location", F.col("units").alias("received_units"), "order_status", F.expr("gross_minor div units").alias("unit_cost"))


@query("SELECT dept, category, count(*) AS variants, min(pack_qty) AS least_pack, max(price_minor) AS top_price FROM products GROUP BY ALL")
def stage_item_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).groupBy("dept", "category").agg(F.count("*").alias("variants"), F.min("pack_qty").alias("least_pack"), F.max("price_minor").alias("top_price"))


@query("SELECT order_id, sum(net_minor + tax_minor) AS line_total, CAST(max(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS invoice_total FROM sales JOIN orders ON o_orderkey = order_id GROUP BY order_id")
def stage_invoice_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines against its independent invoice total."""
    totals = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long").alias("t"))
    return sale_lines(spark, sf_dir).join(totals, "order_id").groupBy("order_id").agg(F.sum(F.col("net_minor") + F.col("tax_minor")).alias("line_total"), F.max("t").alias("invoice_total"))


@query("SELECT user_id AS shipment, event_type AS status, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY ALL", base=False)
def stage_inbound_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("shipment"), F.col("event_type").alias("status")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


@query("SELECT user_id AS shipment, event_type AS status, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", base=False)
def inv_open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest status of each shipment, chosen before anything is joined to it."""
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x")
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("shipment")).agg(last).select("shipment", F.col("x.event_type").alias("status"), "x.value")


@query("SELECT CASE WHEN event_type IN ('signup', 'view') THEN 'open' WHEN event_type = 'purchase' THEN 'received' ELSE 'late' END AS state, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1", base=False)
def inv_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type").isin("signup", "view"), "open").when(F.col("event_type") == "purchase", "received").otherwise("late")
    return read(spark, sf_dir, "events").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("""SELECT 'site' AS source, CAST(s_suppkey AS VARCHAR) AS source_key, market, location_key, 'identity' AS mapped_by FROM supplier JOIN xwalk ON location = s_suppkey UNION ALL
  SELECT 'customer', CAST(k AS VARCHAR), r_name, d.location_key, CASE WHEN d.location_key IS NULL THEN 'none' ELSE 'topology' END FROM (SELECT DISTINCT c_nationkey AS k FROM customer) JOIN nation ON n_nationkey = k JOIN region ON n_regionkey = r_regionkey LEFT JOIN depot d ON d.nation = n_name""")
def location_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source keys under canonical locations: a site's key is its own, a customer's nation goes to the depot of that nation, if there is one."""
    own = supply.crosswalk(spark, sf_dir).select(F.lit("site").alias("source"), F.col("location").cast("string").alias("source_key"), "market", "location_key", F.lit("identity").alias("mapped_by"))
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("market"))
    asked = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct().join(places, "n_nationkey")
    found = asked.join(supply.depots(spark, sf_dir).select("nation", "location_key"), "nation", "left")
    mapped = F.when(F.col("location_key").isNull(), "none").otherwise("topology")
    return own.unionByName(found.select(F.lit("customer").alias("source"), F.col("n_nationkey").cast("string").alias("source_key"), "market", "location_key", mapped.alias("mapped_by")))


_BANDS = """, seen AS (SELECT s.sku, CAST(date_trunc('quarter', business_date) AS DATE) AS quarter, CASE WHEN sum(gross_minor) < sum(s.units) * any_value(price_minor) THEN 'below' WHEN sum(gross_minor) < 2 * sum(s.units) * any_value(price_minor) THEN 'list' ELSE 'above' END AS price_band,
    max(known_as_of) AS known FROM sales s JOIN products p ON p.sku = s.sku GROUP BY ALL),
starts AS (SELECT * FROM (SELECT *, lag(price_band) OVER (PARTITION BY sku ORDER BY quarter) AS before FROM seen) WHERE before IS NULL OR before <> price_band),
versions AS (SELECT sku, CAST(row_number() OVER (PARTITION BY sku ORDER BY quarter) AS INTEGER) AS version_no, price_band, quarter AS valid_from, lead(quarter) OVER (PARTITION BY sku ORDER BY quarter) AS valid_to, known AS known_from FROM starts)"""
versioned = Registry(_BANDS)


def product_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each product by the band in which its quarters' prices lie against its list price."""
    lines = sale_lines(spark, sf_dir).join(products(spark, sf_dir).select("sku", "price_minor"), "sku")
    sums = lines.groupBy("sku", F.to_date(F.trunc("business_date", "quarter")).alias("quarter")).agg(F.sum("gross_minor").alias("g"), F.sum(F.col("units") * F.col("price_minor")).alias("l"), F.max("known_as_of").alias("known"))
    band = F.when(F.col("g") < F.col("l"), "below").when(F.col("g") < 2 * F.col("l"), "list").otherwise("above")
    return versions.compress(sums.select("sku", "quarter", band.alias("price_band"), "known"), ["sku"], "quarter", ["price_band"], "known")


@versioned("SELECT sku, product_name, category, dept, version_no, price_band, valid_from, valid_to, known_from FROM versions JOIN products USING (sku)")
def canon_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of every product that sold: a quarter whose prices lie in another band starts one; a version is known when the last line of its first quarter is."""
    names = products(spark, sf_dir).select("sku", "product_name", "category", "dept")
    return product_versions(spark, sf_dir).join(names, "sku").select("sku", "product_name", "category", "dept", "version_no", "price_band", "valid_from", "valid_to", "known_from")


@versioned("SELECT price_band, version_no, count(*) AS lines, CAST(sum(units) AS BIGINT) AS units FROM sales s JOIN versions v ON v.sku = s.sku AND business_date >= valid_from AND (valid_to IS NULL OR business_date < valid_to) GROUP BY ALL")
def canon_product_at_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and units by the version that was valid on the day of the sale: every line finds one."""
    rows = versions.effective(sale_lines(spark, sf_dir).select("sku", "business_date", "units"), product_versions(spark, sf_dir), ["sku"], "business_date")
    return rows.groupBy("price_band", "version_no").agg(F.count("*").alias("lines"), F.sum("units").alias("units"))


@query("SELECT location, location_name, market FROM locations WHERE location IN (SELECT location FROM sales WHERE business_date > DATE '2001-01-01')")
def canon_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that sold in the last year."""
    active = sale_lines(spark, sf_dir).where("business_date > date'2001-01-01'").select("location")
    return locations(spark, sf_dir).join(active, "location", "left_semi").select("location", "location_name", "market")


@query("""SELECT f.order_id, f.line_no, f.sku, d.market AS demand_market, n.market AS supply_market, f.units FROM sales f JOIN locations d ON d.location = f.location
  JOIN (SELECT c_custkey, r_name AS market FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) n ON n.c_custkey = f.customer WHERE f.fulfilled""")
def canon_fulfilments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crosswalk joins: the site's market and the customer's."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("supply_market"))
    who = read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer"), "supply_market")
    sites = locations(spark, sf_dir).select("location", F.col("market").alias("demand_market"))
    return sale_lines(spark, sf_dir).where("fulfilled").join(sites, "location").join(who, "customer").select("order_id", "line_no", "sku", "demand_market", "supply_market", "units")


@query(f"SELECT t.location AS vendor, t.category, d.market, d.location_key AS warehouse, CAST(ceil(t.lead_days) AS BIGINT) AS lead_days, t.moq, t.valid_from FROM {_TERMS} t JOIN locations l ON l.location = t.location JOIN depot d ON d.market = l.market")
def canon_lead_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every vendor and category, fanned out to each warehouse of the vendor's market."""
    terms = _terms(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location")
    houses = supply.depots(spark, sf_dir).select("market", F.col("location_key").alias("warehouse"))
    return terms.join(houses, "market").select(F.col("location").alias("vendor"), "category", "market", "warehouse", F.ceil("lead_days").cast("long").alias("lead_days"), "moq", "valid_from")


@query("SELECT location, month, n, CASE WHEN late * 2 > n THEN 'high' WHEN late * 4 > n THEN 'medium' ELSE 'low' END AS band, round(100.0 * late / n, 4) AS late_percent FROM (SELECT location, CAST(date_trunc('month', business_date) AS DATE) AS month, count(*) AS n, count(*) FILTER (WHERE date_diff('day', business_date, CAST(known_as_of AS DATE)) > 60) AS late FROM sales GROUP BY ALL)")
def canon_supplier_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.count_if(F.datediff(F.col("known_as_of").cast("date"), "business_date") > 60)
    rows = sale_lines(spark, sf_dir).groupBy("location", F.to_date(F.date_trunc("month", "business_date")).alias("month")).agg(F.count("*").alias("n"), late.alias("late"))
    band = F.when(F.col("late") * 2 > F.col("n"), "high").when(F.col("late") * 4 > F.col("n"), "medium").otherwise("low")
    return rows.select("location", "month", "n", band.alias("band"), F.round(100.0 * F.col("late") / F.col("n"), 4).alias("late_percent"))


_DIMENSIONS = {
    "location": ("locations", "location", ("market", "nation", "location_name")),
    "product": ("products", "sku", ("category", "dept", "product_name", "pack_qty", "price_minor")),
    "customer": ("customer", "c_custkey", ("c_name", "c_mktsegment", "c_nationkey")),
}


def _payload_sql(columns: tuple[str, ...]) -> str:
    return "CAST(json_object(" + ", ".join(f"'{c}', {c}" for c in columns) + ") AS VARCHAR)"


@query("SELECT dimension, dimension_key, payload, sha256(dimension || '|' || dimension_key || '|' || payload) AS row_hash FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS dimension, CAST({k} AS VARCHAR) AS dimension_key, {_payload_sql(c)} AS payload FROM {t}" for n, (t, k, c) in _DIMENSIONS.items()) + ")")
def dimension_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dimension as keyed JSON rows with a hash of name, key and content."""
    frames = {"locations": locations(spark, sf_dir), "products": products(spark, sf_dir), "customer": read(spark, sf_dir, "customer")}
    out = None
    for name, (table, key, columns) in _DIMENSIONS.items():
        rows = frames[table].select(F.lit(name).alias("dimension"), F.col(key).cast("string").alias("dimension_key"), F.to_json(F.struct(*columns)).alias("payload"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("row_hash", text.hash_key("dimension", "dimension_key", "payload"))


@query("SELECT 'positive_pack' AS rule, count(*) AS n FROM products WHERE pack_qty < 1 UNION ALL SELECT 'known_category', count(*) FROM products WHERE category IS NULL OR dept NOT LIKE 'Brand#%'")
def b04_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    return canon.violations([("positive_pack", p.where("pack_qty < 1")), ("known_category", p.where("category is null or dept not like 'Brand#%'"))])


@query("SELECT 'both_open' AS rule, count(*) AS n FROM cells WHERE on_order > 0 AND in_transit > 0 UNION ALL SELECT 'over_position', count(*) FROM cells WHERE on_order + in_transit > position")
def b07_inbound_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = canon.positions(canon.stock_cells(sale_lines(spark, sf_dir)))
    return canon.violations([("both_open", c.where("on_order > 0 and in_transit > 0")), ("over_position", c.where("on_order + in_transit > position"))])


_PAID = "CASE WHEN r_name IN ('AFRICA', 'AMERICA') THEN 'USD' WHEN r_name = 'ASIA' THEN 'GBP' WHEN r_name = 'EUROPE' THEN 'EUR' END"


@query(f"SELECT s.market, count(*) AS n, count(*) FILTER (WHERE p.paid IS NULL OR x.currency IS NULL) AS unknown, count(*) FILTER (WHERE p.paid <> x.currency) AS unlike FROM msales s JOIN xwalk x USING (location) JOIN (SELECT c_custkey, {_PAID} AS paid FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) p ON p.c_custkey = s.customer GROUP BY s.market")
def b13_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales whose customer pays in another currency than the site's, or in one that is unknown."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", text.value_map(F.col("r_name"), supply.CURRENCIES).alias("paid"))
    payer = read(spark, sf_dir, "customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer"), "paid")
    rows = sale_lines(spark, sf_dir).join(supply.crosswalk(spark, sf_dir).select("location", "market", "currency"), "location").join(payer, "customer")
    return rows.groupBy("market").agg(F.count("*").alias("n"), F.count_if(F.col("paid").isNull() | F.col("currency").isNull()).alias("unknown"), F.count_if(F.col("paid") != F.col("currency")).alias("unlike"))


@query("SELECT 'sales' AS relation, count(*) FILTER (WHERE known_as_of > CAST(business_date + INTERVAL 100 DAY AS TIMESTAMP)) AS backfilled, count(*) AS n FROM sales UNION ALL SELECT 'adjustments', count(*) FILTER (WHERE known_as_of > CAST(business_date + INTERVAL 100 DAY AS TIMESTAMP)), count(*) FROM adj")
def b21_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, out = sale_lines(spark, sf_dir), None
    for name, rows in (("sales", lines), ("adjustments", canon.adjustments(lines))):
        late = F.count_if(F.col("known_as_of") > F.date_add("business_date", 100).cast("timestamp"))
        row = rows.agg(F.lit(name).alias("relation"), late.alias("backfilled"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT market, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons, bool_and(reason = 'none') AS eligible FROM (SELECT market, CASE WHEN n < 5 THEN 'sparse' WHEN late > 0.6 THEN 'late' ELSE 'none' END AS reason FROM (SELECT market, location, count(*) AS n, avg(CASE WHEN date_diff('day', business_date, CAST(known_as_of AS DATE)) > 60 THEN 1.0 ELSE 0.0 END) AS late FROM msales GROUP BY ALL)) GROUP BY market")
def zero_demand_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May a missing sale be read as zero, with the reasons of the market's sites."""
    late = F.avg(F.when(F.datediff(F.col("known_as_of").cast("date"), "business_date") > 60, 1.0).otherwise(0.0))
    sites = market_sales(spark, sf_dir).groupBy("market", "location").agg(F.count("*").alias("n"), late.alias("late"))
    reason = F.when(F.col("n") < 5, "sparse").when(F.col("late") > 0.6, "late").otherwise("none")
    return sites.groupBy("market").agg(F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("reasons"), F.bool_and(reason == "none").alias("eligible"))  # three reasons at most


@query("SELECT market, category, count(*) AS cells, CAST(sum(on_hand * cost) AS BIGINT) AS value_minor FROM health WHERE market IN ('ASIA', 'EUROPE') AND category <> 'PROMO' GROUP BY ALL")
def sink_inventory_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection written under version keys and read back from the active one only."""
    rows = _health(spark, sf_dir).select("market", "category", (F.col("on_hand") * F.col("cost")).alias("value"))
    path = scratch(spark, "serving")
    rows.withColumn("version_id", F.lit(2)).write.partitionBy("version_id").parquet(path)
    rows.where("market = 'ASIA'").withColumn("version_id", F.lit(1)).write.mode("append").partitionBy("version_id").parquet(path)
    active = spark.read.parquet(path).where("version_id = 2 and market in ('ASIA', 'EUROPE') and category <> 'PROMO'")
    return active.groupBy("market", "category").agg(F.count("*").alias("cells"), F.sum("value").alias("value_minor"))


@query("SELECT sku, location, units, CASE WHEN age_days > 90 THEN 1 WHEN age_days > 60 THEN 2 ELSE 3 END AS priority, units * cost AS value_minor, CASE WHEN days_left < 0 THEN 'write_off' WHEN days_left <= 30 THEN 'markdown' ELSE 'sell' END AS disposition FROM lots")
def rpt_rows_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("age_days") > 90, 1).when(F.col("age_days") > 60, 2).otherwise(3)
    disposition = F.when(F.col("days_left") < 0, "write_off").when(F.col("days_left") <= 30, "markdown").otherwise("sell")
    return _lots(spark, sf_dir).select("sku", "location", "units", priority.alias("priority"), (F.col("units") * F.col("cost")).alias("value_minor"), disposition.alias("disposition"))


@query("SELECT h.sku, h.location, l.location_name, h.health, CASE WHEN h.health IN ('stockout', 'understock') THEN CAST(ceil(greatest(0, h.daily * 28 - h.atp)) AS BIGINT) * h.cost ELSE h.on_hand * h.cost END AS exposure FROM health h JOIN locations l USING (location)")
def rpt_rows_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure: what is missing for shortages, what lies there otherwise."""
    short = F.ceil(F.greatest(F.lit(0.0), F.col("daily") * 28 - F.col("atp"))).cast("long") * F.col("cost")
    exposure = F.when(F.col("health").isin("stockout", "understock"), short).otherwise(F.col("on_hand") * F.col("cost"))
    return _health(spark, sf_dir).join(locations(spark, sf_dir).select("location", "location_name"), "location").select("sku", "location", "location_name", "health", exposure.alias("exposure"))


@query("SELECT market, age, count(DISTINCT sku) AS skus, CAST(sum(units * cost) AS BIGINT) AS value_minor FROM (SELECT *, least(age_days // 30, 4) AS age FROM lots) GROUP BY ALL")
def rpt_age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.least(F.expr("age_days div 30"), F.lit(4).cast("long"))
    return _lots(spark, sf_dir).groupBy("market", age.alias("age")).agg(F.countDistinct("sku").alias("skus"), F.sum(F.col("units") * F.col("cost")).alias("value_minor"))


@query("SELECT location, CAST(sum(on_hand * cost) AS BIGINT) AS value_minor, CAST(sum(damaged * cost) AS BIGINT) AS blocked_minor, round(CAST(sum(CAST(least(atp, coalesce(daily, 0) * 28) AS DECIMAL(18,6))) AS DOUBLE) / nullif(CAST(sum(CAST(coalesce(daily, 0) * 28 AS DECIMAL(18,6))) AS DOUBLE), 0), 4) AS fill_rate, round(CAST(sum(on_hand) AS DOUBLE) / (count(*) * 120), 6) AS utilisation FROM cellx GROUP BY location")
def rpt_warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value, blocked value, fill rate capped by cell, and use of the room."""
    need = F.coalesce("daily", F.lit(0.0)) * 28
    return _cells(spark, sf_dir).groupBy("location").agg(
        F.sum(F.col("on_hand") * F.col("cost")).alias("value_minor"), F.sum(F.col("damaged") * F.col("cost")).alias("blocked_minor"),
        F.round(F.sum(F.least(F.col("atp").cast("double"), need).cast("decimal(18,6)")).cast("double") / F.nullif(F.sum(need.cast("decimal(18,6)")).cast("double"), F.lit(0.0)), 4).alias("fill_rate"), F.round(F.sum("on_hand") / (F.count("*") * 120), 6).alias("utilisation"),
    )


@query("SELECT market, abc, count(*) AS skus, CAST(sum(value) AS BIGINT) AS value_minor FROM (SELECT market, value, CASE WHEN before < 0.8 THEN 'A' WHEN before < 0.95 THEN 'B' ELSE 'C' END AS abc FROM (SELECT market, sku, value, coalesce(CAST(sum(value) OVER (PARTITION BY market ORDER BY value DESC, sku ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / sum(value) OVER (PARTITION BY market), 0) AS before FROM (SELECT market, sku, sum(net_minor) AS value FROM msales GROUP BY ALL))) GROUP BY ALL")
def rpt_safety_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = market_sales(spark, sf_dir).groupBy("market", "sku").agg(F.sum("net_minor").alias("value"))
    return inv.abc(sums, "market", ["sku"], "value").groupBy("market", "abc").agg(F.count("*").alias("skus"), F.sum("value").alias("value_minor"))


@query("SELECT p_brand, count(*) AS n, sum(p_size) AS sizes FROM part GROUP BY p_brand", base=False)
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files that hold one JSON document each, an array of at most a thousand parts, written by Spark and read back."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").alias("size"))
    documents = part.groupBy(F.expr("p_partkey div 1000")).agg(F.to_json(F.collect_list(F.struct("p_brand", "size"))).alias("value"))
    path = scratch(spark, "json")
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    found = files.scan_json(spark, [path], part.select("p_brand", "size").schema, lines=False)
    return found.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"))


QUERIES, ORACLES = query.queries | versioned.queries, query.oracles | versioned.oracles
