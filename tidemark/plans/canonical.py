"""Queries of staging, canonical transforms and data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import canonical as canon
from ..functions import money
from ..sources.tables import locations, products, read, sale_lines
from .basics import market_sales
from .registration import Registry

query = Registry(canon.CANON_SQL)


@query("SELECT order_id, line_no, sku, net_minor AS net_ex_tax, net_minor + tax_minor AS net_inc_tax, gross_minor AS gross_ex_tax, gross_minor + (gross_minor * tax_pct) // 100 AS gross_inc_tax FROM sales")
def stage_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    gross = F.col("gross_minor") + F.expr("(gross_minor * tax_pct) div 100")
    return sale_lines(spark, sf_dir).select(
        "order_id", "line_no", "sku", F.col("net_minor").alias("net_ex_tax"), (F.col("net_minor") + F.col("tax_minor")).alias("net_inc_tax"), F.col("gross_minor").alias("gross_ex_tax"), gross.alias("gross_inc_tax")
    )


@query("SELECT sku, product_name, dept, category, pack_qty, price_minor, greatest(pack_qty, 1) AS order_pack FROM products")
def stage_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).withColumn("order_pack", F.greatest("pack_qty", F.lit(1).cast("long")))


@query("SELECT location, location_name, market, coalesce(nullif(nation, 'NATION_0'), market) AS zone FROM locations")
def stage_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.coalesce(F.nullif(F.col("nation"), F.lit("NATION_0")), F.col("market"))
    return locations(spark, sf_dir).select("location", "location_name", "market", zone.alias("zone"))


@query("SELECT order_id, line_no, sku, location, units, net_minor, greatest(known_as_of, CAST(business_date + INTERVAL 1 DAY AS TIMESTAMP)) AS known_as_of FROM sales WHERE fulfilled")
def stage_fulfilments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known no earlier than a day after the order."""
    known = F.greatest("known_as_of", F.date_add("business_date", 1).cast("timestamp"))
    return sale_lines(spark, sf_dir).where("fulfilled").select("order_id", "line_no", "sku", "location", "units", "net_minor", known.alias("known_as_of"))


@query("""SELECT order_id, line_no, sku, f + CASE WHEN row_number() OVER (PARTITION BY order_id ORDER BY rest DESC, line_no, sku) <= total - sum(f) OVER (PARTITION BY order_id) THEN 1 ELSE 0 END AS refund_minor
  FROM (SELECT *, CAST((CAST(total AS HUGEINT) * units) // w AS BIGINT) AS f, (CAST(total AS HUGEINT) * units) % w AS rest FROM (
    SELECT order_id, line_no, sku, units, sum(units) OVER (PARTITION BY order_id) AS w, CAST((sum(net_minor) OVER (PARTITION BY order_id)) * 9 // 10 AS BIGINT) AS total FROM sales WHERE returned))""")
def stage_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's refund, nine tenths of what came back, over its return lines by largest remainder."""
    back = sale_lines(spark, sf_dir).where("returned")
    total = F.sum("net_minor").over(Window.partitionBy("order_id")) * 9
    rows = back.withColumn("nine", total).withColumn("total", F.expr("nine div 10")).withColumn("at", F.struct("line_no", "sku"))
    return money.largest_remainder(rows, ["order_id"], "total", "units", "at", "refund_minor").select("order_id", "line_no", "sku", "refund_minor")


@query("SELECT market, c_mktsegment, n, round(n / sum(n) OVER (PARTITION BY market), 9) AS share FROM (SELECT r_name AS market, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)")
def canon_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    who = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    sizes = who.groupBy(F.col("r_name").alias("market"), "c_mktsegment").agg(F.count("*").alias("n"))
    return sizes.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("market")), 9))


@query("SELECT channel, min(known_as_of) AS known_as_of, channel LIKE '%-%URGENT' OR channel LIKE '5%' AS online FROM sales GROUP BY channel")
def canon_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    online = F.col("channel").like("%-%URGENT") | F.col("channel").like("5%")
    return sale_lines(spark, sf_dir).groupBy("channel").agg(F.min("known_as_of").alias("known_as_of")).withColumn("online", online)


@query("SELECT * FROM csales")
def canon_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.canon_sales(sale_lines(spark, sf_dir))


@query("SELECT * FROM adj")
def canon_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.adjustments(sale_lines(spark, sf_dir))


@query("SELECT market, CAST(day AS DATE) AS date, dayname(day) AS weekday, isodow(day) < 6 AS working, month(day) AS month, year(day) AS year FROM (SELECT market, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM (SELECT market, min(business_date) AS a, max(business_date) AS b FROM msales GROUP BY market))")
def canon_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.calendar(market_sales(spark, sf_dir), ["market"], "business_date")


@query("SELECT sku, week, price, known_as_of, sha256(CAST(sku AS VARCHAR) || '|' || strftime(week, '%Y-%m-%d')) AS price_key FROM (SELECT sku, CAST(date_trunc('week', business_date) AS DATE) AS week, gross_minor // units AS price, known_as_of, row_number() OVER (PARTITION BY sku, date_trunc('week', business_date) ORDER BY known_as_of DESC, order_id DESC, line_no DESC) AS r FROM sales) WHERE r = 1")
def canon_sell_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price per sku and week: that of the newest line."""
    lines = sale_lines(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "business_date"))).withColumn("price", F.expr("gross_minor div units"))
    rows = canon.latest(lines, ["sku", "week"], ["known_as_of", "order_id", "line_no"])
    return rows.select("sku", "week", "price", "known_as_of", F.sha2(F.concat_ws("|", F.col("sku").cast("string"), F.date_format("week", "yyyy-MM-dd")), 256).alias("price_key"))


@query("SELECT * FROM cells")
def canon_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.positions(canon.stock_cells(sale_lines(spark, sf_dir)))


@query("SELECT sku, location, min(business_date) AS active_from, max(business_date) AS active_to, count(DISTINCT channel) AS channels FROM sales GROUP BY ALL")
def canon_assortment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).groupBy("sku", "location").agg(F.min("business_date").alias("active_from"), F.max("business_date").alias("active_to"), F.countDistinct("channel").alias("channels"))


@query("SELECT sku, market, CAST((2 * sum(CAST(gross_minor AS HUGEINT)) + sum(units)) // (2 * sum(units)) AS BIGINT) AS unit_cost FROM msales WHERE fulfilled GROUP BY ALL")
def canon_inventory_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted average cost, rounded half up in integers."""
    done = market_sales(spark, sf_dir).where("fulfilled").groupBy("sku", "market").agg(F.sum(F.col("gross_minor").cast("decimal(38,0)")).alias("value"), F.sum("units").alias("units"))
    return done.select("sku", "market", F.expr("cast((2 * value + units) div (2 * units) as bigint)").alias("unit_cost"))


@query("SELECT location, s.sku, market, 'missing_product' AS reason FROM (SELECT DISTINCT location, sku, market FROM msales) s LEFT JOIN (SELECT sku FROM products WHERE sku % 97 <> 0) p USING (sku) WHERE p.sku IS NULL")
def unresolved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in use that the crosswalk (here without every 97th product) doesn't know."""
    known = products(spark, sf_dir).where("sku % 97 <> 0").select("sku")
    used = market_sales(spark, sf_dir).select("location", "sku", "market").distinct()
    return used.join(known, "sku", "left_anti").withColumn("reason", F.lit("missing_product"))


_REASON = "CASE WHEN units > 48 THEN 'too_many_units' WHEN discount_pct >= 10 THEN 'discount_over_limit' WHEN known_as_of < CAST(business_date AS TIMESTAMP) THEN 'known_too_early' END"


@query(f"SELECT reason, count(*) AS n, sum(units) AS units FROM (SELECT units, coalesce({_REASON}, 'accepted') AS reason FROM sales) GROUP BY reason")
def reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        ("too_many_units", F.col("units") > 48),
        ("discount_over_limit", F.col("discount_pct") >= 10),
        ("known_too_early", F.col("known_as_of") < F.col("business_date").cast("timestamp")),
    ]
    rows = canon.reject_split(sale_lines(spark, sf_dir), rules)
    return rows.groupBy(F.coalesce("_reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.sum("units").alias("units"))


@query(f"SELECT sha256('sales|' || order_id || '|' || line_no || '|' || sku || '|' || ({_REASON})) AS quarantine_key, order_id, line_no, sku, {_REASON} AS reason FROM sales WHERE {_REASON} IS NOT NULL")
def canon_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("too_many_units", F.col("units") > 48), ("discount_over_limit", F.col("discount_pct") >= 10), ("known_too_early", F.col("known_as_of") < F.col("business_date").cast("timestamp"))]
    bad = canon.reject_split(sale_lines(spark, sf_dir), rules).where("_reject_reason is not null")
    key = F.sha2(F.concat_ws("|", F.lit("sales"), *(F.col(c).cast("string") for c in ("order_id", "line_no", "sku")), F.col("_reject_reason")), 256)
    return bad.select(key.alias("quarantine_key"), "order_id", "line_no", "sku", F.col("_reject_reason").alias("reason"))


@query(None)
def entity_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count, xor and sum of row hashes of each table: equal for equal rows in any order."""
    out = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        table = read(spark, sf_dir, name)
        h = F.xxhash64(*table.columns)
        row = table.agg(F.lit(name).alias("entity"), F.count("*").alias("n"), F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"))
        out = row if out is None else out.unionByName(row)
    return out


# --- quality rules --------------------------------------------------------------------------


@query("""SELECT 'orders' AS dataset, count(*) AS n, count(*) FILTER (WHERE o_orderkey IS NULL) AS null_keys, count(*) - count(DISTINCT o_orderkey) AS repeated FROM orders
  UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL), count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
  UNION ALL SELECT 'part', count(*), count(*) FILTER (WHERE p_partkey IS NULL), count(*) - count(DISTINCT p_partkey) FROM part""", base=False)
def a05_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, keys in (("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("part", ["p_partkey"])):
        missing = F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull()
        row = read(spark, sf_dir, name).agg(F.lit(name).alias("dataset"), F.count("*").alias("n"), F.count_if(missing).alias("null_keys"), (F.count("*") - F.countDistinct(*keys)).alias("repeated"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE l_quantity IS NULL) AS null_quantity, count(*) FILTER (WHERE l_quantity < 1) AS low_quantity, count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.1) AS bad_discount,
  count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')) AS bad_flag, count(*) FILTER (WHERE l_linestatus NOT IN ('O', 'F')) AS bad_status FROM lineitem""", base=False)
def b01_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_quantity").isNull()).alias("null_quantity"), F.count_if(F.col("l_quantity") < 1).alias("low_quantity"),
        F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 0.1)).alias("bad_discount"), F.count_if(~F.col("l_returnflag").isin("A", "N", "R")).alias("bad_flag"),
        F.count_if(~F.col("l_linestatus").isin("O", "F")).alias("bad_status"),
    )


@query("SELECT sku, location, channel, business_date, count(*) AS n FROM sales GROUP BY ALL HAVING count(*) > 1")
def b02_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).groupBy("sku", "location", "channel", "business_date").agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT 'negative_units' AS rule, count(*) AS n FROM csales WHERE units < 0 UNION ALL SELECT 'no_price', count(*) FROM csales WHERE net_price <= 0
  UNION ALL SELECT 'missing_days', CAST(sum(date_diff('day', a, b) + 1 - days) AS BIGINT) FROM (SELECT min(business_date) AS a, max(business_date) AS b, count(DISTINCT business_date) AS days FROM csales GROUP BY sku, location)
  UNION ALL SELECT 'outside_window', count(*) FROM csales s JOIN (SELECT sku, location, min(business_date) AS a FROM sales WHERE returned GROUP BY ALL) w ON s.sku = w.sku AND s.location = w.location AND s.business_date < w.a""")
def b03_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sale_lines(spark, sf_dir)
    sales = canon.canon_sales(lines)
    span = sales.groupBy("sku", "location").agg(F.min("business_date").alias("a"), F.max("business_date").alias("b"), F.countDistinct("business_date").alias("days"))
    missing = span.agg(F.sum(F.datediff("b", "a") + 1 - F.col("days")).alias("n")).select(F.lit("missing_days").alias("rule"), "n")
    window = lines.where("returned").groupBy("sku", "location").agg(F.min("business_date").alias("a"))
    outside = sales.join(window, ["sku", "location"]).where("business_date < a")
    return canon.violations([("negative_units", sales.where("units < 0")), ("no_price", sales.where("net_price <= 0")), ("outside_window", outside)]).unionByName(missing)


@query("SELECT 'missing' AS rule, count(*) AS n FROM sales WHERE known_as_of IS NULL UNION ALL SELECT 'too_early', count(*) FROM sales WHERE known_as_of < CAST(business_date AS TIMESTAMP) UNION ALL SELECT 'very_late', count(*) FROM sales WHERE known_as_of > CAST(business_date + INTERVAL 90 DAY AS TIMESTAMP)")
def b05_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, day = sale_lines(spark, sf_dir), F.col("business_date")
    return canon.violations([("missing", s.where("known_as_of is null")), ("too_early", s.where(F.col("known_as_of") < day.cast("timestamp"))), ("very_late", s.where(F.col("known_as_of") > F.date_add(day, 90).cast("timestamp")))])


@query("""SELECT 'negative' AS rule, count(*) AS n FROM cells WHERE least(on_hand, committed, reserved, damaged, on_order, in_transit) < 0
  UNION ALL SELECT 'oversold', count(*) FROM cells WHERE on_hand < committed + reserved + damaged UNION ALL SELECT 'atp_equation', count(*) FROM cells WHERE atp <> greatest(0, on_hand - committed - reserved - damaged)""")
def b06_atp(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = canon.positions(canon.stock_cells(sale_lines(spark, sf_dir)))
    return canon.violations([
        ("negative", c.where("least(on_hand, committed, reserved, damaged, on_order, in_transit) < 0")),
        ("oversold", c.where("on_hand < committed + reserved + damaged")),
        ("atp_equation", c.where("atp <> greatest(0, on_hand - committed - reserved - damaged)")),
    ])


@query("""SELECT 'line_order' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'line_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'line_supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'site_nation', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)""", base=False)
def b09_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [("line_order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("line_part", "lineitem", "l_partkey", "part", "p_partkey"), ("line_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
            ("order_customer", "orders", "o_custkey", "customer", "c_custkey"), ("site_nation", "supplier", "s_nationkey", "nation", "n_nationkey")]
    return canon.violations([(rule, read(spark, sf_dir, a).join(read(spark, sf_dir, b), F.col(x) == F.col(y), "left_anti")) for rule, a, x, b, y in keys])


@query("SELECT sku, order_id, line_no, gross_minor // units AS price, net_minor // units AS promo_price FROM sales WHERE net_minor // units > gross_minor // units OR gross_minor // units > 4 * (SELECT avg(price_minor) FROM products)")
def b14_promo_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = products(spark, sf_dir).agg(F.avg("price_minor").alias("mean"))  # one row
    rows = sale_lines(spark, sf_dir).crossJoin(mean).select("sku", "order_id", "line_no", F.expr("gross_minor div units").alias("price"), F.expr("net_minor div units").alias("promo_price"), "mean")
    return rows.where("promo_price > price or price > 4 * mean").drop("mean")


@query("SELECT sku, business_date, next_date FROM (SELECT sku, business_date, lead(business_date) OVER (PARTITION BY sku ORDER BY business_date) AS next_date FROM (SELECT DISTINCT sku, business_date FROM sales)) WHERE date_diff('day', business_date, next_date) > 180")
def b15_stale_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = sale_lines(spark, sf_dir).select("sku", "business_date").distinct()
    following = F.lead("business_date").over(Window.partitionBy("sku").orderBy("business_date"))
    return days.withColumn("next_date", following).where(F.datediff("next_date", "business_date") > 180)


@query("""SELECT coalesce(a.business_date, b.business_date) AS business_date, coalesce(a.units, 0) AS units, coalesce(b.units, 0) AS fulfilled_units, coalesce(a.net, 0) AS net_minor, coalesce(b.net, 0) AS fulfilled_minor,
  coalesce(b.units, 0) > coalesce(a.units, 0) AS over_fulfilled FROM (SELECT business_date, sum(units) AS units, sum(net_minor) AS net FROM sales GROUP BY ALL) a
  FULL JOIN (SELECT business_date, sum(units) AS units, sum(net_minor) AS net FROM csales GROUP BY ALL) b ON a.business_date = b.business_date""")
def b16_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sale_lines(spark, sf_dir)
    a = lines.groupBy("business_date").agg(F.sum("units").alias("u"), F.sum("net_minor").alias("n"))
    b = canon.canon_sales(lines).groupBy("business_date").agg(F.sum("units").alias("fu"), F.sum("net_minor").alias("fn"))
    z = F.lit(0)
    both = a.join(b, "business_date", "full_outer").select("business_date", F.coalesce("u", z).alias("units"), F.coalesce("fu", z).alias("fulfilled_units"), F.coalesce("n", z).alias("net_minor"), F.coalesce("fn", z).alias("fulfilled_minor"))
    return both.withColumn("over_fulfilled", F.col("fulfilled_units") > F.col("units"))


@query("SELECT event_type, count(*) AS n, sum(units) AS units, sum(amount_minor) AS amount_minor FROM adj GROUP BY event_type")
def b17_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.adjustments(sale_lines(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("units").alias("units"), F.sum("amount_minor").alias("amount_minor"))


@query("""SELECT market, n_rows, stores, n_rows > 0 AND stores > 1 AS can_forecast, CASE WHEN n_rows = 0 THEN 'no_sales' WHEN stores <= 1 THEN 'one_store' WHEN share_late > 0.5 THEN 'late_evidence' ELSE 'ready' END AS reason
  FROM (SELECT market, count(*) AS n_rows, count(DISTINCT location) AS stores, avg(CASE WHEN known_as_of > CAST(business_date + INTERVAL 60 DAY AS TIMESTAMP) THEN 1.0 ELSE 0.0 END) AS share_late FROM msales GROUP BY market)""")
def capability_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.when(F.col("known_as_of") > F.date_add("business_date", 60).cast("timestamp"), 1.0).otherwise(0.0)
    facts = market_sales(spark, sf_dir).groupBy("market").agg(F.count("*").alias("n_rows"), F.countDistinct("location").alias("stores"), F.avg(late).alias("share_late"))
    reason = F.when(F.col("n_rows") == 0, "no_sales").when(F.col("stores") <= 1, "one_store").when(F.col("share_late") > 0.5, "late_evidence").otherwise("ready")
    return facts.select("market", "n_rows", "stores", ((F.col("n_rows") > 0) & (F.col("stores") > 1)).alias("can_forecast"), reason.alias("reason"))


QUERIES, ORACLES = query.queries, query.oracles
