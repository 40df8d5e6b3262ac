"""Queries of the relational building blocks: scans and sinks, joins, aggregates, windows, sets, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money
from ..sources import files
from ..sources.tables import category_weeks, line_tasks, locations, products, read, sale_lines, scratch
from .registration import Registry

query = Registry()


def market_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location")


# --- scans and sinks ------------------------------------------------------------------------


@query("SELECT p_brand, count(*) AS parts, sum(p_size) AS sizes FROM part GROUP BY p_brand", base=False)
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_parquet(spark, [f"{sf_dir}/part.parquet"]).groupBy("p_brand").agg(F.count("*").alias("parts"), F.sum("p_size").alias("sizes"))


_CUSTOMERS = "SELECT c_mktsegment, count(*) AS customers, CAST(sum(CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS balance_minor FROM customer GROUP BY c_mktsegment"


def _segments(rows: DataFrame) -> DataFrame:
    balance = F.sum((F.col("c_acctbal").cast("decimal(18,2)") * 100).cast("long"))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), balance.alias("balance_minor"))


@query(_CUSTOMERS, base=False)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(files.scan_csv(spark, [files.land(read(spark, sf_dir, "customer"), "csv")]))


@query(_CUSTOMERS, base=False)
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    return _segments(files.scan_json(spark, [files.land(customer, "json")], customer.schema))


@query(_CUSTOMERS, base=False)
def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark.read.parquet(files.land(read(spark, sf_dir, "customer"), "parquet")))


@query("SELECT year(business_date) AS year, month(business_date) AS month, count(*) AS lines, sum(net_minor) AS net_minor FROM sales WHERE business_date >= DATE '1998-01-01' AND business_date < DATE '1999-01-01' GROUP BY ALL")
def sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.land_by_month(sale_lines(spark, sf_dir), "business_date")
    rows = spark.read.parquet(path).where("year = 1998")
    return rows.groupBy(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month")).agg(F.count("*").alias("lines"), F.sum("net_minor").alias("net_minor"))


@query("SELECT min(business_date) AS first_date, max(business_date) AS last_date, count(DISTINCT sku) AS skus, count(DISTINCT location) AS stores, count(DISTINCT channel) AS channels, count(*) AS n_rows FROM sales")
def publish_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).agg(
        F.min("business_date").alias("first_date"), F.max("business_date").alias("last_date"),
        F.countDistinct("sku").alias("skus"), F.countDistinct("location").alias("stores"), F.countDistinct("channel").alias("channels"), F.count("*").alias("n_rows"),
    )


@query("SELECT c_mktsegment, market, count(*) AS n_rows FROM customer JOIN (SELECT n_nationkey, r_name AS market FROM nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey WHERE market = 'ASIA' GROUP BY ALL", base=False)
def attach_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row gets the market of the file that it came from, by the file's own path."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    markets = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("market"))
    path = files.land_partitioned(read(spark, sf_dir, "customer").join(markets, "c_nationkey"), ["market"])
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    marked = rows.withColumn("market", F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "market=([^/]*)/", 1)))
    return marked.where("market = 'ASIA'").groupBy("c_mktsegment", "market").agg(F.count("*").alias("n_rows"))


@query("SELECT 'orders' AS dataset, count(*) AS declared, count(*) AS landed, true AS agrees FROM orders UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (WHERE l_quantity < 50), count(*) = count(*) FILTER (WHERE l_quantity < 50) FROM lineitem", base=False)
def reconcile_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a manifest declares against those that landed; of the lines, those of the greatest quantity were lost on the way."""
    out = None
    for name, arrives in (("orders", "true"), ("lineitem", "l_quantity < 50")):
        table = read(spark, sf_dir, name)
        noted, landed = scratch(spark, f"manifest-{name}"), scratch(spark, f"landing-{name}")
        table.agg(F.count("*").alias("declared")).write.json(noted)
        table.where(arrives).write.parquet(landed)
        row = spark.read.schema("declared long").json(noted).crossJoin(spark.read.parquet(landed).agg(F.count("*").alias("landed")))  # one row each
        row = row.select(F.lit(name).alias("dataset"), "declared", "landed", (F.col("declared") == F.col("landed")).alias("agrees"))
        out = row if out is None else out.unionByName(row)
    return out


# --- joins ----------------------------------------------------------------------------------


@query("SELECT market, channel, count(*) AS n, sum(net_minor) AS net_minor FROM msales GROUP BY ALL")
def join_inner_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_sales(spark, sf_dir).groupBy("market", "channel").agg(F.count("*").alias("n"), F.sum("net_minor").alias("net_minor"))


@query("SELECT c_mktsegment, count(*) AS customers, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL", base=False)
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.count("o_orderkey").alias("n_orders"))


@query("""SELECT coalesce(a.sku, b.sku) AS sku, coalesce(a.sold, 0) AS sold, coalesce(b.done, 0) AS done, coalesce(a.sold, 0) - coalesce(b.done, 0) AS open_units
  FROM (SELECT sku, sum(units) AS sold FROM sales WHERE NOT returned GROUP BY sku) a
  FULL JOIN (SELECT sku, sum(units) AS done FROM sales WHERE fulfilled GROUP BY sku) b ON a.sku = b.sku""")
def join_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = sale_lines(spark, sf_dir)
    sold = sales.where(~F.col("returned")).groupBy("sku").agg(F.sum("units").alias("sold"))
    done = sales.where("fulfilled").groupBy("sku").agg(F.sum("units").alias("done"))
    both = sold.join(done, "sku", "full_outer").select("sku", F.coalesce("sold", F.lit(0)).alias("sold"), F.coalesce("done", F.lit(0)).alias("done"))
    return both.withColumn("open_units", F.col("sold") - F.col("done"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", base=False)
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a returned line."""
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return read(spark, sf_dir, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT sku, category FROM products p WHERE EXISTS (SELECT 1 FROM sales s WHERE s.sku = p.sku AND s.units >= 49 AND s.gross_minor > p.price_minor * 40)")
def join_semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = products(spark, sf_dir).alias("p"), sale_lines(spark, sf_dir).where("units >= 49").alias("s")
    return p.join(s, F.expr("s.sku = p.sku AND s.gross_minor > p.price_minor * 40"), "left_semi").select("sku", "category")


@query("""SELECT s.order_id, s.line_no, s.sku FROM sales s WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT sku, min(business_date) AS a, max(business_date) AS b FROM sales WHERE fulfilled GROUP BY sku) w
  WHERE w.sku = s.sku AND s.business_date BETWEEN w.a AND w.b)""")
def join_not_exists_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = sale_lines(spark, sf_dir)
    window = sales.where("fulfilled").groupBy(F.col("sku").alias("w_sku")).agg(F.min("business_date").alias("a"), F.max("business_date").alias("b"))
    return sales.join(window, F.expr("w_sku = sku AND business_date BETWEEN a AND b"), "left_anti").select("order_id", "line_no", "sku")


@query("""SELECT s.sku, s.location, count(*) AS days, sum(CASE WHEN d.sku IS NULL THEN 1 ELSE 0 END) AS zero_days
  FROM (SELECT sku, location, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM (SELECT sku, location, min(business_date) AS a, max(business_date) AS b FROM sales GROUP BY ALL HAVING count(*) > 1)) s
  LEFT JOIN (SELECT DISTINCT sku, location, business_date FROM sales) d ON s.sku = d.sku AND s.location = d.location AND CAST(s.day AS DATE) = d.business_date GROUP BY ALL""")
def densify_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each series' active window, and how many of them had no sale; days are added in the row's own task."""
    by_day = sale_lines(spark, sf_dir).groupBy("sku", "location", "business_date").agg(F.sum("units").alias("units"), F.count("*").alias("lines"))
    span = by_day.groupBy("sku", "location").agg(F.min("business_date").alias("a"), F.max("business_date").alias("b"), F.sum("lines").alias("n")).where("n > 1")
    days = span.select("sku", "location", F.explode(F.sequence("a", "b")).alias("business_date"))
    full = days.join(by_day, ["sku", "location", "business_date"], "left")
    return full.groupBy("sku", "location").agg(F.count("*").alias("days"), F.sum(F.when(F.col("units").isNull(), 1).otherwise(0)).alias("zero_days"))


@query("""SELECT sku, location, business_date, units FROM (SELECT sku, location, business_date, units, row_number() OVER (PARTITION BY sku, location
  ORDER BY known_as_of DESC, order_id DESC, line_no DESC) AS r FROM sales WHERE known_as_of <= TIMESTAMP '1999-06-30') WHERE r = 1""")
def join_asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fact of each series that was known at the cutoff."""
    known = sale_lines(spark, sf_dir).where("known_as_of <= timestamp'1999-06-30'")
    latest = F.max_by(F.struct("business_date", "units"), F.struct("known_as_of", "order_id", "line_no")).alias("x")
    return known.groupBy("sku", "location").agg(latest).select("sku", "location", "x.business_date", "x.units")


@query("""SELECT o.week, count(*) AS facts, sum(s.units) AS units FROM (SELECT DISTINCT CAST(date_trunc('week', business_date) AS DATE) AS week FROM sales) o
  JOIN sales s ON CAST(date_trunc('week', s.business_date) AS DATE) = o.week AND s.known_as_of < CAST(o.week + INTERVAL 35 DAY AS TIMESTAMP) GROUP BY ALL""")
def join_pit_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = sale_lines(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "business_date")))
    known = sales.where(F.col("known_as_of") < F.date_add("week", 35).cast("timestamp"))
    return known.groupBy("week").agg(F.count("*").alias("facts"), F.sum("units").alias("units"))


@query("SELECT market, count(*) AS n, max(t.total) AS total FROM msales CROSS JOIN (SELECT sum(net_minor) AS total FROM sales) t GROUP BY market")
def join_cross_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = market_sales(spark, sf_dir)
    total = sale_lines(spark, sf_dir).agg(F.sum("net_minor").alias("total"))  # one row
    return sales.groupBy("market").agg(F.count("*").alias("n")).crossJoin(total)


@query("""SELECT s.location, count(*) AS arrivals, CAST(sum(CASE WHEN s.known_as_of > CAST(s.business_date + INTERVAL 60 DAY AS TIMESTAMP) THEN 1 ELSE 0 END) AS BIGINT) AS late FROM sales s GROUP BY s.location""")
def correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("known_as_of") > F.date_add("business_date", 60).cast("timestamp")
    return sale_lines(spark, sf_dir).groupBy("location").agg(F.count("*").alias("arrivals"), F.sum(F.when(late, 1).otherwise(0)).alias("late"))


@query("SELECT order_id, line_no, p.sku AS product, l.market, CAST(abs(s.gross_minor - s.units * p.price_minor) AS BIGINT) AS off_list FROM sales s JOIN products p USING (sku) JOIN locations l USING (location)")
def join_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines paired with their one product and site; a key that repeats on either side would be an error."""
    goods, sites = products(spark, sf_dir), locations(spark, sf_dir)
    once = goods.groupBy("sku").agg(F.count("*").alias("n"), F.max("price_minor").alias("price_minor"))
    once = once.withColumn("sku", F.when(F.col("n") == 1, F.col("sku")).otherwise(F.raise_error(F.lit("a product key repeats")).cast("long")))
    rows = sale_lines(spark, sf_dir).join(once, "sku").join(sites.select("location", "market"), "location")
    return rows.select("order_id", "line_no", F.col("sku").alias("product"), "market", F.abs(F.col("gross_minor") - F.col("units") * F.col("price_minor")).alias("off_list"))


# --- aggregates -----------------------------------------------------------------------------


@query("SELECT category, sum(units) AS units, sum(gross_minor) AS gross_minor, sum(discount_minor) AS discount_minor, sum(net_minor) AS net_minor, sum(tax_minor) AS tax_minor FROM sales JOIN products USING (sku) GROUP BY category")
def agg_sum_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("units", "gross_minor", "discount_minor", "net_minor", "tax_minor")]
    return sale_lines(spark, sf_dir).join(products(spark, sf_dir).select("sku", "category"), "sku").groupBy("category").agg(*sums)


@query("SELECT channel, count(*) FILTER (WHERE returned) AS returns, CAST(sum(units) FILTER (WHERE fulfilled) AS BIGINT) AS done_units, round(avg(units) FILTER (WHERE discount_pct = 0), 6) AS full_price_units FROM sales GROUP BY channel")
def agg_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).groupBy("channel").agg(
        F.count_if("returned").alias("returns"), F.expr("sum(units) FILTER (WHERE fulfilled)").alias("done_units"),
        F.round(F.expr("avg(units) FILTER (WHERE discount_pct = 0)"), 6).alias("full_price_units"),
    )


@query("SELECT sku, arg_max(units, (known_as_of, order_id, line_no)) AS last_units FROM sales GROUP BY sku")
def agg_arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).groupBy("sku").agg(F.max_by("units", F.struct("known_as_of", "order_id", "line_no")).alias("last_units"))


@query("SELECT location, bool_or(discount_pct >= 10) AS any_promotion, min(channel) AS channel, count(DISTINCT sku) AS skus, count(DISTINCT (sku, business_date)) AS sku_days FROM sales GROUP BY location")
def agg_distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).groupBy("location").agg(
        F.bool_or(F.col("discount_pct") >= 10).alias("any_promotion"), F.min("channel").alias("channel"),
        F.countDistinct("sku").alias("skus"), F.countDistinct("sku", "business_date").alias("sku_days"),
    )


@query("SELECT sku, location, business_date, count(*) AS n FROM sales GROUP BY ALL HAVING count(*) > 1")
def agg_having_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).groupBy("sku", "location", "business_date").agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT location, CAST(date_trunc('month', business_date) AS DATE) AS month, count(*) AS n,
  round(avg(CASE WHEN date_diff('day', business_date, CAST(known_as_of AS DATE)) <= 60 THEN 1.0 ELSE 0.0 END), 6) AS on_time,
  round(avg(date_diff('day', business_date, CAST(known_as_of AS DATE))), 6) AS mean_days, round(stddev_pop(date_diff('day', business_date, CAST(known_as_of AS DATE))), 6) AS dev_days
  FROM sales GROUP BY ALL""")
def supplier_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("known_as_of").cast("date"), F.col("business_date"))
    return (
        sale_lines(spark, sf_dir).withColumn("days", days).groupBy("location", F.to_date(F.date_trunc("month", "business_date")).alias("month"))
        .agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("days") <= 60, 1.0).otherwise(0.0)), 6).alias("on_time"),
             F.round(F.avg("days"), 6).alias("mean_days"), F.round(F.stddev_pop("days"), 6).alias("dev_days"))
    )


@query("SELECT category, market, median(units) AS median_units, quantile_cont(units, 0.9) AS p90_units FROM cweeks GROUP BY ALL")
def agg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = category_weeks(market_sales(spark, sf_dir), products(spark, sf_dir))
    return weeks.groupBy("category", "market").agg(F.median("units").alias("median_units"), F.percentile("units", 0.9).alias("p90_units"))


@query("SELECT business_date, " + ", ".join(f"CAST(coalesce(sum(units) FILTER (WHERE channel = '{c}'), 0) AS BIGINT) AS {n}" for c, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("4-NOT SPECIFIED", "open_"), ("5-LOW", "low"))) + " FROM sales GROUP BY business_date")
def agg_pivot_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "open_", "5-LOW": "low"}
    wide = sale_lines(spark, sf_dir).groupBy("business_date").pivot("channel", list(names)).agg(F.sum("units"))
    return wide.select("business_date", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(n) for c, n in names.items()))


@query("""SELECT market, category, channel, grouping_id(market, category, channel) AS scope, count(*) AS n, sum(units) AS units, sum(net_minor) AS net_minor
  FROM msales JOIN products USING (sku) GROUP BY GROUPING SETS ((), (market), (category), (channel), (market, category), (market, channel))""")
def agg_multi_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scopes in one pass over the rows."""
    rows = market_sales(spark, sf_dir).join(products(spark, sf_dir).select("sku", "category"), "sku")
    sets = [[], ["market"], ["category"], ["channel"], ["market", "category"], ["market", "channel"]]
    return rows.groupingSets(sets, "market", "category", "channel").agg(
        F.grouping_id("market", "category", "channel").alias("scope"), F.count("*").alias("n"), F.sum("units").alias("units"), F.sum("net_minor").alias("net_minor")
    )


@query("SELECT market, round(sum(CAST(units AS DOUBLE) * discount_pct) / nullif(sum(units), 0), 6) AS weighted_discount, max(CASE WHEN returned THEN 2 WHEN fulfilled THEN 1 ELSE 0 END) AS worst FROM msales GROUP BY market")
def agg_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = F.sum(F.col("units").cast("double") * F.col("discount_pct")) / F.nullif(F.sum("units"), F.lit(0))
    return market_sales(spark, sf_dir).groupBy("market").agg(F.round(weighted, 6).alias("weighted_discount"), F.max(F.when(F.col("returned"), 2).when(F.col("fulfilled"), 1).otherwise(0)).alias("worst"))


@query("""SELECT sku, measure, CAST(amount AS BIGINT) AS amount FROM (SELECT sku, 'gross_minor' AS measure, sum(gross_minor) AS amount FROM sales GROUP BY sku UNION ALL SELECT sku, 'net_minor', sum(net_minor) FROM sales GROUP BY sku
  UNION ALL SELECT sku, 'tax_minor', sum(tax_minor) FROM sales GROUP BY sku)""")
def agg_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = sale_lines(spark, sf_dir).groupBy("sku").agg(*(F.sum(c).alias(c) for c in ("gross_minor", "net_minor", "tax_minor")))
    return wide.unpivot("sku", ["gross_minor", "net_minor", "tax_minor"], "measure", "amount")


# --- windows and sets -----------------------------------------------------------------------


@query("SELECT sku, location, business_date, order_id, units FROM (SELECT *, row_number() OVER (PARTITION BY sku, location, business_date ORDER BY known_as_of DESC, order_id DESC, line_no DESC) AS r FROM sales) WHERE r = 1")
def win_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("sku", "location", "business_date").orderBy(F.desc("known_as_of"), F.desc("order_id"), F.desc("line_no"))
    return sale_lines(spark, sf_dir).withColumn("r", F.row_number().over(newest)).where("r = 1").select("sku", "location", "business_date", "order_id", "units")


@query("""SELECT sku, business_date, price, date_diff('day', business_date, lead(business_date) OVER (PARTITION BY sku ORDER BY business_date)) AS gap_days,
  price - lag(price) OVER (PARTITION BY sku ORDER BY business_date) AS step FROM (SELECT sku, business_date, CAST(min(gross_minor // units) AS BIGINT) AS price FROM sales GROUP BY ALL)""")
def win_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = sale_lines(spark, sf_dir).groupBy("sku", "business_date").agg(F.min(F.expr("gross_minor div units")).alias("price"))
    walk = Window.partitionBy("sku").orderBy("business_date")
    gap = F.datediff(F.lead("business_date").over(walk), F.col("business_date")).cast("long")
    return days.select("sku", "business_date", "price", gap.alias("gap_days"), (F.col("price") - F.lag("price").over(walk)).alias("step"))


@query("SELECT location, order_id, line_no, CAST(sum(net_minor) OVER (PARTITION BY location ORDER BY net_minor DESC, order_id, line_no, sku ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM sales")
def win_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("location").orderBy(F.desc("net_minor"), "order_id", "line_no", "sku").rowsBetween(Window.unboundedPreceding, 0)
    return sale_lines(spark, sf_dir).select("location", "order_id", "line_no", F.sum("net_minor").over(order).alias("running"))


@query("SELECT category, market, net, round(net / sum(net) OVER (PARTITION BY market), 9) AS share, round(CAST(sum(net) OVER (PARTITION BY market ORDER BY net DESC, category ROWS UNBOUNDED PRECEDING) - net AS DOUBLE) / sum(net) OVER (PARTITION BY market), 9) AS share_before FROM (SELECT category, market, sum(net_minor) AS net FROM cweeks GROUP BY ALL)")
def win_cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = category_weeks(market_sales(spark, sf_dir), products(spark, sf_dir)).groupBy("category", "market").agg(F.sum("net_minor").alias("net"))
    whole = F.sum("net").over(Window.partitionBy("market"))
    before = F.sum("net").over(Window.partitionBy("market").orderBy(F.desc("net"), "category").rowsBetween(Window.unboundedPreceding, 0)) - F.col("net")
    return sums.select("category", "market", "net", F.round(F.col("net") / whole, 9).alias("share"), F.round(before / whole, 9).alias("share_before"))


@query("SELECT sku, net, n_total FROM (SELECT sku, sum(net_minor) AS net FROM sales GROUP BY sku), (SELECT count(DISTINCT sku) AS n_total FROM sales) ORDER BY net DESC, sku LIMIT 25 OFFSET 50")
def topn_ranked_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the ranking, and the number of rows it is a page of."""
    sums = sale_lines(spark, sf_dir).groupBy("sku").agg(F.sum("net_minor").alias("net"))
    page = sums.orderBy(F.desc("net"), "sku").offset(50).limit(25)
    return page.crossJoin(sums.agg(F.count("*").alias("n_total")))


@query("SELECT sku, location, week, units FROM weeks WHERE week IN (SELECT DISTINCT week FROM weeks WHERE week <= DATE '2001-06-01' ORDER BY week DESC LIMIT 13)")
def topn_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import weekly_series

    weeks = weekly_series(sale_lines(spark, sf_dir))
    last = weeks.where("week <= date'2001-06-01'").select("week").distinct().orderBy(F.desc("week")).limit(13)
    return weeks.join(last, "week", "left_semi").select("sku", "location", "week", "units")


@query("SELECT market, 'sale' AS kind, sku, units FROM msales WHERE NOT returned UNION ALL SELECT market, 'return', sku, -units FROM msales WHERE returned")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market_sales(spark, sf_dir)
    sold = rows.where(~F.col("returned")).select("market", F.lit("sale").alias("kind"), "sku", "units")
    back = rows.where("returned").select("market", F.lit("return").alias("kind"), "sku", (-F.col("units")).alias("units"))
    return sold.unionByName(back)


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer", base=False)
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(read(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query("""SELECT sku, origin, cost FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY pref) AS r FROM (
  SELECT sku, 1 AS pref, 'observed' AS origin, CAST(sum(gross_minor) // sum(units) AS BIGINT) AS cost FROM sales WHERE fulfilled GROUP BY sku
  UNION ALL SELECT sku, 2, 'list', price_minor FROM products)) WHERE r = 1""")
def set_prefer_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = sale_lines(spark, sf_dir).where("fulfilled").groupBy("sku").agg(F.expr("sum(gross_minor) div sum(units)").alias("cost"))
    both = seen.select("sku", F.lit(1).alias("pref"), F.lit("observed").alias("origin"), "cost").unionByName(
        products(spark, sf_dir).select("sku", F.lit(2).alias("pref"), F.lit("list").alias("origin"), F.col("price_minor").alias("cost"))
    )
    return both.groupBy("sku").agg(F.min_by(F.struct("origin", "cost"), "pref").alias("x")).select("sku", "x.origin", "x.cost")


# --- scalars --------------------------------------------------------------------------------


@query("SELECT order_id, line_no, sku, CASE WHEN units = 0 THEN NULL ELSE (net_minor // units) * (units // 3) + least(net_minor % units, units // 3) END AS share FROM sales")
def allocate_first_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sale_lines(spark, sf_dir)
    share = money.first_units_share(F.col("net_minor"), F.expr("units div 3"), F.nullif(F.col("units"), F.lit(0)))
    return rows.select("order_id", "line_no", "sku", share.alias("share"))


@query("""SELECT order_id, line_no, sku, f + CASE WHEN row_number() OVER (PARTITION BY order_id ORDER BY rest DESC, line_no, sku) <= total - sum(f) OVER (PARTITION BY order_id) THEN 1 ELSE 0 END AS part
  FROM (SELECT *, CAST((CAST(total AS HUGEINT) * units) // w AS BIGINT) AS f, (CAST(total AS HUGEINT) * units) % w AS rest FROM (
    SELECT order_id, line_no, sku, units, sum(units) OVER (PARTITION BY order_id) AS w, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS BIGINT) AS total
    FROM sales JOIN orders ON order_id = o_orderkey))""")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long").alias("total"))
    # an order's lines stay in their task for the join and the windows, so tasks are dealt in proportion to lines
    rows = sale_lines(spark, sf_dir).select("order_id", "line_no", "sku", "units").repartition(line_tasks(spark, sf_dir), "order_id").join(orders, "order_id")
    # lines that repeat a number are told apart by their product
    rows = rows.withColumn("at", F.struct("line_no", "sku"))
    return money.largest_remainder(rows, ["order_id"], "total", "units", "at", "part").select("order_id", "line_no", "sku", "part")


@query("""SELECT market, CAST(sum(CAST(round_even(CAST(net_minor AS DECIMAL(20,0)) * CAST(r AS DECIMAL(9,4)), 0) AS BIGINT)) AS BIGINT) AS converted FROM msales
  JOIN (VALUES ('AFRICA', 0.7931), ('AMERICA', 1.0), ('ASIA', 0.0067), ('EUROPE', 1.0877), ('MIDDLE EAST', 0.2723)) t(m, r) ON m = market GROUP BY market""")
def fx_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact is converted half-even, then summed."""
    rates = spark.createDataFrame([("AFRICA", "0.7931"), ("AMERICA", "1.0"), ("ASIA", "0.0067"), ("EUROPE", "1.0877"), ("MIDDLE EAST", "0.2723")], "market string, rate string")
    rows = market_sales(spark, sf_dir).join(F.broadcast(rates), "market")  # five rows
    return rows.groupBy("market").agg(F.sum(money.convert(F.col("net_minor"), F.col("rate").cast("decimal(18,10)"))).alias("converted"))


@query("""SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, weekofyear(o_orderdate) AS iso_week, isoyear(o_orderdate) AS iso_year, month(o_orderdate) AS month, year(o_orderdate) AS year,
  isodow(o_orderdate) < 6 AS working, round(sin(2 * pi() * weekofyear(o_orderdate) / 52), 9) AS week_sin, round(cos(2 * pi() * weekofyear(o_orderdate) / 52), 9) AS week_cos,
  CAST(o_orderdate + INTERVAL 7 HOUR AS DATE) AS local_date FROM orders""", base=False)
def weekday_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    angle = 2 * F.pi() * F.weekofyear(day) / 52
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date(F.date_trunc("week", day)).alias("week"), F.weekofyear(day).cast("long").alias("iso_week"), F.expr("extract(yearofweek from o_orderdate)").cast("long").alias("iso_year"),
        F.month(day).cast("long").alias("month"), F.year(day).cast("long").alias("year"), (F.weekday(day) < 5).alias("working"),
        F.round(F.sin(angle), 9).alias("week_sin"), F.round(F.cos(angle), 9).alias("week_cos"), F.from_utc_timestamp(day, "Asia/Bangkok").cast("date").alias("local_date"),
    )


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS label, nullif(p_type, 'PROMO') AS kind, p_name ILIKE '%RING%' AS ring,
  sha256(p_brand || '|' || p_type || '|' || CAST(p_size AS VARCHAR)) AS hash_key, try_cast(substr(p_brand, 7) AS BIGINT) AS brand_no, replace(p_name, ' ', '-') AS slug FROM part""", base=False)
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    label = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1000)))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.split_part(name, F.lit(" "), F.lit(1)).alias("first_word"), label.alias("label"), F.nullif(F.col("p_type"), F.lit("PROMO")).alias("kind"), name.ilike("%RING%").alias("ring"),
        F.sha2(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")), 256).alias("hash_key"), F.substring("p_brand", 7, 20).try_cast("long").alias("brand_no"), F.replace(name, F.lit(" "), F.lit("-")).alias("slug"),
    )


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL", base=False)
def json_array_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("n"))


QUERIES, ORACLES = query.queries, query.oracles
