"""Queries of window forms, scalar functions and point-in-time joins over the dense category series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money
from ..sources.tables import category_weeks, locations, products, read, sale_lines, weekly_series
from .basics import market_sales
from .registration import Registry

query = Registry()

_KEY = "PARTITION BY category, market ORDER BY week"


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_weeks(market_sales(spark, sf_dir), products(spark, sf_dir))


def _walk():
    return Window.partitionBy("category", "market").orderBy("week")


@query(f"SELECT category, market, week, " + ", ".join(f"lag(units, {n}) OVER ({_KEY}) AS lag_{n}" for n in (1, 4, 13, 52)) + " FROM cweeks")
def win_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weeks(spark, sf_dir).select("category", "market", "week", *(F.lag("units", n).over(_walk()).alias(f"lag_{n}") for n in (1, 4, 13, 52)))


@query(f"SELECT category, market, week, " + ", ".join(f"CASE WHEN lead(lines, {n}) OVER ({_KEY}) >= 3 THEN lead(units, {n}) OVER ({_KEY}) END AS target_h{n}" for n in range(1, 27)) + " FROM cweeks")
def win_lead_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units 1 to 26 weeks ahead, of weeks with three lines or more."""
    ahead = [F.when(F.lead("lines", n).over(_walk()) >= 3, F.lead("units", n).over(_walk())).alias(f"target_h{n}") for n in range(1, 27)]
    return _weeks(spark, sf_dir).select("category", "market", "week", *ahead)


@query(f"SELECT category, market, week, " + ", ".join(f"round(avg(units) OVER ({_KEY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS mean_{n}, round(stddev_samp(units) OVER ({_KEY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS dev_{n}" for n in (4, 13)) + " FROM cweeks")
def win_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for n in (4, 13):
        frame = _walk().rowsBetween(-n, -1)
        out += [F.round(F.avg("units").over(frame), 6).alias(f"mean_{n}"), F.round(F.stddev_samp("units").over(frame), 6).alias(f"dev_{n}")]
    return _weeks(spark, sf_dir).select("category", "market", "week", *out)


@query(f"SELECT category, market, week, round(sum(CASE WHEN units < 20 THEN lines ELSE 0 END) OVER ({_KEY} ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)::DOUBLE / nullif(sum(lines) OVER ({_KEY} ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING), 0), 6) AS low_share FROM cweeks")
def win_rolling_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the past year's exposure in weeks of low sales."""
    frame = _walk().rowsBetween(-52, -1)
    low = F.sum(F.when(F.col("units") < 20, F.col("lines")).otherwise(0)).over(frame)
    return _weeks(spark, sf_dir).select("category", "market", "week", F.round(low / F.nullif(F.sum("lines").over(frame), F.lit(0)), 6).alias("low_share"))


@query(f"SELECT category, market, week, round(median(net_minor / units) OVER ({_KEY} ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING), 4) AS median_price FROM cweeks")
def win_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("net_minor") / F.col("units")
    return _weeks(spark, sf_dir).withColumn("price", price).select("category", "market", "week", F.round(F.percentile("price", 0.5).over(_walk().rowsBetween(-13, -1)), 4).alias("median_price"))


@query("SELECT category, market, week, round(units / avg(units) OVER (PARTITION BY market, week), 6) AS ratio FROM cweeks")
def win_partition_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weeks(spark, sf_dir).select("category", "market", "week", F.round(F.col("units") / F.avg("units").over(Window.partitionBy("market", "week")), 6).alias("ratio"))


@query("SELECT category, market, max(units) FILTER (WHERE r = 1) AS last_units, round(avg(units) FILTER (WHERE r <= 13), 6) AS mean_13 FROM (SELECT *, row_number() OVER (PARTITION BY category, market ORDER BY week DESC) AS r FROM cweeks) GROUP BY ALL")
def win_recency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _weeks(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("category", "market").orderBy(F.desc("week"))))
    return ranked.groupBy("category", "market").agg(F.max(F.when(F.col("r") == 1, F.col("units"))).alias("last_units"), F.round(F.avg(F.when(F.col("r") <= 13, F.col("units"))), 6).alias("mean_13"))


@query("SELECT channel, net, round(net::DOUBLE / (SELECT sum(net_minor) FROM sales), 9) AS share FROM (SELECT channel, sum(net_minor) AS net FROM sales GROUP BY channel)")
def win_share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total is joined as one row: a window over everything would put all rows in one task."""
    sums = sale_lines(spark, sf_dir).groupBy("channel").agg(F.sum("net_minor").alias("net"))
    return sums.crossJoin(sums.agg(F.sum("net").alias("total"))).select("channel", "net", F.round(F.col("net") / F.col("total"), 9).alias("share"))


@query("SELECT customer, order_id, business_date FROM (SELECT customer, order_id, business_date, row_number() OVER (PARTITION BY customer ORDER BY business_date, order_id) AS r FROM (SELECT DISTINCT customer, order_id, business_date FROM sales)) WHERE r = 1")
def win_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("business_date", "order_id")).alias("x")
    return sale_lines(spark, sf_dir).groupBy("customer").agg(first).select("customer", "x.order_id", "x.business_date")


@query("SELECT market, week, days, lead(days) OVER (PARTITION BY market ORDER BY week) AS next_days FROM (SELECT market, CAST(date_trunc('week', business_date) AS DATE) AS week, count(DISTINCT business_date) AS days FROM msales GROUP BY ALL)")
def win_calendar_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = market_sales(spark, sf_dir).groupBy("market", F.to_date(F.date_trunc("week", "business_date")).alias("week")).agg(F.countDistinct("business_date").alias("days"))
    return weeks.withColumn("next_days", F.lead("days").over(Window.partitionBy("market").orderBy("week")))


@query("SELECT category, market, round(var_samp(units) / nullif(avg(units), 0), 5) AS dispersion, round(corr(units, prior), 6) AS autocorrelation, round(stddev_pop(units), 6) AS dev FROM (SELECT *, lag(units) OVER (PARTITION BY category, market ORDER BY week) AS prior FROM cweeks) GROUP BY ALL")
def agg_var_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _weeks(spark, sf_dir).withColumn("prior", F.lag("units").over(_walk()))
    return rows.groupBy("category", "market").agg(F.round(F.var_samp("units") / F.nullif(F.avg("units"), F.lit(0.0)), 5).alias("dispersion"), F.round(F.corr("units", "prior"), 6).alias("autocorrelation"), F.round(F.stddev_pop("units"), 6).alias("dev"))


@query("SELECT location, quantile_cont(units, 0.1) AS p10, quantile_cont(units, 0.5) AS p50, quantile_cont(units, 0.9) AS p90 FROM sales GROUP BY location")
def agg_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).groupBy("location").agg(*(F.percentile("units", q).alias(n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))))


@query("SELECT location, ['Good', 'Watch', 'Issue'][1 + max(CASE WHEN known_as_of > CAST(business_date + INTERVAL 118 DAY AS TIMESTAMP) THEN 2 WHEN discount_pct > 9 THEN 1 ELSE 0 END)] AS worst FROM sales GROUP BY location")
def agg_worst_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst quality class of a site's lines, by rank and back."""
    rank = F.when(F.col("known_as_of") > F.date_add("business_date", 118).cast("timestamp"), 2).when(F.col("discount_pct") > 9, 1).otherwise(0)
    names = F.array(F.lit("Good"), F.lit("Watch"), F.lit("Issue"))
    return sale_lines(spark, sf_dir).groupBy("location").agg(F.max(rank).alias("r")).select("location", F.element_at(names, F.col("r") + 1).alias("worst"))


@query("SELECT sku, min(dept) AS dept, bool_or(promo) AS any_promo, bool_and(promo) AS all_promo FROM (SELECT sku, dept, discount_pct >= 5 AS promo FROM sales JOIN products USING (sku)) GROUP BY sku")
def agg_bool_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sale_lines(spark, sf_dir).join(products(spark, sf_dir).select("sku", "dept"), "sku").withColumn("promo", F.col("discount_pct") >= 5)
    return rows.groupBy("sku").agg(F.min("dept").alias("dept"), F.bool_or("promo").alias("any_promo"), F.bool_and("promo").alias("all_promo"))


@query("""SELECT w.location, count(*) AS lines, sum(s.units) AS units FROM (SELECT location, CAST(date_trunc('month', min(business_date)) AS DATE) AS a, CAST(date_trunc('month', min(business_date)) + INTERVAL 400 DAY AS DATE) AS b FROM sales GROUP BY location) w
  JOIN sales s ON s.location = w.location AND s.business_date BETWEEN w.a AND w.b GROUP BY w.location""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inside each site's first window: an equi-join on the site, then the range."""
    lines = sale_lines(spark, sf_dir)
    start = F.to_date(F.date_trunc("month", F.min("business_date")))
    window = lines.groupBy("location").agg(start.alias("a")).withColumn("b", F.date_add("a", 400))
    return lines.join(window, "location").where("business_date between a and b").groupBy("location").agg(F.count("*").alias("lines"), F.sum("units").alias("units"))


_LANES = "(SELECT location, 'lane-' || location AS lane, CASE WHEN location % 2 = 0 THEN DATE '1996-01-01' + CAST(location % 700 AS INTEGER) ELSE DATE '1995-01-01' END AS a, CASE WHEN location % 3 = 0 THEN NULL ELSE DATE '1999-01-01' + CAST(location % 300 AS INTEGER) END AS b FROM locations)"


@query(f"SELECT s.location, count(*) AS lines, count(l.lane) AS on_lane, round(count(l.lane) / count(*), 6) AS coverage FROM sales s LEFT JOIN {_LANES} l ON l.location = s.location AND s.business_date >= l.a AND (l.b IS NULL OR s.business_date < l.b) GROUP BY s.location")
def join_effective_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of lines on a lane that was in effect on their day."""
    sites = locations(spark, sf_dir)
    even = F.expr("date_add(date'1996-01-01', cast(location % 700 as int))")
    until = F.expr("date_add(date'1999-01-01', cast(location % 300 as int))")
    lanes = sites.select(F.col("location").alias("at"), F.when(F.col("location") % 2 == 0, even).otherwise(F.lit("1995-01-01").cast("date")).alias("a"), F.when(F.col("location") % 3 != 0, until).alias("b"), F.concat(F.lit("lane-"), F.col("location")).alias("lane"))
    on = F.expr("at = location AND business_date >= a AND (b IS NULL OR business_date < b)")
    n = F.count("*")
    return sale_lines(spark, sf_dir).join(lanes, on, "left").groupBy("location").agg(n.alias("lines"), F.count("lane").alias("on_lane"), F.round(F.count("lane") / n, 6).alias("coverage"))


@query("SELECT location, CAST(day AS DATE) AS day FROM (SELECT location, unnest(generate_series(a, least(b, a + INTERVAL 9 DAY), INTERVAL 1 DAY)) AS day FROM (SELECT location, min(business_date) AS a, max(business_date) AS b FROM sales GROUP BY location))")
def lateral_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = sale_lines(spark, sf_dir).groupBy("location").agg(F.min("business_date").alias("a"), F.max("business_date").alias("b"))
    return span.select("location", F.explode(F.sequence("a", F.least("b", F.date_add("a", 9)))).alias("day"))


@query("SELECT sku, location, count(*) AS visible, max(known_as_of) AS newest FROM sales WHERE known_as_of < TIMESTAMP '1998-07-01' GROUP BY ALL")
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).where("known_as_of < timestamp'1998-07-01'").groupBy("sku", "location").agg(F.count("*").alias("visible"), F.max("known_as_of").alias("newest"))


@query("SELECT sku, location, business_date, units FROM (SELECT sku, location, business_date, units, row_number() OVER (PARTITION BY sku ORDER BY known_as_of DESC, order_id DESC, line_no DESC) AS r FROM sales WHERE known_as_of < TIMESTAMP '1998-07-01') WHERE r = 1")
def visible_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = sale_lines(spark, sf_dir).where("known_as_of < timestamp'1998-07-01'")
    return seen.groupBy("sku").agg(F.max_by(F.struct("location", "business_date", "units"), F.struct("known_as_of", "order_id", "line_no")).alias("x")).select("sku", "x.location", "x.business_date", "x.units")


@query("SELECT sku, location, week, units, week <= DATE '2000-12-31' - INTERVAL 56 DAY AND known_as_of < TIMESTAMP '2000-12-31' AS usable FROM weeks WHERE week >= DATE '2000-06-01'")
def label_embargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of weeks at least eight weeks old that were known by the fit."""
    usable = (F.col("week") <= F.lit("2000-11-05").cast("date")) & (F.col("known_as_of") < F.lit("2000-12-31").cast("timestamp"))
    return weekly_series(sale_lines(spark, sf_dir)).where("week >= date'2000-06-01'").select("sku", "location", "week", "units", usable.alias("usable"))


@query("""SELECT c_custkey, CAST(c_acctbal * 100 AS DECIMAL(18,0))::BIGINT AS minor, CASE WHEN c_nationkey % 4 = 3 THEN NULL ELSE CAST(CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) AS BIGINT) END AS known_minor, c_nationkey % 4 = 3 AS invalid FROM customer""", base=False)
def exact_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances to minor units in a currency by nation, one of which is unknown."""
    amount = F.col("c_acctbal").cast("decimal(18,2)")
    code = F.element_at(F.array(F.lit("EUR"), F.lit("USD"), F.lit("GBP"), F.lit("XXX")), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", (amount * 100).cast("long").alias("minor"), money.exact_minor(amount, code).alias("known_minor"), money.invalid_minor(amount, code).alias("invalid"))


@query("SELECT order_id, line_no, sku, CAST(net_minor AS DECIMAL(18,2)) / 100 AS major, CAST(round_even(CAST(net_minor AS DECIMAL(20,0)) * 1.0875, 0) AS BIGINT) AS converted FROM sales")
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sale_lines(spark, sf_dir)
    return rows.select("order_id", "line_no", "sku", money.to_major(F.col("net_minor"), F.lit("EUR")).cast("double").alias("major"), money.convert(F.col("net_minor"), F.lit("1.0875").cast("decimal(18,10)")).alias("converted"))


@query("SELECT event_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS local_date, CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 5 HOUR AS local_midnight FROM events", base=False)
def local_business_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local day of an instant five hours west, and the instant that day began."""
    ts = F.col("ts").cast("timestamp")
    day = F.from_utc_timestamp(ts, "America/Bogota").cast("date")
    return read(spark, sf_dir, "events").select("event_id", day.alias("local_date"), F.to_utc_timestamp(day.cast("timestamp"), "America/Bogota").alias("local_midnight"))


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'E' WHEN 'PROMO' THEN 'P' WHEN 'SMALL' THEN 'S' END AS mapped, p_brand || '|' || p_type AS composed, try_cast(replace(p_brand, 'Brand#', '') AS INTEGER) AS number,
  round(CAST(p_retailprice AS DECIMAL(18,4)) / 3, 2)::DOUBLE AS third, coalesce(try_strptime('199' || (p_size % 10) || '-0' || (1 + p_size % 9) || '-1' || (p_size % 10), '%Y-%m-%d')::DATE, DATE '1970-01-01') AS parsed FROM part""", base=False)
def mapped_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared mapping as columns: closed value map, composed key, tolerant number, quantity and date."""
    kind, size = F.col("p_type"), F.col("p_size")
    mapped = F.when(kind == "ECONOMY", "E").when(kind == "PROMO", "P").when(kind == "SMALL", "S")
    text = F.concat(F.lit("199"), size % 10, F.lit("-0"), 1 + size % 9, F.lit("-1"), size % 10)
    return read(spark, sf_dir, "part").select(
        "p_partkey", mapped.alias("mapped"), F.concat_ws("|", "p_brand", "p_type").alias("composed"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("int").alias("number"),
        F.round(F.col("p_retailprice").cast("decimal(18,4)") / 3, 2).cast("double").alias("third"),
        F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1970-01-01").cast("date")).alias("parsed"),
    )


@query("""SELECT s.sku, s.location, 'inventory-' || l.market AS role, abs(s.booked - s.shipped) AS wms_difference FROM (
  SELECT sku, location, CAST(sum(units) FILTER (WHERE fulfilled) AS BIGINT) AS booked, CAST(coalesce(sum(units) FILTER (WHERE fulfilled AND NOT returned), 0) AS BIGINT) AS shipped FROM sales GROUP BY ALL) s
  JOIN locations l USING (location) WHERE booked IS NOT NULL""")
def inv_wms_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute difference of what one system booked and another shipped and kept, by cell."""
    booked, shipped = F.sum(F.when(F.col("fulfilled"), F.col("units"))), F.coalesce(F.sum(F.when(F.col("fulfilled") & ~F.col("returned"), F.col("units"))), F.lit(0))
    cells = sale_lines(spark, sf_dir).groupBy("sku", "location").agg(booked.alias("booked"), shipped.alias("shipped")).where("booked is not null").join(locations(spark, sf_dir).select("location", "market"), "location")
    return cells.select("sku", "location", F.concat(F.lit("inventory-"), F.col("market")).alias("role"), F.abs(F.col("booked") - F.col("shipped")).alias("wms_difference"))


QUERIES, ORACLES = query.queries, query.oracles
