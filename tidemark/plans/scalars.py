"""Queries of scalar functions: money scales, weeks, keys and the parsing of mapped files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, text, weeks
from ..sources.tables import locations, products, read, sale_lines
from .registration import Registry

query = Registry()

#: The currency of each market; the last one has none.
CURRENCIES = {"AFRICA": "USD", "AMERICA": "USD", "ASIA": "GBP", "EUROPE": "EUR"}
_CODE = "CASE " + " ".join(f"WHEN {{0}} = '{m}' THEN '{c}'" for m, c in CURRENCIES.items()) + " END"


def currency_of(market: Column) -> Column:
    return text.value_map(market, CURRENCIES)


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer balances with the currency of their market."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("market"))
    rows = read(spark, sf_dir, "customer").join(home, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", "market", currency_of(F.col("market")).alias("currency"), "c_acctbal")


_BALANCES = f"(SELECT c_custkey, r_name AS market, {_CODE.format('r_name')} AS currency, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"SELECT c_custkey, currency, CASE WHEN currency IN ('GBP', 'EUR', 'USD', 'SEK') THEN 2 END AS scale FROM {_BALANCES}", base=False)
def minor_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal places of each balance's currency; null where the market has none."""
    return _balances(spark, sf_dir).select("c_custkey", "currency", money.minor_scale(F.col("currency")).alias("scale"))


@query(f"SELECT c_custkey, currency IS NULL OR CAST(c_acctbal AS DECIMAL(18,3)) / 7 * 100 <> floor(CAST(c_acctbal AS DECIMAL(18,3)) / 7 * 100) AS invalid FROM (SELECT c_custkey, currency, round(c_acctbal) AS c_acctbal FROM {_BALANCES}) WHERE c_acctbal IS NOT NULL", base=False)
def invalid_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sevenths of whole balances are no whole minor units, or in no known currency."""
    seventh = F.round("c_acctbal").cast("decimal(18,3)") / 7
    rows = _balances(spark, sf_dir).where("c_acctbal is not null")
    return rows.select("c_custkey", money.invalid_minor(seventh, F.col("currency")).alias("invalid"))


@query("SELECT order_id, line_no, sku, currency, CASE WHEN currency IS NOT NULL THEN net_minor / 100.0 END AS major FROM (SELECT s.*, " + _CODE.format("market") + " AS currency FROM msales s)")
def to_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net money of each line in major units, null in an unknown currency."""
    rows = sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location").withColumn("currency", currency_of(F.col("market")))
    return rows.select("order_id", "line_no", "sku", "currency", money.to_major(F.col("net_minor"), F.col("currency")).cast("double").alias("major"))


@query("""SELECT market, currency, CAST(sum(x) AS BIGINT) AS converted, count(*) FILTER (WHERE x IS NULL) AS unknown FROM (
  SELECT market, currency, CAST(round_even(CAST(net_minor AS DECIMAL(20,0)) * CAST(r AS DECIMAL(9,4)), 0) AS BIGINT) AS x FROM (SELECT s.*, """ + _CODE.format("market") + """ AS currency FROM msales s)
  LEFT JOIN (VALUES ('USD', 0.9194), ('GBP', 1.1702), ('EUR', 1.0)) t(c, r) ON c = currency) GROUP BY ALL""")
def fx_row_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines converted row by row to one currency, then summed; an unknown currency stays null and is counted."""
    rates = spark.createDataFrame([("USD", "0.9194"), ("GBP", "1.1702"), ("EUR", "1.0")], "currency string, rate string")
    rows = sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location").withColumn("currency", currency_of(F.col("market")))
    told = rows.join(F.broadcast(rates), "currency", "left").withColumn("x", money.convert(F.col("net_minor"), F.col("rate").cast("decimal(18,10)")))  # three rows
    return told.groupBy("market", "currency").agg(F.sum("x").alias("converted"), F.count_if(F.col("x").isNull()).alias("unknown"))


@query("SELECT event_id, CAST(date_trunc('week', ts + INTERVAL 7 HOUR) AS DATE) AS week, CAST(date_trunc('week', ts + INTERVAL 7 HOUR) AS TIMESTAMP) + INTERVAL 7 DAY - INTERVAL 7 HOUR AS cutoff FROM events", base=False)
def local_midnight_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant at which the local week of an event ends."""
    day = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Bangkok")
    return read(spark, sf_dir, "events").select("event_id", weeks.week_start(day).alias("week"), weeks.week_cutoff(weeks.week_start(day), "Asia/Bangkok").alias("cutoff"))


@query("SELECT CAST(date_trunc('week', business_date) AS DATE) AS week, count(*) AS lines, CAST(min(business_date - CAST(date_trunc('week', business_date) AS DATE)) AS BIGINT) AS first_day, CAST(max(business_date - CAST(date_trunc('week', business_date) AS DATE)) AS BIGINT) AS last_day FROM sales GROUP BY ALL")
def week_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by Monday week, with the first and last weekday that sold."""
    week = weeks.week_start(F.col("business_date"))
    away = F.datediff("business_date", week).cast("long")
    return sale_lines(spark, sf_dir).groupBy(week.alias("week")).agg(F.count("*").alias("lines"), F.min(away).alias("first_day"), F.max(away).alias("last_day"))


@query("SELECT isoyear(business_date) AS iso_year, weekofyear(business_date) AS iso_week, min(business_date) AS first_date, max(business_date) AS last_date, sum(units) AS units FROM sales GROUP BY ALL")
def iso_week_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by ISO year and week, so that a week over new year is one."""
    day = F.col("business_date")
    year, week = weeks.iso_parts(day)
    return sale_lines(spark, sf_dir).groupBy(year.alias("iso_year"), week.alias("iso_week")).agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.sum("units").alias("units"))


@query("SELECT sku, location, week, round(sin(2 * pi() * weekofyear(week) / 52.0), 9) AS week_sin, round(cos(2 * pi() * weekofyear(week) / 52.0), 9) AS week_cos FROM weeks")
def seasonal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of a cell's week in the year on a circle."""
    rows = sale_lines(spark, sf_dir).select("sku", "location", weeks.week_start(F.col("business_date")).alias("week")).distinct()
    sine, cosine = weeks.seasonal(F.col("week"))
    return rows.select("sku", "location", "week", F.round(sine, 9).alias("week_sin"), F.round(cosine, 9).alias("week_cos"))


@query("""SELECT w.sku, w.location, week, date_diff('day', greatest(week, first_day), least(week + 6, last_day)) + 1 AS active_days FROM weeks w
  JOIN (SELECT sku, location, min(business_date) AS first_day, max(CAST(known_as_of AS DATE)) AS last_day FROM sales GROUP BY ALL) USING (sku, location) WHERE week <= last_day""")
def week_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each sold week within the cell's active window, from its first sale to its last shipment."""
    lines = sale_lines(spark, sf_dir)
    window = lines.groupBy("sku", "location").agg(F.min("business_date").alias("first_day"), F.max(F.col("known_as_of").cast("date")).alias("last_day"))
    rows = lines.select("sku", "location", weeks.week_start(F.col("business_date")).alias("week")).distinct().join(window, ["sku", "location"]).where("week <= last_day")
    return rows.select("sku", "location", "week", weeks.exposure(F.col("week"), F.col("first_day"), F.col("last_day")).cast("long").alias("active_days"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS tag_1, split_part(p_name, ' ', 2) AS tag_2, nullif(split_part(p_name, ' ', 3), '') AS tag_3, len(string_split(p_name, ' ')) AS tags FROM part", base=False)
def split_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a delimited name; a part that isn't there is null."""
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", *(text.tag(name, " ", n).alias(f"tag_{n}") for n in (1, 2, 3)), F.size(F.split(name, " ")).cast("long").alias("tags"))


@query("SELECT p_partkey, slug, list_aggregate(list_transform(string_split(slug, '-'), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', ' ') AS label FROM (SELECT p_partkey, replace(lower(p_name || ' ' || p_type), ' ', '-') AS slug FROM part)", base=False)
def slug_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slug of name and type, and the label that reads it back."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.replace(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit(" "), F.lit("-")).alias("slug"))
    return rows.withColumn("label", text.label(F.col("slug")))


@query("SELECT sku, location, channel, sha256(CAST(sku AS VARCHAR) || '|' || CAST(location AS VARCHAR) || '|' || channel) AS scope_key, count(*) AS lines FROM sales GROUP BY ALL")
def hash_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for each scope that sold."""
    rows = sale_lines(spark, sf_dir).groupBy("sku", "location", "channel").agg(F.count("*").alias("lines"))
    return rows.withColumn("scope_key", text.hash_key("sku", "location", "channel"))


@query("""SELECT s_suppkey, '{"name":"' || s_name || '","nation":' || s_nationkey || ',"in_credit":' || CASE WHEN s_acctbal >= 0 THEN 'true' ELSE 'false' END || '}' AS packed FROM supplier""", base=False)
def json_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of each site as one JSON value."""
    packed = F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") >= 0).alias("in_credit")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", packed.alias("packed"))


@query("SELECT market || '~' || CAST(location AS VARCHAR) || '~' || channel AS store_key, sum(units) AS units, sum(net_minor) AS net_minor FROM msales GROUP BY ALL")
def map_compose_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales under a key composed of market, site and channel."""
    rows = sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location")
    return rows.groupBy(text.compose_key("~", "market", "location", "channel").alias("store_key")).agg(F.sum("units").alias("units"), F.sum("net_minor").alias("net_minor"))


#: Dates as files bring them: day first, ISO, and one that is none.
_RAW = "CASE CAST(o_orderkey % 3 AS INTEGER) WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'week ' || weekofyear(o_orderdate) END"


def _raw_date() -> Column:
    key, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    return F.when(key == 0, F.date_format(day, "dd/MM/yyyy")).when(key == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat(F.lit("week "), F.weekofyear(day)))


@query(f"SELECT o_orderkey, raw, CAST(coalesce(try_strptime(raw, '%d/%m/%Y'), try_cast(raw AS TIMESTAMP)) AS DATE) AS parsed FROM (SELECT o_orderkey, {_RAW} AS raw FROM orders)", base=False)
def map_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared format first, a plain cast second, null where neither reads the text."""
    return read(spark, sf_dir, "orders").select("o_orderkey", _raw_date().alias("raw")).withColumn("parsed", text.parse_date(F.col("raw"), "dd/MM/yyyy"))


@query("SELECT event_id, raw, try_strptime(raw, '%Y%m%d %H:%M:%S') - INTERVAL 7 HOUR AS instant FROM (SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'pending' ELSE strftime(ts, '%Y%m%d %H:%M:%S') END AS raw FROM events)", base=False)
def map_parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local wall-clock texts as instants; a text that is none gives null."""
    raw = F.when(F.col("event_id") % 5 == 4, "pending").otherwise(F.date_format("ts", "yyyyMMdd HH:mm:ss"))
    return read(spark, sf_dir, "events").select("event_id", raw.alias("raw")).withColumn("instant", text.parse_instant(F.col("raw"), "yyyyMMdd HH:mm:ss", "Asia/Bangkok"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(l_quantity AS DECIMAL(18,4)) / 12, 2) AS DOUBLE) AS dozens FROM lineitem", base=False)
def map_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in another unit, rounded half up as decimals."""
    dozens = text.quantity(F.col("l_quantity") / 1, 12, 2)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", dozens.cast("double").alias("dozens"))


@query("SELECT p_type, CASE p_type WHEN 'ECONOMY' THEN 'value' WHEN 'STANDARD' THEN 'core' WHEN 'PROMO' THEN 'offer' END AS tier, count(*) AS products, count(DISTINCT p_brand) AS brands FROM part GROUP BY ALL", base=False)
def map_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed mapping of product types; what isn't in it is null and can be counted."""
    tier = text.value_map(F.col("p_type"), {"ECONOMY": "value", "STANDARD": "core", "PROMO": "offer"})
    return read(spark, sf_dir, "part").groupBy("p_type", tier.alias("tier")).agg(F.count("*").alias("products"), F.countDistinct("p_brand").alias("brands"))


@query("SELECT order_id, line_no, sku, CASE WHEN channel NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'CHANNEL_OUT_OF_SCOPE' WHEN location IN (7, 11, 13) THEN 'SITE_EXCLUDED' END AS reason FROM sales")
def mapped_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the code of the declared filter that drops them, in the order of declaration."""
    rows = sale_lines(spark, sf_dir)
    return text.row_filters(rows, [("channel", "in", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "CHANNEL_OUT_OF_SCOPE"), ("location", "not_in", [7, 11, 13], "SITE_EXCLUDED")]).select("order_id", "line_no", "sku", "reason")


@query("SELECT category, dept, min(product_name) AS example, count(*) AS n, count(DISTINCT pack_qty) AS packs FROM products GROUP BY ALL")
def agg_any_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A representative attribute of each group; the least one, so that reruns agree."""
    return products(spark, sf_dir).groupBy("category", "dept").agg(F.min("product_name").alias("example"), F.count("*").alias("n"), F.countDistinct("pack_qty").alias("packs"))


@query("SELECT location, count(*) AS shipments, round(avg(d), 6) AS mean_days, round(stddev_pop(d), 6) AS deviation FROM (SELECT location, CAST(date_diff('day', business_date, CAST(known_as_of AS DATE)) AS DOUBLE) AS d FROM sales) GROUP BY location")
def agg_stddev_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population deviation of the days from order to shipment, by site."""
    days = F.datediff(F.col("known_as_of").cast("date"), "business_date").cast("double")
    return sale_lines(spark, sf_dir).groupBy("location").agg(F.count("*").alias("shipments"), F.round(F.avg(days), 6).alias("mean_days"), F.round(F.stddev_pop(days), 6).alias("deviation"))


@query("SELECT p_partkey AS sku, p_brand AS dept, 'GB' AS country, 'v1' AS mapping FROM part", base=False)
def map_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared mapping: columns under their canonical names, and constants."""
    names, constants = {"p_partkey": "sku", "p_brand": "dept"}, {"country": "GB", "mapping": "v1"}
    return read(spark, sf_dir, "part").select(*(F.col(a).alias(b) for a, b in names.items()), *(F.lit(v).alias(c) for c, v in constants.items()))


@query("SELECT c_custkey, try_cast(split_part(c_name, '#', 2) AS BIGINT) AS number, CAST(try_cast(replace(CAST(c_acctbal AS VARCHAR), '-', '') AS DECIMAL(18,2)) AS DOUBLE) AS amount, try_cast(c_mktsegment AS BIGINT) AS none FROM customer", base=False)
def map_parse_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as whole numbers and decimals; null where they are none."""
    amount = F.replace(F.col("c_acctbal").cast("string"), F.lit("-"), F.lit("")).try_cast("decimal(18,2)")
    return read(spark, sf_dir, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(2)).try_cast("long").alias("number"), amount.cast("double").alias("amount"), F.col("c_mktsegment").try_cast("long").alias("none"))


@query(f"SELECT c_custkey, currency, CASE WHEN currency IS NOT NULL THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) END AS minor FROM {_BALANCES}", base=False)
def map_money_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Major amounts as exact minor units of their row's currency."""
    return _balances(spark, sf_dir).select("c_custkey", "currency", money.exact_minor(F.col("c_acctbal").cast("decimal(18,2)"), F.col("currency")).alias("minor"))


QUERIES, ORACLES = query.queries, query.oracles
