"""Queries of the site panel: coverage, windows, external columns, visibility and the current cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import weeks as week_of
from ..operators import panel
from ..operators.panel import INPUTS, SERIES, SITE_SQL
from ..sources.tables import line_tasks, locations, products, read, sale_lines
from .registration import Registry

query = Registry(SITE_SQL)
#: the decision day of the current cycle, a Thursday
DECIDED = "2000-12-28"


def site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the market of their site and the category of their product."""
    lines = sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location")
    return lines.join(products(spark, sf_dir).select("sku", "category"), "sku")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.dense_weeks(site_lines(spark, sf_dir), line_tasks(spark, sf_dir))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.windows(_dense(spark, sf_dir))


_CALENDAR = "isoyear(week) AS iso_year, weekofyear(week) AS iso_week, round(sin(2 * pi() * weekofyear(week) / 52.0), 9) AS week_sin, round(cos(2 * pi() * weekofyear(week) / 52.0), 9) AS week_cos, lag_52 IS NULL AS cold"


@query(f"SELECT *, {_CALENDAR} FROM site")
def feat_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly panel by category and site: dense weeks, lags, rolling windows, prices, season and targets."""
    year, week = week_of.iso_parts(F.col("week"))
    sine, cosine = week_of.seasonal(F.col("week"))
    return _panel(spark, sf_dir).withColumns({"iso_year": year, "iso_week": week, "week_sin": F.round(sine, 9), "week_cos": F.round(cosine, 9), "cold": F.col("lag_52").isNull()})


@query("SELECT category, location, week, units, mean_4, mean_8, mean_13, mean_26, dev_4, dev_8, dev_13, dev_26, zero_share_13, price_ratio, trend_4v13, weeks_since_sale FROM site")
def feat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling columns alone; none holds its own week but the price."""
    return _panel(spark, sf_dir).select(*SERIES, "week", "units", *(f"{k}_{n}" for k in ("mean", "dev") for n in panel.ROLLS), "zero_share_13", "price_ratio", "trend_4v13", "weeks_since_sale")


@query("""SELECT c.sku, c.location, c.business_date, market, category, dept, CAST(sum(c.units) AS BIGINT) AS units, CAST(sum(c.net_minor) AS BIGINT) AS net_minor, max(c.known_as_of) AS known_as_of
  FROM sales c JOIN (SELECT sku, location, min(business_date) AS first_day, CAST(max(known_as_of) FILTER (WHERE NOT returned) AS DATE) AS last_day FROM sales GROUP BY ALL) a USING (sku, location)
  JOIN locations USING (location) JOIN products USING (sku) WHERE business_date BETWEEN first_day AND last_day GROUP BY ALL""")
def feat_covered_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sales within the cell's assortment window, with site and product; the window ends with its last shipment that stayed."""
    lines = sale_lines(spark, sf_dir)
    stays = F.when(~F.col("returned"), F.col("known_as_of"))
    window = lines.groupBy("sku", "location").agg(F.min("business_date").alias("first_day"), F.max(stays).cast("date").alias("last_day"))
    daily = lines.groupBy("sku", "location", "business_date").agg(F.sum("units").alias("units"), F.sum("net_minor").alias("net_minor"), F.max("known_as_of").alias("known_as_of"))
    rows = daily.join(window, ["sku", "location"]).where("business_date between first_day and last_day")
    goods, sites = products(spark, sf_dir).select("sku", "category", "dept"), locations(spark, sf_dir).select("location", "market")
    return rows.join(sites, "location").join(goods, "sku").select("sku", "location", "business_date", "market", "category", "dept", "units", "net_minor", "known_as_of")


@query("""SELECT category, location, week, round((net_minor / units) / ((mn - net_minor) / nullif(mu - units, 0)), 6) AS price_ratio, mu - units AS rival_units, date_diff('day', last_rival, week) // 7 AS age_weeks FROM (
  SELECT d.category, d.location, d.week, d.units, d.net_minor, m.units AS mu, m.net_minor AS mn, (SELECT max(x.week) FROM sw x WHERE x.category = d.category AND x.market = d.market AND x.location <> d.location AND x.week <= d.week) AS last_rival
  FROM sw d JOIN (SELECT category, market, week, CAST(sum(units) AS BIGINT) AS units, CAST(sum(net_minor) AS BIGINT) AS net_minor FROM sw GROUP BY ALL) m USING (category, market, week))""")
def feat_competitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own price against that of the market's other sites in the same week, and the weeks since one of them sold."""
    sums = site_lines(spark, sf_dir).groupBy("category", "location", "market", F.to_date(F.date_trunc("week", "business_date")).alias("week")).agg(F.sum("units").alias("units"), F.sum("net_minor").alias("net_minor"))
    market = ["category", "market", "week"]
    whole = sums.groupBy(*market).agg(F.sum("units").alias("mu"), F.sum("net_minor").alias("mn"), F.count("*").alias("sites"))
    # the last week before in which anyone sold; in a week of its own a site has no rival
    walk = Window.partitionBy("category", "market").orderBy("week")
    shared = F.max(F.when(F.col("sites") > 1, F.col("week"))).over(walk)
    alone = sums.join(whole, market)
    order = Window.partitionBy("category", "market").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    # of weeks with one site only, the last of that site and the last of any other
    marks = whole.withColumn("shared", shared).join(sums.groupBy(*market).agg(F.max("location").alias("only")), market)
    solo = F.when(F.col("sites") == 1, F.struct("week", "only"))
    other = _last_of_others(marks.withColumn("solo", F.max(solo).over(order)))
    rows = alone.join(other, market)
    own = F.col("units")
    rival = F.greatest("shared", F.when(F.col("solo.only") != F.col("location"), F.col("solo.week")).otherwise(F.col("unlike.week")))
    ratio = (F.col("net_minor") / own) / ((F.col("mn") - F.col("net_minor")) / F.nullif(F.col("mu") - own, F.lit(0)))
    return rows.select("category", "location", "week", F.round(ratio, 6).alias("price_ratio"), (F.col("mu") - own).alias("rival_units"), (F.datediff("week", rival) / 7).cast("long").alias("age_weeks"))


def _last_of_others(runs: DataFrame) -> DataFrame:
    """For each week the last week with one site only, and the last such week of another site than that."""
    order = Window.partitionBy("category", "market").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    change = F.lag("solo").over(Window.partitionBy("category", "market").orderBy("week"))
    turned = F.when(change["only"] != F.col("solo.only"), change)
    return runs.withColumn("turned", turned).withColumn("unlike", F.last("turned", ignorenulls=True).over(order)).select("category", "market", "week", "shared", "solo", "unlike")


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, weekofyear(ts) AS iso_week, event_type, count(*) AS days, CAST(round(sum(CAST(value AS DECIMAL(18,6))) / count(*), 9) AS DOUBLE) AS mean_value, max(value) AS top_value FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL", base=False)
def feat_weather_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed external readings by week and kind."""
    rows = read(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    mean = F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count("*")
    return rows.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), F.weekofyear("ts").cast("long").alias("iso_week"), "event_type").agg(F.count("*").alias("days"), F.round(mean, 9).alias("mean_value"), F.max("value").alias("top_value"))


@query("""SELECT issued, horizon, CAST(round(sum(CAST(value AS DECIMAL(18,6))) / count(*), 9) AS DOUBLE) AS forecast, count(*) AS readings FROM (
  SELECT CAST(date_trunc('week', ts) AS DATE) AS issued, user_id % 4 + 1 AS horizon, value FROM events WHERE event_type = 'signup' AND extract('hour' FROM ts) < 18) GROUP BY ALL""", base=False)
def feat_weather_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was foretold, by week of issue and horizon; readings after the day's cutoff are the next issue's."""
    rows = read(spark, sf_dir, "events").where("event_type = 'signup'").where(F.hour("ts") < 18)
    mean = F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count("*")
    return rows.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("issued"), (F.col("user_id") % 4 + 1).alias("horizon")).agg(F.round(mean, 9).alias("forecast"), F.count("*").alias("readings"))


_MACRO = """(SELECT market, month, spend, round(spend / nullif(lag(spend, 12) OVER (PARTITION BY market ORDER BY month), 0), 6) AS year_index FROM (
  SELECT market, CAST(date_trunc('month', business_date) AS DATE) AS month, CAST(sum(net_minor) AS BIGINT) AS spend FROM msales GROUP BY ALL))"""


def _macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location")
    sums = lines.groupBy("market", F.trunc("business_date", "MM").alias("month")).agg(F.sum("net_minor").alias("spend"))
    before = F.lag("spend", 12).over(Window.partitionBy("market").orderBy("month"))
    return sums.withColumn("year_index", F.round(F.col("spend") / F.nullif(before, F.lit(0)), 6))


@query(f"SELECT * FROM {_MACRO}")
def feat_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spending of a market by month, and against the year before."""
    return _macro(spark, sf_dir)


@query(f"""SELECT s.category, s.location, s.week, s.units, m.year_index, w.mean_value, w.mean_value IS NULL AS climate_missing FROM site s
  LEFT JOIN {_MACRO} m ON m.market = s.market AND m.month = CAST(date_trunc('month', s.week) AS DATE) - INTERVAL 1 MONTH
  LEFT JOIN (SELECT weekofyear(ts) AS iso_week, CAST(round(sum(CAST(value AS DECIMAL(18,6))) / count(*), 9) AS DOUBLE) AS mean_value FROM events WHERE event_type = 'view' GROUP BY ALL) w ON w.iso_week = weekofyear(s.week)""")
def feat_external_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with last month's index of its market and the usual reading of its week; what is missing stays null."""
    macro = _macro(spark, sf_dir).select("market", F.add_months("month", 1).alias("month"), "year_index")
    mean = F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count("*")
    usual = read(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.weekofyear("ts").alias("iso_week")).agg(F.round(mean, 9).alias("mean_value"))
    rows = _dense(spark, sf_dir).withColumns({"month": F.trunc("week", "MM"), "iso_week": F.weekofyear("week")})
    rows = rows.join(macro, ["market", "month"], "left").join(usual, "iso_week", "left")
    return rows.select(*SERIES, "week", "units", "year_index", "mean_value", F.col("mean_value").isNull().alias("climate_missing"))


@query("SELECT sku, location, business_date, units, known_as_of FROM sales WHERE business_date = DATE '2000-06-15' AND known_as_of <= TIMESTAMP '2000-07-20'")
def visible_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one target date that were known by an instant."""
    seen = (F.col("business_date") == F.lit("2000-06-15").cast("date")) & (F.col("known_as_of") <= F.lit("2000-07-20").cast("timestamp"))
    return sale_lines(spark, sf_dir).where(seen).select("sku", "location", "business_date", "units", "known_as_of")


_ORIGIN = f"(SELECT max(week) AS origin FROM dense WHERE week + 7 > DATE '{DECIDED}' - 7 AND week <= DATE '{DECIDED}')"


def _origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = F.lit(DECIDED).cast("date")
    rows = _dense(spark, sf_dir).where((F.date_add("week", 7) > F.date_sub(decided, 7)) & (F.col("week") <= decided))
    return rows.agg(F.max("week").alias("origin"))  # one row


@query(f"SELECT origin, origin + 7 AS first_target, count(DISTINCT (category, location)) AS series FROM {_ORIGIN} JOIN dense ON week <= origin GROUP BY ALL")
def current_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest week that is history at the decision, and the series that have begun by then."""
    rows = _dense(spark, sf_dir).crossJoin(F.broadcast(_origin(spark, sf_dir))).where("week <= origin")
    return rows.groupBy("origin", F.date_add("origin", 7).alias("first_target")).agg(F.countDistinct(*SERIES).alias("series"))


@query(f"SELECT category, location, origin + 7 * h AS target_week, h, units AS last_units, mean_13, dev_13 FROM site JOIN {_ORIGIN} ON week = origin CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS h)")
def current_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to score: the coming four weeks of each series at the current origin, by what was known then."""
    rows = _panel(spark, sf_dir).join(F.broadcast(_origin(spark, sf_dir)), F.col("week") == F.col("origin"))
    each = rows.withColumn("h", F.explode(F.array(*(F.lit(h) for h in (1, 2, 3, 4)))))
    return each.select(*SERIES, F.expr("date_add(origin, 7 * h)").alias("target_week"), "h", F.col("units").alias("last_units"), "mean_13", "dev_13")


_DAYS = "(SELECT category, location, CAST(date_trunc('week', business_date) AS DATE) AS week, count(DISTINCT business_date) AS days, CAST(sum(units) AS BIGINT) AS units FROM msales JOIN products USING (sku) GROUP BY ALL)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    # few lines share a series, so they are dealt before they are counted, by tasks in proportion to them
    rows = site_lines(spark, sf_dir).select(*SERIES, "business_date", "units").repartition(line_tasks(spark, sf_dir), *SERIES)
    return rows.groupBy(*SERIES, F.to_date(F.date_trunc("week", "business_date")).alias("week")).agg(F.countDistinct("business_date").alias("days"), F.sum("units").alias("units"))


@query(f"SELECT category, location, week, units FROM {_DAYS} WHERE week < DATE '{DECIDED}' - 7 AND days >= 3")
def history_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks before the decision that sold on at least three days."""
    return _days(spark, sf_dir).where(F.col("week") < F.date_sub(F.lit(DECIDED).cast("date"), 7)).where("days >= 3").select(*SERIES, "week", "units")


@query(f"SELECT category, location, week, days, units, round(units * 7.0 / days, 6) AS scaled FROM {_DAYS} WHERE week < DATE '{DECIDED}' - 7 AND days < 3")
def history_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other weeks, scaled to seven days."""
    rows = _days(spark, sf_dir).where(F.col("week") < F.date_sub(F.lit(DECIDED).cast("date"), 7)).where("days < 3")
    return rows.select(*SERIES, "week", "days", "units", F.round(F.col("units") * 7.0 / F.col("days"), 6).alias("scaled"))


@query(f"""SELECT category, location, count(*) AS weeks_seen, count(*) FILTER (WHERE week >= origin - 84 AND units > 0) AS sold_13, date_diff('day', max(week) FILTER (WHERE units > 0), origin) // 7 AS age_weeks
  FROM dense JOIN {_ORIGIN} ON week <= origin GROUP BY category, location, origin""")
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks seen, sold weeks of the last thirteen, and the age of the last sale at the origin."""
    rows = _dense(spark, sf_dir).crossJoin(F.broadcast(_origin(spark, sf_dir))).where("week <= origin")
    sold = F.col("units") > 0
    recent = F.count_if(sold & (F.col("week") >= F.date_sub("origin", 84)))
    age = F.datediff("origin", F.max(F.when(sold, F.col("week"))))
    return rows.groupBy(*SERIES, "origin").agg(F.count("*").alias("weeks_seen"), recent.alias("sold_13"), (age / 7).cast("long").alias("age_weeks")).drop("origin")


@query("SELECT category, location, week, round((" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in INPUTS) + f") / {len(INPUTS)}.0, 6) AS missing_share, round(mean_4 / nullif(mean_13, 0) - 1, 6) AS uplift FROM site WHERE target_1 IS NOT NULL")
def quality_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of missing inputs of each row, and the last month against the last quarter."""
    rows = _panel(spark, sf_dir).where("target_1 is not null")
    missing = sum((F.col(c).isNull().cast("int") for c in INPUTS), F.lit(0)) / float(len(INPUTS))
    return rows.select(*SERIES, "week", F.round(missing, 6).alias("missing_share"), F.round(F.col("mean_4") / F.nullif(F.col("mean_13"), F.lit(0.0)) - 1, 6).alias("uplift"))


@query("""SELECT week, h, CASE WHEN h = 1 AND n >= 20 THEN recent ELSE usual END AS reading, CASE WHEN h = 1 AND n >= 20 THEN 'forecast' ELSE 'climate' END AS origin FROM (
  SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(18,6))) / count(*), 9) AS DOUBLE) AS recent FROM events WHERE event_type = 'error' GROUP BY ALL)
  CROSS JOIN (SELECT CAST(round(sum(CAST(value AS DECIMAL(18,6))) / count(*), 9) AS DOUBLE) AS usual FROM events WHERE event_type = 'error') CROSS JOIN (SELECT unnest([1, 2, 3]) AS h)""", base=False)
def horizon_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast for the first week where it is complete, the usual reading for others."""
    rows = read(spark, sf_dir, "events").where("event_type = 'error'")
    mean = F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count("*"), 9)
    by_week = rows.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"), mean.alias("recent"))
    each = by_week.crossJoin(F.broadcast(rows.agg(mean.alias("usual")))).withColumn("h", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))  # one row
    told = (F.col("h") == 1) & (F.col("n") >= 20)
    return each.select("week", "h", F.when(told, F.col("recent")).otherwise(F.col("usual")).alias("reading"), F.when(told, "forecast").otherwise("climate").alias("origin"))


QUERIES, ORACLES = query.queries, query.oracles
