"""Queries of forecast report tables, policy history and acceptance, readiness, landing and serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import inventory as inv
from ..operators import supply
from ..operators.supply import SUPPLY_SQL
from ..sources import landing
from ..sources.serving import ServingTable
from ..sources.tables import locations, products, read, sale_lines, scratch
from .evaluation import _quality, _QUALITY, error, tot, total
from .forecast import _CAL, KEYS, PANEL_SQL, _calibrated, _evals, _panel
from .registration import Registry
from .supply import _promos, _PROMO, _scoped, _SCOPED, _sites

query = Registry(SUPPLY_SQL + PANEL_SQL)
_ERR = "abs(ma13 - actual)"


def n_if(condition: str) -> Column:
    return F.count_if(F.expr(condition))


# --- forecast reports ----------------------------------------------------------------------------------


@query("SELECT version, weeks, rows, version = max(version) OVER () AS active FROM (SELECT CAST(year(week) AS BIGINT) AS version, count(DISTINCT week) AS weeks, count(*) AS rows FROM evals GROUP BY ALL)")
def rpt_fc_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version for each year of origins; the newest is the active one."""
    rows = _evals(spark, sf_dir).groupBy(F.year("week").cast("long").alias("version")).agg(F.countDistinct("week").alias("weeks"), F.count("*").alias("rows"))
    newest = rows.agg(F.max("version").alias("newest"))  # one row
    return rows.crossJoin(F.broadcast(newest)).select("version", "weeks", "rows", (F.col("version") == F.col("newest")).alias("active"))


@query(f"""SELECT n, series, round(err / act, 6) AS wape, round(covered / n, 6) AS coverage, good, watch, issue FROM (SELECT count(*) AS n, count(DISTINCT (category, market)) AS series, {tot(_ERR)} AS err, {tot("actual")} AS act, count(*) FILTER (WHERE actual <= p90) AS covered FROM ({_CAL}))
  CROSS JOIN (SELECT count(*) FILTER (WHERE class = 'Good') AS good, count(*) FILTER (WHERE class = 'Watch') AS watch, count(*) FILTER (WHERE class = 'Issue') AS issue FROM {_QUALITY})""")
def rpt_fc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline accuracy and coverage, beside the number of series of each class; one row each."""
    head = _calibrated(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct(*KEYS).alias("series"), total(error()).alias("err"), total(F.col("actual")).alias("act"), n_if("actual <= p90").alias("covered"))
    classes = _quality(spark, sf_dir).agg(*(n_if(f"class = '{c}'").alias(c.lower()) for c in ("Good", "Watch", "Issue")))
    return head.crossJoin(classes).select("n", "series", F.round(F.col("err") / F.col("act"), 6).alias("wape"), F.round(F.col("covered") / F.col("n"), 6).alias("coverage"), "good", "watch", "issue")


_BY = ", ".join(f"round({tot(f'abs({b} - actual)')} / nullif({tot('actual')}, 0), 6) AS wape_{b}" for b in ("naive", "ma8", "ma13"))


@query(f"SELECT coalesce(market, 'portfolio') AS market, count(*) AS n, {_BY} FROM evals GROUP BY GROUPING SETS ((), (market))")
def rpt_fc_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every baseline's error at the portfolio and by market."""
    act = F.nullif(total(F.col("actual")), F.lit(0.0))
    rows = _evals(spark, sf_dir).groupingSets([[], ["market"]], "market")
    return rows.agg(F.count("*").alias("n"), *(F.round(total(error(b)) / act, 6).alias(f"wape_{b}") for b in ("naive", "ma8", "ma13"))).withColumn("market", F.coalesce("market", F.lit("portfolio")))


_BENCH = f"""(SELECT e.category, e.market, e.n, e.wape, q.class, p.promo_lines, e.last_actual, CASE WHEN e.signed > 0.1 * e.act THEN 'over' WHEN e.signed < -0.1 * e.act THEN 'under' ELSE 'level' END AS bias FROM (
  SELECT category, market, count(*) AS n, {tot(_ERR)} / nullif({tot("actual")}, 0) AS wape, {tot("ma13 - actual")} AS signed, {tot("actual")} AS act, arg_max(actual, week) AS last_actual FROM evals GROUP BY ALL) e
  JOIN {_QUALITY} q ON q.category = e.category AND q.market = e.market LEFT JOIN (SELECT category, market, CAST(sum(lines) AS BIGINT) AS promo_lines FROM {_PROMO} GROUP BY ALL) p ON p.category = e.category AND p.market = e.market)"""


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.col("ma13") - F.col("actual")
    sums = _evals(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n"), total(error()).alias("err"), total(signed).alias("signed"), total(F.col("actual")).alias("act"), F.max_by("actual", "week").alias("last_actual"))
    promo = _promos(spark, sf_dir).groupBy(*KEYS).agg(F.sum("lines").alias("promo_lines"))
    rows = sums.join(_quality(spark, sf_dir).select(*KEYS, "class"), KEYS).join(promo, KEYS, "left")
    bias = F.when(F.col("signed") > 0.1 * F.col("act"), "over").when(F.col("signed") < -0.1 * F.col("act"), "under").otherwise("level")
    return rows.select(*KEYS, "n", (F.col("err") / F.nullif(F.col("act"), F.lit(0.0))).alias("wape"), "class", "promo_lines", "last_actual", bias.alias("bias"))


@query(f"SELECT category, market, n, round(wape, 6) AS wape, class, promo_lines, last_actual, bias FROM {_BENCH}")
def rpt_fc_workbench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series with its error, class, promotions, last actual and the way it errs; all frames are reduced to series first."""
    return _bench(spark, sf_dir).withColumn("wape", F.round("wape", 6))


@query(f"SELECT category, market, round(wape, 6) AS wape, class, count(*) OVER () AS n_total FROM {_BENCH} ORDER BY wape DESC, category, market LIMIT 10 OFFSET 5")
def rpt_fc_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of series by error, with the number of all."""
    rows = _bench(spark, sf_dir).select(*KEYS, "wape", "class")
    page = rows.orderBy(F.desc("wape"), *KEYS).offset(5).limit(10)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n_total")))).withColumn("wape", F.round("wape", 6))


_HORIZONS = "(SELECT category, market, week + 7 * h AS target_week, h, ma13 AS forecast, CASE h WHEN 1 THEN target_1 WHEN 2 THEN target_2 WHEN 3 THEN target_3 ELSE target_4 END AS actual FROM base CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS h) WHERE mean_13 IS NOT NULL)"


def _horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel(spark, sf_dir).where("mean_13 is not null").withColumn("forecast", F.greatest(F.coalesce("mean_13", F.lit(0.0)), F.lit(0.0)))
    each = rows.select(*KEYS, "week", "forecast", F.expr("stack(4, 1, target_1, 2, target_2, 3, target_3, 4, target_4) AS (h, actual)"))
    return each.select(*KEYS, F.expr("date_add(week, 7 * h)").alias("target_week"), "h", "forecast", "actual")


@query(f"SELECT market, target_week, round({tot('forecast')}, 4) AS forecast, CAST(sum(actual) AS BIGINT) AS actual, max(h) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY category, market, target_week ORDER BY h) AS r FROM {_HORIZONS} WHERE actual IS NOT NULL) WHERE r = 1 GROUP BY ALL")
def rpt_fc_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each week's actual beside the freshest forecast of it."""
    rows = _horizons(spark, sf_dir).where("actual is not null").groupBy(*KEYS, "target_week").agg(F.min_by(F.struct("forecast", "actual", "h"), "h").alias("x"))
    return rows.groupBy("market", "target_week").agg(F.round(total(F.col("x.forecast")), 4).alias("forecast"), F.sum("x.actual").alias("actual"), F.max("x.h").alias("oldest"))


@query("SELECT category, market, week, actual, ma13 FROM evals WHERE market = 'ASIA' ORDER BY week DESC, category LIMIT 50 OFFSET 20")
def rpt_fc_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one market's evaluation rows, newest first."""
    return _evals(spark, sf_dir).where("market = 'ASIA'").orderBy(F.desc("week"), "category").offset(20).limit(50).select(*KEYS, "week", "actual", "ma13")


@query(f"SELECT h, n, round(err / act, 6) AS wape, leaves, round(leaves / max(leaves) OVER (), 6) AS coverage FROM (SELECT h, CAST(sum(n) AS BIGINT) AS n, {tot('abs(f - a)')} AS err, {tot('a')} AS act, CAST(max(leaves) AS BIGINT) AS leaves FROM (SELECT h, market, target_week, count(*) AS n, count(DISTINCT category) AS leaves, {tot('forecast')} AS f, CAST(sum(actual) AS DOUBLE) AS a FROM {_HORIZONS} WHERE actual IS NOT NULL GROUP BY ALL) GROUP BY h)")
def rpt_fc_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by horizon, summed to the market before the error is taken, and how many leaves stand behind it."""
    by_market = _horizons(spark, sf_dir).where("actual is not null").groupBy("h", "market", "target_week").agg(F.count("*").alias("n"), F.countDistinct("category").alias("leaves"), total(F.col("forecast")).alias("f"), F.sum("actual").cast("double").alias("a"))
    rows = by_market.groupBy("h").agg(F.sum("n").alias("n"), total(F.abs(F.col("f") - F.col("a"))).alias("err"), total(F.col("a")).alias("act"), F.max("leaves").alias("leaves"))
    most = rows.agg(F.max("leaves").alias("most"))  # one row
    return rows.crossJoin(F.broadcast(most)).select("h", "n", F.round(F.col("err") / F.col("act"), 6).alias("wape"), "leaves", F.round(F.col("leaves") / F.col("most"), 6).alias("coverage"))


_STORE = "(SELECT location, market, week, units, CAST(CAST(sum(units) OVER w AS BIGINT) AS DOUBLE) / count(*) OVER w AS forecast FROM (SELECT location, market, CAST(date_trunc('week', business_date) AS DATE) AS week, CAST(sum(units) AS BIGINT) AS units FROM msales GROUP BY ALL) WINDOW w AS (PARTITION BY location ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"


@query(f"SELECT s.location, s.market, n, round(err / act, 6) AS wape, late_lines, CASE WHEN late_lines * 5 > lines THEN 'supply' WHEN err > act THEN 'forecast' ELSE 'none' END AS risk FROM (SELECT location, market, count(*) AS n, {tot('abs(forecast - units)')} AS err, {tot('units')} AS act FROM {_STORE} WHERE forecast IS NOT NULL GROUP BY ALL) s JOIN (SELECT location, count(*) AS lines, count(*) FILTER (WHERE state = 'late') AS late_lines FROM ship GROUP BY location) i USING (location)")
def rpt_fc_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of an eight-week mean by site, beside the lines its suppliers are late with."""
    lines = sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location")
    weeks = lines.groupBy("location", "market", F.to_date(F.date_trunc("week", "business_date")).alias("week")).agg(F.sum("units").alias("units"))
    past = Window.partitionBy("location").orderBy("week").rowsBetween(-8, -1)
    rows = weeks.withColumn("forecast", F.sum("units").over(past).cast("double") / F.count("*").over(past)).where("forecast is not null")
    sums = rows.groupBy("location", "market").agg(F.count("*").alias("n"), total(F.abs(F.col("forecast") - F.col("units"))).alias("err"), total(F.col("units")).alias("act"))
    late = supply.shipments(spark, sf_dir).groupBy("location").agg(F.count("*").alias("lines"), n_if("state = 'late'").alias("late_lines"))
    risk = F.when(F.col("late_lines") * 5 > F.col("lines"), "supply").when(F.col("err") > F.col("act"), "forecast").otherwise("none")
    return sums.join(late, "location").select("location", "market", "n", F.round(F.col("err") / F.col("act"), 6).alias("wape"), "late_lines", risk.alias("risk"))


@query("SELECT coalesce(a.location, b.location) AS location, coalesce(a.late_units, 0) AS late_units, coalesce(b.returned_units, 0) AS returned_units FROM (SELECT location, CAST(sum(outstanding_units) AS BIGINT) AS late_units FROM ship WHERE state = 'late' GROUP BY location) a FULL JOIN (SELECT location, CAST(sum(units) AS BIGINT) AS returned_units FROM ship WHERE returned AND state = 'received' GROUP BY location) b ON a.location = b.location")
def rpt_fc_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late and returned units of every site that has either."""
    rows = supply.shipments(spark, sf_dir)
    late = rows.where("state = 'late'").groupBy("location").agg(F.sum("outstanding_units").alias("late_units"))
    back = rows.where("returned and state = 'received'").groupBy("location").agg(F.sum("units").alias("returned_units"))
    return late.join(back, "location", "full").select("location", F.coalesce("late_units", F.lit(0)).alias("late_units"), F.coalesce("returned_units", F.lit(0)).alias("returned_units"))


@query(f"SELECT category, market, CASE WHEN CAST(month(week) AS BIGINT) IN (11, 12) THEN 'season' ELSE 'usual' END AS scope, round({tot('naive - ma13')}, 4) AS recent, round({tot('coalesce(seasonal_naive, ma13) - ma13')}, 4) AS season FROM evals WHERE market = 'EUROPE' GROUP BY ALL")
def rpt_fc_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of a market's series in the season and outside it."""
    scope = F.when(F.month("week").isin(11, 12), "season").otherwise("usual")
    season = F.coalesce("seasonal_naive", "ma13") - F.col("ma13")
    return _evals(spark, sf_dir).where("market = 'EUROPE'").groupBy(*KEYS, scope.alias("scope")).agg(F.round(total(F.col("naive") - F.col("ma13")), 4).alias("recent"), F.round(total(season), 4).alias("season"))


@query("SELECT category, market, week, kind, count(*) OVER () AS n_total FROM (SELECT category, market, week, unnest(list_filter([CASE WHEN actual > 2 * ma13 THEN 'UNDER_FORECAST' END, CASE WHEN ma13 > 2 * actual THEN 'OVER_FORECAST' END, CASE WHEN cold THEN 'SPARSE_HISTORY' END], lambda x: x IS NOT NULL)) AS kind FROM evals) ORDER BY week DESC, category, market, kind LIMIT 40 OFFSET 10")
def rpt_fc_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of forecast exceptions with the number of all."""
    kinds = F.array_compact(F.array(F.when(F.col("actual") > 2 * F.col("ma13"), "UNDER_FORECAST"), F.when(F.col("ma13") > 2 * F.col("actual"), "OVER_FORECAST"), F.when(F.col("cold"), "SPARSE_HISTORY")))
    rows = _evals(spark, sf_dir).select(*KEYS, "week", F.explode(kinds).alias("kind"))
    page = rows.orderBy(F.desc("week"), *KEYS, "kind").offset(10).limit(40)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n_total"))))


# --- policy replay ----------------------------------------------------------------------------------------


@query("SELECT week, CAST(week AS TIMESTAMP) - INTERVAL 7 HOUR AS opens, CAST(week AS TIMESTAMP) + INTERVAL 7 DAY - INTERVAL 7 HOUR AS closes, CAST(week AS TIMESTAMP) - INTERVAL 4 DAY - INTERVAL 7 HOUR AS decided, count(*) AS lines FROM (SELECT CAST(date_trunc('week', business_date) AS DATE) AS week FROM sales) GROUP BY week")
def rep_week_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local bounds of each replayed week as instants, and the Thursday before on which it was decided."""
    def instant(day: Column) -> Column:
        return F.to_utc_timestamp(day.cast("timestamp"), "Asia/Bangkok")

    weeks = sale_lines(spark, sf_dir).groupBy(F.to_date(F.date_trunc("week", "business_date")).alias("week")).agg(F.count("*").alias("lines"))
    return weeks.select("week", instant(F.col("week")).alias("opens"), instant(F.date_add("week", 7)).alias("closes"), instant(F.date_sub("week", 4)).alias("decided"), "lines")


_HIST = """(SELECT location, sku, week, CAST(sum(demand) AS BIGINT) AS demand, CAST(sum(served) AS BIGINT) AS served, CAST(sum(arrived) AS BIGINT) AS arrived, CAST(sum(wasted) AS BIGINT) AS wasted FROM (
  SELECT location, sku, CAST(date_trunc('week', business_date) AS DATE) AS week, units AS demand, received_units AS served, 0 AS arrived, 0 AS wasted FROM ship UNION ALL
  SELECT location, sku, CAST(date_trunc('week', due_date) AS DATE), 0, 0, received_units, CASE WHEN returned THEN received_units ELSE 0 END FROM ship WHERE state = 'received') GROUP BY ALL)"""
_BRIDGE = f"(SELECT *, run - least(0, CAST(min(run) OVER (PARTITION BY location, sku ORDER BY week ROWS UNBOUNDED PRECEDING) AS BIGINT)) AS closing FROM (SELECT *, CAST(sum(arrived - served - wasted) OVER (PARTITION BY location, sku ORDER BY week ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM {_HIST}))"


def _bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly flows of each cell and its closing stock: the running balance, lifted whenever it would fall below zero."""
    rows = supply.shipments(spark, sf_dir)
    zero = F.lit(0).cast("long")
    asked = rows.select("location", "sku", F.to_date(F.date_trunc("week", "business_date")).alias("week"), F.col("units").alias("demand"), F.col("received_units").alias("served"), zero.alias("arrived"), zero.alias("wasted"))
    came = rows.where("state = 'received'").select("location", "sku", F.to_date(F.date_trunc("week", "due_date")).alias("week"), zero.alias("demand"), zero.alias("served"), F.col("received_units").alias("arrived"), F.when(F.col("returned"), F.col("received_units")).otherwise(0).alias("wasted"))
    flows = asked.unionByName(came).groupBy("location", "sku", "week").agg(*(F.sum(c).alias(c) for c in ("demand", "served", "arrived", "wasted")))
    walk = Window.partitionBy("location", "sku").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    run = flows.withColumn("run", F.sum(F.col("arrived") - F.col("served") - F.col("wasted")).over(walk))
    # a fold that is clamped at zero equals the balance less its least value so far
    return run.withColumn("closing", F.col("run") - F.least(F.lit(0), F.min("run").over(walk)))


@query(f"SELECT location, sku, week, demand, served, arrived, wasted, closing, closing - arrived + served + wasted AS opening FROM {_BRIDGE}")
def rep_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cell asked, served, took in and wasted each week, bridged from opening to closing stock."""
    rows = _bridge(spark, sf_dir)
    return rows.select("location", "sku", "week", "demand", "served", "arrived", "wasted", "closing", (F.col("closing") - F.col("arrived") + F.col("served") + F.col("wasted")).alias("opening"))


@query(f"SELECT location, count(*) AS weeks, count(*) FILTER (WHERE closing = 0) AS stockout_weeks, CAST(sum(demand - served) AS BIGINT) AS lost, round(CAST(sum(served) AS DOUBLE) / nullif(sum(demand), 0), 6) AS fill_rate, round(CAST(sum(closing) AS DOUBLE) / count(*), 6) AS mean_stock FROM {_BRIDGE} GROUP BY location")
def rep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bridge(spark, sf_dir).groupBy("location")
    return rows.agg(F.count("*").alias("weeks"), n_if("closing = 0").alias("stockout_weeks"), F.sum(F.col("demand") - F.col("served")).alias("lost"), F.round(F.sum("served").cast("double") / F.nullif(F.sum("demand"), F.lit(0)), 6).alias("fill_rate"), F.round(F.sum("closing").cast("double") / F.count("*"), 6).alias("mean_stock"))


@query(f"SELECT market, cells, round(err / cells, 6) AS mean_error, err / cells <= 5 AS within FROM (SELECT market, count(*) AS cells, CAST(sum(abs(closing - balance)) AS DOUBLE) AS err FROM (SELECT location, sku, arg_max(closing, week) AS closing, greatest(0, arg_max(run, week)) AS balance FROM {_BRIDGE} GROUP BY ALL) JOIN (SELECT location, market FROM locations) USING (location) GROUP BY market)")
def rep_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute distance of the bridged closing stock from the plain balance, within a tolerance."""
    last = _bridge(spark, sf_dir).groupBy("location", "sku").agg(F.max_by("closing", "week").alias("closing"), F.greatest(F.lit(0), F.max_by("run", "week")).alias("balance"))
    sums = last.join(locations(spark, sf_dir).select("location", "market"), "location").groupBy("market").agg(F.count("*").alias("cells"), F.sum(F.abs(F.col("closing") - F.col("balance"))).cast("double").alias("err"))
    mean = F.col("err") / F.col("cells")
    return sums.select("market", "cells", F.round(mean, 6).alias("mean_error"), (mean <= 5).alias("within"))


@query(f"SELECT location, sku, mean_demand, CAST(ceil(mean_demand * 4) AS BIGINT) AS cover_target, CAST(ceil(mean_demand * 2 + top) AS BIGINT) AS reorder_point FROM (SELECT location, sku, CAST(sum(demand) AS DOUBLE) / count(*) AS mean_demand, max(demand) AS top FROM {_BRIDGE} GROUP BY ALL)")
def rep_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of two policies for each cell: weeks of cover, or a reorder point."""
    rows = _bridge(spark, sf_dir).groupBy("location", "sku").agg((F.sum("demand").cast("double") / F.count("*")).alias("mean_demand"), F.max("demand").alias("top"))
    return rows.select("location", "sku", "mean_demand", F.ceil(F.col("mean_demand") * 4).cast("long").alias("cover_target"), F.ceil(F.col("mean_demand") * 2 + F.col("top")).cast("long").alias("reorder_point"))


_COHORT = "CASE WHEN CAST('0x' || substr(sha256('replay-1|' || sku), 1, 15) AS BIGINT) % 100 < 5 THEN 'candidate' ELSE 'incumbent' END"


@query(f"""SELECT market, c.fill AS candidate_fill, i.fill AS incumbent_fill, coalesce(c.fill >= i.fill - 0.02, false) AS accepted FROM (SELECT DISTINCT market FROM locations)
  LEFT JOIN (SELECT market, round(CAST(sum(served) AS DOUBLE) / sum(demand), 6) AS fill FROM {_BRIDGE} JOIN (SELECT location, market FROM locations) USING (location) WHERE demand > 0 AND {_COHORT} = 'candidate' GROUP BY market) c USING (market)
  LEFT JOIN (SELECT market, round(CAST(sum(served) AS DOUBLE) / sum(demand), 6) AS fill FROM {_BRIDGE} JOIN (SELECT location, market FROM locations) USING (location) WHERE demand > 0 AND {_COHORT} = 'incumbent' GROUP BY market) i USING (market)""")
def rep_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate cohort must serve as much of its demand as the incumbent, but for two percent, in each market."""
    rows = _bridge(spark, sf_dir).where("demand > 0").join(locations(spark, sf_dir).select("location", "market"), "location").withColumn("cohort", inv.cohort(F.col("sku"), "replay-1"))
    fill = lambda c: F.round(F.sum(F.when(F.col("cohort") == c, F.col("served"))).cast("double") / F.sum(F.when(F.col("cohort") == c, F.col("demand"))), 6)
    sums = rows.groupBy("market").agg(fill("candidate").alias("candidate_fill"), fill("incumbent").alias("incumbent_fill"))
    every = locations(spark, sf_dir).select("market").distinct().join(sums, "market", "left")
    return every.withColumn("accepted", F.coalesce(F.col("candidate_fill") >= F.col("incumbent_fill") - 0.02, F.lit(False)))


# --- rules, readiness, landing, serving ---------------------------------------------------------------------


@query(f"SELECT scope_type, count(*) AS terms, count(*) FILTER (WHERE lead_days <= 0) AS no_lead, count(*) FILTER (WHERE moq <= 0) AS no_moq FROM {_SCOPED} GROUP BY scope_type")
def b08_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are not positive, by scope."""
    return _scoped(spark, sf_dir).groupBy("scope_type").agg(F.count("*").alias("terms"), n_if("lead_days <= 0").alias("no_lead"), n_if("moq <= 0").alias("no_moq"))


@query("SELECT scope_type, count(*) AS rows, count(*) FILTER (WHERE scope IS NULL) AS no_scope, count(*) FILTER (WHERE l.location IS NULL AND scope_type = 'site') AS unknown FROM (SELECT 'site' AS scope_type, user_id AS scope FROM events WHERE event_type = 'view' UNION ALL SELECT 'visitor', user_id FROM events WHERE event_type = 'click') x LEFT JOIN locations l ON l.location = scope GROUP BY scope_type")
def b10_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside rows without a scope, and site scopes that name no site."""
    kind = F.when(F.col("event_type") == "view", "site").otherwise("visitor")
    rows = read(spark, sf_dir, "events").where("event_type in ('view', 'click')").select(kind.alias("scope_type"), F.col("user_id").alias("scope"))
    told = rows.join(locations(spark, sf_dir).select(F.col("location").alias("scope"), F.lit(True).alias("known")), "scope", "left")
    return told.groupBy("scope_type").agg(F.count("*").alias("rows"), n_if("scope is null").alias("no_scope"), n_if("known is null and scope_type = 'site'").alias("unknown"))


@query(f"SELECT category, month, count(*) AS scopes, count(DISTINCT market) AS markets, bool_or(market = 'EUROPE') AS in_europe, count(*) <> count(DISTINCT (dept, market)) AS repeated FROM {_PROMO} GROUP BY category, month")
def b11_promo_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope rows of each promotion: distinct, and which reach the market."""
    rows = _promos(spark, sf_dir).groupBy("category", "month")
    return rows.agg(F.count("*").alias("scopes"), F.countDistinct("market").alias("markets"), F.bool_or(F.col("market") == "EUROPE").alias("in_europe"), (F.count("*") != F.countDistinct("dept", "market")).alias("repeated"))


@query(f"SELECT 'category' AS kind, count(*) AS unresolved FROM (SELECT DISTINCT category FROM {_PROMO}) p ANTI JOIN (SELECT DISTINCT category FROM products WHERE price_minor > 91000) USING (category) UNION ALL SELECT 'dept', count(*) FROM (SELECT DISTINCT dept FROM {_PROMO}) p ANTI JOIN (SELECT DISTINCT dept FROM products WHERE price_minor > 91000) USING (dept) UNION ALL SELECT 'pair', count(*) FROM (SELECT DISTINCT category, dept FROM {_PROMO}) p ANTI JOIN (SELECT DISTINCT category, dept FROM products WHERE price_minor > 91000) USING (category, dept)")
def b12_merch_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotion targets that resolve to no regular product, at three grains."""
    promos, goods = _promos(spark, sf_dir), products(spark, sf_dir).where("price_minor > 91000")
    out = None
    for kind, keys in (("category", ["category"]), ("dept", ["dept"]), ("pair", ["category", "dept"])):
        part = promos.select(*keys).distinct().join(goods.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("unresolved")).select(F.lit(kind).alias("kind"), "unresolved")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT market, count(*) AS orders, count(*) FILTER (WHERE abs(warehouse - ledger) > warehouse) AS unexplained FROM (SELECT order_id, min(location) AS location, CAST(sum(net_minor) AS BIGINT) AS ledger, CAST(CAST(max(o_totalprice) AS DECIMAL(18,2)) * 100 AS BIGINT) AS warehouse FROM ship JOIN orders ON o_orderkey = order_id GROUP BY order_id) JOIN (SELECT location, market FROM locations) USING (location) GROUP BY market")
def b19_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose two values differ by more than the whole of one."""
    heads = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long").alias("warehouse"))
    sums = supply.shipments(spark, sf_dir).groupBy("order_id").agg(F.min("location").alias("location"), F.sum("net_minor").alias("ledger")).join(heads, "order_id")
    return sums.join(locations(spark, sf_dir).select("location", "market"), "location").groupBy("market").agg(F.count("*").alias("orders"), n_if("abs(warehouse - ledger) > warehouse").alias("unexplained"))


@query("SELECT user_id AS scope, count(*) AS phases, count(*) FILTER (WHERE value IS NULL OR props IS NULL) AS incomplete, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS BIGINT) AS span_days FROM events WHERE event_type = 'error' GROUP BY user_id", base=False)
def b20_disruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every phase of a disruption carries its evidence."""
    span = F.datediff(F.max("ts").cast("date"), F.min("ts").cast("date")).cast("long")
    return read(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("scope")).agg(F.count("*").alias("phases"), n_if("value is null or props is null").alias("incomplete"), span.alias("span_days"))


_EVIDENCE = "(SELECT market, min(business_date) AS first_day, max(business_date) AS last_day, count(*) AS rows, count(*) FILTER (WHERE CAST(known_as_of AS DATE) >= business_date) AS timely FROM msales GROUP BY market)"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location").groupBy("market")
    return rows.agg(F.min("business_date").alias("first_day"), F.max("business_date").alias("last_day"), F.count("*").alias("rows"), n_if("cast(known_as_of as date) >= business_date").alias("timely"))


_GRADE = "CASE WHEN timely * 10 >= rows * 9 THEN 'point_in_time' WHEN timely * 10 >= rows * 4 THEN 'mixed' ELSE 'backfilled' END"


def _grade() -> Column:
    return F.when(F.col("timely") * 10 >= F.col("rows") * 9, "point_in_time").when(F.col("timely") * 10 >= F.col("rows") * 4, "mixed").otherwise("backfilled")


@query(f"SELECT market, first_day, last_day, round(timely / rows, 6) AS timely_share, {_GRADE} AS grade FROM {_EVIDENCE}")
def temporal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a market's evidence was known no earlier than it happened, and the grade that gives."""
    return _evidence(spark, sf_dir).select("market", "first_day", "last_day", F.round(F.col("timely") / F.col("rows"), 6).alias("timely_share"), _grade().alias("grade"))


@query(f"SELECT market, CASE WHEN rows < 10 THEN 'unavailable' WHEN grade = 'backfilled' THEN 'blocked' WHEN grade = 'mixed' OR unpriced > 0 THEN 'partial' ELSE 'ready' END AS readiness, unpriced FROM (SELECT *, {_GRADE} AS grade FROM {_EVIDENCE}) JOIN (SELECT market, count(*) FILTER (WHERE currency IS NULL) AS unpriced FROM xwalk GROUP BY market) USING (market)")
def capability_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready, partial, unavailable or blocked, by evidence and by sites without a currency."""
    unpriced = _sites(spark, sf_dir).groupBy("market").agg(n_if("currency is null").alias("unpriced"))
    rows = _evidence(spark, sf_dir).withColumn("grade", _grade()).join(unpriced, "market")
    readiness = F.when(F.col("rows") < 10, "unavailable").when(F.col("grade") == "backfilled", "blocked").when((F.col("grade") == "mixed") | (F.col("unpriced") > 0), "partial").otherwise("ready")
    return rows.select("market", readiness.alias("readiness"), "unpriced")


@query("SELECT dataset, column_name, kind, rows FROM (VALUES ('events', 'event_id', 'bigint'), ('events', 'event_type', 'string'), ('events', 'props', 'string'), ('events', 'ts', 'string'), ('events', 'user_id', 'bigint'), ('events', 'value', 'double'), ('supplier', 's_acctbal', 'double'), ('supplier', 's_name', 'string'), ('supplier', 's_nationkey', 'bigint'), ('supplier', 's_suppkey', 'bigint')) v(dataset, column_name, kind) JOIN (SELECT 'events' AS dataset, count(*) AS rows FROM events UNION ALL SELECT 'supplier', count(*) FROM supplier) USING (dataset)", base=False)
def infer_source_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names and types of undeclared JSON files, inferred from all their rows."""
    out = None
    for name in ("events", "supplier"):
        path = scratch(spark, f"undeclared-{name}")
        read(spark, sf_dir, name).write.json(path)
        found = spark.read.json(path)
        fields = F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("kind")) for f in found.schema))
        part = found.agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), F.explode(fields).alias("x"), "rows").select("dataset", "x.column_name", "x.kind", "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT object, declared, landed, status FROM (SELECT CAST(y AS VARCHAR) AS object, n AS declared, CASE WHEN y <> 1993 THEN n END AS landed, CASE y WHEN 1993 THEN 'missing' WHEN 1995 THEN 'altered' ELSE 'intact' END AS status FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)
  UNION ALL SELECT 'stray', NULL, count(*), 'extra' FROM orders WHERE year(o_orderdate) = 1996)""", base=False)
def object_hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed by year against the manifest of what was sent, with three faults on the way: a year lost, a cent changed in one order of another, a folder that nobody sent."""
    sent = read(spark, sf_dir, "orders").withColumn("object", F.year("o_orderdate").cast("string"))
    manifest = landing.declare(sent)
    first = sent.where("object = '1995'").agg(F.min("o_orderkey").alias("_first"))  # one row
    touched = sent.where("object <> '1993'").crossJoin(F.broadcast(first))
    arrived = touched.withColumn("o_totalprice", F.when(F.col("o_orderkey") == F.col("_first"), F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice"))).drop("_first")
    stray = sent.where("object = '1996'").withColumn("object", F.lit("stray"))
    path = landing.land_objects(arrived.unionByName(stray))
    return landing.check_objects(spark.read.parquet(manifest), spark.read.option("basePath", path).schema(sent.schema).parquet(path))


@query(f"SELECT category, market, week, round(ma13, 4) AS forecast FROM evals WHERE year(week) = 2001")
def select_active_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of two years published as versions; then the earlier is activated again and the later once more, and one written and never activated stays unseen."""
    table = ServingTable(spark, scratch(spark, "versions"))
    rows = _evals(spark, sf_dir).select(*KEYS, "week", F.round("ma13", 4).alias("forecast"))
    older, newer = (table.publish(rows.where(F.year("week") == y)) for y in (2000, 2001))
    table.activate(older)
    table.activate(newer)
    table.write(rows.limit(1))
    return table.read()


@query(f"SELECT market, count(*) AS rows, round({tot('p50')}, 4) AS p50, round({tot('p90')}, 4) AS p90 FROM ({_CAL}) GROUP BY market")
def sink_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast published by market partitions, twice: the second version takes the place of the first when it is whole, and readers see one copy."""
    rows = _calibrated(spark, sf_dir).select("market", "category", "week", "p50", "p90")
    table = ServingTable(spark, scratch(spark, "published"))
    for _ in range(2):
        table.publish(rows, ["market"])
    return table.read().groupBy("market").agg(F.count("*").alias("rows"), F.round(total(F.col("p50")), 4).alias("p50"), F.round(total(F.col("p90")), 4).alias("p90"))


QUERIES, ORACLES = query.queries, query.oracles
