"""Queries of inventory, replenishment and report tables over stock cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import canonical as canon
from ..operators import horizons, supply
from ..operators import inventory as inv
from ..sources.tables import category_weeks, locations, products, sale_lines, scratch
from .registration import Registry
from .supply import _MOVES, _moves

TODAY = "2000-12-31"

INV_SQL = supply.SUPPLY_SQL + canon.CANON_SQL + f"""
, trail AS (SELECT sku, location, sum(units) / 91.0 AS daily FROM sales WHERE business_date <= DATE '{TODAY}' AND business_date > DATE '{TODAY}' - INTERVAL 91 DAY GROUP BY ALL),
goods AS (SELECT sku, category, dept, price_minor, price_minor * 6 // 10 AS cost, pack_qty FROM products),
cellx AS (SELECT c.*, l.market, g.category, g.cost, g.pack_qty, t.daily FROM cells c JOIN locations l USING (location) JOIN goods g USING (sku) LEFT JOIN trail t USING (sku, location)),
health AS (SELECT *, CASE WHEN coalesce(daily, 0) = 0 THEN 'dead' WHEN atp = 0 THEN 'stockout' WHEN position / daily < 7 THEN 'understock' WHEN position / daily > 45 THEN 'overstock' ELSE 'healthy' END AS health,
  round(position / nullif(daily, 0), 6) AS cover_days,
  CASE WHEN coalesce(daily, 0) = 0 AND NOT active THEN 'DEAD_STOCK_DEASSORTED' WHEN coalesce(daily, 0) = 0 THEN 'DEAD_STOCK_NO_DEMAND' END AS reason FROM cellx),
lots AS (SELECT t.sku, t.location, l.market, t.category, g.cost, t.units, date_diff('day', received_on, DATE '{TODAY}') AS age_days, date_diff('day', DATE '{TODAY}', expires_on) AS days_left
  FROM lot t JOIN locations l USING (location) JOIN goods g ON g.sku = t.sku WHERE received_on <= DATE '{TODAY}' AND received_on > DATE '{TODAY}' - 365),
fweeks AS (SELECT category, market, CAST(date_trunc('week', business_date) AS DATE) AS week, CAST(sum(units) AS BIGINT) AS units FROM msales JOIN products USING (sku)
  WHERE date_trunc('week', business_date) + INTERVAL 6 DAY <= DATE '{TODAY}' GROUP BY ALL),
fgrid AS (SELECT category, market, CAST(unnest(generate_series(a, (SELECT max(week) FROM fweeks), INTERVAL 7 DAY)) AS DATE) AS week FROM (SELECT category, market, min(week) AS a FROM fweeks GROUP BY ALL)),
fdense AS (SELECT g.category, g.market, g.week, coalesce(units, 0) AS units FROM fgrid g LEFT JOIN fweeks c ON c.category = g.category AND c.market = g.market AND c.week = g.week),
forigin AS (SELECT category, market, week, avg(units) OVER (PARTITION BY category, market ORDER BY week ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS mean_13, row_number() OVER (PARTITION BY category, market ORDER BY week) AS age FROM fdense),
frows AS (SELECT o.category, o.market, o.week, h, greatest(o.mean_13, 1.0) AS scale, CAST(t.units AS DOUBLE) AS actual, CASE WHEN o.age >= 52 THEN (CAST(y.units AS DOUBLE) + o.mean_13) / 2 ELSE o.mean_13 END AS middle
  FROM forigin o CROSS JOIN (SELECT unnest(generate_series(1, 26)) AS h) LEFT JOIN fdense t ON t.category = o.category AND t.market = o.market AND t.week = CAST(o.week + to_days(CAST(7 * h AS INTEGER)) AS DATE)
  LEFT JOIN fdense y ON y.category = o.category AND y.market = o.market AND y.week = CAST(o.week + to_days(CAST(7 * h - 364 AS INTEGER)) AS DATE) WHERE o.age >= 13 AND o.week > (SELECT max(week) FROM fdense) - INTERVAL 364 DAY),
fmissed AS (SELECT market, h, quantile_cont((actual - middle) / scale, 0.9) AS q FROM frows WHERE actual IS NOT NULL GROUP BY ALL),
fcast AS (SELECT category, market, week AS origin, h, middle AS p50, middle + greatest(coalesce(q, 0), 0) * scale AS p90 FROM frows LEFT JOIN fmissed USING (market, h) WHERE week = (SELECT max(week) FROM fdense)),
sterms AS (SELECT location, CAST(s AS DOUBLE) / n AS days, CASE WHEN n >= 8 THEN (n * q - s * s) / (n * n) / 49.0 END AS variance, moq FROM (
  SELECT location, count(*) AS n, CAST(sum(lead_days) AS BIGINT) AS s, CAST(sum(lead_days * lead_days) AS BIGINT) AS q, min(units) AS moq FROM ship WHERE state = 'received' AND lead_days >= 1 GROUP BY location)),
farrays AS (SELECT category, market, list(p50 ORDER BY h) AS p50, list((p90 - p50) / {inv.service_z(0.90)!r} ORDER BY h) AS dev FROM fcast GROUP BY ALL),
fwhole AS (SELECT category, market, CAST(sum(CAST(round(daily * 91) AS BIGINT)) AS BIGINT) AS units FROM cellx WHERE daily > 0 GROUP BY ALL)
"""

query = Registry(INV_SQL)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sale_lines(spark, sf_dir)
    goods = products(spark, sf_dir).select("sku", "category", F.expr("price_minor * 6 div 10").alias("cost"), "pack_qty")
    cells = canon.positions(canon.stock_cells(lines, daily=inv.trailing_mean(TODAY)))
    return cells.join(locations(spark, sf_dir).select("location", "market"), "location").join(goods, "sku")


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.health(_cells(spark, sf_dir))


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots received within a year, at list cost, with their age and the days until they expire."""
    today = F.lit(TODAY).cast("date")
    goods = products(spark, sf_dir).select("sku", F.expr("price_minor * 6 div 10").alias("cost"))
    rows = supply.lots(spark, sf_dir).where((F.col("received_on") <= today) & (F.col("received_on") > F.date_sub(today, 365)))
    rows = rows.join(locations(spark, sf_dir).select("location", "market"), "location").join(goods, "sku")
    return rows.select("sku", "location", "market", "category", "cost", "units", F.datediff(today, "received_on").cast("long").alias("age_days"), F.datediff("expires_on", today).cast("long").alias("days_left"))


def _site_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protection days, their variance in weeks and the least order of each site, from all it received a day or more after the order."""
    rows = supply.shipments(spark, sf_dir).where("state = 'received' and lead_days >= 1")
    sums = rows.groupBy("location").agg(F.count("*").alias("n"), F.sum("lead_days").alias("s"), F.sum(F.col("lead_days") * F.col("lead_days")).alias("q"), F.min("units").alias("moq"))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    return sums.select("location", (s.cast("double") / n).alias("days"), F.when(n >= 8, (n * q - s * s) / (n * n) / 49.0).alias("variance"), "moq")


@query("SELECT sku, location, market, category, on_hand, committed, reserved, damaged, on_order, in_transit, active, atp, position FROM cellx")
def inv_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("sku", "location", "market", "category", "on_hand", "committed", "reserved", "damaged", "on_order", "in_transit", "active", "atp", "position")


@query("SELECT sku, location, round(daily, 9) AS daily FROM trail")
def inv_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.trailing_daily(sale_lines(spark, sf_dir), TODAY).withColumn("daily", F.round("daily", 9))


@query("SELECT sku, location, health, cover_days, reason FROM health")
def inv_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).select("sku", "location", "health", "cover_days", "reason")


_AGE = "CASE WHEN age_days <= 30 THEN '0-30' WHEN age_days <= 60 THEN '31-60' WHEN age_days <= 90 THEN '61-90' ELSE '90+' END"


@query(f"SELECT market, category, {_AGE} AS bucket, count(*) AS lots, sum(units) AS units, CAST(sum(units * cost) AS BIGINT) AS value_minor, CASE WHEN max(age_days) > 90 THEN 'markdown' WHEN max(age_days) > 60 THEN 'review' ELSE 'hold' END AS action FROM lots GROUP BY ALL")
def inv_ageing(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.when(F.col("age_days") <= 30, "0-30").when(F.col("age_days") <= 60, "31-60").when(F.col("age_days") <= 90, "61-90").otherwise("90+")
    action = F.when(F.max("age_days") > 90, "markdown").when(F.max("age_days") > 60, "review").otherwise("hold")
    return _lots(spark, sf_dir).groupBy("market", "category", age.alias("bucket")).agg(F.count("*").alias("lots"), F.sum("units").alias("units"), F.sum(F.col("units") * F.col("cost")).alias("value_minor"), action.alias("action"))


@query("SELECT location, CAST(coalesce(sum(units) FILTER (WHERE days_left < 0), 0) AS BIGINT) AS expired, CAST(coalesce(sum(units) FILTER (WHERE days_left BETWEEN 0 AND 30), 0) AS BIGINT) AS expiring, CAST(coalesce(sum(units * cost) FILTER (WHERE days_left <= 30), 0) AS BIGINT) AS exposure_minor FROM lots GROUP BY location")
def inv_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    def total(value, holds):
        return F.coalesce(F.sum(F.when(holds, value)), F.lit(0))

    left, units = F.col("days_left"), F.col("units")
    return _lots(spark, sf_dir).groupBy("location").agg(total(units, left < 0).alias("expired"), total(units, left.between(0, 30)).alias("expiring"), total(units * F.col("cost"), left <= 30).alias("exposure_minor"))


@query(f"SELECT market, category, bool_and(c IS NOT NULL) AS complete, CASE WHEN bool_and(c IS NOT NULL) THEN CAST(sum(on_hand * c) AS BIGINT) END AS value_minor, count(*) FILTER (WHERE c IS NULL) AS uncosted FROM cellx LEFT JOIN (SELECT sku, CAST(sum(units * unit_cost) AS BIGINT) // CAST(sum(units) AS BIGINT) AS c FROM lot WHERE NOT returned AND received_on <= DATE '{TODAY}' GROUP BY sku) k USING (sku) WHERE on_hand > 0 GROUP BY market, category")
def inv_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value by category at the mean cost of what was received and stayed, only where every held product has such a cost."""
    kept = supply.lots(spark, sf_dir).where(~F.col("returned") & (F.col("received_on") <= F.lit(TODAY).cast("date")))
    costs = kept.groupBy("sku").agg(F.sum(F.col("units") * F.col("unit_cost")).alias("m"), F.sum("units").alias("u")).select("sku", F.expr("m div u").alias("c"))
    held = _cells(spark, sf_dir).where("on_hand > 0").join(costs, "sku", "left")
    sums = held.groupBy("market", "category").agg(F.bool_and(F.col("c").isNotNull()).alias("complete"), F.sum(F.col("on_hand") * F.col("c")).alias("v"), F.count_if(F.col("c").isNull()).alias("uncosted"))
    return sums.select("market", "category", "complete", F.when(F.col("complete"), F.col("v")).alias("value_minor"), "uncosted")


@query("""SELECT market, sku, value, CASE WHEN value IS NULL THEN NULL WHEN before < 0.8 THEN 'A' WHEN before < 0.95 THEN 'B' ELSE 'C' END AS abc FROM (
  SELECT market, sku, value, coalesce(CAST(sum(value) OVER (PARTITION BY market ORDER BY value DESC NULLS LAST, sku ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / sum(value) OVER (PARTITION BY market), 0) AS before
  FROM (SELECT market, sku, CASE WHEN v >= 100000 THEN v END AS value FROM (SELECT market, sku, sum(net_minor) AS v FROM msales GROUP BY ALL)))""")
def inv_abc(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location").groupBy("market", "sku").agg(F.sum("net_minor").alias("v"))
    values = sums.select("market", "sku", F.when(F.col("v") >= 100000, F.col("v")).alias("value"))
    return inv.abc(values, "market", ["sku"], "value")


_Z = repr(inv.service_z(0.96))
_W = "(CASE WHEN h < 25 THEN least(1.0, greatest(0.0, days / 7.0 - h)) ELSE greatest(0.0, days / 7.0 - h) END)"
_SAFETY = f"""(SELECT *, need / (days / 7.0) * sqrt(coalesce(variance, 0)) AS lead_part FROM (
  SELECT *, share * list_sum(list_transform(range(26), lambda h: {_W} * p50[h + 1])) AS need, sqrt(share) * sqrt(list_sum(list_transform(range(26), lambda h: {_W} * dev[h + 1] * dev[h + 1]))) AS sigma, share * p50[1] AS next_week
  FROM (SELECT cellx.*, CAST(round(daily * 91) AS BIGINT) / fwhole.units AS share, p50, dev, coalesce(days, 14.0) AS days, variance, coalesce(moq, 1) AS least_units
    FROM cellx JOIN fwhole USING (category, market) JOIN farrays USING (category, market) LEFT JOIN sterms USING (location) WHERE daily > 0)))"""
MAX_COVER = 150


def cell_forecasts(spark: SparkSession, sf_dir: str, decided: str = TODAY) -> DataFrame:
    """category, market, origin, h, p50 and p90 from the weeks that had ended by the decision day."""
    lines = sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location")
    weeks = category_weeks(lines, products(spark, sf_dir)).where(F.date_add("week", 6) <= F.lit(decided).cast("date"))
    return horizons.baseline_forecasts(horizons.dense_series(weeks, ["category", "market"]), ["category", "market"], "market")


def _supply(spark: SparkSession, sf_dir: str, forecasts: DataFrame | None = None) -> DataFrame:
    """Cells with demand, their terms, and need and buffer over the protection days by forecasts(category, market, origin, h, p50, p90)."""
    rows = _cells(spark, sf_dir).where("daily > 0").join(_site_terms(spark, sf_dir), "location", "left").withColumns({"days": F.coalesce("days", F.lit(14.0)), "moq": F.coalesce("moq", F.lit(1)).cast("double")})
    told = cell_forecasts(spark, sf_dir) if forecasts is None else forecasts
    return inv.protected(rows, told, ["category", "market"], TODAY, 0.96)


def ordered(spark: SparkSession, sf_dir: str, forecasts: DataFrame | None = None) -> DataFrame:
    """_supply with order_units and reason: up to need, buffer and a week of review, by least quantity, pack and cover cap."""
    rows = _supply(spark, sf_dir, forecasts).withColumns({"raw": F.col("need") + F.col("safety") + F.col("next_week") - F.col("position"), "pack": F.greatest(F.lit(1).cast("long"), F.col("pack_qty")).cast("double")})
    units, reason = inv.order_quantity(F.col("raw"), F.col("moq"), F.col("pack"), F.col("position"), F.col("daily"), MAX_COVER)
    return rows.withColumns({"order_units": units, "reason": reason})


@query(f"SELECT sku, location, round(need, 6) AS need, round({_Z} * sqrt(sigma * sigma + lead_part * lead_part), 6) AS safety, round(need + {_Z} * sqrt(sigma * sigma + lead_part * lead_part), 6) AS reorder_point FROM {_SAFETY}")
def inv_safety_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Need over the protection days, the buffer, and their sum as reorder point."""
    return _supply(spark, sf_dir).select("sku", "location", F.round("need", 6).alias("need"), F.round("safety", 6).alias("safety"), F.round(F.col("need") + F.col("safety"), 6).alias("reorder_point"))


_ORDERS = f"""(SELECT *, ceil(greatest(raw, moq) / pack) * pack AS wanted, ceil(moq / pack) * pack AS least_order, daily * {MAX_COVER} - position AS cap, floor((daily * {MAX_COVER} - position) / pack) * pack AS shrunk
  FROM (SELECT *, need + {_Z} * sqrt(sigma * sigma + lead_part * lead_part) + next_week - position AS raw, CAST(least_units AS DOUBLE) AS moq, CAST(greatest(1, pack_qty) AS DOUBLE) AS pack FROM {_SAFETY}))"""
_NONE = "(raw <= 0 OR cap <= 0)"
_CONFLICT = "(wanted > cap AND (wanted = least_order OR shrunk < moq OR shrunk <= 0))"


@query(f"SELECT sku, location, CAST(CASE WHEN {_NONE} OR {_CONFLICT} THEN 0 WHEN wanted > cap THEN shrunk ELSE wanted END AS BIGINT) AS order_units, CASE WHEN NOT {_NONE} AND {_CONFLICT} THEN 'CAP_CONFLICT' END AS reason FROM {_ORDERS}")
def inv_replenish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order quantities up to the level, by least quantity, pack and cover cap."""
    return ordered(spark, sf_dir).select("sku", "location", "order_units", "reason")


@query("SELECT market, category, count(*) AS cells, CAST(sum(CAST(ceil(greatest(0, daily * 28 * 1.3 - atp)) AS BIGINT)) AS BIGINT) AS risk_units, CAST(sum(CAST(ceil(greatest(0, daily * 28 * 1.3 - atp)) AS BIGINT) * cost) AS BIGINT) AS risk_minor FROM cellx WHERE daily > 0 GROUP BY ALL")
def inv_demand_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.ceil(F.greatest(F.lit(0.0), F.col("daily") * 28 * 1.3 - F.col("atp"))).cast("long")
    return _cells(spark, sf_dir).where("daily > 0").groupBy("market", "category").agg(F.count("*").alias("cells"), F.sum(short).alias("risk_units"), F.sum(short * F.col("cost")).alias("risk_minor"))


@query("""SELECT location, sku, channel, wanted, CAST(least(wanted, greatest(0, pool - coalesce(sum(wanted) OVER (PARTITION BY location, sku ORDER BY channel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS allocated
  FROM (SELECT location, sku, channel, CAST(sum(units) AS BIGINT) AS wanted, max(atp) AS pool FROM sales JOIN cells USING (sku, location) GROUP BY ALL)""")
def inv_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's free stock to its channels in order of priority."""
    lines = sale_lines(spark, sf_dir)
    pool = canon.positions(canon.stock_cells(lines)).select("sku", "location", F.col("atp").alias("pool"))
    demand = lines.groupBy("location", "sku", "channel").agg(F.sum("units").alias("wanted")).join(pool, ["sku", "location"])
    return inv.allocate(demand, ["location", "sku"], "wanted", "pool", ["channel"]).select("location", "sku", "channel", "wanted", "allocated")


LANE_ROUNDS = 3
_LANES = f"""lanes AS (SELECT 0 AS round, nation AS origin, nation AS destination FROM (SELECT DISTINCT nation FROM locations)
  UNION ALL SELECT r, origin, destination FROM (SELECT origin, destination, row_number() OVER (PARTITION BY destination ORDER BY units DESC, origin) AS r
    FROM (SELECT origin, destination, sum(units) AS units FROM {_MOVES} WHERE origin <> destination GROUP BY ALL)) WHERE r < {LANE_ROUNDS})"""


def _round_sql(k: int) -> str:
    """The CTEs of a round: what is left, the ends of all stretches, and the moves."""
    past = " UNION ALL ".join(f"SELECT * FROM moves{j}" for j in range(k)) or "SELECT 0 AS round, 0 AS sku, 0 AS source, 0 AS target, 0 AS moved WHERE false"
    return f"""past{k} AS ({past}),
free{k} AS (SELECT s.sku, s.nation AS origin, s.location AS source, s.free - coalesce(g, 0) AS free FROM spare s LEFT JOIN (SELECT sku, source, sum(moved) AS g FROM past{k} GROUP BY ALL) p ON p.sku = s.sku AND p.source = s.location),
need{k} AS (SELECT t.sku, l.origin, t.location AS target, t.need - coalesce(g, 0) AS need FROM short t JOIN lanes l ON l.destination = t.nation AND l.round = {k} LEFT JOIN (SELECT sku, target, sum(moved) AS g FROM past{k} GROUP BY ALL) p ON p.sku = t.sku AND p.target = t.location),
cuts{k} AS (SELECT sku, origin, cut, max(source) AS source, max(target) AS target FROM (
    SELECT sku, origin, source, NULL AS target, sum(free) OVER (PARTITION BY sku, origin ORDER BY free DESC, source ROWS UNBOUNDED PRECEDING) AS cut FROM free{k} WHERE free > 0
    UNION ALL SELECT sku, origin, NULL, target, sum(need) OVER (PARTITION BY sku, origin ORDER BY need DESC, target ROWS UNBOUNDED PRECEDING) FROM need{k} WHERE need > 0) GROUP BY ALL),
pieces{k} AS (SELECT sku, origin, cut - lag(cut, 1, 0) OVER (PARTITION BY sku, origin ORDER BY cut) AS moved, first_value(source IGNORE NULLS) OVER (PARTITION BY sku, origin ORDER BY cut ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS source,
    first_value(target IGNORE NULLS) OVER (PARTITION BY sku, origin ORDER BY cut ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS target FROM cuts{k}),
moves{k} AS (SELECT {k} AS round, sku, source, target, CAST(moved AS BIGINT) AS moved FROM pieces{k} WHERE source IS NOT NULL AND target IS NOT NULL)"""


_TRANSFERS = f""", spare AS (SELECT sku, nation, location, atp - CAST(ceil(coalesce(daily, 0) * 28) AS BIGINT) AS free FROM cellx JOIN (SELECT location, nation FROM locations) USING (location) WHERE atp > ceil(coalesce(daily, 0) * 28)),
short AS (SELECT sku, nation, location, CAST(ceil(daily * 28) AS BIGINT) - atp AS need FROM cellx JOIN (SELECT location, nation FROM locations) USING (location) WHERE daily > 0 AND ceil(daily * 28) > atp),
{_LANES}, {", ".join(_round_sql(k) for k in range(LANE_ROUNDS))}"""
_MOVED = "(" + " UNION ALL ".join(f"SELECT * FROM moves{k}" for k in range(LANE_ROUNDS)) + ")"
lane_query = Registry(INV_SQL + _TRANSFERS)


@lane_query(f"SELECT round, sku, source, target, moved FROM {_MOVED}")
def transfer_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of free stock to cells that lack it: within the nation first, then over the lanes that carried most to it.

    Free is what exceeds four weeks of demand, need what four weeks lack.
    """
    path = scratch(spark, "cells")  # both sides of each round read them
    sites = locations(spark, sf_dir).select("location", "nation")
    _cells(spark, sf_dir).join(sites, "location").select("nation", "sku", "location", "atp", "daily").write.parquet(path)
    weeks = F.ceil(F.coalesce("daily", F.lit(0.0)) * 28)
    cells = spark.read.parquet(path).withColumns({"area": F.col("nation"), "left": F.col("atp") - weeks})
    spare = cells.where("left > 0").select("sku", "area", F.col("location").alias("source"), F.col("left").alias("free"))
    short = cells.where("daily > 0 and left < 0").select("sku", "area", F.col("location").alias("target"), (-F.col("left")).alias("need"))
    carried = _moves(spark, sf_dir).where("origin <> destination").groupBy("origin", "destination").agg(F.sum("units").alias("units"))
    rank = F.row_number().over(Window.partitionBy("destination").orderBy(F.desc("units"), "origin"))
    lanes = carried.withColumn("round", rank).where(F.col("round") < LANE_ROUNDS).select("round", "origin", "destination")
    own = sites.select(F.lit(0).alias("round"), F.col("nation").alias("origin"), F.col("nation").alias("destination")).distinct()
    known = scratch(spark, "lanes")  # each round reads them
    own.unionByName(lanes).write.parquet(known)
    return inv.transfers(spare, short, spark.read.parquet(known), LANE_ROUNDS)


@query("SELECT location, n, round(on_time, 6) AS on_time, CASE WHEN on_time < 0.55 OR n < 20 THEN 'high' WHEN on_time < 0.65 THEN 'medium' ELSE 'low' END AS risk, list_filter([CASE WHEN on_time < 0.55 THEN 'LATE' END, CASE WHEN n < 20 THEN 'FEW_OBSERVATIONS' END], lambda x: x IS NOT NULL) AS reasons FROM (SELECT location, count(*) AS n, avg(CASE WHEN date_diff('day', business_date, CAST(known_as_of AS DATE)) <= 60 THEN 1.0 ELSE 0.0 END) AS on_time FROM sales GROUP BY location)")
def inv_supplier_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_time = F.avg(F.when(F.datediff(F.col("known_as_of").cast("date"), "business_date") <= 60, 1.0).otherwise(0.0))
    rows = sale_lines(spark, sf_dir).groupBy("location").agg(F.count("*").alias("n"), on_time.alias("t"))
    late, few = F.col("t") < 0.55, F.col("n") < 20
    reasons = F.array_compact(F.array(F.when(late, "LATE"), F.when(few, "FEW_OBSERVATIONS")))
    return rows.select("location", "n", F.round("t", 6).alias("on_time"), F.when(late | few, "high").when(F.col("t") < 0.65, "medium").otherwise("low").alias("risk"), reasons.alias("reasons"))


@query("SELECT sku, CASE WHEN CAST('0x' || substr(sha256('replay-1|' || sku), 1, 15) AS BIGINT) % 100 < 5 THEN 'candidate' ELSE 'incumbent' END AS cohort FROM products")
def cohort_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("sku", inv.cohort(F.col("sku"), "replay-1").alias("cohort"))


@query(None)
def replay_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """104 weeks of a cover policy on each product of a market, summed to the market and cohort."""
    lines = sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location")
    week = F.floor(F.datediff("business_date", F.lit("1997-01-06").cast("date")) / 7).cast("int")
    sums = lines.withColumn("w", week).where("w >= 0 and w < 104").groupBy("market", "sku", "w").agg(F.sum("units").alias("u"))
    cells = sums.groupBy("market", "sku").agg(F.collect_list(F.struct("w", "u")).alias("entries"), F.sum("u").alias("total"))  # 104 at most
    cells = cells.withColumn("target", F.ceil(F.col("total") / 104.0 * 6).cast("long") + 10)
    done = inv.replay_cells(cells, 104, ["market", "sku"])
    return done.groupBy("market", inv.cohort(F.col("sku"), "replay-1").alias("cohort")).agg(
        F.count("*").alias("cells"), F.sum("served").alias("served"), F.sum("lost").alias("lost"), F.sum("out_weeks").alias("stockout_weeks"),
        F.round(F.sum("served") / F.sum(F.col("served") + F.col("lost")), 6).alias("fill_rate"),
    )


# --- reports --------------------------------------------------------------------------------


@query("SELECT market, health, count(*) AS cells, count(DISTINCT location) AS stores, round(avg(cover_days), 6) AS mean_cover, CAST(sum(on_hand * cost) AS BIGINT) AS value_minor FROM health GROUP BY ALL")
def rpt_kpi_inventory_stock_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).groupBy("market", "health").agg(F.count("*").alias("cells"), F.countDistinct("location").alias("stores"), F.round(F.avg("cover_days"), 6).alias("mean_cover"), F.sum(F.col("on_hand") * F.col("cost")).alias("value_minor"))


@query("SELECT sum(on_hand) AS on_hand, sum(committed) AS committed, sum(on_order) AS on_order, sum(in_transit) AS in_transit, count(*) FILTER (WHERE atp > 0) AS in_stock, count(*) FILTER (WHERE on_hand < committed + reserved + damaged) AS negative, count(*) FILTER (WHERE on_hand = 0) AS zero, count(*) AS cells FROM cells")
def rpt_kpi_inventory_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.positions(canon.stock_cells(sale_lines(spark, sf_dir))).agg(
        *(F.sum(c).alias(c) for c in ("on_hand", "committed", "on_order", "in_transit")), F.count_if(F.col("atp") > 0).alias("in_stock"),
        F.count_if(F.col("on_hand") < F.col("committed") + F.col("reserved") + F.col("damaged")).alias("negative"), F.count_if(F.col("on_hand") == 0).alias("zero"), F.count("*").alias("cells"),
    )


@query("SELECT count(*) FILTER (WHERE age_days > 60) AS over_60, count(*) FILTER (WHERE age_days > 90) AS over_90, CAST(coalesce(sum(units) FILTER (WHERE age_days > 90), 0) AS BIGINT) AS markdown_units, CAST(sum(units * cost) AS BIGINT) AS value_minor FROM lots")
def rpt_kpi_inventory_ageing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.col("age_days") > 90
    return _lots(spark, sf_dir).agg(F.count_if(F.col("age_days") > 60).alias("over_60"), F.count_if(old).alias("over_90"), F.coalesce(F.sum(F.when(old, F.col("units"))), F.lit(0)).alias("markdown_units"), F.sum(F.col("units") * F.col("cost")).alias("value_minor"))


@query("SELECT location, market, count(*) AS cells, count(*) FILTER (WHERE health = 'stockout') AS stockouts, count(*) FILTER (WHERE health = 'overstock') AS overstocks, round(count(*) FILTER (WHERE atp > 0) / count(*), 6) AS availability, CASE WHEN count(*) FILTER (WHERE health = 'dead') * 2 > count(*) THEN 'clear' WHEN count(*) FILTER (WHERE health = 'stockout') * 20 > count(*) THEN 'replenish' ELSE 'watch' END AS action FROM health GROUP BY ALL")
def rpt_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    def n(kind):
        return F.count_if(F.col("health") == kind)

    cells = F.count("*")
    action = F.when(n("dead") * 2 > cells, "clear").when(n("stockout") * 20 > cells, "replenish").otherwise("watch")
    return _health(spark, sf_dir).groupBy("location", "market").agg(cells.alias("cells"), n("stockout").alias("stockouts"), n("overstock").alias("overstocks"), F.round(F.count_if(F.col("atp") > 0) / cells, 6).alias("availability"), action.alias("action"))


@query("SELECT sku, location, health, exposure, n_total FROM (SELECT sku, location, health, on_hand * cost AS exposure, count(*) OVER () AS n_total FROM health WHERE market = 'ASIA' AND health IN ('overstock', 'dead')) ORDER BY exposure DESC, sku, location LIMIT 50 OFFSET 100")
def rpt_inventory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the cells with most exposure in a market, with the number of all."""
    rows = _health(spark, sf_dir).where("market = 'ASIA' and health in ('overstock', 'dead')").select("sku", "location", "health", (F.col("on_hand") * F.col("cost")).alias("exposure"))
    page = rows.orderBy(F.desc("exposure"), "sku", "location").offset(100).limit(50)
    return page.crossJoin(rows.agg(F.count("*").alias("n_total")))


@query("SELECT market, category, CAST(sum(on_hand * cost) AS BIGINT) AS value_minor, CAST(sum(on_hand * cost) FILTER (WHERE health = 'dead') AS BIGINT) AS dead_minor, round(CAST(sum(on_hand * cost) FILTER (WHERE health = 'dead') AS DOUBLE) / sum(on_hand * cost), 6) AS dead_share FROM health GROUP BY ALL")
def rpt_value_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("on_hand") * F.col("cost")
    dead = F.sum(F.when(F.col("health") == "dead", value))
    return _health(spark, sf_dir).groupBy("market", "category").agg(F.sum(value).alias("value_minor"), dead.alias("dead_minor"), F.round(dead / F.sum(value), 6).alias("dead_share"))


QUERIES, ORACLES = query.queries | lane_query.queries, query.oracles | lane_query.oracles
