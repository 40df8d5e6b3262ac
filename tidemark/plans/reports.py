"""Queries of replenishment artifacts, policy replay and report tables over cells, lots, shipments and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import inventory as inv
from ..operators.prefix import running_before
from ..operators import supply, topology
from ..sources.tables import line_tasks, locations, products, read, sale_lines
from .inventory import _NONE, _CONFLICT, _ORDERS, _Z, INV_SQL, TODAY, _cells, _health, _lots, _SAFETY, _site_terms, _supply, cell_forecasts, ordered
from .registration import Registry
from .supply import _CAPACITY, _MOVES, _WASTE, _capacity, _moves, _sites, _waste

query = Registry(INV_SQL)


def dsum(value: Column) -> Column:
    return F.sum(value.cast("decimal(18,6)")).cast("double")


def d(sql: str) -> str:
    return f"CAST(sum(CAST({sql} AS DECIMAL(18,6))) AS DOUBLE)"


def today() -> Column:
    return F.lit(TODAY).cast("date")


def n_if(condition: str) -> Column:
    return F.count_if(F.expr(condition))


# --- replenishment artifacts ------------------------------------------------------------------------


@query(f"SELECT sku, location, order_id, line_no, units, received_on, expires_on FROM lot WHERE received_on <= DATE '{TODAY}' AND expires_on >= DATE '{TODAY}' AND NOT returned")
def inv_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots that lie on the shelf at the decision day."""
    held = (F.col("received_on") <= today()) & (F.col("expires_on") >= today()) & ~F.col("returned")
    return supply.lots(spark, sf_dir).where(held).select("sku", "location", "order_id", "line_no", "units", "received_on", "expires_on")


@query(f"SELECT location, sku, CAST(coalesce(sum(units) FILTER (WHERE reason = 'returned'), 0) AS BIGINT) AS returned_units, CAST(coalesce(sum(units) FILTER (WHERE reason = 'expired'), 0) AS BIGINT) AS expired_units, CAST(sum(units * unit_cost) AS BIGINT) AS cost_minor FROM {_WASTE} WHERE wasted_on > DATE '{TODAY}' - 365 GROUP BY ALL")
def inv_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waste of the last year by cell and reason."""
    units = lambda r: F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("units"))), F.lit(0))
    rows = _waste(spark, sf_dir).where(F.col("wasted_on") > F.date_sub(today(), 365))
    return rows.groupBy("location", "sku").agg(units("returned").alias("returned_units"), units("expired").alias("expired_units"), F.sum(F.col("units") * F.col("unit_cost")).alias("cost_minor"))


_COST = "(SELECT sku, location, CAST(sum(received_units * unit_cost) AS BIGINT) // CAST(sum(received_units) AS BIGINT) AS cost FROM ship WHERE state = 'received' GROUP BY ALL)"


@query(f"SELECT c.sku, c.location, coalesce(r.cost, g.cost) AS unit_cost, CASE WHEN r.cost IS NULL THEN 'list' ELSE 'receipts' END AS origin FROM cells c JOIN goods g USING (sku) LEFT JOIN {_COST} r ON r.sku = c.sku AND r.location = c.location")
def inv_unit_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell's own receipts set its cost; without any, the list does."""
    own = supply.shipments(spark, sf_dir).where("state = 'received'").groupBy("sku", "location").agg(F.sum(F.col("received_units") * F.col("unit_cost")).alias("v"), F.sum("received_units").alias("u"))
    cells = _cells(spark, sf_dir).select("sku", "location", "cost").join(own.select("sku", "location", F.expr("v div u").alias("own")), ["sku", "location"], "left")
    return cells.select("sku", "location", F.coalesce("own", "cost").alias("unit_cost"), F.when(F.col("own").isNull(), "list").otherwise("receipts").alias("origin"))


@query("SELECT location, sku, channel, CAST(sum(units) AS BIGINT) AS requested, count(*) AS lines FROM ship GROUP BY ALL HAVING sum(units) >= 20")
def inv_channel_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each channel of a cell asked for, where that is twenty units or more."""
    return supply.shipments(spark, sf_dir).groupBy("location", "sku", "channel").agg(F.sum("units").alias("requested"), F.count("*").alias("lines")).where("requested >= 20")


_PERF = f"(SELECT location, count(*) AS lines, count(DISTINCT CAST(date_trunc('quarter', business_date) AS DATE)) AS periods, count(*) FILTER (WHERE state = 'late') AS late, CAST(coalesce(sum(outstanding_units), 0) AS BIGINT) AS outstanding, arg_max(category, (units_c, category)) AS main_scope FROM (SELECT s.*, p.category, sum(s.units) OVER (PARTITION BY s.location, p.category) AS units_c FROM ship s JOIN products p USING (sku)) GROUP BY location)"


def _vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supply.shipments(spark, sf_dir).join(products(spark, sf_dir).select("sku", "category"), "sku")
    by_scope = rows.groupBy("location", "category").agg(
        F.count("*").alias("lines"), F.collect_set(F.trunc("business_date", "quarter")).alias("quarters"), n_if("state = 'late'").alias("late"), F.sum("outstanding_units").alias("outstanding"), F.sum("units").alias("units_c")
    )  # quarters of history at most
    return by_scope.groupBy("location").agg(
        F.sum("lines").alias("lines"), F.size(F.array_distinct(F.flatten(F.collect_list("quarters")))).cast("long").alias("periods"), F.sum("late").alias("late"),
        F.sum("outstanding").alias("outstanding"), F.max_by("category", F.struct("units_c", "category")).alias("main_scope"),
    )


@query(f"SELECT location, location_name, lines, periods, round(1 - late / lines, 6) AS kept_rate, outstanding, main_scope FROM {_PERF} JOIN locations USING (location)")
def inv_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vendor's record: quarters observed, share of lines not late, and the category it supplies most."""
    rows = _vendors(spark, sf_dir).join(locations(spark, sf_dir).select("location", "location_name"), "location")
    return rows.select("location", "location_name", "lines", "periods", F.round(1 - F.col("late") / F.col("lines"), 6).alias("kept_rate"), "outstanding", "main_scope")


@query(f"SELECT location, max(year) AS year, arg_max(ceiling, year) AS ceiling, CASE WHEN count(*) >= 3 THEN 'observed' ELSE 'sparse' END AS evidence FROM {_CAPACITY} GROUP BY location")
def inv_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capacity(spark, sf_dir).groupBy("location").agg(F.max("year").alias("year"), F.max_by("ceiling", "year").alias("ceiling"), F.when(F.count("*") >= 3, "observed").otherwise("sparse").alias("evidence"))


_EDGES = "edges AS (SELECT DISTINCT CAST(location AS VARCHAR) AS child, nation AS parent FROM locations UNION ALL SELECT DISTINCT nation, market FROM locations UNION ALL SELECT DISTINCT market, 'WORLD' FROM locations)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites, the nation's warehouse, the market's hub and the whole, as edges from child to parent."""
    sites = locations(spark, sf_dir)
    pairs = F.explode(F.array(*(F.struct(c.alias("child"), p.alias("parent")) for c, p in ((F.col("location").cast("string"), F.col("nation")), (F.col("nation"), F.col("market")), (F.col("market"), F.lit("WORLD"))))))
    return sites.select(pairs.alias("x")).select("x.child", "x.parent").distinct()


_SITE_WEEKS = f"(SELECT CAST(location AS VARCHAR) AS node, h + 1 AS h, sum(CAST(share * p50[h + 1] AS DECIMAL(28,6))) AS p50 FROM {_SAFETY}, (SELECT unnest(range(26)) AS h) GROUP BY ALL)"


@query(f", {_EDGES}, own AS {_SITE_WEEKS} SELECT node, CAST(h AS INTEGER) AS h, CAST(sum((p50)) AS DOUBLE) AS p50 FROM (SELECT * FROM own UNION ALL SELECT e.parent, h, p50 FROM own JOIN edges e ON e.child = node"
       " UNION ALL SELECT f.parent, h, p50 FROM own JOIN edges e ON e.child = node JOIN edges f ON f.child = e.parent UNION ALL SELECT g.parent, h, p50 FROM own JOIN edges e ON e.child = node JOIN edges f ON f.child = e.parent JOIN edges g ON g.child = f.parent) GROUP BY node, h")  # fmt: skip
def inv_node_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P50 of each coming week at every site, and at the warehouses, hubs and whole that supply it, by a roll-up over the edges of the network."""
    cells = _cells(spark, sf_dir).where("daily > 0").withColumns({"days": F.lit(7.0), "variance": F.lit(None).cast("double")})
    told = inv.forecast_arrays(cell_forecasts(spark, sf_dir), ["category", "market"], TODAY)
    weeks = inv.protected(cells, cell_forecasts(spark, sf_dir), ["category", "market"], TODAY, 0.96).select("location", "category", "market", "share").join(told, ["category", "market"])
    rows = weeks.select(F.col("location").cast("string").alias("node"), "share", F.posexplode("p50").alias("at", "v")).select("node", (F.col("at") + 1).alias("h"), (F.col("share") * F.col("v")).cast("decimal(28,6)").alias("p50"))
    total = topology.roll_up(rows, _edges(spark, sf_dir), ["p50"], ["h"])
    return total.select("node", "h", F.col("p50").cast("double").alias("p50"))


_LANES = f"(SELECT origin, destination, sum(units) AS carried FROM {_MOVES} WHERE business_date < DATE '2000-01-01' GROUP BY ALL HAVING count(*) >= 3)"


@query(f"SELECT m.origin, count(*) AS moves, count(*) FILTER (WHERE l.origin IS NOT NULL) AS on_lane, round(count(*) FILTER (WHERE l.origin IS NOT NULL) / count(*), 6) AS coverage FROM {_MOVES} m LEFT JOIN {_LANES} l ON l.origin = m.origin AND l.destination = m.destination WHERE m.business_date >= DATE '2000-01-01' GROUP BY m.origin")
def inv_lane_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the year's moves that ran on a lane declared before it."""
    rows = _moves(spark, sf_dir)
    lanes = rows.where("business_date < date'2000-01-01'").groupBy("origin", "destination").agg(F.count("*").alias("n")).where("n >= 3").select("origin", "destination", F.lit(True).alias("known"))
    seen = rows.where("business_date >= date'2000-01-01'").join(lanes, ["origin", "destination"], "left")
    on = F.count_if(F.col("known"))
    return seen.groupBy("origin").agg(F.count("*").alias("moves"), on.alias("on_lane"), F.round(on / F.count("*"), 6).alias("coverage"))


@query("SELECT DISTINCT market, sku FROM cellx WHERE active")
def inv_dc_assortment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market's warehouse carries what any of its sites does."""
    return _cells(spark, sf_dir).where("active").select("market", "sku").distinct()


@query("SELECT sku, location, atp, position, CASE WHEN active THEN 'active' ELSE 'residual' END AS kind FROM cellx WHERE active OR on_hand > 0 OR on_order > 0")
def inv_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are published: the active ones, and others while anything is left of them."""
    return _cells(spark, sf_dir).where("active or on_hand > 0 or on_order > 0").select("sku", "location", "atp", "position", F.when(F.col("active"), "active").otherwise("residual").alias("kind"))


@query(f", {_EDGES}, own AS (SELECT CAST(location AS VARCHAR) AS node, sku, sum(CAST(daily AS DECIMAL(28,6))) AS daily, CAST(sum(position) AS BIGINT) AS position FROM cellx GROUP BY ALL),"
       " up1 AS (SELECT e.parent AS node, sku, sum((daily)) AS daily, CAST(sum(position) AS BIGINT) AS position FROM own JOIN edges e ON e.child = node GROUP BY ALL), up2 AS (SELECT e.parent AS node, sku, sum((daily)) AS daily, CAST(sum(position) AS BIGINT) AS position FROM up1 JOIN edges e ON e.child = node GROUP BY ALL),"
       " up3 AS (SELECT e.parent AS node, sku, sum((daily)) AS daily, CAST(sum(position) AS BIGINT) AS position FROM up2 JOIN edges e ON e.child = node GROUP BY ALL)"
       " SELECT node, sku, CAST(round(CAST(daily AS DOUBLE), 6) AS DOUBLE) AS daily, position FROM (SELECT * FROM up1 UNION ALL SELECT * FROM up2 UNION ALL SELECT * FROM up3)")  # fmt: skip
def inv_node_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing demand and stock of each product at the warehouses, hubs and whole: those of the sites behind them."""
    rows = _cells(spark, sf_dir).select(F.col("location").cast("string").alias("node"), "sku", F.col("daily").cast("decimal(28,6)").alias("daily"), "position")
    edges = _edges(spark, sf_dir)
    total = topology.roll_up(rows, edges, ["daily", "position"], ["sku"], tasks=line_tasks(spark, sf_dir))
    upper = edges.select(F.col("parent").alias("node")).distinct()
    # nations, markets and the whole: few, and a shuffle by them would put a nation's products in one task
    return total.join(F.broadcast(upper), "node", "left_semi").select("node", "sku", F.round(F.col("daily").cast("double"), 6).alias("daily"), "position")


@query("SELECT sku, location, round(position / nullif(daily, 0), 6) AS days_supply, round(atp / nullif(daily, 0), 6) AS days_on_hand FROM cellx")
def inv_days_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that position and free stock last; null without demand."""
    daily = F.nullif(F.col("daily"), F.lit(0.0))
    return _cells(spark, sf_dir).select("sku", "location", F.round(F.col("position") / daily, 6).alias("days_supply"), F.round(F.col("atp") / daily, 6).alias("days_on_hand"))


_LANE_RANK = f"(SELECT origin, destination, nullif(channel, '5-LOW') AS channel, row_number() OVER (PARTITION BY destination, nullif(channel, '5-LOW') ORDER BY units DESC, origin) AS r FROM (SELECT origin, destination, channel, sum(units) AS units FROM {_MOVES} GROUP BY ALL))"


@query(f"SELECT w.destination, w.channel, coalesce(e.origin, x.origin) AS origin, e.origin IS NOT NULL AS exact FROM (SELECT DISTINCT destination, channel FROM {_MOVES}) w LEFT JOIN (SELECT * FROM {_LANE_RANK} WHERE r = 1 AND channel IS NOT NULL) e ON e.destination = w.destination AND e.channel = w.channel LEFT JOIN (SELECT * FROM {_LANE_RANK} WHERE r = 1 AND channel IS NULL) x ON x.destination = w.destination")
def inv_resolve_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lane of each destination and channel: its own before the default."""
    sums = _moves(spark, sf_dir).groupBy("origin", "destination", "channel").agg(F.sum("units").alias("units"))
    lanes = sums.withColumn("on", F.nullif(F.col("channel"), F.lit("5-LOW")))
    best = lanes.groupBy("destination", "on").agg(F.min_by("origin", F.struct(-F.col("units"), "origin")).alias("origin"))
    exact = best.where("on is not null").select("destination", F.col("on").alias("channel"), F.col("origin").alias("own"))
    default = best.where("on is null").select("destination", F.col("origin").alias("any"))
    asked = sums.select("destination", "channel").distinct().join(exact, ["destination", "channel"], "left").join(default, "destination", "left")
    return asked.select("destination", "channel", F.coalesce("own", "any").alias("origin"), F.col("own").isNotNull().alias("exact"))


@query("""SELECT c.sku, c.location, coalesce(a.d, b.d, k.d) AS lead_days, CASE WHEN a.d IS NOT NULL THEN 'sku' WHEN b.d IS NOT NULL THEN 'dept' WHEN k.d IS NOT NULL THEN 'category' END AS scope FROM cells c JOIN products p USING (sku)
  LEFT JOIN (SELECT location, sku, CAST(max(lead_days) AS BIGINT) AS d FROM ship WHERE state = 'received' AND lead_days >= 1 GROUP BY ALL) a ON a.location = c.location AND a.sku = c.sku
  LEFT JOIN (SELECT location, dept, CAST(max(lead_days) AS BIGINT) AS d FROM ship JOIN products USING (sku) WHERE state = 'received' AND lead_days >= 1 GROUP BY ALL) b ON b.location = c.location AND b.dept = p.dept
  LEFT JOIN (SELECT location, category, CAST(max(lead_days) AS BIGINT) AS d FROM ship JOIN products USING (sku) WHERE state = 'received' AND lead_days >= 1 GROUP BY ALL) k ON k.location = c.location AND k.category = p.category""")
def inv_resolve_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell's lead time by the narrowest scope that has one: product, department, category."""
    goods = products(spark, sf_dir).select("sku", "dept", "category")
    rows = supply.shipments(spark, sf_dir).where("state = 'received' and lead_days >= 1").join(goods, "sku")
    out = _cells(spark, sf_dir).select("sku", "location").join(goods, "sku")
    for scope in ("sku", "dept", "category"):
        out = out.join(rows.groupBy("location", scope).agg(F.max("lead_days").alias(f"by_{scope}")), ["location", scope], "left")
    scope = F.when(F.col("by_sku").isNotNull(), "sku").when(F.col("by_dept").isNotNull(), "dept").when(F.col("by_category").isNotNull(), "category")
    return out.select("sku", "location", F.coalesce("by_sku", "by_dept", "by_category").alias("lead_days"), scope.alias("scope"))


@query("SELECT sku, c.location, market, round(coalesce(days, 14.0), 6) AS protection_days, least(26, greatest(1, CAST(ceil(coalesce(days, 14.0) / 7) AS BIGINT))) AS weeks, coalesce(moq, 1) AS moq, greatest(1, pack_qty) AS pack, days IS NULL AS assumed FROM cellx c LEFT JOIN sterms USING (location)")
def inv_cell_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route terms of every cell: protection days, weeks, least order and pack; assumed where the site has none."""
    rows = _cells(spark, sf_dir).join(_site_terms(spark, sf_dir), "location", "left")
    days = F.coalesce("days", F.lit(14.0))
    weeks = F.least(F.lit(26), F.greatest(F.lit(1), F.ceil(days / 7).cast("long")))
    return rows.select("sku", "location", "market", F.round(days, 6).alias("protection_days"), weeks.alias("weeks"), F.coalesce("moq", F.lit(1)).alias("moq"), F.greatest(F.lit(1), F.col("pack_qty")).alias("pack"), F.col("days").isNull().alias("assumed"))


@query(f"SELECT origin, destination, carried FROM {_LANES}")
def inv_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes that were known before the year of decision."""
    rows = _moves(spark, sf_dir).where("business_date < date'2000-01-01'").groupBy("origin", "destination").agg(F.sum("units").alias("carried"), F.count("*").alias("n"))
    return rows.where("n >= 3").drop("n")


@query(f"SELECT sku, location, round(need, 6) AS need, round(sigma, 6) AS spread FROM {_ORDERS}")
def inv_horizon_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly demand over a fractional window of days, summed and in quadrature."""
    return _supply(spark, sf_dir).select("sku", "location", F.round("need", 6).alias("need"), F.round("sigma", 6).alias("spread"))


@query("SELECT location_key, state, count(*) AS lines, CAST(sum(units) AS BIGINT) AS units, min(due_date) AS first_due FROM ship JOIN xwalk USING (location) GROUP BY ALL")
def inv_inbound_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published inbound artifact: lines of each state under canonical keys."""
    rows = supply.shipments(spark, sf_dir).join(_sites(spark, sf_dir), "location")
    return rows.groupBy("location_key", "state").agg(F.count("*").alias("lines"), F.sum("units").alias("units"), F.min("due_date").alias("first_due"))


_LEVELS = {"A": 0.98, "B": 0.95, "C": 0.90}


@query("SELECT category, level, round(CASE level " + " ".join(f"WHEN {v!r} THEN {inv.service_z(v)!r}" for v in _LEVELS.values()) + " END, 9) AS z, skus FROM (SELECT category, CASE WHEN price_minor > 95000 THEN 0.98 WHEN price_minor > 92000 THEN 0.95 ELSE 0.9 END AS level, count(*) AS skus FROM products GROUP BY ALL)")
def inv_service_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal quantile of each product group's service level, by a lookup of three rows."""
    lookup = spark.createDataFrame([(v, inv.service_z(v)) for v in _LEVELS.values()], "level double, z double")
    level = F.when(F.col("price_minor") > 95000, 0.98).when(F.col("price_minor") > 92000, 0.95).otherwise(0.9)
    rows = products(spark, sf_dir).groupBy("category", level.alias("level")).agg(F.count("*").alias("skus"))
    return rows.join(F.broadcast(lookup), "level").select("category", "level", F.round("z", 9).alias("z"), "skus")


@query("SELECT location, round(days, 6) AS days, round(variance, 6) AS variance, variance IS NOT NULL AS enough FROM sterms")
def inv_lead_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead time and its squared weekly deviation, where a site shows eight or more."""
    return _site_terms(spark, sf_dir).select("location", F.round("days", 6).alias("days"), F.round("variance", 6).alias("variance"), F.col("variance").isNotNull().alias("enough"))


@query(f"SELECT sku, location, round(point, 6) AS reorder_point, round(point + next_week, 6) AS order_up_to, position < point AS below FROM (SELECT *, need + {_Z} * sqrt(sigma * sigma + lead_part * lead_part) AS point FROM {_ORDERS})")
def inv_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.col("need") + F.col("safety")
    return _supply(spark, sf_dir).select("sku", "location", F.round(point, 6).alias("reorder_point"), F.round(point + F.col("next_week"), 6).alias("order_up_to"), (F.col("position") < point).alias("below"))


_ORDERED = f"(SELECT *, CAST(CASE WHEN {_NONE} OR {_CONFLICT} THEN 0 WHEN wanted > cap THEN shrunk ELSE wanted END AS BIGINT) AS order_units, CASE WHEN NOT {_NONE} AND {_CONFLICT} THEN 'CAP_CONFLICT' END AS reason, need + {_Z} * sqrt(sigma * sigma + lead_part * lead_part) AS point FROM {_ORDERS})"


@query(f"SELECT market, category, count(*) AS cells, count(*) FILTER (WHERE order_units > 0) AS orders, count(*) FILTER (WHERE order_units > 0 AND order_units % CAST(pack AS BIGINT) <> 0) AS broken_packs, count(*) FILTER (WHERE order_units > 0 AND order_units < moq) AS below_moq, count(*) FILTER (WHERE reason IS NOT NULL) AS conflicts FROM {_ORDERED} GROUP BY ALL")
def inv_order_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How orders keep to packs and least quantities, and how many cells admit none."""
    rows = ordered(spark, sf_dir)
    return rows.groupBy("market", "category").agg(
        F.count("*").alias("cells"), n_if("order_units > 0").alias("orders"), n_if("order_units > 0 and order_units % cast(pack as bigint) <> 0").alias("broken_packs"),
        n_if("order_units > 0 and order_units < moq").alias("below_moq"), n_if("reason is not null").alias("conflicts"),
    )


@query("SELECT s.sku, s.market, s.location AS source, CAST(sum(least(s.atp, t.need)) AS BIGINT) AS cover, count(*) AS targets FROM (SELECT sku, market, location, atp FROM cellx WHERE atp > 0 AND coalesce(daily, 0) = 0) s JOIN (SELECT sku, market, location, CAST(ceil(daily * 28 - atp) AS BIGINT) AS need FROM cellx WHERE daily * 28 > atp) t ON t.sku = s.sku AND t.market = s.market AND t.location <> s.location GROUP BY ALL")
def inv_transfer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What idle stock could cover of a shortfall elsewhere in its market.

    A source's cover over all targets is summed, so the needs of a market's product are sorted once
    with their running sums and each source looks its place up: pairs are never written.
    """
    cells = _cells(spark, sf_dir)
    need = cells.where("daily * 28 > atp").select("sku", "market", F.ceil(F.col("daily") * 28 - F.col("atp")).cast("long").alias("need"))
    # needs of one value are one entry, so an entry list is as long as there are different needs
    sums = need.groupBy("sku", "market", "need").agg(F.count("*").alias("n"))
    lists = sums.groupBy("sku", "market").agg(F.collect_list(F.struct("need", "n")).alias("needs"), F.sum("n").alias("targets"))
    spare = cells.where("atp > 0 and coalesce(daily, 0) = 0").select("sku", "market", F.col("location").alias("source"), "atp")
    cover = F.aggregate("needs", F.lit(0).cast("long"), lambda a, x: a + F.least(F.col("atp"), x["need"]) * x["n"])
    return spare.join(lists, ["sku", "market"]).select("sku", "market", "source", cover.alias("cover"), "targets")


@query("SELECT s.location, CAST(sum(outstanding_units * coalesce(r.cost, g.cost)) AS BIGINT) AS open_minor, CAST(sum(outstanding_units) AS BIGINT) AS open_units FROM ship s JOIN goods g USING (sku) LEFT JOIN " + _COST + " r ON r.sku = s.sku AND r.location = s.location WHERE state <> 'received' GROUP BY s.location")
def inv_open_po_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open units at the cost of the cell that will receive them."""
    rows = supply.shipments(spark, sf_dir)
    own = rows.where("state = 'received'").groupBy("sku", "location").agg(F.sum(F.col("received_units") * F.col("unit_cost")).alias("v"), F.sum("received_units").alias("u")).select("sku", "location", F.expr("v div u").alias("own"))
    goods = products(spark, sf_dir).select("sku", F.expr("price_minor * 6 div 10").alias("cost"))
    open_rows = rows.where("state <> 'received'").join(goods, "sku").join(own, ["sku", "location"], "left")
    return open_rows.groupBy("location").agg(F.sum(F.col("outstanding_units") * F.coalesce("own", "cost")).alias("open_minor"), F.sum("outstanding_units").alias("open_units"))


@query(f"SELECT market, count(*) AS sites, CASE WHEN median(days) > 30 THEN 60 ELSE 45 END AS over_days, round(median(days), 6) AS usual_days FROM sterms JOIN locations USING (location) GROUP BY market")
def inv_market_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by market, from what its sites' lead times usually are."""
    rows = _site_terms(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location")
    return rows.groupBy("market").agg(F.count("*").alias("sites"), F.when(F.median("days") > 30, 60).otherwise(45).alias("over_days"), F.round(F.median("days"), 6).alias("usual_days"))


@query("SELECT c.sku, c.location, c.category, p.product_name, replace(lower(p.product_name), ' ', '-') AS slug, c.cost, round(c.daily * 91, 4) AS trailing_units FROM cellx c JOIN products p USING (sku)")
def inv_sku_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = products(spark, sf_dir).select("sku", "product_name")
    slug = F.replace(F.lower("product_name"), F.lit(" "), F.lit("-"))
    return _cells(spark, sf_dir).join(names, "sku").select("sku", "location", "category", "product_name", slug.alias("slug"), "cost", F.round(F.col("daily") * 91, 4).alias("trailing_units"))


@query("SELECT market, count(*) FILTER (WHERE daily > 0) AS assessed, count(*) FILTER (WHERE coalesce(daily, 0) = 0 AND active) AS withheld, count(*) FILTER (WHERE NOT active) AS residual FROM cellx GROUP BY market")
def inv_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("market").agg(n_if("daily > 0").alias("assessed"), n_if("coalesce(daily, 0) = 0 and active").alias("withheld"), n_if("not active").alias("residual"))


@query("SELECT market, count(*) FILTER (WHERE NOT active) AS withheld_cells, count(DISTINCT sku) FILTER (WHERE NOT active) AS withheld_skus, round(" + d("CASE WHEN active THEN 0 ELSE coalesce(daily, 0) END") + " / nullif(" + d("coalesce(daily, 0)") + ", 0), 6) AS withheld_demand, CASE WHEN count(*) FILTER (WHERE NOT active) > 0 THEN 'INTERVAL_WITHHELD' END AS exception FROM cellx GROUP BY market")
def inv_interval_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose interval is withheld, the demand behind them, and one exception for a market that has any."""
    daily = F.coalesce("daily", F.lit(0.0))
    held = F.count_if(~F.col("active"))
    share = dsum(F.when(F.col("active"), F.lit(0.0)).otherwise(daily)) / F.nullif(dsum(daily), F.lit(0.0))
    return _cells(spark, sf_dir).groupBy("market").agg(held.alias("withheld_cells"), F.countDistinct(F.when(~F.col("active"), F.col("sku"))).alias("withheld_skus"), F.round(share, 6).alias("withheld_demand"), F.when(held > 0, "INTERVAL_WITHHELD").alias("exception"))


@query("SELECT 'cells' AS artifact, count(*) AS n, count(*) FILTER (WHERE atp < 0) AS negative, count(*) FILTER (WHERE position < atp) AS unsound FROM cellx UNION ALL SELECT 'lots', count(*), count(*) FILTER (WHERE units < 0), count(*) FILTER (WHERE age_days < 0) FROM lots UNION ALL SELECT 'orders', count(*), count(*) FILTER (WHERE order_units < 0), count(*) FILTER (WHERE order_units > 0 AND reason IS NOT NULL) FROM " + _ORDERED)
def inv_artifact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules of three artifacts; each is read once."""
    out = None
    for name, rows, negative, unsound in (
        ("cells", _cells(spark, sf_dir), "atp < 0", "position < atp"), ("lots", _lots(spark, sf_dir), "units < 0", "age_days < 0"), ("orders", ordered(spark, sf_dir), "order_units < 0", "order_units > 0 and reason is not null")
    ):
        part = rows.agg(F.count("*").alias("n"), n_if(negative).alias("negative"), n_if(unsound).alias("unsound")).select(F.lit(name).alias("artifact"), "n", "negative", "unsound")
        out = part if out is None else out.unionByName(part)
    return out


# --- report rows -------------------------------------------------------------------------------------


@query("SELECT market, location, category, count(*) AS cells, sum(on_hand) AS on_hand FROM cellx JOIN products USING (sku, category) WHERE market IN ('ASIA', 'EUROPE') AND category = 'PROMO' AND product_name ILIKE '%ring%' GROUP BY ALL")
def rpt_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market, category and search filters, each only where the frame has its column."""
    rows = _cells(spark, sf_dir).join(products(spark, sf_dir).select("sku", "product_name"), "sku")
    wanted = {"market": F.col("market").isin("ASIA", "EUROPE"), "category": F.col("category") == "PROMO", "product_name": F.col("product_name").ilike("%ring%")}
    for column, condition in wanted.items():
        rows = rows.where(condition) if column in rows.columns else rows
    return rows.groupBy("market", "location", "category").agg(F.count("*").alias("cells"), F.sum("on_hand").alias("on_hand"))


_SOLD = f"(SELECT sku, location, CAST(sum(units) AS BIGINT) AS sold FROM sales WHERE business_date <= DATE '{TODAY}' AND business_date > DATE '{TODAY}' - 91 GROUP BY ALL)"


def _sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = (F.col("business_date") <= today()) & (F.col("business_date") > F.date_sub(today(), 91))
    return sale_lines(spark, sf_dir).where(recent).groupBy("sku", "location").agg(F.sum("units").alias("sold"))


@query(f"SELECT t.sku, t.location, units, age_days, units * cost AS value_minor, round(coalesce(sold, 0) / (coalesce(sold, 0) + units), 6) AS sell_through, CASE WHEN age_days > 180 THEN 1 WHEN age_days > 90 THEN 2 ELSE 3 END AS priority FROM lots t LEFT JOIN {_SOLD} s ON s.sku = t.sku AND s.location = t.location")
def rpt_rows_ageing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots with value, what their cell sold in 91 days against what is left, and a priority by age."""
    rows = _lots(spark, sf_dir).join(_sold(spark, sf_dir), ["sku", "location"], "left")
    sold = F.coalesce("sold", F.lit(0))
    priority = F.when(F.col("age_days") > 180, 1).when(F.col("age_days") > 90, 2).otherwise(3)
    return rows.select("sku", "location", "units", "age_days", (F.col("units") * F.col("cost")).alias("value_minor"), F.round(sold / (sold + F.col("units")), 6).alias("sell_through"), priority.alias("priority"))


_VARIANCE = "(SELECT sku, location, CAST(sum(units) FILTER (WHERE fulfilled AND returned) AS BIGINT) AS variance FROM sales GROUP BY ALL)"


def _variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_lines(spark, sf_dir).groupBy("sku", "location").agg(F.sum(F.when(F.col("fulfilled") & F.col("returned"), F.col("units"))).alias("variance"))


@query(f"SELECT c.sku, c.location, c.on_hand * c.cost AS value_minor, v.variance, v.variance * m.mean_cost AS variance_minor FROM cellx c JOIN {_VARIANCE} v ON v.sku = c.sku AND v.location = c.location LEFT JOIN (SELECT category, CAST(sum(on_hand * cost) AS BIGINT) // nullif(CAST(sum(on_hand) AS BIGINT), 0) AS mean_cost FROM cellx GROUP BY category) m ON m.category = c.category WHERE c.on_hand > 0")
def rpt_rows_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held value and the variance of each cell, the latter at its category's mean cost."""
    cells = _cells(spark, sf_dir)
    means = cells.groupBy("category").agg(F.sum(F.col("on_hand") * F.col("cost")).alias("v"), F.sum("on_hand").alias("u")).select("category", F.expr("v div nullif(u, 0)").alias("mean_cost"))
    rows = cells.where("on_hand > 0").join(_variance(spark, sf_dir), ["sku", "location"]).join(means, "category", "left")
    return rows.select("sku", "location", (F.col("on_hand") * F.col("cost")).alias("value_minor"), "variance", (F.col("variance") * F.col("mean_cost")).alias("variance_minor"))


@query(f"SELECT sku, location, round(point - need, 6) AS buffer_units, round((point - need) * cost, 4) AS buffer_minor, CASE WHEN point - need > 10 THEN 'deep' WHEN point - need > 2 THEN 'usual' ELSE 'thin' END AS segment FROM {_ORDERED}")
def rpt_rows_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    # point less need, as the SQL has it
    buffer = (F.col("need") + F.col("safety")) - F.col("need")
    segment = F.when(buffer > 10, "deep").when(buffer > 2, "usual").otherwise("thin")
    return _supply(spark, sf_dir).select("sku", "location", F.round(buffer, 6).alias("buffer_units"), F.round(buffer * F.col("cost"), 4).alias("buffer_minor"), segment.alias("segment"))


_ALLOCATED = """(SELECT location, sku, channel, wanted, pool, CAST(least(wanted, greatest(0, pool - coalesce(sum(wanted) OVER (PARTITION BY location, sku ORDER BY channel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS allocated
  FROM (SELECT location, sku, channel, CAST(sum(units) AS BIGINT) AS wanted, max(atp) AS pool FROM sales JOIN cells USING (sku, location) GROUP BY ALL))"""


def _allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    demand = sale_lines(spark, sf_dir).groupBy("location", "sku", "channel").agg(F.sum("units").alias("wanted"))
    pool = _cells(spark, sf_dir).select("sku", "location", F.col("atp").alias("pool"))
    return inv.allocate(demand.join(pool, ["sku", "location"]), ["location", "sku"], "wanted", "pool", ["channel"])


@query(f"SELECT location, sku, channel, wanted, allocated, pool, CASE WHEN allocated = wanted THEN 'filled' WHEN allocated > 0 THEN 'partial' ELSE 'none' END AS status, CAST(left(channel, 1) AS BIGINT) AS priority FROM {_ALLOCATED}")
def rpt_rows_allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("allocated") == F.col("wanted"), "filled").when(F.col("allocated") > 0, "partial").otherwise("none")
    return _allocated(spark, sf_dir).select("location", "sku", "channel", "wanted", "allocated", "pool", status.alias("status"), F.substring("channel", 1, 1).cast("long").alias("priority"))


_EXCEPTIONS = f"(SELECT sku, location, 'stock' AS side, health AS class, CASE health WHEN 'stockout' THEN 'high' WHEN 'understock' THEN 'medium' ELSE 'low' END AS severity FROM health WHERE health IN ('stockout', 'understock', 'overstock') UNION ALL SELECT sku, location, 'supply', lower(reason), 'high' FROM {_ORDERED} WHERE reason IS NOT NULL)"


def _exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("health") == "stockout", "high").when(F.col("health") == "understock", "medium").otherwise("low")
    stock = _health(spark, sf_dir).where("health in ('stockout', 'understock', 'overstock')").select("sku", "location", F.lit("stock").alias("side"), F.col("health").alias("class"), severity.alias("severity"))
    orders = ordered(spark, sf_dir).where("reason is not null").select("sku", "location", F.lit("supply").alias("side"), F.lower("reason").alias("class"), F.lit("high").alias("severity"))
    return stock.unionByName(orders)


_RESOLVES = {"stockout": "expedite", "understock": "reorder", "overstock": "mark down"}


@query(f"SELECT sku, location, severity, upper(left(class, 1)) || replace(substr(class, 2), '_', ' ') AS label, CASE class {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _RESOLVES.items())} ELSE 'raise the cap' END AS resolution FROM {_EXCEPTIONS}")
def rpt_rows_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.upper(F.substring("class", 1, 1)), F.replace(F.substring("class", 2, 99), F.lit("_"), F.lit(" ")))
    return _exceptions(spark, sf_dir).select("sku", "location", "severity", label.alias("label"), F.coalesce(text.value_map(F.col("class"), _RESOLVES), F.lit("raise the cap")).alias("resolution"))


@query(f"SELECT p.location, location_name, currency, lines, outstanding, CAST(round_even(CAST(outstanding * 1000 AS DECIMAL(20,0)) * CAST(CASE currency WHEN 'USD' THEN 0.9194 WHEN 'GBP' THEN 1.1702 WHEN 'EUR' THEN 1.0 END AS DECIMAL(9,4)), 0) AS BIGINT) AS open_value, CASE WHEN late * 4 > lines THEN 'review' WHEN outstanding > 1000 THEN 'chase' ELSE 'none' END AS action FROM {_PERF} p JOIN locations USING (location) JOIN (SELECT location, currency FROM xwalk) USING (location)")
def rpt_rows_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors with their open value in one currency, unknown ones null, and what to do."""
    rates = spark.createDataFrame([("USD", "0.9194"), ("GBP", "1.1702"), ("EUR", "1.0")], "currency string, rate string")
    sites = _sites(spark, sf_dir).select("location", "currency").join(locations(spark, sf_dir).select("location", "location_name"), "location")
    rows = _vendors(spark, sf_dir).join(sites, "location").join(F.broadcast(rates), "currency", "left")  # three rows
    action = F.when(F.col("late") * 4 > F.col("lines"), "review").when(F.col("outstanding") > 1000, "chase").otherwise("none")
    return rows.select("location", "location_name", "currency", "lines", "outstanding", money.convert(F.col("outstanding") * 1000, F.col("rate").cast("decimal(18,10)")).alias("open_value"), action.alias("action"))


@query(f"""SELECT o.sku, o.location, location_name, product_name, h.health, order_units, round(point - need, 6) AS buffer, atp, CASE WHEN h.health = 'stockout' THEN 'urgent' WHEN order_units > moq THEN 'regular' ELSE 'minimum' END AS order_type,
  DATE '{TODAY}' + CAST(ceil(o.days) AS INTEGER) AS expected_on FROM {_ORDERED} o JOIN (SELECT sku, location, health FROM health) h ON h.sku = o.sku AND h.location = o.location JOIN (SELECT location, location_name FROM locations) n ON n.location = o.location JOIN (SELECT sku, product_name FROM products) p ON p.sku = o.sku WHERE order_units > 0""")
def rpt_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommended orders with names, stock, buffer, class, type and the day they should arrive."""
    rows = inv.health(ordered(spark, sf_dir).where("order_units > 0"))
    rows = rows.join(locations(spark, sf_dir).select("location", "location_name"), "location").join(products(spark, sf_dir).select("sku", "product_name"), "sku")
    kind = F.when(F.col("health") == "stockout", "urgent").when(F.col("order_units") > F.col("moq"), "regular").otherwise("minimum")
    buffer = (F.col("need") + F.col("safety")) - F.col("need")
    return rows.select("sku", "location", "location_name", "product_name", "health", "order_units", F.round(buffer, 6).alias("buffer"), "atp", kind.alias("order_type"), F.date_add(today(), F.ceil("days").cast("int")).alias("expected_on"))


@query(f"SELECT origin, destination, count(*) AS moves, CAST(sum(units) AS BIGINT) AS units, CAST(coalesce(max(a.free), 0) AS BIGINT) AS available FROM {_MOVES} m LEFT JOIN (SELECT nation, CAST(sum(atp) AS BIGINT) AS free FROM cells JOIN locations USING (location) GROUP BY nation) a ON a.nation = m.origin WHERE origin <> destination GROUP BY ALL")
def rpt_rows_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes with what they carried and what is free at their origin."""
    free = _cells(spark, sf_dir).join(locations(spark, sf_dir).select("location", "nation"), "location").groupBy(F.col("nation").alias("origin")).agg(F.sum("atp").alias("free"))
    lanes = _moves(spark, sf_dir).where("origin <> destination").groupBy("origin", "destination").agg(F.count("*").alias("moves"), F.sum("units").alias("units"))
    return lanes.join(free, "origin", "left").select("origin", "destination", "moves", "units", F.coalesce("free", F.lit(0)).alias("available"))


@query("SELECT 'site' AS kind, CAST(location AS VARCHAR) AS key, location_name AS name FROM locations UNION ALL SELECT 'category', category, upper(left(category, 1)) || lower(substr(category, 2)) FROM (SELECT DISTINCT category FROM products)")
def rpt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = locations(spark, sf_dir).select(F.lit("site").alias("kind"), F.col("location").cast("string").alias("key"), F.col("location_name").alias("name"))
    kinds = products(spark, sf_dir).select("category").distinct().select(F.lit("category").alias("kind"), F.col("category").alias("key"), F.initcap("category").alias("name"))
    return sites.unionByName(kinds)


# --- report totals -------------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (WHERE daily > 0) AS assessed, count(*) FILTER (WHERE coalesce(daily, 0) = 0) AS withheld, count(*) FILTER (WHERE daily * 28 * 1.3 > atp) AS at_risk, CAST(coalesce(sum(CAST(ceil(daily * 28 * 1.3 - atp) AS BIGINT)) FILTER (WHERE daily * 28 * 1.3 > atp), 0) AS BIGINT) AS risk_units FROM cellx")
def rpt_kpi_inventory_demand_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.col("daily") * 28 * 1.3 - F.col("atp")
    over = F.col("daily") * 28 * 1.3 > F.col("atp")
    return _cells(spark, sf_dir).agg(n_if("daily > 0").alias("assessed"), n_if("coalesce(daily, 0) = 0").alias("withheld"), F.count_if(over).alias("at_risk"), F.coalesce(F.sum(F.when(over, F.ceil(short).cast("long"))), F.lit(0)).alias("risk_units"))


@query(f"SELECT expiring, expired, wasted FROM (SELECT CAST(coalesce(sum(units) FILTER (WHERE days_left BETWEEN 0 AND 30), 0) AS BIGINT) AS expiring, CAST(coalesce(sum(units) FILTER (WHERE days_left < 0), 0) AS BIGINT) AS expired FROM lots) CROSS JOIN (SELECT CAST(coalesce(sum(units), 0) AS BIGINT) AS wasted FROM {_WASTE} WHERE wasted_on > DATE '{TODAY}' - 365 AND wasted_on <= DATE '{TODAY}')")
def rpt_kpi_inventory_expiry_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("units"))), F.lit(0))
    left = _lots(spark, sf_dir).agg(units("days_left between 0 and 30").alias("expiring"), units("days_left < 0").alias("expired"))
    gone = _waste(spark, sf_dir).where((F.col("wasted_on") > F.date_sub(today(), 365)) & (F.col("wasted_on") <= today())).agg(F.coalesce(F.sum("units"), F.lit(0)).alias("wasted"))
    return left.crossJoin(gone)  # one row each


_ECHELON = "CASE WHEN on_hand >= 40 THEN 'bulk' ELSE 'shelf' END"


@query(f"SELECT {_ECHELON} AS kind, count(*) AS cells, CAST(sum(on_hand * cost) AS BIGINT) AS value_minor, CAST(coalesce(sum(variance), 0) AS BIGINT) AS variance FROM cellx LEFT JOIN {_VARIANCE} v USING (sku, location) GROUP BY 1")
def rpt_kpi_inventory_valuation_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("on_hand") >= 40, "bulk").otherwise("shelf")
    rows = _cells(spark, sf_dir).join(_variance(spark, sf_dir), ["sku", "location"], "left")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("cells"), F.sum(F.col("on_hand") * F.col("cost")).alias("value_minor"), F.coalesce(F.sum("variance"), F.lit(0)).alias("variance"))


@query(f"SELECT count(*) FILTER (WHERE cost IS NULL OR cost = 0) AS unvalued, count(*) FILTER (WHERE on_hand < committed + reserved + damaged) AS negative, CAST(sum(on_hand * cost) AS BIGINT) AS value_minor, CAST(coalesce(sum(variance * cost), 0) AS BIGINT) AS variance_minor FROM cellx LEFT JOIN {_VARIANCE} v USING (sku, location)")
def rpt_kpi_inventory_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cells(spark, sf_dir).join(_variance(spark, sf_dir), ["sku", "location"], "left")
    return rows.agg(n_if("cost is null or cost = 0").alias("unvalued"), n_if("on_hand < committed + reserved + damaged").alias("negative"), F.sum(F.col("on_hand") * F.col("cost")).alias("value_minor"), F.coalesce(F.sum(F.col("variance") * F.col("cost")), F.lit(0)).alias("variance_minor"))


@query(f"SELECT count(*) FILTER (WHERE order_units > 0) AS orders, CAST(sum(order_units) AS BIGINT) AS units, count(*) FILTER (WHERE order_units > 0 AND order_units >= moq) AS keeps_moq, count(*) FILTER (WHERE order_units > 0 AND atp = 0) AS urgent, count(DISTINCT location) FILTER (WHERE order_units > 0) AS sources, CAST(sum(order_units * cost) AS BIGINT) AS value_minor FROM {_ORDERED}")
def rpt_kpi_replenishment_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.col("order_units") > 0
    return ordered(spark, sf_dir).agg(F.count_if(some).alias("orders"), F.sum("order_units").alias("units"), n_if("order_units > 0 and order_units >= moq").alias("keeps_moq"), n_if("order_units > 0 and atp = 0").alias("urgent"), F.countDistinct(F.when(some, F.col("location"))).alias("sources"), F.sum(F.col("order_units") * F.col("cost")).alias("value_minor"))


@query(f"SELECT count(*) AS n, round({d('point - need')}, 3) AS buffer_units, count(*) FILTER (WHERE position >= point) AS covered FROM {_ORDERED}")
def rpt_kpi_replenishment_safety_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.col("need") + F.col("safety")
    return _supply(spark, sf_dir).agg(F.count("*").alias("n"), F.round(dsum(point - F.col("need")), 3).alias("buffer_units"), F.count_if(F.col("position") >= point).alias("covered"))


@query(f"SELECT count(*) AS n, CAST(sum(units) AS BIGINT) AS units, count(*) FILTER (WHERE origin = destination) AS local, count(DISTINCT (origin, destination)) AS lanes FROM {_MOVES}")
def rpt_kpi_replenishment_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("units").alias("units"), n_if("origin = destination").alias("local"), F.countDistinct("origin", "destination").alias("lanes"))


@query("SELECT count(*) AS pools, CAST(sum(atp) AS BIGINT) AS units, count(*) FILTER (WHERE atp = 0) AS empty FROM cells")
def rpt_kpi_replenishment_allocation_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).agg(F.count("*").alias("pools"), F.sum("atp").alias("units"), n_if("atp = 0").alias("empty"))


@query(f"SELECT channel, count(*) AS n, CAST(sum(wanted) AS BIGINT) AS wanted, CAST(sum(allocated) AS BIGINT) AS allocated, round(CAST(sum(allocated) AS DOUBLE) / sum(wanted), 6) AS fill FROM {_ALLOCATED} GROUP BY channel")
def rpt_kpi_replenishment_allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allocated(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.sum("wanted").alias("wanted"), F.sum("allocated").alias("allocated"), F.round(F.sum("allocated") / F.sum("wanted"), 6).alias("fill"))


@query(f"SELECT CASE WHEN late * 4 > lines THEN 'high' WHEN late * 8 > lines THEN 'medium' ELSE 'low' END AS risk, count(*) AS suppliers, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(late) AS BIGINT) AS late_lines FROM {_PERF} GROUP BY 1")
def rpt_kpi_replenishment_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = F.when(F.col("late") * 4 > F.col("lines"), "high").when(F.col("late") * 8 > F.col("lines"), "medium").otherwise("low")
    return _vendors(spark, sf_dir).groupBy(risk.alias("risk")).agg(F.count("*").alias("suppliers"), F.sum("lines").alias("lines"), F.sum("late").alias("late_lines"))


@query(f"SELECT severity, count(*) AS n, count(DISTINCT (sku, location)) AS cells, count(*) FILTER (WHERE side = 'supply') AS supply_side FROM {_EXCEPTIONS} GROUP BY severity")
def rpt_kpi_replenishment_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exceptions(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("sku", "location").alias("cells"), n_if("side = 'supply'").alias("supply_side"))


_RATE = "CAST(CASE currency WHEN 'USD' THEN 0.9194 WHEN 'GBP' THEN 1.1702 WHEN 'EUR' THEN 1.0 END AS DECIMAL(9,4))"


@query(f"SELECT kind, CAST(sum(x) AS BIGINT) AS value, count(*) FILTER (WHERE x IS NULL) AS unconverted FROM (SELECT {_ECHELON} AS kind, CAST(round_even(CAST(on_hand * cost AS DECIMAL(20,0)) * {_RATE}, 0) AS BIGINT) AS x FROM cellx JOIN (SELECT location, currency FROM xwalk) USING (location)) GROUP BY kind")
def rpt_money_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock value by kind in one currency; cells of an unknown currency are counted, not guessed."""
    rates = spark.createDataFrame([("USD", "0.9194"), ("GBP", "1.1702"), ("EUR", "1.0")], "currency string, rate string")
    rows = _cells(spark, sf_dir).join(_sites(spark, sf_dir).select("location", "currency"), "location").join(F.broadcast(rates), "currency", "left")  # three rows
    x = money.convert(F.col("on_hand") * F.col("cost"), F.col("rate").cast("decimal(18,10)"))
    return rows.groupBy(F.when(F.col("on_hand") >= 40, "bulk").otherwise("shelf").alias("kind")).agg(F.sum(x).alias("value"), F.count_if(x.isNull()).alias("unconverted"))


@query("SELECT market, cells, orders_open, late_lines FROM (SELECT market, count(*) AS cells FROM cellx GROUP BY market) JOIN (SELECT market, count(*) FILTER (WHERE state = 'open') AS orders_open, count(*) FILTER (WHERE state = 'late') AS late_lines FROM ship JOIN (SELECT location, market FROM locations) USING (location) GROUP BY market) USING (market)")
def rpt_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report source built of two frames at its own grain, joined after both are reduced."""
    cells = _cells(spark, sf_dir).groupBy("market").agg(F.count("*").alias("cells"))
    inbound = supply.shipments(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location").groupBy("market").agg(n_if("state = 'open'").alias("orders_open"), n_if("state = 'late'").alias("late_lines"))
    return cells.join(inbound, "market")


@query("SELECT cells, held, lots, open_lines FROM (SELECT count(*) AS cells, CAST(sum(on_hand) AS BIGINT) AS held FROM cellx WHERE market = 'EUROPE') CROSS JOIN (SELECT count(*) AS lots FROM lots WHERE market = 'EUROPE') CROSS JOIN (SELECT count(*) AS open_lines FROM ship JOIN (SELECT location, market FROM locations) USING (location) WHERE market = 'EUROPE' AND state = 'open')")
def rpt_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of several tables under one scope; one row each."""
    cells = _cells(spark, sf_dir).where("market = 'EUROPE'").agg(F.count("*").alias("cells"), F.sum("on_hand").alias("held"))
    lots = _lots(spark, sf_dir).where("market = 'EUROPE'").agg(F.count("*").alias("lots"))
    inbound = supply.shipments(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location").where("market = 'EUROPE' and state = 'open'").agg(F.count("*").alias("open_lines"))
    return cells.crossJoin(lots).crossJoin(inbound)


@query("SELECT market, CAST(sum(CAST(ceil(greatest(0, coalesce(daily, 0) * 28 - atp)) AS BIGINT)) AS BIGINT) AS needed, count(*) FILTER (WHERE daily * 28 > atp) AS cells FROM cellx GROUP BY market")
def rpt_outbound_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that the sites of a market need from its warehouse over four weeks."""
    need = F.ceil(F.greatest(F.lit(0.0), F.coalesce("daily", F.lit(0.0)) * 28 - F.col("atp"))).cast("long")
    return _cells(spark, sf_dir).groupBy("market").agg(F.sum(need).alias("needed"), n_if("daily * 28 > atp").alias("cells"))


@query("SELECT location, round(CAST(sum(least(served, demand)) AS DOUBLE) / sum(demand), 6) AS fill_rate, count(*) AS skus FROM (SELECT location, sku, CAST(sum(units) AS BIGINT) AS demand, CAST(sum(received_units) AS BIGINT) AS served FROM ship GROUP BY ALL) GROUP BY location")
def rpt_fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served over asked, capped for each product."""
    by_sku = supply.shipments(spark, sf_dir).groupBy("location", "sku").agg(F.sum("units").alias("demand"), F.sum("received_units").alias("served"))
    return by_sku.groupBy("location").agg(F.round(F.sum(F.least("served", "demand")) / F.sum("demand"), 6).alias("fill_rate"), F.count("*").alias("skus"))


@query(f"SELECT location, held, ceiling, round(held / nullif(ceiling, 0), 6) AS utilisation FROM (SELECT location, CAST(sum(on_hand) AS BIGINT) AS held FROM cells GROUP BY location) LEFT JOIN (SELECT location, CAST(max(ceiling) AS BIGINT) AS ceiling FROM {_CAPACITY} GROUP BY location) USING (location)")
def rpt_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held units over the most that the site took in a week."""
    held = _cells(spark, sf_dir).groupBy("location").agg(F.sum("on_hand").alias("held"))
    top = _capacity(spark, sf_dir).groupBy("location").agg(F.max("ceiling").alias("ceiling"))
    return held.join(top, "location", "left").select("location", "held", "ceiling", F.round(F.col("held") / F.nullif(F.col("ceiling"), F.lit(0)), 6).alias("utilisation"))


@query("SELECT category, count(*) AS cells, count(*) FILTER (WHERE health = 'stockout') AS stockouts, count(*) FILTER (WHERE health = 'dead') AS dead, coalesce(max(e.expiring), 0) AS expiring, CASE WHEN count(*) FILTER (WHERE health = 'dead') * 2 > count(*) THEN 'clear' WHEN coalesce(max(e.expiring), 0) * 10 > sum(on_hand) THEN 'expiry' ELSE 'steady' END AS risk FROM health h LEFT JOIN (SELECT category, CAST(sum(units) FILTER (WHERE days_left <= 30) AS BIGINT) AS expiring FROM lots GROUP BY category) e USING (category) GROUP BY category")
def rpt_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a category by class, what of it expires soon, and the risk that dominates."""
    cells = _health(spark, sf_dir).groupBy("category").agg(F.count("*").alias("cells"), n_if("health = 'stockout'").alias("stockouts"), n_if("health = 'dead'").alias("dead"), F.sum("on_hand").alias("held"))
    soon = _lots(spark, sf_dir).where("days_left <= 30").groupBy("category").agg(F.sum("units").alias("e"))
    expiring = F.coalesce("e", F.lit(0))
    risk = F.when(F.col("dead") * 2 > F.col("cells"), "clear").when(expiring * 10 > F.col("held"), "expiry").otherwise("steady")
    return cells.join(soon, "category", "left").select("category", "cells", "stockouts", "dead", expiring.alias("expiring"), risk.alias("risk"))


@query("SELECT location, market, " + ", ".join(f"count(*) FILTER (WHERE health = '{h}') AS {h}" for h in ("stockout", "understock", "healthy", "overstock", "dead")) + " FROM health GROUP BY ALL")
def rpt_health_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).groupBy("location", "market").agg(*(n_if(f"health = '{h}'").alias(h) for h in ("stockout", "understock", "healthy", "overstock", "dead")))


@query("SELECT market, state, count(*) AS lines, round(CAST(sum(lead_days) AS DOUBLE) / count(*), 6) AS lead_days, round(count(*) FILTER (WHERE lead_days > 30) / count(*), 6) AS slow_share FROM ship JOIN (SELECT location, market FROM locations) USING (location) WHERE lead_days BETWEEN 0 AND 120 GROUP BY ALL")
def rpt_lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supply.shipments(spark, sf_dir).where("lead_days between 0 and 120").join(locations(spark, sf_dir).select("location", "market"), "location")
    return rows.groupBy("market", "state").agg(F.count("*").alias("lines"), F.round(F.sum("lead_days").cast("double") / F.count("*"), 6).alias("lead_days"), F.round(n_if("lead_days > 30") / F.count("*"), 6).alias("slow_share"))


@query(f"SELECT market, sku, location, value, spent <= 50000000 AS within FROM (SELECT market, sku, location, order_units * cost AS value, sum(order_units * cost) OVER (PARTITION BY market ORDER BY order_units * cost DESC, sku, location ROWS UNBOUNDED PRECEDING) AS spent FROM {_ORDERED} WHERE order_units > 0)")
def rpt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by value until a market's weekly budget is spent."""
    rows = ordered(spark, sf_dir).where("order_units > 0").withColumn("value", F.col("order_units") * F.col("cost"))
    spent = running_before(rows.select("market", "sku", "location", "value"), ["market"], [F.desc("value"), F.asc("sku"), F.asc("location")], "value")
    return spent.select("market", "sku", "location", "value", (F.col("before") + F.col("value") <= 50000000).alias("within"))


@query("SELECT pair, rate, day FROM (SELECT event_type || '/USD' AS pair, value / 100 AS rate, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value > 0) WHERE r = 1", base=False)
def rpt_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest rate of each pair."""
    last = F.max_by(F.struct((F.col("value") / 100).alias("rate"), F.col("ts").cast("date").alias("day")), F.struct("ts", "event_id")).alias("x")
    return read(spark, sf_dir, "events").where("value > 0").groupBy(F.concat(F.col("event_type"), F.lit("/USD")).alias("pair")).agg(last).select("pair", "x.rate", "x.day")


_HEALTH_ROWS = "SELECT 'sales' AS source, count(*) AS records, count(*) FILTER (WHERE units <= 0 OR net_minor < 0 OR CAST(known_as_of AS DATE) < business_date) AS bad FROM sales UNION ALL SELECT 'products', count(*), count(*) FILTER (WHERE price_minor <= 0 OR pack_qty <= 0) FROM products UNION ALL SELECT 'sites', count(*), count(*) FILTER (WHERE currency IS NULL) FROM xwalk UNION ALL SELECT 'events', count(*), count(*) FILTER (WHERE value IS NULL OR value < 0) FROM events"


@query(f"SELECT source, records, round(100.0 * (records - bad) / records, 4) AS quality_pct, CASE WHEN bad = 0 THEN 'good' WHEN bad * 5 < records THEN 'watch' ELSE 'issue' END AS status FROM ({_HEALTH_ROWS})")
def rpt_data_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, share of sound ones and status of each source; a source is read once."""
    frames = [
        ("sales", sale_lines(spark, sf_dir), "units <= 0 or net_minor < 0 or cast(known_as_of as date) < business_date"), ("products", products(spark, sf_dir), "price_minor <= 0 or pack_qty <= 0"),
        ("sites", _sites(spark, sf_dir), "currency is null"), ("events", read(spark, sf_dir, "events"), "value is null or value < 0"),
    ]
    out = None
    for name, rows, bad in frames:
        part = rows.agg(F.count("*").alias("records"), n_if(bad).alias("bad")).select(F.lit(name).alias("source"), "records", "bad")
        out = part if out is None else out.unionByName(part)
    status = F.when(F.col("bad") == 0, "good").when(F.col("bad") * 5 < F.col("records"), "watch").otherwise("issue")
    return out.select("source", "records", F.round(100.0 * (F.col("records") - F.col("bad")) / F.col("records"), 4).alias("quality_pct"), status.alias("status"))


QUERIES, ORACLES = query.queries, query.oracles
