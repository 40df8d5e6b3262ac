"""Queries of supply-side staging and its canonical facts: receipts, lots, lanes, terms, promotions and outside data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import canonical as canon
from ..operators import supply
from ..operators.supply import AS_OF, SUPPLY_SQL
from ..sources.tables import locations, products, read, sale_lines
from .registration import Registry

query = Registry(SUPPLY_SQL)


def _ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.shipments(spark, sf_dir)


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.crosswalk(spark, sf_dir)


def mean(value: str) -> Column:
    """Mean of whole numbers: the sum is exact."""
    return F.sum(value).cast("double") / F.count(value)


# --- vendors and terms --------------------------------------------------------------------------


@query("SELECT s_suppkey AS vendor, s_name AS vendor_name, CAST(CAST(s_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) AS balance_minor, s_acctbal < 0 AS blocked FROM supplier", base=False)
def stage_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = (F.col("s_acctbal").cast("decimal(18,2)") * 100).cast("long")
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor"), F.col("s_name").alias("vendor_name"), balance.alias("balance_minor"), (F.col("s_acctbal") < 0).alias("blocked"))


@query("SELECT location AS vendor, location_name AS vendor_name, location_key, currency, s_acctbal < 0 AS blocked FROM supplier JOIN xwalk ON location = s_suppkey JOIN locations USING (location)")
def canon_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendor dimension under canonical keys."""
    vendor = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("location"), F.col("s_name").alias("vendor_name"), (F.col("s_acctbal") < 0).alias("blocked"))
    return vendor.join(_sites(spark, sf_dir), "location").select(F.col("location").alias("vendor"), "vendor_name", "location_key", "currency", "blocked")


_TERMS = "(SELECT location, category, count(*) AS n, CAST(sum(lead_days) AS DOUBLE) / count(*) AS lead_days, min(units) AS moq, CAST(max(units) AS BIGINT) AS most, min(business_date) AS valid_from FROM ship JOIN products USING (sku) WHERE state = 'received' GROUP BY ALL)"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ship(spark, sf_dir).where("state = 'received'").join(products(spark, sf_dir).select("sku", "category"), "sku")
    return rows.groupBy("location", "category").agg(F.count("*").alias("n"), mean("lead_days").alias("lead_days"), F.min("units").alias("moq"), F.max("units").alias("most"), F.min("business_date").alias("valid_from"))


@query(f"SELECT location AS vendor, category, n, round(lead_days, 6) AS lead_days, moq, valid_from FROM {_TERMS}")
def stage_vendor_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a vendor has kept to in each category: mean lead time and the smallest order it took."""
    return _terms(spark, sf_dir).select(F.col("location").alias("vendor"), "category", "n", F.round("lead_days", 6).alias("lead_days"), "moq", "valid_from")


_SCOPED = """(SELECT location, CASE WHEN grouping(sku) = 0 THEN 'sku' WHEN grouping(dept) = 0 THEN 'dept' ELSE 'category' END AS scope_type,
  CASE WHEN grouping(sku) = 0 THEN CAST(sku AS VARCHAR) WHEN grouping(dept) = 0 THEN dept ELSE category END AS scope, count(*) AS n, CAST(sum(lead_days) AS DOUBLE) / count(*) AS lead_days,
  CAST(sum(lead_days * lead_days) AS BIGINT) AS q, CAST(sum(lead_days) AS BIGINT) AS s, min(units) AS moq FROM ship JOIN products USING (sku) WHERE state = 'received' GROUP BY GROUPING SETS ((location, sku), (location, dept), (location, category)))"""


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ship(spark, sf_dir).where("state = 'received'").join(products(spark, sf_dir).select("sku", "category", "dept"), "sku")
    kind = F.when(F.grouping("sku") == 0, "sku").when(F.grouping("dept") == 0, "dept").otherwise("category")
    scope = F.when(F.grouping("sku") == 0, F.col("sku").cast("string")).when(F.grouping("dept") == 0, F.col("dept")).otherwise(F.col("category"))
    sets = [["location", "sku"], ["location", "dept"], ["location", "category"]]
    return rows.groupingSets(sets, "location", "sku", "dept", "category").agg(
        kind.alias("scope_type"), scope.alias("scope"), F.count("*").alias("n"), mean("lead_days").alias("lead_days"), F.sum(F.col("lead_days") * F.col("lead_days")).alias("q"), F.sum("lead_days").alias("s"), F.min("units").alias("moq")
    )


@query(f"SELECT location, scope_type, scope, n, round(lead_days, 6) AS lead_days, round(sqrt((n * q - s * s) / (n * n)), 6) AS deviation, moq FROM {_SCOPED}")
def stage_supply_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead time, its deviation and least order by product, department and category, in one pass."""
    n, q, s = F.col("n"), F.col("q"), F.col("s")
    return _scoped(spark, sf_dir).select("location", "scope_type", "scope", "n", F.round("lead_days", 6).alias("lead_days"), F.round(F.sqrt((n * q - s * s) / (n * n)), 6).alias("deviation"), "moq")


@query(f"SELECT location_key, scope_type, scope, CAST(ceil(lead_days) AS BIGINT) AS lead_days, moq FROM {_SCOPED} JOIN xwalk USING (location) WHERE n >= 2")
def canon_supply_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoped terms with at least two observations, under canonical site keys."""
    rows = _scoped(spark, sf_dir).where("n >= 2").join(_sites(spark, sf_dir), "location")
    return rows.select("location_key", "scope_type", "scope", F.ceil("lead_days").cast("long").alias("lead_days"), "moq")


# --- receipts, lots, costs ------------------------------------------------------------------------


@query("SELECT sku, location, received_on, unit_cost, sum(units) AS units FROM lot WHERE NOT returned GROUP BY ALL")
def stage_cost_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each cost, newest receipts apart."""
    return supply.lots(spark, sf_dir).where("not returned").groupBy("sku", "location", "received_on", "unit_cost").agg(F.sum("units").alias("units"))


@query("SELECT s.order_id, s.line_no, s.sku, location_key, currency, received_units, unit_cost, received_units * unit_cost AS cost_minor, due_date FROM ship s JOIN xwalk USING (location) WHERE state = 'received'")
def canon_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ship(spark, sf_dir).where("state = 'received'").join(_sites(spark, sf_dir), "location")
    return rows.select("order_id", "line_no", "sku", "location_key", "currency", "received_units", "unit_cost", (F.col("received_units") * F.col("unit_cost")).alias("cost_minor"), "due_date")


@query("SELECT order_id || '-' || line_no || '-' || sku AS lot_no, sku, location, units, received_on, expires_on FROM lot")
def stage_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.lots(spark, sf_dir).select(text.compose_key("-", "order_id", "line_no", "sku").alias("lot_no"), "sku", "location", "units", "received_on", "expires_on")


@query(f"SELECT location_key, sku, currency, count(*) AS lots, sum(units) AS units, CAST(sum(units * unit_cost) AS BIGINT) AS value_minor, count(*) FILTER (WHERE expires_on < DATE '{AS_OF}') AS expired, min(expires_on) AS first_expiry FROM lot JOIN xwalk USING (location) WHERE received_on <= DATE '{AS_OF}' GROUP BY ALL")
def canon_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots by cell with their value in the site's currency and the first expiry."""
    rows = supply.lots(spark, sf_dir).where(F.col("received_on") <= supply.as_of()).join(_sites(spark, sf_dir), "location")
    return rows.groupBy("location_key", "sku", "currency").agg(
        F.count("*").alias("lots"), F.sum("units").alias("units"), F.sum(F.col("units") * F.col("unit_cost")).alias("value_minor"), F.count_if(F.col("expires_on") < supply.as_of()).alias("expired"), F.min("expires_on").alias("first_expiry")
    )


_WASTE = f"""(SELECT location, sku, 'store' AS echelon, units, unit_cost, received_on AS wasted_on, 'returned' AS reason FROM lot WHERE returned UNION ALL
  SELECT location, sku, 'warehouse', units, unit_cost, expires_on, 'expired' FROM lot WHERE NOT returned AND expires_on <= DATE '{AS_OF}' AND units >= 45)"""


def _waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supply.lots(spark, sf_dir)
    back = rows.where("returned").select("location", "sku", F.lit("store").alias("echelon"), "units", "unit_cost", F.col("received_on").alias("wasted_on"), F.lit("returned").alias("reason"))
    old = rows.where(~F.col("returned") & (F.col("expires_on") <= supply.as_of()) & (F.col("units") >= 45))
    return back.unionByName(old.select("location", "sku", F.lit("warehouse").alias("echelon"), "units", "unit_cost", F.col("expires_on").alias("wasted_on"), F.lit("expired").alias("reason")))


@query(f"SELECT * FROM {_WASTE}")
def stage_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store waste (what came back) and warehouse waste (large lots past their expiry), united by name."""
    return _waste(spark, sf_dir)


@query(f"SELECT location_key, currency, echelon, reason, CAST(date_trunc('month', wasted_on) AS DATE) AS month, sum(units) AS units, CAST(sum(units * unit_cost) AS BIGINT) AS cost_minor FROM {_WASTE} JOIN xwalk USING (location) GROUP BY ALL")
def canon_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _waste(spark, sf_dir).join(_sites(spark, sf_dir), "location")
    return rows.groupBy("location_key", "currency", "echelon", "reason", F.trunc("wasted_on", "MM").alias("month")).agg(F.sum("units").alias("units"), F.sum(F.col("units") * F.col("unit_cost")).alias("cost_minor"))


# --- inbound, transfers, lanes --------------------------------------------------------------------


@query("SELECT order_id, line_no, sku, location, state, received_units, outstanding_units, due_date FROM ship")
def stage_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ship(spark, sf_dir).select("order_id", "line_no", "sku", "location", "state", "received_units", "outstanding_units", "due_date")


@query("SELECT location_key, sku, count(*) AS lines, sum(outstanding_units) AS outstanding, count(*) FILTER (WHERE state = 'late') AS late_lines, min(due_date) FILTER (WHERE state = 'open') AS next_due FROM ship JOIN xwalk USING (location) WHERE state <> 'received' GROUP BY ALL")
def canon_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and late inbound lines of each cell."""
    rows = _ship(spark, sf_dir).where("state <> 'received'").join(_sites(spark, sf_dir), "location")
    due = F.min(F.when(F.col("state") == "open", F.col("due_date")))
    return rows.groupBy("location_key", "sku").agg(F.count("*").alias("lines"), F.sum("outstanding_units").alias("outstanding"), F.count_if(F.col("state") == "late").alias("late_lines"), due.alias("next_due"))


_HISTORY = "(SELECT order_id, line_no, sku, location, 'ordered' AS status, business_date AS happened FROM ship UNION ALL SELECT order_id, line_no, sku, location, CASE WHEN returned THEN 'returned' ELSE 'shipped' END, due_date FROM ship WHERE state = 'received')"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ["order_id", "line_no", "sku", "location"]
    rows = _ship(spark, sf_dir)
    begun = rows.select(*own, F.lit("ordered").alias("status"), F.col("business_date").alias("happened"))
    return begun.unionByName(rows.where("state = 'received'").select(*own, F.when(F.col("returned"), "returned").otherwise("shipped").alias("status"), F.col("due_date").alias("happened")))


@query(f"SELECT order_id, line_no, sku, location_key, status, happened, row_number() OVER (PARTITION BY order_id, line_no, sku, location ORDER BY happened, status) AS step FROM {_HISTORY} JOIN xwalk USING (location)")
def canon_inbound_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered states of every inbound line."""
    step = F.row_number().over(Window.partitionBy("order_id", "line_no", "sku", "location").orderBy("happened", "status"))
    return _status(spark, sf_dir).withColumn("step", step).join(_sites(spark, sf_dir), "location").select("order_id", "line_no", "sku", "location_key", "status", "happened", "step")


_MOVES = "(SELECT order_id, line_no, sku, location, a.n_name AS origin, b.n_name AS destination, channel, units, unit_cost, state, business_date, due_date FROM ship JOIN supplier ON s_suppkey = location JOIN nation a ON a.n_nationkey = s_nationkey JOIN customer ON c_custkey = customer JOIN nation b ON b.n_nationkey = c_nationkey)"


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as moves from their site's nation to their customer's."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    origin = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("location"), F.col("n_name").alias("origin"))
    goal = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer"), F.col("n_name").alias("destination"))
    rows = _ship(spark, sf_dir).join(origin, "location").join(goal, "customer")
    return rows.select("order_id", "line_no", "sku", "location", "origin", "destination", "channel", "units", "unit_cost", "state", "business_date", "due_date")


@query(f"SELECT order_id, min(origin) AS origin, min(destination) AS destination, count(*) AS lines, sum(units) AS units FROM {_MOVES} GROUP BY order_id")
def stage_transfer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Move headers with their lines summed."""
    return _moves(spark, sf_dir).groupBy("order_id").agg(F.min("origin").alias("origin"), F.min("destination").alias("destination"), F.count("*").alias("lines"), F.sum("units").alias("units"))


@query(f"SELECT origin, destination, status, CAST(date_trunc('month', happened) AS DATE) AS month, count(*) AS n FROM (SELECT origin, destination, unnest(['created', 'dispatched']) AS status, unnest([business_date, CASE WHEN state = 'received' THEN due_date END]) AS happened FROM {_MOVES}) WHERE happened IS NOT NULL GROUP BY ALL")
def stage_transfer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of moves by lane and month."""
    done = F.when(F.col("state") == "received", F.col("due_date"))
    events = F.array(F.struct(F.lit("created").alias("status"), F.col("business_date").alias("at")), F.struct(F.lit("dispatched").alias("status"), done.alias("at")))
    rows = _moves(spark, sf_dir).withColumn("x", F.explode(events)).where("x.at is not null")
    return rows.groupBy("origin", "destination", "x.status", F.trunc("x.at", "MM").alias("month")).agg(F.count("*").alias("n"))


@query(f"SELECT order_id, line_no, sku, origin, destination, origin = destination AS local, units, state, business_date, due_date FROM {_MOVES}")
def canon_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir).select("order_id", "line_no", "sku", "origin", "destination", (F.col("origin") == F.col("destination")).alias("local"), "units", "state", "business_date", "due_date")


@query(f"SELECT origin, destination, count(*) FILTER (WHERE state = 'received') AS done, CAST(sum(units * unit_cost) AS BIGINT) AS cost_minor, max(due_date) FILTER (WHERE state = 'received') AS last_move FROM {_MOVES} GROUP BY ALL")
def canon_transfer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished moves of each lane with their cost."""
    done = F.col("state") == "received"
    return _moves(spark, sf_dir).groupBy("origin", "destination").agg(F.count_if(done).alias("done"), F.sum(F.col("units") * F.col("unit_cost")).alias("cost_minor"), F.max(F.when(done, F.col("due_date"))).alias("last_move"))


@query(f"SELECT origin, destination, nullif(channel, '5-LOW') AS channel, units, row_number() OVER (PARTITION BY destination, nullif(channel, '5-LOW') ORDER BY units DESC, origin) AS lane_rank FROM (SELECT origin, destination, channel, sum(units) AS units FROM {_MOVES} GROUP BY ALL)")
def canon_service_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes by channel, the lowest channel standing for any, ranked by what they carried."""
    sums = _moves(spark, sf_dir).groupBy("origin", "destination", "channel").agg(F.sum("units").alias("units"))
    rows = sums.withColumn("channel", F.nullif(F.col("channel"), F.lit("5-LOW")))
    rank = F.row_number().over(Window.partitionBy("destination", "channel").orderBy(F.desc("units"), "origin"))
    return rows.withColumn("lane_rank", rank)


# --- demand not served, capacity, controls ------------------------------------------------------------


@query("SELECT sku, location, business_date, sum(units) AS demand, sum(received_units) AS served, sum(outstanding_units) AS shortfall FROM ship GROUP BY ALL")
def stage_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ship(spark, sf_dir).groupBy("sku", "location", "business_date").agg(F.sum("units").alias("demand"), F.sum("received_units").alias("served"), F.sum("outstanding_units").alias("shortfall"))


@query("""SELECT location_key, CAST(date_trunc('month', business_date) AS DATE) AS month, sum(outstanding_units) AS shortfall, coalesce(max(w.wasted), 0) AS wasted FROM ship JOIN xwalk USING (location)
  LEFT JOIN (SELECT location, CAST(date_trunc('month', received_on) AS DATE) AS month, CAST(sum(units) AS BIGINT) AS wasted FROM lot WHERE returned GROUP BY ALL) w ON w.location = ship.location AND w.month = CAST(date_trunc('month', business_date) AS DATE)
  WHERE state <> 'received' GROUP BY ALL""")
def canon_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units a site could not serve in a month, beside what came back to it then."""
    month = F.trunc("business_date", "MM")
    short = _ship(spark, sf_dir).where("state <> 'received'").groupBy("location", month.alias("month")).agg(F.sum("outstanding_units").alias("shortfall"))
    back = supply.lots(spark, sf_dir).where("returned").groupBy("location", F.trunc("received_on", "MM").alias("month")).agg(F.sum("units").alias("wasted"))
    rows = short.join(_sites(spark, sf_dir), "location").join(back, ["location", "month"], "left")
    return rows.select("location_key", "month", "shortfall", F.coalesce("wasted", F.lit(0)).alias("wasted"))


_CAPACITY = "(SELECT location, CAST(date_trunc('year', week) AS DATE) AS year, CAST(max(units) AS BIGINT) AS ceiling FROM (SELECT location, CAST(date_trunc('week', due_date) AS DATE) AS week, sum(units) AS units FROM ship WHERE state = 'received' GROUP BY ALL) GROUP BY ALL)"


def _capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = _ship(spark, sf_dir).where("state = 'received'").groupBy("location", F.to_date(F.date_trunc("week", "due_date")).alias("week")).agg(F.sum("units").alias("units"))
    return weeks.groupBy("location", F.trunc("week", "YEAR").alias("year")).agg(F.max("units").alias("ceiling"))


@query(f"SELECT * FROM {_CAPACITY}")
def stage_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most units a site has taken in one week of each year."""
    return _capacity(spark, sf_dir)


@query(f"SELECT location_key, max(year) AS year, arg_max(ceiling, year) AS ceiling FROM {_CAPACITY} JOIN xwalk USING (location) GROUP BY location_key")
def canon_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest ceiling of each site."""
    rows = _capacity(spark, sf_dir).join(_sites(spark, sf_dir), "location")
    return rows.groupBy("location_key").agg(F.max("year").alias("year"), F.max_by("ceiling", "year").alias("ceiling"))


@query("SELECT order_id, CAST(sum(net_minor) AS BIGINT) AS ledger, CAST(CAST(max(o_totalprice) AS DECIMAL(18,2)) * 100 AS BIGINT) AS warehouse, CAST(CAST(max(o_totalprice) AS DECIMAL(18,2)) * 100 AS BIGINT) - CAST(sum(net_minor) AS BIGINT) AS difference FROM ship JOIN orders ON o_orderkey = order_id GROUP BY order_id")
def stage_wms_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems' value of each order, and their difference."""
    heads = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long").alias("warehouse"))
    sums = _ship(spark, sf_dir).groupBy("order_id").agg(F.sum("net_minor").alias("ledger"))
    return sums.join(heads, "order_id").select("order_id", "ledger", "warehouse", (F.col("warehouse") - F.col("ledger")).alias("difference"))


@query("""SELECT market, CAST(date_trunc('year', business_date) AS DATE) AS year, count(*) AS orders, CAST(sum(abs(warehouse - ledger)) AS BIGINT) AS absolute, count(*) FILTER (WHERE warehouse <> ledger) AS unlike FROM (
  SELECT order_id, min(location) AS location, min(business_date) AS business_date, CAST(sum(net_minor) AS BIGINT) AS ledger, CAST(CAST(max(o_totalprice) AS DECIMAL(18,2)) * 100 AS BIGINT) AS warehouse FROM ship JOIN orders ON o_orderkey = order_id GROUP BY order_id) JOIN xwalk USING (location) GROUP BY ALL""")
def canon_wms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the two systems by the market of an order's first site."""
    heads = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long").alias("warehouse"))
    sums = _ship(spark, sf_dir).groupBy("order_id").agg(F.min("location").alias("location"), F.min("business_date").alias("business_date"), F.sum("net_minor").alias("ledger")).join(heads, "order_id")
    gap = F.abs(F.col("warehouse") - F.col("ledger"))
    return sums.join(_sites(spark, sf_dir), "location").groupBy("market", F.trunc("business_date", "YEAR").alias("year")).agg(F.count("*").alias("orders"), F.sum(gap).alias("absolute"), F.count_if(gap != 0).alias("unlike"))


@query("SELECT order_id, line_no, sku, received_units, CASE WHEN units = 0 THEN NULL ELSE (net_minor // units) * received_units + least(net_minor % units, received_units) END AS fulfilled_minor FROM ship")
def sales_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money of the fulfilled units of each line; the first units carry the odd minor units."""
    from ..functions import money

    share = money.first_units_share(F.col("net_minor"), F.col("received_units"), F.nullif(F.col("units"), F.lit(0)))
    return _ship(spark, sf_dir).select("order_id", "line_no", "sku", "received_units", share.alias("fulfilled_minor"))


_RULES = {
    "sales": ("sales", "order_id || '-' || line_no || '-' || sku", [("DISCOUNT_TOO_HIGH", "discount_pct > 9"), ("SHIPPED_BEFORE_ORDER", "CAST(known_as_of AS DATE) < business_date"), ("TAX_OVER_NET", "tax_minor > net_minor")]),
    "products": ("products", "CAST(sku AS VARCHAR)", [("PACK_MISSING", "pack_qty <= 1"), ("PRICE_TOO_LOW", "price_minor < 90100")]),
    "lots": ("lot", "order_id || '-' || line_no || '-' || sku", [("EXPIRED_ON_RECEIPT", "expires_on <= received_on"), ("NO_COST", "unit_cost <= 0")]),
    "sites": ("xwalk", "location_key", [("NO_CURRENCY", "currency IS NULL")]),
}
_BROKEN = " UNION ALL ".join(f"SELECT '{name}' AS relation, '{code}' AS reason, sha256('{name}|{code}|' || {key}) AS row_hash FROM {table} WHERE {rule}" for name, (table, key, rules) in _RULES.items() for code, rule in rules)


@query(_BROKEN)
def quarantine_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of four relations that break one of eight rules, hashed; a relation is read once for all its rules."""
    frames = {"sales": sale_lines(spark, sf_dir), "products": products(spark, sf_dir), "lots": supply.lots(spark, sf_dir), "sites": _sites(spark, sf_dir)}
    keys = {"sales": text.compose_key("-", "order_id", "line_no", "sku"), "products": F.col("sku").cast("string"), "lots": text.compose_key("-", "order_id", "line_no", "sku"), "sites": F.col("location_key")}
    out = None
    for name, (_, _, rules) in _RULES.items():
        codes = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(code)) for code, rule in rules)))
        rows = frames[name].select(keys[name].alias("key"), F.explode(codes).alias("reason"))
        found = rows.select(F.lit(name).alias("relation"), "reason", F.sha2(F.concat_ws("|", F.lit(name), "reason", "key"), 256).alias("row_hash"))
        out = found if out is None else out.unionByName(found)
    return out


# --- outside data -------------------------------------------------------------------------------------


@query("SELECT event_type AS dataset, CAST(ts AS DATE) AS day, count(*) AS readings, count(DISTINCT user_id) AS scopes, max(ts) AS landed_at, CAST(sum(CAST(value AS DECIMAL(18,2)) * 100) AS BIGINT) AS total_minor FROM events GROUP BY ALL", base=False)
def stage_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope over every outside dataset: what it is, its day, its scopes and when it landed."""
    hundredths = (F.col("value").cast("decimal(18,2)") * 100).cast("long")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dataset"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("readings"), F.countDistinct("user_id").alias("scopes"), F.max("ts").alias("landed_at"), F.sum(hundredths).alias("total_minor"))


_VIEWS = {"view": "weather_actual", "click": "weather_forecast", "purchase": "promotions", "signup": "holidays", "error": "disruptions"}


@query("SELECT view_name, user_id AS scope, CAST(ts AS DATE) AS day, value, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS code FROM events JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _VIEWS.items()) + ") v(t, view_name) ON t = event_type", base=False)
def stage_derived_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside rows under the name of the view they feed."""
    code = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    rows = read(spark, sf_dir, "events").withColumn("view_name", text.value_map(F.col("event_type"), _VIEWS))
    return rows.where("view_name is not null").select("view_name", F.col("user_id").alias("scope"), F.col("ts").cast("date").alias("day"), "value", code.alias("code"))


def _outside(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return read(spark, sf_dir, "events").where(F.col("event_type") == kind)


_EXACT = "CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE)"


def _sum_value() -> Column:
    return F.sum(F.col("value").cast("decimal(18,6)")).cast("double")


@query(f"SELECT user_id AS scope, CAST(ts AS DATE) AS day, count(*) AS n, round({_EXACT} / count(*), 9) AS reading FROM events WHERE event_type = 'view' GROUP BY ALL", base=False)
def canon_weather_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outside(spark, sf_dir, "view").groupBy(F.col("user_id").alias("scope"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.round(_sum_value() / F.count("*"), 9).alias("reading"))


@query("SELECT user_id AS scope, CAST(ts AS DATE) AS issued_on, CAST(ts AS DATE) + CAST(1 + json_extract(props, '$.k')::BIGINT % 7 AS INTEGER) AS target_day, event_id, value AS forecast FROM events WHERE event_type = 'click'", base=False)
def canon_weather_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue day and target day of each forecast."""
    ahead = (1 + F.get_json_object("props", "$.k").cast("long") % 7).cast("int")
    issued = F.col("ts").cast("date")
    return _outside(spark, sf_dir, "click").select(F.col("user_id").alias("scope"), issued.alias("issued_on"), F.date_add(issued, ahead).alias("target_day"), "event_id", F.col("value").alias("forecast"))


@query("SELECT scope, day, count(*) AS events FROM (SELECT user_id AS scope, unnest(generate_series(CAST(ts AS DATE), CAST(ts AS DATE) + CAST(json_extract(props, '$.k')::BIGINT % 5 AS INTEGER), INTERVAL 1 DAY))::DATE AS day FROM events WHERE event_type = 'purchase') GROUP BY ALL", base=False)
def canon_local_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's range of days as one row a day."""
    first = F.col("ts").cast("date")
    last = F.date_add(first, (F.get_json_object("props", "$.k").cast("long") % 5).cast("int"))
    return _outside(spark, sf_dir, "purchase").select(F.col("user_id").alias("scope"), F.explode(F.sequence(first, last)).alias("day")).groupBy("scope", "day").agg(F.count("*").alias("events"))


@query("SELECT CASE WHEN user_id % 3 = 0 THEN 'market' ELSE 'site' END AS scope_type, CASE WHEN user_id % 3 = 0 THEN 'all' ELSE CAST(user_id AS VARCHAR) END AS scope, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY ALL", base=False)
def canon_calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar entries with their scope normalised: a whole market or one site."""
    wide = F.col("user_id") % 3 == 0
    rows = _outside(spark, sf_dir, "signup").select(F.when(wide, "market").otherwise("site").alias("scope_type"), F.when(wide, F.lit("all")).otherwise(F.col("user_id").cast("string")).alias("scope"), F.col("ts").cast("date").alias("day"))
    return rows.groupBy("scope_type", "scope", "day").agg(F.count("*").alias("n"))


@query("SELECT user_id AS scope, CAST(date_trunc('week', ts) AS DATE) AS week, greatest(0.0, round(1 - " + _EXACT + " / count(*) / 200, 9)) AS factor, min(ts) AS starts, max(ts) AS ends FROM events WHERE event_type = 'error' AND value IS NOT NULL GROUP BY ALL", base=False)
def canon_disruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly phases of a disruption with the factor by which they slow a scope."""
    factor = F.greatest(F.lit(0.0), F.round(1 - _sum_value() / F.count("*") / 200, 9))
    return _outside(spark, sf_dir, "error").where("value is not null").groupBy(F.col("user_id").alias("scope"), F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(factor.alias("factor"), F.min("ts").alias("starts"), F.max("ts").alias("ends"))


@query("SELECT pair, day, CAST(rate AS DOUBLE) AS rate FROM (SELECT event_type || '/USD' AS pair, CAST(ts AS DATE) AS day, CAST(max(value) AS DECIMAL(18,2)) / 100 AS rate FROM events WHERE try_cast(value AS DECIMAL(18,2)) > 0 GROUP BY ALL)", base=False)
def canon_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rates as decimals; what is no positive number is left out."""
    rows = read(spark, sf_dir, "events").where(F.col("value").try_cast("decimal(18,2)") > 0)
    rate = (F.max("value").cast("decimal(18,2)") / 100).cast("decimal(38,18)")
    return rows.groupBy(F.concat(F.col("event_type"), F.lit("/USD")).alias("pair"), F.col("ts").cast("date").alias("day")).agg(rate.cast("double").alias("rate"))


@query("SELECT market, week, round(spend * 100.0 / first_spend, 6) AS index FROM (SELECT market, week, spend, first_value(spend) OVER (PARTITION BY market ORDER BY week) AS first_spend FROM (SELECT market, CAST(date_trunc('week', business_date) AS DATE) AS week, CAST(sum(net_minor) AS BIGINT) AS spend FROM msales GROUP BY ALL))")
def canon_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market's weekly spending as an index of its first week."""
    sums = sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location").groupBy("market", F.to_date(F.date_trunc("week", "business_date")).alias("week")).agg(F.sum("net_minor").alias("spend"))
    first = F.first("spend").over(Window.partitionBy("market").orderBy("week"))
    return sums.select("market", "week", F.round(F.col("spend") * 100.0 / first, 6).alias("index"))


# --- competitors: the other nations of a market ---------------------------------------------------------

_RIVALS = "(SELECT market, nation AS competitor, category, business_date, sku, net_minor // units AS price FROM sales JOIN xwalk USING (location) JOIN products USING (sku) WHERE fulfilled)"


def _rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    goods = products(spark, sf_dir).select("sku", "category")
    rows = sale_lines(spark, sf_dir).where("fulfilled").join(_sites(spark, sf_dir), "location").join(goods, "sku")
    return rows.select("market", F.col("nation").alias("competitor"), "category", "business_date", "sku", F.expr("net_minor div units").alias("price"))


@query(f"SELECT DISTINCT market, competitor FROM {_RIVALS}")
def canon_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rivals(spark, sf_dir).select("market", "competitor").distinct()


@query(f"SELECT competitor, sku, min(business_date) AS first_seen, min(category) AS category, count(*) AS observations FROM {_RIVALS} GROUP BY competitor, sku")
def canon_competitor_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rivals(spark, sf_dir).groupBy("competitor", "sku").agg(F.min("business_date").alias("first_seen"), F.min("category").alias("category"), F.count("*").alias("observations"))


@query(f"SELECT market, competitor, category, CAST(date_trunc('month', business_date) AS DATE) AS month, CASE WHEN count(*) >= 3 THEN 'market' ELSE 'single' END AS scope, CAST(sum(price) AS BIGINT) // count(*) AS mean_price, min(price) AS least_price FROM {_RIVALS} GROUP BY ALL")
def canon_competitor_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly prices of a competitor; few observations stand for a single site only."""
    sums = _rivals(spark, sf_dir).groupBy("market", "competitor", "category", F.trunc("business_date", "MM").alias("month")).agg(F.count("*").alias("n"), F.sum("price").alias("s"), F.min("price").alias("least_price"))
    return sums.select("market", "competitor", "category", "month", F.when(F.col("n") >= 3, "market").otherwise("single").alias("scope"), F.expr("s div n").alias("mean_price"), "least_price")


@query(f"SELECT market, sku, count(DISTINCT competitor) AS sellers, min(competitor) AS first_seller, max(business_date) AS last_seen FROM {_RIVALS} GROUP BY ALL HAVING count(DISTINCT competitor) > 1 AND max(business_date) >= DATE '1999-01-01'")
def canon_competitor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that more than one competitor of a market sells and that still sell."""
    rows = _rivals(spark, sf_dir).groupBy("market", "sku").agg(F.countDistinct("competitor").alias("sellers"), F.min("competitor").alias("first_seller"), F.max("business_date").alias("last_seen"))
    return rows.where("sellers > 1 and last_seen >= date'1999-01-01'")


# --- promotions: months in which a category was discounted widely ----------------------------------------

_PROMO = "(SELECT category, dept, market, CAST(date_trunc('month', business_date) AS DATE) AS month, count(*) AS lines, CAST(sum(discount_minor) AS BIGINT) AS given_minor, max(discount_pct) AS deepest FROM msales JOIN products USING (sku) WHERE discount_pct >= 8 GROUP BY ALL)"


def _promos(spark: SparkSession, sf_dir: str) -> DataFrame:
    goods = products(spark, sf_dir).select("sku", "category", "dept")
    rows = sale_lines(spark, sf_dir).where("discount_pct >= 8").join(locations(spark, sf_dir).select("location", "market"), "location").join(goods, "sku")
    return rows.groupBy("category", "dept", "market", F.trunc("business_date", "MM").alias("month")).agg(F.count("*").alias("lines"), F.sum("discount_minor").alias("given_minor"), F.max("discount_pct").alias("deepest"))


#: a week is promoted when its lines give away this percentage or more
PROMOTED = 6
promoted = Registry(SUPPLY_SQL + f"""
, pline AS (SELECT category, dept, s.sku, market, location, CAST(date_trunc('week', business_date) AS DATE) AS week, gross_minor, discount_minor, discount_pct FROM msales s JOIN products p ON p.sku = s.sku),
pweek AS (SELECT category, market, week FROM pline GROUP BY ALL HAVING 100 * sum(discount_minor) >= {PROMOTED} * sum(gross_minor)),
pmark AS (SELECT *, CASE WHEN lag(week) OVER (PARTITION BY category, market ORDER BY week) = week - 7 THEN NULL ELSE week END AS first FROM pweek),
pspan AS (SELECT category, market, week, max(first) OVER (PARTITION BY category, market ORDER BY week) AS starts_on FROM pmark),
promo AS (SELECT l.*, starts_on, sha256(l.category || '|' || l.market || '|' || CAST(starts_on AS VARCHAR)) AS promotion_id FROM pline l JOIN pspan s ON s.category = l.category AND s.market = l.market AND s.week = l.week)
""")


def _promotion_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of promotions: runs of promoted weeks of a category in a market, named by where and when they start."""
    goods, week = products(spark, sf_dir).select("sku", "category", "dept"), F.to_date(F.date_trunc("week", "business_date"))
    lines = sale_lines(spark, sf_dir).join(locations(spark, sf_dir).select("location", "market"), "location").join(goods, "sku")
    lines = lines.select("category", "dept", "sku", "market", "location", week.alias("week"), "gross_minor", "discount_minor", "discount_pct")
    sums = lines.groupBy("category", "market", "week").agg(F.sum("discount_minor").alias("given"), F.sum("gross_minor").alias("gross"))
    walk = Window.partitionBy("category", "market").orderBy("week")
    goes_on = F.coalesce(F.lag("week").over(walk) == F.date_sub("week", 7), F.lit(False))
    weeks = sums.where(F.col("given") * 100 >= F.col("gross") * PROMOTED).withColumn("first", F.when(~goes_on, F.col("week")))
    spans = weeks.select("category", "market", "week", F.max("first").over(walk).alias("starts_on"))
    return lines.join(spans, ["category", "market", "week"]).withColumn("promotion_id", text.hash_key("category", "market", "starts_on"))


@promoted("""SELECT promotion_id, category, market, starts_on, CAST(max(week) + 6 AS DATE) AS ends_on, date_diff('day', starts_on, max(week)) // 7 + 1 AS weeks, count(*) AS lines, CAST(sum(discount_minor) AS BIGINT) AS given_minor, max(discount_pct) AS deepest,
  max(week) + 6 >= last - 90 AS active FROM promo CROSS JOIN (SELECT max(business_date) AS last FROM sales) GROUP BY promotion_id, category, market, starts_on, last""")
def canon_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotions with their span, active if they end within 90 days of the last sale."""
    last = sale_lines(spark, sf_dir).agg(F.max("business_date").alias("last"))  # one row
    sums = _promotion_lines(spark, sf_dir).groupBy("promotion_id", "category", "market", "starts_on").agg(F.date_add(F.max("week"), 6).alias("ends_on"), F.count("*").alias("lines"), F.sum("discount_minor").alias("given_minor"), F.max("discount_pct").alias("deepest"))
    weeks = F.expr("(datediff(ends_on, starts_on) + 1) div 7")
    return sums.crossJoin(F.broadcast(last)).select("promotion_id", "category", "market", "starts_on", "ends_on", weeks.alias("weeks"), "lines", "given_minor", "deepest", (F.col("ends_on") >= F.date_sub("last", 90)).alias("active"))


@promoted("SELECT sha256(promotion_id || '|' || location_key) AS scope_key, promotion_id, location_key, count(*) AS lines FROM promo p JOIN xwalk x ON x.location = p.location GROUP BY promotion_id, location_key")
def canon_promotion_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites that took part in each promotion, under a hashed key."""
    rows = _promotion_lines(spark, sf_dir).join(_sites(spark, sf_dir).select("location", "location_key"), "location")
    return rows.groupBy("promotion_id", "location_key").agg(F.count("*").alias("lines")).withColumn("scope_key", text.hash_key("promotion_id", "location_key"))


@promoted("SELECT promotion_id, CASE WHEN min(sku) = max(sku) THEN 'sku' WHEN min(dept) = max(dept) THEN 'dept' ELSE 'category' END AS target_type, CASE WHEN min(sku) = max(sku) THEN CAST(min(sku) AS VARCHAR) WHEN min(dept) = max(dept) THEN min(dept) ELSE min(category) END AS target FROM promo GROUP BY promotion_id")
def canon_promotion_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A promotion aims at the one product that it sold, at the one department, or at its category."""
    one = {c: F.min(c) == F.max(c) for c in ("sku", "dept")}
    kind = F.when(one["sku"], "sku").when(one["dept"], "dept").otherwise("category")
    target = F.when(one["sku"], F.min("sku").cast("string")).when(one["dept"], F.min("dept")).otherwise(F.min("category"))
    return _promotion_lines(spark, sf_dir).groupBy("promotion_id").agg(kind.alias("target_type"), target.alias("target"))


@query("SELECT location_key, sku, channel, CAST(sum(received_units) AS BIGINT) AS allocated, CAST(sum(units) AS BIGINT) AS requested FROM ship JOIN xwalk USING (location) GROUP BY ALL")
def canon_allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each channel of a cell was given of what it asked for."""
    return _ship(spark, sf_dir).join(_sites(spark, sf_dir), "location").groupBy("location_key", "sku", "channel").agg(F.sum("received_units").alias("allocated"), F.sum("units").alias("requested"))


@query("SELECT location_key, location_name, market, nation, first_sale FROM (SELECT location, location_key, market, nation, row_number() OVER (PARTITION BY location_key ORDER BY location DESC) AS r FROM xwalk) JOIN (SELECT location, location_name FROM locations) USING (location) LEFT JOIN (SELECT location, min(business_date) AS first_sale FROM sales GROUP BY location) USING (location) WHERE r = 1")
def canon_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each canonical site key, with its name and first sale."""
    newest = canon.latest(_sites(spark, sf_dir), ["location_key"], ["location"])
    names = locations(spark, sf_dir).select("location", "location_name")
    first = sale_lines(spark, sf_dir).groupBy("location").agg(F.min("business_date").alias("first_sale"))
    return newest.join(names, "location").join(first, "location", "left").select("location_key", "location_name", "market", "nation", "first_sale")


QUERIES, ORACLES = query.queries | promoted.queries, query.oracles | promoted.oracles
