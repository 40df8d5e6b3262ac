"""Queries of weekly features, baselines, evaluation and diagnostics over category and market series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features
from ..operators.horizons import dense_series
from ..sources.tables import category_weeks, products, read, sale_lines, scratch, weekly_series
from .basics import market_sales
from .registration import Registry

KEYS = ["category", "market"]

_W = "OVER (PARTITION BY category, market ORDER BY week"
_ROLL = ", ".join(
    f"round(avg(units) {_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS mean_{n}, round(stddev_samp(units) {_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS dev_{n}" for n in features.ROLLS
)
PANEL_SQL = f"""
, cgrid AS (SELECT category, market, CAST(unnest(generate_series(a, (SELECT max(week) FROM cweeks), INTERVAL 7 DAY)) AS DATE) AS week FROM (SELECT category, market, min(week) AS a FROM cweeks GROUP BY ALL)),
cdense AS (SELECT g.category, g.market, g.week, coalesce(c.units, 0) AS units, coalesce(c.net_minor, 0) AS net_minor, coalesce(c.lines, 0) AS lines, coalesce(c.promo_lines, 0) AS promo_lines
  FROM cgrid g LEFT JOIN cweeks c ON c.category = g.category AND c.market = g.market AND c.week = g.week),
panel0 AS (SELECT *, {", ".join(f"lag(units, {n}) {_W}) AS lag_{n}" for n in features.LAGS)}, {_ROLL},
  round(avg(CASE WHEN units = 0 THEN 1.0 ELSE 0.0 END) {_W} ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING), 6) AS zero_share_52,
  {", ".join(f"lead(units, {n}) {_W}) AS target_{n}" for n in range(1, 5))} FROM cdense),
panel AS (SELECT *, round(mean_4 / nullif(mean_13, 0), 6) AS trend_4v13 FROM panel0),
base AS (SELECT *, greatest(coalesce(CAST(lag_1 AS DOUBLE), 0), 0) AS naive, CASE WHEN lag_52 IS NOT NULL THEN greatest(CAST(lag_52 AS DOUBLE), 0) END AS seasonal_naive,
  greatest(coalesce(mean_8, 0), 0) AS ma8, greatest(coalesce(mean_13, 0), 0) AS ma13 FROM panel),
evals AS (SELECT category, market, week, CAST(target_1 AS DOUBLE) AS actual, naive, seasonal_naive, ma8, ma13, dev_13, lag_52 IS NULL AS cold FROM base WHERE target_1 IS NOT NULL)
"""

query = Registry(PANEL_SQL)

#: The written panel of each session and input, as most forecast and report queries read it.
_PANELS: dict[tuple[str, str], str] = {}


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every week of every series, missing weeks made, written once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PANELS:
        weeks = dense_series(category_weeks(market_sales(spark, sf_dir), products(spark, sf_dir)), KEYS, ("net_minor", "lines", "promo_lines"))
        path = scratch(spark, "panel")
        features.panel(weeks, KEYS).write.parquet(path)
        _PANELS[key] = path
    return spark.read.parquet(_PANELS[key])


def _evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.baselines(_panel(spark, sf_dir)).where("target_1 is not null")
    return rows.select(*KEYS, "week", F.col("target_1").cast("double").alias("actual"), "naive", "seasonal_naive", "ma8", "ma13", "dev_13", F.col("lag_52").isNull().alias("cold"))


@query("SELECT sku, location, week, units, lines, net_minor, known_as_of, round(net_minor / nullif(units, 0), 6) AS mean_price FROM weeks")
def feat_weekly_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = weekly_series(sale_lines(spark, sf_dir))
    return weeks.select("sku", "location", "week", "units", "lines", "net_minor", "known_as_of", F.round(F.col("net_minor") / F.nullif(F.col("units"), F.lit(0)), 6).alias("mean_price"))


@query("SELECT category, market, week, price, round(price / avg(price) OVER (PARTITION BY market, week), 6) AS price_index, days, days = 7 AS full_week FROM (SELECT category, market, CAST(date_trunc('week', business_date) AS DATE) AS week, sum(net_minor) / sum(units) AS price, count(DISTINCT business_date) AS days FROM msales JOIN products USING (sku) GROUP BY ALL)")
def feat_weekly_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market_sales(spark, sf_dir).join(products(spark, sf_dir).select("sku", "category"), "sku").groupBy("category", "market", F.to_date(F.date_trunc("week", "business_date")).alias("week"))
    rows = rows.agg((F.sum("net_minor") / F.sum("units")).alias("price"), F.countDistinct("business_date").alias("days"))
    index = F.round(F.col("price") / F.avg("price").over(Window.partitionBy("market", "week")), 6)
    return rows.select("category", "market", "week", "price", index.alias("price_index"), "days", (F.col("days") == 7).alias("full_week"))


@query("SELECT week, CAST(week + INTERVAL 7 DAY AS TIMESTAMP) - INTERVAL 7 HOUR AS cutoff, n FROM (SELECT CAST(date_trunc('week', business_date) AS DATE) AS week, count(*) AS n FROM sales GROUP BY ALL)")
def feat_origin_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each week's cutoff: local midnight after its Sunday, as an instant."""
    weeks = sale_lines(spark, sf_dir).groupBy(F.to_date(F.date_trunc("week", "business_date")).alias("week")).agg(F.count("*").alias("n"))
    return weeks.select("week", F.to_utc_timestamp(F.date_add("week", 7).cast("timestamp"), "Asia/Bangkok").alias("cutoff"), "n")


@query("SELECT market, week, days, lead(days, 1) OVER (PARTITION BY market ORDER BY week) AS days_1, lead(days, 2) OVER (PARTITION BY market ORDER BY week) AS days_2, lead(days, 3) OVER (PARTITION BY market ORDER BY week) AS days_3 FROM (SELECT market, CAST(date_trunc('week', business_date) AS DATE) AS week, count(DISTINCT business_date) FILTER (WHERE isodow(business_date) < 6) AS days FROM msales GROUP BY ALL)")
def feat_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working days of each market's week, and of the weeks to come."""
    work = F.countDistinct(F.when(F.weekday("business_date") < 5, F.col("business_date")))
    weeks = market_sales(spark, sf_dir).groupBy("market", F.to_date(F.date_trunc("week", "business_date")).alias("week")).agg(work.alias("days"))
    walk = Window.partitionBy("market").orderBy("week")
    return weeks.withColumns({f"days_{n}": F.lead("days", n).over(walk) for n in (1, 2, 3)})


_SERIES = """(SELECT category, market, min(week) AS first_week, max(week) AS last_week, count(*) AS observed_weeks, count(*) FILTER (WHERE lines > 0) AS sold_weeks,
  CASE WHEN count(*) < 52 THEN 'cold_start' WHEN count(*) < 104 THEN 'developing' ELSE 'established' END AS stage, round(avg(CASE WHEN units = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share,
  arg_max(zero_share_52, week) AS current_zero_share, coalesce(arg_max(zero_share_52, week) > 0.6, false) AS slow_mover, round(avg(units), 6) AS mean_units, round(var_samp(units) / nullif(avg(units), 0), 5) AS dispersion,
  round(CASE WHEN isfinite(corr(units, lag_1)) THEN corr(units, lag_1) END, 6) AS autocorrelation, round(avg(units) FILTER (WHERE promo_lines > 0) / nullif(avg(units) FILTER (WHERE promo_lines = 0), 0), 6) AS event_ratio
  FROM panel GROUP BY category, market)"""


@query(f"SELECT * FROM {_SERIES}")
def feat_characterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.characterise(_panel(spark, sf_dir), KEYS)


_MEDIANS = ("zero_share", "dispersion", "autocorrelation", "event_ratio")


@query(f"SELECT market, count(*) AS n_series, count(*) FILTER (WHERE slow_mover) AS slow_movers, {', '.join(f"count(*) FILTER (WHERE stage = '{k}') AS {k}" for k in ('cold_start', 'developing', 'established'))}, {', '.join(f'round(median({c}), 8) AS {c}' for c in _MEDIANS)} FROM {_SERIES} GROUP BY market")
def feat_characterise_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of each market by stage, its slow movers and the medians of what characterises them."""
    stages = [F.count_if(F.col("stage") == k).alias(k) for k in ("cold_start", "developing", "established")]
    rows = features.characterise(_panel(spark, sf_dir), KEYS).groupBy("market")
    return rows.agg(F.count("*").alias("n_series"), F.count_if("slow_mover").alias("slow_movers"), *stages, *(F.round(F.median(c), 8).alias(c) for c in _MEDIANS))


@query("SELECT " + ", ".join(f"count({c}) AS {c}" for c in ("lag_1", "lag_52", "mean_13", "dev_13", "target_1", "target_4")) + ", count(*) AS n FROM panel")
def feat_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have each column, in one pass."""
    columns = ("lag_1", "lag_52", "mean_13", "dev_13", "target_1", "target_4")
    return _panel(spark, sf_dir).agg(*(F.count(c).alias(c) for c in columns), F.count("*").alias("n"))


@query("SELECT p.category, p.market, p.week, p.units, p.mean_13, p.target_1 FROM panel p JOIN (SELECT DISTINCT week FROM panel WHERE week <= DATE '2001-04-30' ORDER BY week DESC LIMIT 104) o USING (week) WHERE p.lag_13 IS NOT NULL AND p.target_1 IS NOT NULL")
def train_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 104 origins before the embargo, one horizon."""
    rows = _panel(spark, sf_dir)
    origins = rows.where("week <= date'2001-04-30'").select("week").distinct().orderBy(F.desc("week")).limit(104)
    return rows.join(origins, "week", "left_semi").where("lag_13 is not null and target_1 is not null").select(*KEYS, "week", "units", "mean_13", "target_1")


@query("SELECT week FROM (SELECT week, row_number() OVER (ORDER BY week DESC) AS r FROM (SELECT DISTINCT week FROM panel WHERE target_4 IS NOT NULL)) WHERE r <= 26 AND r % 2 = 1")
def scoring_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second of the last 26 eligible weeks; the ranking is of those 26 only."""
    last = _panel(spark, sf_dir).where("target_4 is not null").select("week").distinct().orderBy(F.desc("week")).limit(26)
    return last.withColumn("r", F.row_number().over(Window.orderBy(F.desc("week")))).where("r % 2 = 1").select("week")


@query("SELECT category, market, week, h, units FROM (SELECT category, market, week, unnest([1, 2, 3, 4]) AS h, unnest([target_1, target_2, target_3, target_4]) AS units FROM panel WHERE week = DATE '2000-01-03')")
def eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel(spark, sf_dir).where("week = date'2000-01-03'")
    return rows.select(*KEYS, "week", F.expr("stack(4, 1, target_1, 2, target_2, 3, target_3, 4, target_4) AS (h, units)"))


@query("SELECT category, market, week, naive, seasonal_naive, ma8, ma13 FROM base")
def fc_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.baselines(_panel(spark, sf_dir)).select(*KEYS, "week", "naive", "seasonal_naive", "ma8", "ma13")


_CROSTON = """
, months AS (SELECT sku, date_diff('month', (SELECT min(business_date) FROM sales), business_date) AS w, CAST(sum(units) AS DOUBLE) AS u FROM sales GROUP BY ALL),
hits AS (SELECT sku, w, u, row_number() OVER (PARTITION BY sku ORDER BY w) AS k, CAST(w - lag(w) OVER (PARTITION BY sku ORDER BY w) AS DOUBLE) AS gap FROM months WHERE u > 0),
ends AS (SELECT sku, max(k) AS n FROM hits GROUP BY sku)
SELECT sku, round(0.95 * z / greatest(p, 1.0), 6) AS forecast FROM (SELECT h.sku,
    sum(CASE WHEN k = 1 THEN pow(0.9, n - 1) * u ELSE 0.1 * pow(0.9, n - k) * u END) AS z,
    sum(CASE WHEN k = 1 THEN pow(0.9, n - 1) * (w + 1) ELSE 0.1 * pow(0.9, n - k) * gap END) AS p FROM hits h JOIN ends e ON h.sku = e.sku GROUP BY h.sku)"""


@query(_CROSTON)
def fc_croston(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Croston forecast of each product from the first month of all sales to the last; the SQL has the smoothing in closed form."""
    lines = sale_lines(spark, sf_dir)
    span = lines.agg(F.trunc(F.min("business_date"), "MM").alias("first"), F.trunc(F.max("business_date"), "MM").alias("last"))  # one row
    month = F.months_between(F.trunc("business_date", "MM"), "first").cast("int")
    last = F.months_between("last", "first").cast("int")
    sums = lines.crossJoin(F.broadcast(span)).groupBy("sku", month.alias("w"), last.alias("n")).agg(F.sum("units").alias("u"))
    found = sums.groupBy("sku", "n").agg(F.map_from_entries(F.collect_list(F.struct("w", "u"))).alias("by_month"))  # a month each
    values = F.transform(F.sequence(F.lit(0), F.col("n")), lambda w: F.coalesce(F.try_element_at("by_month", w), F.lit(0).cast("long")))
    return found.withColumn("values", values).select("sku", F.round(features.croston(F.col("values")), 6).alias("forecast"))


OWN_ROWS = 200


@query(f"""SELECT market, n, n >= {OWN_ROWS} AS own, round(CASE WHEN n >= {OWN_ROWS} THEN o50 ELSE g50 END, 6) AS offset_p50, round(CASE WHEN n >= {OWN_ROWS} THEN o90 ELSE g90 END, 6) AS offset_p90 FROM
  (SELECT market, count(*) AS n, quantile_cont(actual - ma13, 0.5) AS o50, quantile_cont(actual - ma13, 0.9) AS o90 FROM evals GROUP BY market) CROSS JOIN (SELECT quantile_cont(actual - ma13, 0.5) AS g50, quantile_cont(actual - ma13, 0.9) AS g90 FROM evals)""")
def fc_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of P50 and P90 by market; a market of fewer than OWN_ROWS rows takes those of all."""
    rest, whole = F.col("actual") - F.col("ma13"), Window.partitionBy()
    sums = _evals(spark, sf_dir).groupingSets([["market"], []], "market").agg(F.grouping("market").alias("all"), F.count("*").alias("n"), F.percentile(rest, 0.5).alias("o50"), F.percentile(rest, 0.9).alias("o90"))
    # a row for each market and one for all
    told = sums.withColumns({f"g{k}": F.max(F.when(F.col("all") == 1, F.col(f"o{k}"))).over(whole) for k in (50, 90)}).where("all = 0")
    own = F.col("n") >= OWN_ROWS
    return told.select("market", "n", own.alias("own"), *(F.round(F.when(own, F.col(f"o{k}")).otherwise(F.col(f"g{k}")), 6).alias(f"offset_p{k}") for k in (50, 90)))


#: offsets are fitted on the weeks before this one and judged on the others
FITTED = "2000-01-01"
_CAL = f"SELECT e.*, greatest(0, ma13 + o50) AS p50, greatest(0, ma13 + o50, ma13 + o90) AS p90 FROM evals e JOIN (SELECT market, quantile_cont(actual - ma13, 0.5) AS o50, quantile_cont(actual - ma13, 0.9) AS o90 FROM evals WHERE week < DATE '{FITTED}' GROUP BY market) USING (market) WHERE week >= DATE '{FITTED}'"


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fitted = _evals(spark, sf_dir), F.col("week") < F.lit(FITTED).cast("date")
    rest = F.col("actual") - F.col("ma13")
    offsets = rows.where(fitted).groupBy("market").agg(F.percentile(rest, 0.5).alias("o50"), F.percentile(rest, 0.9).alias("o90"))
    low, high = F.col("ma13") + F.col("o50"), F.col("ma13") + F.col("o90")
    return rows.where(~fitted).join(offsets, "market").withColumns({"p50": F.greatest(F.lit(0.0), low), "p90": F.greatest(F.lit(0.0), low, high)})


@query(f"""SELECT market, cohort, n, round(coverage, 6) AS coverage, coverage BETWEEN 0.85 AND 0.95 AS passes, monotone FROM (
  SELECT market, CASE WHEN grouping(cold) = 1 THEN 'all' WHEN cold THEN 'cold_start' ELSE 'established' END AS cohort, count(*) AS n, avg(CASE WHEN actual <= p90 THEN 1.0 ELSE 0.0 END) AS coverage, bool_and(p90 >= p50) AS monotone
  FROM ({_CAL}) GROUP BY GROUPING SETS ((market), (market, cold)))""")
def fc_gate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of later actuals within P90, whole and by cohort, that must lie between 0.85 and 0.95."""
    cohort = F.when(F.grouping("cold") == 1, "all").when(F.col("cold"), "cold_start").otherwise("established")
    covered = F.avg(F.when(F.col("actual") <= F.col("p90"), 1.0).otherwise(0.0))
    rows = _calibrated(spark, sf_dir).groupingSets([["market"], ["market", "cold"]], "market", "cold")
    rows = rows.agg(cohort.alias("cohort"), F.count("*").alias("n"), covered.alias("c"), F.bool_and(F.col("p90") >= F.col("p50")).alias("monotone"))
    return rows.select("market", "cohort", "n", F.round("c", 6).alias("coverage"), F.col("c").between(0.85, 0.95).alias("passes"), "monotone")


@query(f"SELECT category, market, round(sum(greatest(p50, 1) / (1 + (p90 - p50) / greatest(p50, 1))) / sum(greatest(p50, 1)), 6) AS confidence FROM ({_CAL}) GROUP BY ALL")
def fc_confidence_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence 1 / (1 + spread / max(P50, 1)), averaged by max(P50, 1)."""
    weight = F.greatest("p50", F.lit(1.0))
    sure = 1 / (1 + (F.col("p90") - F.col("p50")) / weight)
    return _calibrated(spark, sf_dir).groupBy("category", "market").agg(F.round(F.sum(weight * sure) / F.sum(weight), 6).alias("confidence"))


@query("SELECT market, round(least(1.25, greatest(0.8, sum(actual) / nullif(sum(ma13), 0))), 6) AS factor FROM evals WHERE week < DATE '2000-01-01' GROUP BY market")
def fc_bias_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.sum("actual") / F.nullif(F.sum("ma13"), F.lit(0.0))
    return _evals(spark, sf_dir).where("week < date'2000-01-01'").groupBy("market").agg(F.round(F.least(F.lit(1.25), F.greatest(F.lit(0.8), factor)), 6).alias("factor"))


@query("""SELECT category, market, week, round(ma13, 4) AS bottom_up, round(t * w, 4) AS top_down, round(CASE WHEN b > 0 THEN ma13 * t / b END, 4) AS proportional FROM (
  SELECT *, CAST(sum(CAST(ma13 AS DECIMAL(18,6))) OVER (PARTITION BY market, week) AS DOUBLE) AS b, CAST(sum(lag_u) OVER (PARTITION BY market, week) AS DOUBLE) AS t,
    CAST(sum(lag_u) OVER (PARTITION BY category, market ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / nullif(sum(lag_u) OVER (PARTITION BY market ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS w
  FROM (SELECT *, coalesce(lag_1, 0) AS lag_u FROM base))""")
def fc_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-up, top-down by the share of what was sold before, and leaves scaled to their parent's total."""
    rows = features.baselines(_panel(spark, sf_dir)).withColumn("u", F.coalesce("lag_1", F.lit(0)).cast("long"))
    of_week = Window.partitionBy("market", "week")
    own, parent = (Window.partitionBy(*k).orderBy("week").rangeBetween(Window.unboundedPreceding, Window.currentRow) for k in (KEYS, ["market"]))
    share = F.sum("u").over(own).cast("double") / F.nullif(F.sum("u").over(parent), F.lit(0))
    total, leaves = F.sum("u").over(of_week).cast("double"), F.sum(F.col("ma13").cast("decimal(18,6)")).over(of_week).cast("double")
    return rows.select(*KEYS, "week", F.round("ma13", 4).alias("bottom_up"), F.round(total * share, 4).alias("top_down"), F.round(F.when(leaves > 0, F.col("ma13") * total / leaves), 4).alias("proportional"))


@query("SELECT category, market, round(err, 4) AS err, round(err / sum(err) OVER (), 6) AS mass, err / sum(err) OVER () >= 0.05 AS material, CASE WHEN signed > 0.02 * actual THEN 'over' WHEN signed < -0.02 * actual THEN 'under' ELSE 'neutral' END AS bias FROM (SELECT category, market, sum(abs(ma13 - actual)) AS err, sum(ma13 - actual) AS signed, sum(actual) AS actual FROM evals GROUP BY ALL)")
def fc_error_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the absolute error by slice; the total is a one-row join, not a window over all rows."""
    e = F.col("ma13") - F.col("actual")
    slices = _evals(spark, sf_dir).groupBy(*KEYS).agg(F.sum(F.abs(e)).alias("err"), F.sum(e).alias("signed"), F.sum("actual").alias("actual"))
    whole = slices.crossJoin(slices.agg(F.sum("err").alias("total")))
    mass = F.col("err") / F.col("total")
    bias = F.when(F.col("signed") > 0.02 * F.col("actual"), "over").when(F.col("signed") < -0.02 * F.col("actual"), "under").otherwise("neutral")
    return whole.select(*KEYS, F.round("err", 4).alias("err"), F.round(mass, 6).alias("mass"), (mass >= 0.05).alias("material"), bias.alias("bias"))


@query(None)
def fc_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of the gain over the naive baseline from 500 resamples of series.

    A series enters a sample as often as a Poisson draw by hash says, so samples are formed in one
    aggregate without collecting series.
    """
    by_series = _evals(spark, sf_dir).groupBy(*KEYS).agg(F.sum(F.abs(F.col("ma13") - F.col("actual"))).alias("a"), F.sum(F.abs(F.col("naive") - F.col("actual"))).alias("b"))
    u = (F.pmod(F.xxhash64("category", "market", "sample"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    bounds = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    times = sum((F.when(u > b, 1).otherwise(0) for b in bounds), F.lit(0))
    drawn = by_series.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(500)))).withColumn("k", times)
    gains = drawn.groupBy("sample").agg((1 - F.sum(F.col("k") * F.col("a")) / F.sum(F.col("k") * F.col("b"))).alias("gain"))
    return gains.agg(F.percentile("gain", 0.025).alias("low"), F.percentile("gain", 0.5).alias("middle"), F.percentile("gain", 0.975).alias("high"))


@query("SELECT user_id, event_type, ts, gap_minutes > 720 AS new_session FROM (SELECT user_id, event_type, ts, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 60000000.0 AS gap_minutes FROM events) WHERE gap_minutes IS NOT NULL")
def fc_history_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in a status log: where more than half a day passed since the entry before."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 60000000.0
    return read(spark, sf_dir, "events").withColumn("gap", gap).where("gap is not null").select("user_id", "event_type", "ts", (F.col("gap") > 720).alias("new_session"))


QUERIES, ORACLES = query.queries, query.oracles
