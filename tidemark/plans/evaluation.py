"""Queries of cohorts, comparators, acceptance gates, corrections, drivers and quality classes of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features
from .forecast import _CAL, KEYS, PANEL_SQL, _calibrated, _evals, _panel
from .registration import Registry

query = Registry(PANEL_SQL)


def total(value: Column) -> Column:
    """Sum that doesn't depend on the order of rows."""
    return F.sum(value.cast("decimal(18,6)")).cast("double")


def tot(sql: str) -> str:
    return f"CAST(sum(CAST({sql} AS DECIMAL(18,6))) AS DOUBLE)"


def error(forecast: str = "ma13") -> Column:
    return F.abs(F.col(forecast) - F.col("actual"))


_ERR, _NAIVE = "abs(ma13 - actual)", "abs(naive - actual)"


def ratio(a: Column, b: Column, places: int = 6) -> Column:
    return F.round(a / F.nullif(b, F.lit(0.0)), places)


@query(f"""SELECT market, n, round(err / nullif(act, 0), 6) AS wape, round(sgn / nullif(act, 0), 6) AS bias, round(greatest(0, 1 - err / nullif(act, 0)), 6) AS accuracy, round(covered / n, 6) AS coverage FROM (
  SELECT market, count(*) AS n, {tot(_ERR)} AS err, {tot("ma13 - actual")} AS sgn, {tot("actual")} AS act, count(*) FILTER (WHERE actual <= p90) AS covered FROM ({_CAL}) GROUP BY market)""")
def fc_additive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error sums first, ratios of them last: weighted absolute error, bias, accuracy and coverage."""
    rows = _calibrated(spark, sf_dir).groupBy("market").agg(F.count("*").alias("n"), total(error()).alias("err"), total(F.col("ma13") - F.col("actual")).alias("sgn"), total(F.col("actual")).alias("act"), F.count_if(F.col("actual") <= F.col("p90")).alias("covered"))
    wape = F.col("err") / F.nullif(F.col("act"), F.lit(0.0))
    return rows.select("market", "n", F.round(wape, 6).alias("wape"), ratio(F.col("sgn"), F.col("act")).alias("bias"), F.round(F.greatest(F.lit(0.0), 1 - wape), 6).alias("accuracy"), F.round(F.col("covered") / F.col("n"), 6).alias("coverage"))


@query(f"SELECT category, market, week, round(1 / (1 + (p90 - p50) / greatest(p50, 1)), 6) AS confidence FROM ({_CAL})")
def fc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 / (1 + spread / max(P50, 1)) of each row."""
    return _calibrated(spark, sf_dir).select(*KEYS, "week", F.round(1 / (1 + (F.col("p90") - F.col("p50")) / F.greatest("p50", F.lit(1.0))), 6).alias("confidence"))


@query("SELECT category, market, week, actual, ma13, seasonal_naive, count(*) OVER (PARTITION BY category, market, week) AS copies FROM evals WHERE isfinite(actual) AND isfinite(ma13) AND seasonal_naive IS NOT NULL")
def fc_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose actual, champion and comparator are all there, with how often their key occurs."""
    rows = _evals(spark, sf_dir).where("actual is not null and ma13 is not null and seasonal_naive is not null and not isnan(actual) and not isnan(ma13)")
    return rows.select(*KEYS, "week", "actual", "ma13", "seasonal_naive", F.count("*").over(Window.partitionBy(*KEYS, "week")).alias("copies"))


@query(f"SELECT category, market, n, round(1 - a / nullif(b, 0), 6) AS gain, a < b AS better FROM (SELECT category, market, count(*) AS n, {tot(_ERR)} AS a, {tot('abs(seasonal_naive - actual)')} AS b FROM evals WHERE seasonal_naive IS NOT NULL GROUP BY ALL)")
def fc_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative gain of the champion over the paired seasonal naive forecast."""
    rows = _evals(spark, sf_dir).where("seasonal_naive is not null").groupBy(*KEYS).agg(F.count("*").alias("n"), total(error()).alias("a"), total(F.abs(F.col("seasonal_naive") - F.col("actual"))).alias("b"))
    return rows.select(*KEYS, "n", F.round(1 - F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), 6).alias("gain"), (F.col("a") < F.col("b")).alias("better"))


_COHORT = "CASE WHEN dev_13 IS NULL THEN 'ineligible' WHEN cold THEN 'cold_start' ELSE 'established' END"


def _cohort() -> Column:
    return F.when(F.col("dev_13").isNull(), "ineligible").when(F.col("cold"), "cold_start").otherwise("established")


@query(f"SELECT market, cohort, n, round(n / sum(n) OVER (PARTITION BY market), 6) AS share, cohort <> 'ineligible' OR n <= 0.01 * sum(n) OVER (PARTITION BY market) AS within_cap FROM (SELECT market, {_COHORT} AS cohort, count(*) AS n FROM evals GROUP BY ALL)")
def fc_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by cohort; at most one percent of a market may be ineligible."""
    rows = _evals(spark, sf_dir).groupBy("market", _cohort().alias("cohort")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("market"))
    return rows.select("market", "cohort", "n", F.round(F.col("n") / whole, 6).alias("share"), ((F.col("cohort") != "ineligible") | (F.col("n") <= 0.01 * whole)).alias("within_cap"))


_COLD = """(SELECT category, market, CAST(sum(units) AS DOUBLE) / count(*) AS comparator, count(*) AS weeks FROM (
  SELECT category, market, units, row_number() OVER (PARTITION BY category, market ORDER BY week DESC) AS r FROM cweeks WHERE week < DATE '2000-01-01' AND lines >= 2) WHERE r <= 13 GROUP BY ALL)"""


def _comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each series' last thirteen complete weeks before the fit."""
    newest = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("week")))
    rows = _panel(spark, sf_dir).where("week < date'2000-01-01' and lines >= 2").withColumn("r", newest).where("r <= 13")
    return rows.groupBy(*KEYS).agg((F.sum("units").cast("double") / F.count("*")).alias("comparator"), F.count("*").alias("weeks"))


@query(f"SELECT category, market, round(comparator, 6) AS comparator, weeks FROM {_COLD}")
def fc_cold_comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a series without a year of history is compared with."""
    return _comparator(spark, sf_dir).select(*KEYS, F.round("comparator", 6).alias("comparator"), "weeks")


@query(f"SELECT e.category, e.market, e.week, e.actual, e.ma13, round(coalesce(c.comparator, e.naive), 6) AS comparator, c.comparator IS NULL AS fallback FROM evals e LEFT JOIN {_COLD} c USING (category, market) WHERE week >= DATE '2000-01-01'")
def fc_attach_comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evals(spark, sf_dir).where("week >= date'2000-01-01'").join(_comparator(spark, sf_dir), KEYS, "left")
    return rows.select(*KEYS, "week", "actual", "ma13", F.round(F.coalesce("comparator", "naive"), 6).alias("comparator"), F.col("comparator").isNull().alias("fallback"))


@query("SELECT market, count(*) AS n, bit_xor(CAST('0x' || substr(sha256(category || '|' || market || '|' || CAST(week AS VARCHAR)), 1, 15) AS BIGINT)) AS key_hash FROM evals GROUP BY market")
def fc_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for a set of row keys, whatever their order."""
    key = F.conv(F.substring(F.sha2(F.concat_ws("|", "category", "market", F.col("week").cast("string")), 256), 1, 15), 16, 10).cast("long")
    return _evals(spark, sf_dir).groupBy("market").agg(F.count("*").alias("n"), F.bit_xor(key).alias("key_hash"))


@query(f"""SELECT market, least_rows, round(a / nullif(act, 0), 6) AS wape, least_rows >= 2 AND a <= b AS passes FROM (SELECT market, min(n) AS least_rows, sum(a) AS a, sum(b) AS b, sum(act) AS act FROM (
  SELECT market, week, count(*) AS n, {tot(_ERR)} AS a, {tot(_NAIVE)} AS b, {tot("actual")} AS act FROM evals WHERE ma13 < 2000 GROUP BY ALL) GROUP BY market)""".replace("sum(a) AS a, sum(b) AS b, sum(act) AS act", "sum(CAST(a AS DECIMAL(18,6)))::DOUBLE AS a, sum(CAST(b AS DECIMAL(18,6)))::DOUBLE AS b, sum(CAST(act AS DECIMAL(18,6)))::DOUBLE AS act"))
def fc_gate_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow movers: enough rows at every origin, and no worse than the naive forecast."""
    by_origin = _evals(spark, sf_dir).where("ma13 < 2000").groupBy("market", "week").agg(F.count("*").alias("n"), total(error()).alias("a"), total(error("naive")).alias("b"), total(F.col("actual")).alias("act"))
    rows = by_origin.groupBy("market").agg(F.min("n").alias("least_rows"), total(F.col("a")).alias("a"), total(F.col("b")).alias("b"), total(F.col("act")).alias("act"))
    return rows.select("market", "least_rows", ratio(F.col("a"), F.col("act")).alias("wape"), ((F.col("least_rows") >= 2) & (F.col("a") <= F.col("b"))).alias("passes"))


@query(f"SELECT market, count(*) AS n, count(*) FILTER (WHERE p90 < p50) AS crossed, bool_and(p90 >= p50) AS passes FROM ({_CAL}) GROUP BY market")
def fc_gate_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    crossed = F.col("p90") < F.col("p50")
    return _calibrated(spark, sf_dir).groupBy("market").agg(F.count("*").alias("n"), F.count_if(crossed).alias("crossed"), F.bool_and(~crossed).alias("passes"))


@query(f"""SELECT scope, gain, coverage, gain_passes, coverage_passes, monotone, gain_passes AND coverage_passes AND monotone AS accepted FROM (
  SELECT scope, round(1 - a / nullif(b, 0), 6) AS gain, round(c / n, 6) AS coverage, 1 - a / nullif(b, 0) >= 0.05 AS gain_passes, c / n BETWEEN 0.85 AND 0.95 AS coverage_passes, monotone FROM (
  SELECT CASE WHEN grouping(market) = 1 THEN 'all' ELSE market END AS scope, count(*) AS n, count(*) FILTER (WHERE actual <= p90) AS c, {tot(_ERR)} AS a, {tot(_NAIVE)} AS b, bool_and(p90 >= p50) AS monotone
  FROM ({_CAL}) GROUP BY GROUPING SETS ((), (market))))""")
def fc_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates, over everything and by market, in one pass."""
    scope = F.when(F.grouping("market") == 1, "all").otherwise(F.col("market"))
    rows = _calibrated(spark, sf_dir).groupingSets([[], ["market"]], "market").agg(
        scope.alias("scope"), F.count("*").alias("n"), F.count_if(F.col("actual") <= F.col("p90")).alias("c"), total(error()).alias("a"), total(error("naive")).alias("b"), F.bool_and(F.col("p90") >= F.col("p50")).alias("monotone")
    )
    gain, cover = 1 - F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), F.col("c") / F.col("n")
    out = rows.select("scope", F.round(gain, 6).alias("gain"), F.round(cover, 6).alias("coverage"), (gain >= 0.05).alias("gain_passes"), cover.between(0.85, 0.95).alias("coverage_passes"), "monotone")
    return out.withColumn("accepted", F.col("gain_passes") & F.col("coverage_passes") & F.col("monotone"))


@query("SELECT week, CASE WHEN row_number() OVER (ORDER BY week DESC) <= 13 THEN 'confirmation' ELSE 'development' END AS part FROM (SELECT DISTINCT week FROM evals)")
def fc_split_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirteen origins confirm, those before develop; the cut is a date, so no window over all rows is needed."""
    weeks = _evals(spark, sf_dir).select("week").distinct()
    cut = weeks.orderBy(F.desc("week")).limit(13).agg(F.min("week").alias("cut"))  # one row
    return weeks.crossJoin(F.broadcast(cut)).select("week", F.when(F.col("week") >= F.col("cut"), "confirmation").otherwise("development").alias("part"))


_SPREAD = "(SELECT market, least(2.0, greatest(0.5, quantile_cont((actual - ma13) / nullif(1.2816 * dev_13, 0), 0.9))) AS k FROM evals WHERE NOT cold AND dev_13 > 0 AND week < DATE '2000-01-01' GROUP BY market)"


@query(f"SELECT e.category, e.market, e.week, round(ma13 + 1.2816 * dev_13 * CASE WHEN cold THEN 1 ELSE coalesce(k, 1) END, 4) AS p90 FROM evals e LEFT JOIN {_SPREAD} s USING (market) WHERE dev_13 IS NOT NULL AND week >= DATE '2000-01-01'")
def fc_interval_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multiplier of the spread, fitted on earlier weeks, for the established cohort only."""
    rows = _evals(spark, sf_dir)
    rest = (F.col("actual") - F.col("ma13")) / F.nullif(1.2816 * F.col("dev_13"), F.lit(0.0))
    fitted = rows.where("not cold and dev_13 > 0 and week < date'2000-01-01'").groupBy("market").agg(F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.percentile(rest, 0.9))).alias("k"))
    used = rows.where("dev_13 is not null and week >= date'2000-01-01'").join(fitted, "market", "left")
    factor = F.when(F.col("cold"), F.lit(1.0)).otherwise(F.coalesce("k", F.lit(1.0)))
    return used.select(*KEYS, "week", F.round(F.col("ma13") + 1.2816 * F.col("dev_13") * factor, 4).alias("p90"))


_BLEND = "(SELECT market, arg_min(g, (err, g)) / 20.0 AS weight FROM (SELECT market, g, round(sum(abs((g / 20.0) * naive + (1 - g / 20.0) * ma13 - actual)), 3) AS err FROM evals CROSS JOIN (SELECT unnest(range(21)) AS g) WHERE week < DATE '2000-01-01' GROUP BY ALL) GROUP BY market)"


@query(f"SELECT c.category, c.market, c.week, round(b, 4) AS p50, round(b + (p90 - p50), 4) AS p90, weight FROM (SELECT x.*, w.weight, w.weight * naive + (1 - w.weight) * p50 AS b FROM ({_CAL}) x JOIN {_BLEND} w USING (market)) c")
def fc_blend_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier weeks' best blend with the naive forecast moves the median and keeps the width."""
    errors = [F.round(F.sum(F.abs((g / 20) * F.col("naive") + (1 - g / 20) * F.col("ma13") - F.col("actual"))), 3).alias(f"e{g}") for g in range(21)]
    sums = _evals(spark, sf_dir).where("week < date'2000-01-01'").groupBy("market").agg(*errors)
    best = F.array_min(F.array(*(F.struct(F.col(f"e{g}").alias("e"), F.lit(g).alias("g")) for g in range(21))))["g"]
    rows = _calibrated(spark, sf_dir).join(sums.select("market", (best / 20.0).alias("weight")), "market")
    middle = F.col("weight") * F.col("naive") + (1 - F.col("weight")) * F.col("p50")
    return rows.select(*KEYS, "week", F.round(middle, 4).alias("p50"), F.round(middle + (F.col("p90") - F.col("p50")), 4).alias("p90"), "weight")


@query(f"""SELECT 'leaf' AS grain, round({tot(_ERR)} / {tot("actual")}, 6) AS wape FROM evals UNION ALL
  SELECT 'market', round({tot("abs(f - a)")} / {tot("a")}, 6) FROM (SELECT {tot("ma13")} AS f, {tot("actual")} AS a FROM evals GROUP BY market, week) UNION ALL
  SELECT 'category', round({tot("abs(f - a)")} / {tot("a")}, 6) FROM (SELECT {tot("ma13")} AS f, {tot("actual")} AS a FROM evals GROUP BY category, week)""")
def fc_leaf_vs_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same forecast judged at its leaves, by market and by category."""
    rows = _evals(spark, sf_dir)

    def judged(grain: str, *keys: str) -> DataFrame:
        sums = rows.groupBy(*keys, "week").agg(total(F.col("ma13")).alias("f"), total(F.col("actual")).alias("a"))
        return sums.agg(F.round(total(F.abs(F.col("f") - F.col("a"))) / total(F.col("a")), 6).alias("wape")).select(F.lit(grain).alias("grain"), "wape")

    return judged("leaf", *KEYS).unionByName(judged("market", "market")).unionByName(judged("category", "category"))


@query("SELECT category, market, week, h, CASE WHEN NOT (cold AND h > 2) THEN round(ma13 + 1.2816 * dev_13 * sqrt(h), 4) END AS p90, cold AND h > 2 AS withheld FROM evals CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS h) WHERE week >= DATE '2001-01-01'")
def fc_withhold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the far weeks are withheld for series without a year of history."""
    rows = _evals(spark, sf_dir).where("week >= date'2001-01-01'").withColumn("h", F.explode(F.array(*(F.lit(h) for h in (1, 2, 3, 4)))))
    far = F.col("cold") & (F.col("h") > 2)
    return rows.select(*KEYS, "week", "h", F.when(~far, F.round(F.col("ma13") + 1.2816 * F.col("dev_13") * F.sqrt("h"), 4)).alias("p90"), far.alias("withheld"))


@query(f"""SELECT cause, slice, round(err, 4) AS err, round(err / w, 6) AS mass FROM (
  SELECT 'market' AS cause, market AS slice, {tot(_ERR)} AS err FROM evals GROUP BY market UNION ALL SELECT 'category', category, {tot(_ERR)} FROM evals GROUP BY category UNION ALL
  SELECT 'history', CASE WHEN cold THEN 'short' ELSE 'full' END, {tot(_ERR)} FROM evals GROUP BY ALL UNION ALL
  SELECT 'direction', CASE WHEN ma13 > actual THEN 'over' ELSE 'under' END, {tot(_ERR)} FROM evals GROUP BY ALL) CROSS JOIN (SELECT {tot(_ERR)} AS w FROM evals) WHERE err >= 0.05 * w""")
def fc_rank_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of four hypotheses that carry at least five percent of the absolute error, in one pass over the rows."""
    causes = F.array(
        F.struct(F.lit("market").alias("cause"), F.col("market").alias("slice")),
        F.struct(F.lit("category").alias("cause"), F.col("category").alias("slice")),
        F.struct(F.lit("history").alias("cause"), F.when(F.col("cold"), "short").otherwise("full").alias("slice")),
        F.struct(F.lit("direction").alias("cause"), F.when(F.col("ma13") > F.col("actual"), "over").otherwise("under").alias("slice")),
    )
    slices = _evals(spark, sf_dir).withColumn("x", F.explode(causes)).groupBy("x.cause", "x.slice").agg(total(error()).alias("err"))
    whole = slices.where("cause = 'direction'").agg(F.sum("err").alias("w"))
    return slices.crossJoin(F.broadcast(whole)).where("err >= 0.05 * w").select("cause", "slice", F.round("err", 4).alias("err"), F.round(F.col("err") / F.col("w"), 6).alias("mass"))


_PARTS = {"level": "ma13", "season": "coalesce(seasonal_naive, ma13) - ma13", "recent": "naive - ma13"}
_DRIVERS = " UNION ALL ".join(f"SELECT market, '{k}' AS driver, {tot(v)} AS c FROM evals GROUP BY market" for k, v in _PARTS.items())


def _contributions(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(k).alias("driver"), F.expr(v).alias("value")) for k, v in _PARTS.items()))
    return _evals(spark, sf_dir).withColumn("x", F.explode(parts)).groupBy(*keys, "x.driver").agg(total(F.col("x.value")).alias("c"))


@query(f"SELECT market, driver, round(c, 4) AS contribution, round(abs(c) / sum(abs(c)) OVER (PARTITION BY market), 6) AS share, CASE WHEN c > 0 THEN 'up' WHEN c < 0 THEN 'down' ELSE 'none' END AS direction FROM ({_DRIVERS})")
def fc_baseline_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed parts of the forecast, and each one's share of their absolute sum."""
    rows = _contributions(spark, sf_dir, "market")
    size, c = F.abs("c"), F.col("c")
    way = F.when(c > 0, "up").when(c < 0, "down").otherwise("none")
    return rows.select("market", "driver", F.round("c", 4).alias("contribution"), F.round(size / F.sum(size).over(Window.partitionBy("market")), 6).alias("share"), way.alias("direction"))


_DRIVER_ROWS = " UNION ALL ".join(f"SELECT category, market, '{k}' AS driver, {v} AS v FROM evals" for k, v in _PARTS.items())


@query(f"SELECT coalesce(category, 'portfolio') AS category, coalesce(market, 'portfolio') AS market, driver, round({tot('v')}, 4) AS contribution FROM ({_DRIVER_ROWS}) GROUP BY GROUPING SETS ((driver), (category, market, driver))")
def fc_baseline_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each series, and of the portfolio, in one pass."""
    parts = F.array(*(F.struct(F.lit(k).alias("driver"), F.expr(v).alias("value")) for k, v in _PARTS.items()))
    rows = _evals(spark, sf_dir).withColumn("x", F.explode(parts)).select(*KEYS, F.col("x.driver").alias("driver"), F.col("x.value").alias("v"))
    sums = rows.groupingSets([["driver"], [*KEYS, "driver"]], *KEYS, "driver").agg(F.round(total(F.col("v")), 4).alias("contribution"))
    return sums.select(*(F.coalesce(k, F.lit("portfolio")).alias(k) for k in KEYS), "driver", "contribution")


_SLOW = """, hist AS (SELECT category, market, CAST(date_trunc('month', week) AS DATE) AS month, CAST(sum(units) AS DOUBLE) AS u FROM cdense GROUP BY ALL),
moved AS (SELECT category, market, month, u, lag(u, 12) OVER (PARTITION BY category, market ORDER BY month) AS year_ago, avg(u) OVER (PARTITION BY category, market ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS level FROM hist),
duel AS (SELECT category, market, count(*) AS months, round(sum(abs(level - u)), 3) AS level_err, round(sum(abs(year_ago - u)), 3) AS season_err FROM moved WHERE year_ago IS NOT NULL AND level IS NOT NULL GROUP BY ALL)"""
slow = Registry(PANEL_SQL + _SLOW)


def _duel(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_month = _panel(spark, sf_dir).groupBy(*KEYS, F.trunc("week", "MM").alias("month")).agg(F.sum("units").cast("double").alias("u"))
    walk = Window.partitionBy(*KEYS).orderBy("month")
    moved = by_month.withColumns({"year_ago": F.lag("u", 12).over(walk), "level": F.avg("u").over(walk.rowsBetween(-6, -1))}).where("year_ago is not null and level is not null")
    return moved.groupBy(*KEYS).agg(F.count("*").alias("months"), F.round(F.sum(F.abs(F.col("level") - F.col("u"))), 3).alias("level_err"), F.round(F.sum(F.abs(F.col("year_ago") - F.col("u"))), 3).alias("season_err"))


@slow("SELECT category, market, months, level_err, season_err, level_err < season_err AS level_wins FROM duel")
def fc_croston_vs_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed level against the month a year before, over every month that has both."""
    return _duel(spark, sf_dir).withColumn("level_wins", F.col("level_err") < F.col("season_err"))


@slow("SELECT e.category, e.market, e.week, CASE WHEN d.level_err < d.season_err THEN 'level' WHEN e.seasonal_naive IS NOT NULL THEN 'seasonal' ELSE 'recent' END AS route, round(CASE WHEN d.level_err < d.season_err THEN e.ma13 ELSE coalesce(e.seasonal_naive, e.ma8) END, 4) AS forecast FROM evals e LEFT JOIN duel d USING (category, market) WHERE e.week >= DATE '2001-01-01'")
def fc_route_intermittent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series takes the forecast that was better for it; without a year of history the recent mean."""
    rows = _evals(spark, sf_dir).where("week >= date'2001-01-01'").join(_duel(spark, sf_dir), KEYS, "left")
    wins = F.coalesce(F.col("level_err") < F.col("season_err"), F.lit(False))
    route = F.when(wins, "level").when(F.col("seasonal_naive").isNotNull(), "seasonal").otherwise("recent")
    return rows.select(*KEYS, "week", route.alias("route"), F.round(F.when(wins, F.col("ma13")).otherwise(F.coalesce("seasonal_naive", "ma8")), 4).alias("forecast"))


@query(f"SELECT category, market, n, round(a, 4) AS champion_err, round(b, 4) AS tail_err FROM (SELECT category, market, count(*) AS n, {tot(_ERR)} AS a, {tot('abs(ma8 - actual)')} AS b FROM evals WHERE week BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY ALL) WHERE n >= 8 AND b < a")
def fc_tail_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series for which the shorter mean was better on at least eight resolved rows."""
    rows = _evals(spark, sf_dir).where("week between date'1999-01-01' and date'2000-12-31'").groupBy(*KEYS).agg(F.count("*").alias("n"), total(error()).alias("a"), total(F.abs(F.col("ma8") - F.col("actual"))).alias("b"))
    return rows.where("n >= 8 and b < a").select(*KEYS, "n", F.round("a", 4).alias("champion_err"), F.round("b", 4).alias("tail_err"))


@query(f"SELECT market, round(k, 6) AS multiplier FROM {_SPREAD}")
def fc_interval_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread multiplier of each market, from the residual quantile of earlier weeks."""
    rest = (F.col("actual") - F.col("ma13")) / F.nullif(1.2816 * F.col("dev_13"), F.lit(0.0))
    rows = _evals(spark, sf_dir).where("not cold and dev_13 > 0 and week < date'2000-01-01'").groupBy("market")
    return rows.agg(F.round(F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.percentile(rest, 0.9))), 6).alias("multiplier"))


_SEGMENT = f"(SELECT category, market, CASE WHEN weeks >= 26 AND act > 0 THEN least(1.5, greatest(0.67, act / nullif(fc, 0))) END AS factor, weeks FROM (SELECT category, market, count(DISTINCT week) AS weeks, {tot('actual')} AS act, {tot('ma13')} AS fc FROM evals WHERE week < DATE '2000-01-01' GROUP BY ALL))"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evals(spark, sf_dir).where("week < date'2000-01-01'").groupBy(*KEYS).agg(F.countDistinct("week").alias("weeks"), total(F.col("actual")).alias("act"), total(F.col("ma13")).alias("fc"))
    factor = F.least(F.lit(1.5), F.greatest(F.lit(0.67), F.col("act") / F.nullif(F.col("fc"), F.lit(0.0))))
    return rows.select(*KEYS, F.when((F.col("weeks") >= 26) & (F.col("act") > 0), factor).alias("factor"), "weeks")


@query(f"SELECT category, market, round(factor, 9) AS factor, weeks FROM {_SEGMENT}")
def fc_segment_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clamped factor for each segment with half a year of evidence."""
    return _segments(spark, sf_dir).withColumn("factor", F.round("factor", 9))


@query(f"SELECT e.category, e.market, e.week, round(e.ma13 * coalesce(s.factor, 1), 4) AS forecast, s.factor IS NULL AS unchanged FROM evals e LEFT JOIN {_SEGMENT} s ON s.category = e.category AND s.market = e.market WHERE e.week >= DATE '2000-01-01'")
def fc_segment_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later forecasts under their segment's factor; those without one stay."""
    rows = _evals(spark, sf_dir).where("week >= date'2000-01-01'").join(_segments(spark, sf_dir), KEYS, "left")
    return rows.select(*KEYS, "week", F.round(F.col("ma13") * F.coalesce("factor", F.lit(1.0)), 4).alias("forecast"), F.col("factor").isNull().alias("unchanged"))


# --- screens and classes ----------------------------------------------------------------------


@query("SELECT category, market, first_week, last_week, weeks, CASE WHEN weeks >= 156 AND last_week >= DATE '2001-10-01' THEN 'replayable' WHEN weeks >= 52 THEN 'partial' ELSE 'insufficient' END AS grade FROM (SELECT category, market, min(week) AS first_week, max(week) AS last_week, count(DISTINCT week) AS weeks FROM cweeks GROUP BY ALL)")
def sig_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a series' evidence reaches far enough to be replayed."""
    rows = _panel(spark, sf_dir).where("lines > 0").groupBy(*KEYS).agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.countDistinct("week").alias("weeks"))
    grade = F.when((F.col("weeks") >= 156) & (F.col("last_week") >= F.lit("2001-10-01").cast("date")), "replayable").when(F.col("weeks") >= 52, "partial").otherwise("insufficient")
    return rows.withColumn("grade", grade)


_SIGNAL = f"""(SELECT market, count(*) AS n, count(*) FILTER (WHERE active) AS active, {tot(_ERR)} AS err, coalesce(CAST(sum(CAST({_ERR} AS DECIMAL(18,6))) FILTER (WHERE active) AS DOUBLE), 0) AS active_err
  FROM (SELECT *, abs(naive - ma13) > 0.1 * ma13 AS active FROM evals) GROUP BY market)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = F.abs(F.col("naive") - F.col("ma13")) > 0.1 * F.col("ma13")
    rows = _evals(spark, sf_dir).withColumn("active", active)
    return rows.groupBy("market").agg(F.count("*").alias("n"), F.count_if(F.col("active")).alias("active"), total(error()).alias("err"), F.coalesce(total(F.when(F.col("active"), error())), F.lit(0.0)).alias("active_err"))


@query(f"SELECT market, n, active, round(active_err / nullif(err, 0), 6) AS mass, active_err >= 0.05 * err AS material FROM {_SIGNAL}")
def sig_materiality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the error on rows where the signal speaks."""
    return _signals(spark, sf_dir).select("market", "n", "active", ratio(F.col("active_err"), F.col("err")).alias("mass"), (F.col("active_err") >= 0.05 * F.col("err")).alias("material"))


@query(f"SELECT market, CASE WHEN active < 20 THEN 'rejected: too few rows' WHEN active_err < 0.05 * err THEN 'rejected: immaterial' WHEN active_err / err > 2.0 * active / n THEN 'candidate' ELSE 'watch' END AS disposition FROM {_SIGNAL}")
def sig_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first screen that fails decides."""
    says = F.when(F.col("active") < 20, "rejected: too few rows").when(F.col("active_err") < 0.05 * F.col("err"), "rejected: immaterial")
    says = says.when(F.col("active_err") / F.col("err") > 2.0 * F.col("active") / F.col("n"), "candidate").otherwise("watch")
    return _signals(spark, sf_dir).select("market", says.alias("disposition"))


@query(f"""SELECT market, round(gain, 6) AS gain, gain > 0.6 AS implausible, same AS reproduced FROM (SELECT market, 1 - {tot('abs(ma8 - actual)')} / nullif({tot(_ERR)}, 0) AS gain, bool_and(ma8 >= 0 AND ma13 >= 0) AS same FROM evals GROUP BY market)""")
def cmp_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate's gain over the champion that is too good to be true, and whether its rows are sound."""
    gain = 1 - total(F.abs(F.col("ma8") - F.col("actual"))) / F.nullif(total(error()), F.lit(0.0))
    rows = _evals(spark, sf_dir).groupBy("market").agg(gain.alias("g"), F.bool_and((F.col("ma8") >= 0) & (F.col("ma13") >= 0)).alias("reproduced"))
    return rows.select("market", F.round("g", 6).alias("gain"), (F.col("g") > 0.6).alias("implausible"), "reproduced")


@query(f"""SELECT cohort, n, round(1 - a / nullif(b, 0), 6) AS gain, worst_market FROM (SELECT cohort, sum(n)::BIGINT AS n, sum(CAST(a AS DECIMAL(18,6)))::DOUBLE AS a, sum(CAST(b AS DECIMAL(18,6)))::DOUBLE AS b, arg_max(market, (round(a / nullif(b, 0), 6), market)) AS worst_market FROM (
  SELECT {_COHORT} AS cohort, market, count(*) AS n, {tot('abs(ma8 - actual)')} AS a, {tot(_ERR)} AS b FROM evals GROUP BY ALL) GROUP BY cohort)""")
def cmp_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate's gain by cohort, and the market where it does worst."""
    parts = _evals(spark, sf_dir).groupBy(_cohort().alias("cohort"), "market").agg(F.count("*").alias("n"), total(F.abs(F.col("ma8") - F.col("actual"))).alias("a"), total(error()).alias("b"))
    worst = F.max_by("market", F.struct(ratio(F.col("a"), F.col("b")), "market"))
    rows = parts.groupBy("cohort").agg(F.sum("n").alias("n"), total(F.col("a")).alias("a"), total(F.col("b")).alias("b"), worst.alias("worst_market"))
    return rows.select("cohort", "n", F.round(1 - F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), 6).alias("gain"), "worst_market")


@query(f"""SELECT market, round(1 - a / nullif(b, 0), 6) AS gain_all, round(1 - a5 / nullif(b5, 0), 6) AS gain_last, coalesce(a <= b AND a5 <= b5, false) AS passes FROM (SELECT market, {tot('abs(ma8 - actual)')} AS a, {tot(_ERR)} AS b,
  CAST(sum(CAST(abs(ma8 - actual) AS DECIMAL(18,6))) FILTER (WHERE week >= cut) AS DOUBLE) AS a5, CAST(sum(CAST({_ERR} AS DECIMAL(18,6))) FILTER (WHERE week >= cut) AS DOUBLE) AS b5
  FROM evals CROSS JOIN (SELECT min(week) AS cut FROM (SELECT DISTINCT week FROM evals ORDER BY week DESC LIMIT 5)) GROUP BY market)""")
def cmp_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate must pass over all origins and over the last five."""
    rows = _evals(spark, sf_dir)
    cut = rows.select("week").distinct().orderBy(F.desc("week")).limit(5).agg(F.min("week").alias("cut"))  # one row
    late, other = F.col("week") >= F.col("cut"), F.abs(F.col("ma8") - F.col("actual"))
    sums = rows.crossJoin(F.broadcast(cut)).groupBy("market").agg(total(other).alias("a"), total(error()).alias("b"), total(F.when(late, other)).alias("a5"), total(F.when(late, error())).alias("b5"))
    gain = lambda a, b: F.round(1 - F.col(a) / F.nullif(F.col(b), F.lit(0.0)), 6)
    return sums.select("market", gain("a", "b").alias("gain_all"), gain("a5", "b5").alias("gain_last"), F.coalesce((F.col("a") <= F.col("b")) & (F.col("a5") <= F.col("b5")), F.lit(False)).alias("passes"))


_RANKS = "greatest(CASE WHEN wape > 0.5 THEN 2 WHEN wape > 0.3 THEN 1 ELSE 0 END, CASE WHEN abs(bias) > 0.2 THEN 2 WHEN abs(bias) > 0.1 THEN 1 ELSE 0 END, CASE WHEN weeks < 26 THEN 2 WHEN weeks < 104 THEN 1 ELSE 0 END, CASE WHEN zero > 0.5 THEN 2 WHEN zero > 0.2 THEN 1 ELSE 0 END)"
_QUALITY = f"""(SELECT category, market, weeks, wape, bias, ['Good', 'Watch', 'Issue'][CAST({_RANKS} AS INTEGER) + 1] AS class FROM (SELECT category, market, count(*) AS weeks, {tot(_ERR)} / nullif({tot("actual")}, 0) AS wape, {tot("ma13 - actual")} / nullif({tot("actual")}, 0) AS bias,
  count(*) FILTER (WHERE actual = 0) / count(*) AS zero FROM evals GROUP BY ALL))"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = F.nullif(total(F.col("actual")), F.lit(0.0))
    rows = _evals(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("weeks"), (total(error()) / act).alias("wape"), (total(F.col("ma13") - F.col("actual")) / act).alias("bias"), (F.count_if(F.col("actual") == 0) / F.count("*")).alias("zero"))

    def rank(bad: Column, watch: Column) -> Column:
        return F.when(bad, 2).when(watch, 1).otherwise(0)

    ranks = [rank(F.col("wape") > 0.5, F.col("wape") > 0.3), rank(F.abs("bias") > 0.2, F.abs("bias") > 0.1), rank(F.col("weeks") < 26, F.col("weeks") < 104), rank(F.col("zero") > 0.5, F.col("zero") > 0.2)]
    return rows.withColumn("class", F.element_at(F.array(F.lit("Good"), F.lit("Watch"), F.lit("Issue")), F.greatest(*ranks) + 1))


@query(f"SELECT category, market, weeks, round(wape, 6) AS wape, round(bias, 6) AS bias, class FROM {_QUALITY}")
def cls_quality_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good, Watch or Issue by the worst of a series' checks."""
    return _quality(spark, sf_dir).select(*KEYS, "weeks", F.round("wape", 6).alias("wape"), F.round("bias", 6).alias("bias"), "class")


@query(f"SELECT count(*) AS series, count(*) FILTER (WHERE class = 'Issue') AS issues, list_filter([CASE WHEN count(*) FILTER (WHERE class = 'Issue') * 10 > count(*) THEN 'MANY_ISSUES' END, CASE WHEN count(DISTINCT market) < 5 THEN 'MARKET_MISSING' END, CASE WHEN min(weeks) < 26 THEN 'SHORT_HISTORY' END], lambda x: x IS NOT NULL) AS findings FROM {_QUALITY}")
def cls_quality_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about a whole publication, as a list."""
    issues = F.count_if(F.col("class") == "Issue")
    findings = F.array_compact(F.array(F.when(issues * 10 > F.count("*"), "MANY_ISSUES"), F.when(F.countDistinct("market") < 5, "MARKET_MISSING"), F.when(F.min("weeks") < 26, "SHORT_HISTORY")))
    return _quality(spark, sf_dir).agg(F.count("*").alias("series"), issues.alias("issues"), findings.alias("findings"))


@query(f"SELECT category, market, CASE WHEN own >= whole THEN ['Good', 'Watch', 'Issue'][own + 1] ELSE ['Good', 'Watch', 'Issue'][whole + 1] END AS class, CASE WHEN own >= whole THEN 'series' ELSE 'publication' END AS caused_by FROM (SELECT category, market, CASE class WHEN 'Issue' THEN 2 WHEN 'Watch' THEN 1 ELSE 0 END AS own FROM {_QUALITY}) CROSS JOIN (SELECT CASE WHEN count(*) FILTER (WHERE class = 'Issue') * 10 > count(*) THEN 1 ELSE 0 END AS whole FROM {_QUALITY})")
def cls_quality_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worse of a series' class and the publication's, and which of them it was."""
    rows = _quality(spark, sf_dir)
    whole = rows.agg(F.when(F.count_if(F.col("class") == "Issue") * 10 > F.count("*"), 1).otherwise(0).alias("whole"))  # one row
    own = F.when(F.col("class") == "Issue", 2).when(F.col("class") == "Watch", 1).otherwise(0)
    both = rows.withColumn("own", own).crossJoin(F.broadcast(whole))
    name = F.element_at(F.array(F.lit("Good"), F.lit("Watch"), F.lit("Issue")), F.greatest("own", "whole") + 1)
    return both.select(*KEYS, name.alias("class"), F.when(F.col("own") >= F.col("whole"), "series").otherwise("publication").alias("caused_by"))


QUERIES, ORACLES = query.queries | slow.queries, query.oracles | slow.oracles
