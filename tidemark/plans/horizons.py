"""Queries of forecasts by horizon: quantile trees, their drivers, and the baselines they compete with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import horizons as hz
from ..operators.sketches import RANK_ERROR, SketchStore, fallback
from ..sources.tables import category_weeks, products, scratch
from .basics import market_sales
from .forecast import KEYS
from .registration import Registry

#: The written origins and forecasts of each session and input, as several queries read them.
_ORIGINS: dict[tuple[str, str], str] = {}
_ARTIFACTS: dict[tuple[str, str], str] = {}
EVERY, HELD_WEEKS, TRAIN_WEEKS = 2, 52, 104
#: a head or weight of its own takes so many rows
OWN_ROWS = 2000


def series_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every week of every series of (category, market), missing weeks made, with what is known at its end; written once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ORIGINS:
        path = scratch(spark, "origins")
        hz.origin_rows(hz.dense_series(category_weeks(market_sales(spark, sf_dir), products(spark, sf_dir)), KEYS), KEYS).write.parquet(path)
        _ORIGINS[key] = path
    return spark.read.parquet(_ORIGINS[key])


def week_no(day: str) -> Column:
    """Number of a Monday week."""
    return F.expr(f"datediff({day}, date'1970-01-05') div 7")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model forecasts of every second origin of the last year, written once for a session.

    The last HELD_WEEKS weeks are scored, the origins a year before them correct the spread, and the
    model is fitted on origins of the TRAIN_WEEKS before, half a year apart from the former; no
    target of a fitted or correcting row is later than the first scored origin.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ARTIFACTS:
        origins = series_origins(spark, sf_dir)
        end = origins.agg(F.max(week_no("week")).alias("w")).first()["w"]
        rows = hz.horizon_rows(origins, KEYS).where("age >= 13 and actual is not null")
        at, target = week_no("origin"), week_no("target_week")
        scored = rows.where((at > end - HELD_WEEKS) & (at % EVERY == 0))
        held = rows.where((target <= end - HELD_WEEKS) & (at > end - 2 * HELD_WEEKS) & (at % EVERY == 0))
        train = rows.where((target <= end - 3 * HELD_WEEKS // 2) & (at > end - 3 * HELD_WEEKS // 2 - TRAIN_WEEKS) & (at % (2 * EVERY) == 0))
        model = hz.fit_quantiles(train, held)
        out = scratch(spark, "forecasts")
        model.score(scored).select(*KEYS, "origin", "h", "target_week", "actual", "seasonal", "p50", "p90", "base", "parts").write.parquet(out)
        _ARTIFACTS[key] = out
    return spark.read.parquet(_ARTIFACTS[key])


_HZ_SQL = """
, hspan AS (SELECT max(week) AS last FROM cweeks),
hgrid AS (SELECT category, market, CAST(unnest(generate_series(a, (SELECT last FROM hspan), INTERVAL 7 DAY)) AS DATE) AS week FROM (SELECT category, market, min(week) AS a FROM cweeks GROUP BY ALL)),
hdense AS (SELECT g.category, g.market, g.week, coalesce(units, 0) AS units FROM hgrid g LEFT JOIN cweeks c ON c.category = g.category AND c.market = g.market AND c.week = g.week),
horigin AS (SELECT category, market, week, units, avg(units) OVER (PARTITION BY category, market ORDER BY week ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS mean_8,
  avg(units) OVER (PARTITION BY category, market ORDER BY week ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS mean_13, row_number() OVER (PARTITION BY category, market ORDER BY week) AS age FROM hdense),
hrows AS (SELECT o.category, o.market, o.week AS origin, h, CAST(t.units AS DOUBLE) AS actual, CASE WHEN o.age >= 52 THEN CAST(y.units AS DOUBLE) END AS seasonal, CAST(o.units AS DOUBLE) AS naive, o.mean_8 AS ma8, o.mean_13 AS ma13
  FROM horigin o CROSS JOIN (SELECT unnest(generate_series(1, 26)) AS h) LEFT JOIN hdense t ON t.category = o.category AND t.market = o.market AND t.week = CAST(o.week + to_days(CAST(7 * h AS INTEGER)) AS DATE)
  LEFT JOIN hdense y ON y.category = o.category AND y.market = o.market AND y.week = CAST(o.week + to_days(CAST(7 * h - 364 AS INTEGER)) AS DATE) WHERE o.age >= 13),
hall AS (SELECT *, CASE WHEN seasonal IS NULL THEN ma13 ELSE (seasonal + ma13) / 2 END AS blend FROM hrows WHERE actual IS NOT NULL),
hevals AS (SELECT * FROM hall WHERE seasonal IS NOT NULL)
"""

query = Registry(_HZ_SQL)
BASELINES = ("naive", "seasonal", "ma8", "ma13")


def all_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of every origin of 13 weeks or more and every horizon that has an actual; without a year of history `seasonal` is null.

    `blend` is half the seasonal value and half the 13-week mean, the mean alone where there is no year.
    """
    rows = series_origins(spark, sf_dir).where("age >= 13").withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(hz.HORIZONS))))
    double = lambda c: c.cast("double")
    rows = rows.select(*KEYS, F.col("week").alias("origin"), "h", double(F.get("ahead", F.col("h") - 1)).alias("actual"), double(F.get("year_ago", F.col("h") - 1)).alias("seasonal"),
                       double(F.col("units")).alias("naive"), F.col("mean_8").alias("ma8"), F.col("mean_13").alias("ma13"))
    blend = F.when(F.col("seasonal").isNull(), F.col("ma13")).otherwise((F.col("seasonal") + F.col("ma13")) / 2)
    return rows.where("actual is not null").withColumn("blend", blend)


def horizon_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of a year of history, which all baselines have."""
    return all_evals(spark, sf_dir).where("seasonal is not null")


def _total(value: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(value.cast("decimal(18,6)"))


_SQL_ERR = ", ".join(f"sum(CAST(abs({b} - actual) AS DECIMAL(18,6))) AS e_{b}, sum(CAST({b} - actual AS DECIMAL(18,6))) AS s_{b}" for b in BASELINES)
_SQL_BEST = "CASE least(" + ", ".join(f"e_{b}" for b in BASELINES) + ") " + " ".join(f"WHEN e_{b} THEN '{b}'" for b in BASELINES) + " END"
_SQL_RATIO = ", ".join(f"CAST(round(CAST(e_{b} AS DOUBLE) / nullif(CAST(act AS DOUBLE), 0), 6) AS DOUBLE) AS wape_{b}, CAST(round(CAST(s_{b} AS DOUBLE) / nullif(CAST(act AS DOUBLE), 0), 6) AS DOUBLE) AS bias_{b}" for b in BASELINES)


_SQL_SUMS = ", ".join(f"CAST(round(e_{b}, 4) AS DOUBLE) AS abs_{b}, CAST(round(s_{b}, 4) AS DOUBLE) AS signed_{b}" for b in BASELINES)


def _errors(rows: DataFrame, sets: list[list[str]], *keys: str) -> DataFrame:
    """Error sums of every baseline at all scopes in one pass, with the champion: least absolute error, first of equal ones."""
    sums = [F.count("*").alias("n"), _total(F.col("actual")).alias("act")]
    for b in BASELINES:
        sums += [_total(F.abs(F.col(b) - F.col("actual"))).alias(f"e_{b}"), _total(F.col(b) - F.col("actual")).alias(f"s_{b}")]
    found = rows.groupingSets(sets, *keys).agg(*sums)
    least = F.least(*(F.col(f"e_{b}") for b in BASELINES))
    return found.withColumn("champion", F.coalesce(*(F.when(F.col(f"e_{b}") == least, F.lit(b)) for b in BASELINES)))


def _judged(rows: DataFrame, sets: list[list[str]], *keys: str) -> DataFrame:
    """The ratios of those sums to the actual."""
    act = F.nullif(F.col("act").cast("double"), F.lit(0.0))
    ratios = [F.round(F.col(f"{k}_{b}").cast("double") / act, 6).alias(f"{n}_{b}") for b in BASELINES for k, n in (("e", "wape"), ("s", "bias"))]
    return _errors(rows, sets, *keys).select(*keys, "n", *ratios, "champion")


def _share(part: str, whole: str) -> Column:
    return F.col(part).cast("double") / F.nullif(F.col(whole).cast("double"), F.lit(0.0))


def _sql_share(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)"


def _sql_total(value: str) -> str:
    return f"sum(CAST({value} AS DECIMAL(18,6)))"


@query(f"SELECT market, category, CAST(h AS INTEGER) AS h, n, CAST(round(act, 4) AS DOUBLE) AS actual, {_SQL_SUMS}, {_SQL_BEST} AS champion FROM (SELECT market, category, h, count(*) AS n, {_sql_total('actual')} AS act, {_SQL_ERR} FROM hevals GROUP BY GROUPING SETS ((), (h), (market), (market, h), (category, h)))")
def fc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive error sums of every baseline whole, by horizon, market and category, with the champion of each scope, in one pass."""
    found = _errors(horizon_evals(spark, sf_dir), [[], ["h"], ["market"], ["market", "h"], ["category", "h"]], "market", "category", "h")
    sums = [F.round(f"{k}_{b}", 4).cast("double").alias(f"{n}_{b}") for b in BASELINES for k, n in (("e", "abs"), ("s", "signed"))]
    return found.select("market", "category", "h", "n", F.round("act", 4).cast("double").alias("actual"), *sums, "champion")


@query(f"""SELECT market, category, CAST(h AS INTEGER) AS h, n, paired, round({_sql_share("e_blend", "act")}, 6) AS wape, round(1 - {_sql_share("e_blend", "e_ma13")}, 6) AS gain_ma13, round(1 - {_sql_share("p_blend", "p_seasonal")}, 6) AS gain_seasonal FROM (
  SELECT market, category, h, count(*) AS n, count(seasonal) AS paired, {_sql_total("actual")} AS act, {_sql_total("abs(blend - actual)")} AS e_blend, {_sql_total("abs(ma13 - actual)")} AS e_ma13,
    {_sql_total("CASE WHEN seasonal IS NOT NULL THEN abs(blend - actual) END")} AS p_blend, {_sql_total("abs(seasonal - actual)")} AS p_seasonal FROM hall GROUP BY GROUPING SETS ((), (market), (h), (market, h), (category)))""")
def fc_value_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of the blended forecast over the 13-week mean on all rows and over the seasonal naive one on the rows that have it, by scope."""
    missed = lambda b: F.abs(F.col(b) - F.col("actual"))
    rows = all_evals(spark, sf_dir).groupingSets([[], ["market"], ["h"], ["market", "h"], ["category"]], "market", "category", "h").agg(
        F.count("*").alias("n"), F.count("seasonal").alias("paired"), _total(F.col("actual")).alias("act"), _total(missed("blend")).alias("e_blend"), _total(missed("ma13")).alias("e_ma13"),
        _total(F.when(F.col("seasonal").isNotNull(), missed("blend"))).alias("p_blend"), _total(missed("seasonal")).alias("p_seasonal"),
    )
    return rows.select("market", "category", "h", "n", "paired", F.round(_share("e_blend", "act"), 6).alias("wape"), F.round(1 - _share("e_blend", "e_ma13"), 6).alias("gain_ma13"), F.round(1 - _share("p_blend", "p_seasonal"), 6).alias("gain_seasonal"))


@query(f"""SELECT scope, slice, CAST(h AS INTEGER) AS h, count(*) AS n, CAST(round(sum((act)), 4) AS DOUBLE) AS actual, CAST(round(sum(abs(told - act)), 4) AS DOUBLE) AS abs_error FROM (
  SELECT CASE WHEN category IS NULL THEN 'market' ELSE 'category' END AS scope, coalesce(market, category) AS slice, h, origin, {_sql_total("actual")} AS act, {_sql_total("blend")} AS told FROM hall GROUP BY GROUPING SETS ((market, origin, h), (category, origin, h))) GROUP BY scope, slice, h""")
def fc_metrics_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of sums: forecasts and actuals of each origin and horizon are summed to the market, or to the category, before the error is taken."""
    sums = all_evals(spark, sf_dir).groupingSets([["market", "origin", "h"], ["category", "origin", "h"]], "market", "category", "origin", "h").agg(_total(F.col("actual")).alias("act"), _total(F.col("blend")).alias("told"))
    named = sums.withColumns({"scope": F.when(F.col("category").isNull(), "market").otherwise("category"), "slice": F.coalesce("market", "category")})
    return named.groupBy("scope", "slice", "h").agg(F.count("*").alias("n"), F.round(F.sum("act"), 4).cast("double").alias("actual"), F.round(F.sum(F.abs(F.col("told") - F.col("act"))), 4).cast("double").alias("abs_error"))


JUDGED = "2000-01-01"
_SLICES = {
    "market": ("market", F.col), "category": ("category", F.col), "series": ("category || '/' || market", F.expr), "cohort": ("cohort", F.col),
    "horizon": ("CAST(h AS VARCHAR)", lambda _: F.col("h").cast("string")), "band": ("band", F.col), "route": ("route", F.col), "role": ("role", F.col),
}
_SQL_BAND = f"CASE WHEN h <= {hz.BANDS['near']} THEN 'near' WHEN h <= {hz.BANDS['mid']} THEN 'mid' ELSE 'far' END"


def _band() -> Column:
    return F.when(F.col("h") <= hz.BANDS["near"], "near").when(F.col("h") <= hz.BANDS["mid"], "mid").otherwise("far")


@query(f"""SELECT scope, slice, CAST(sum((n)) AS BIGINT) AS n, CAST(round(sum((act)), 4) AS DOUBLE) AS actual, CAST(round(sum((err)), 4) AS DOUBLE) AS abs_error, CAST(round(sum((sgn)), 4) AS DOUBLE) AS signed_error, round({_sql_share("sum((err))", "sum((act))")}, 6) AS wape FROM (
  SELECT unnest([{", ".join(f"'{k}'" for k in _SLICES)}]) AS scope, unnest([{", ".join(v for v, _ in _SLICES.values())}]) AS slice, n, act, err, sgn FROM (
    SELECT market, category, h, CASE WHEN seasonal IS NULL THEN 'cold_start' ELSE 'established' END AS cohort, {_SQL_BAND} AS band, CASE WHEN ma8 = 0 THEN 'silent' WHEN seasonal IS NULL THEN 'recent' WHEN ma13 < 5 THEN 'intermittent' ELSE 'seasonal' END AS route,
      CASE WHEN origin < DATE '{JUDGED}' THEN 'fit' ELSE 'judged' END AS role, count(*) AS n, {_sql_total("actual")} AS act, {_sql_total("abs(blend - actual)")} AS err, {_sql_total("blend - actual")} AS sgn FROM hall GROUP BY ALL)) GROUP BY scope, slice""")
def fc_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error sums by market, category, series, cohort, horizon, band, route and role of the origin; rows are summed to their finest slice before they multiply."""
    cold = F.col("seasonal").isNull()
    route = F.when(F.col("ma8") == 0, "silent").when(cold, "recent").when(F.col("ma13") < 5, "intermittent").otherwise("seasonal")
    error = F.col("blend") - F.col("actual")
    rows = all_evals(spark, sf_dir).withColumns({"cohort": F.when(cold, "cold_start").otherwise("established"), "band": _band(), "route": route, "role": F.when(F.col("origin") < F.lit(JUDGED).cast("date"), "fit").otherwise("judged")})
    fine = rows.groupBy("market", "category", "h", "cohort", "band", "route", "role").agg(F.count("*").alias("n"), _total(F.col("actual")).alias("act"), _total(F.abs(error)).alias("err"), _total(error).alias("sgn"))
    each = fine.withColumn("x", F.explode(F.array(*(F.struct(F.lit(k).alias("scope"), make(v).alias("slice")) for k, (v, make) in _SLICES.items()))))
    sums = each.groupBy("x.scope", "x.slice").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in ("act", "err", "sgn")))
    return sums.select("scope", "slice", "n", *(F.round(c, 4).cast("double").alias(k) for c, k in (("act", "actual"), ("err", "abs_error"), ("sgn", "signed_error"))), F.round(_share("err", "act"), 6).alias("wape"))


@query("""SELECT market, CAST(h AS INTEGER) AS h, expected, present, sold, expected = present AS complete FROM (SELECT o.market, g.h, count(*) AS expected, count(t.week) AS present, count(*) FILTER (WHERE t.units > 0) AS sold FROM horigin o
  CROSS JOIN (SELECT unnest(generate_series(1, 26)) AS h) g LEFT JOIN hdense t ON t.category = o.category AND t.market = o.market AND t.week = CAST(o.week + to_days(CAST(7 * g.h AS INTEGER)) AS DATE)
  WHERE o.age >= 13 AND o.week <= (SELECT last FROM hspan) - 182 GROUP BY o.market, g.h)""")
def fc_schedule_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every origin that is half a year back has a target at every horizon, and how many of these are weeks with sales."""
    origins = series_origins(spark, sf_dir)
    last = origins.agg(F.max("week").alias("last"))  # one row
    due = origins.where("age >= 13").crossJoin(F.broadcast(last)).where(F.col("week") <= F.date_sub("last", 182))
    each = due.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(hz.HORIZONS)))).withColumn("target", F.get("ahead", F.col("h") - 1))
    rows = each.groupBy("market", "h").agg(F.count("*").alias("expected"), F.count("target").alias("present"), F.count_if(F.col("target") > 0).alias("sold"))
    return rows.withColumn("complete", F.col("expected") == F.col("present"))


@query(f""", bc AS (SELECT market, h, g, count(*) AS n, {_sql_total("abs((g / 20.0) * naive + (1 - g / 20.0) * ma13 - actual)")} AS err FROM hall CROSS JOIN (SELECT unnest(range(21)) AS g) WHERE seasonal IS NULL GROUP BY ALL),
bl AS (SELECT x.market, x.h, y.g, coalesce(n, 0) AS n, coalesce(err, 0) AS err FROM (SELECT DISTINCT market, h FROM hall) x CROSS JOIN (SELECT unnest(range(21)) AS g) y LEFT JOIN bc ON bc.market = x.market AND bc.h = x.h AND bc.g = y.g),
b2 AS (SELECT *, sum(n) OVER (PARTITION BY market, g) AS n_m, sum(err) OVER (PARTITION BY market, g) AS err_m, sum(err) OVER (PARTITION BY g) AS err_a FROM bl)
SELECT market, CAST(h AS INTEGER) AS h, max(n) AS n, CASE WHEN max(n) >= {OWN_ROWS} THEN 'own' WHEN max(n_m) >= {OWN_ROWS} THEN 'group' ELSE 'all' END AS source,
  CASE WHEN max(n) >= {OWN_ROWS} THEN arg_min(g, (err, g)) WHEN max(n_m) >= {OWN_ROWS} THEN arg_min(g, (err_m, g)) ELSE arg_min(g, (err_a, g)) END / 20.0 AS weight FROM b2 GROUP BY market, h""")
def fc_blend_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For series without a year of history, the weight of the last week in its mix with the 13-week mean, by market and horizon."""
    rows = all_evals(spark, sf_dir).withColumn("used", F.col("seasonal").isNull())
    return hz.blend_weights(rows, "market", "naive", "ma13", least_rows=OWN_ROWS)


@query(f""", ch AS (SELECT market, {_SQL_BAND} AS band, actual, greatest(ma8, 1.0) AS level, (date_diff('day', DATE '1970-01-05', origin) // 7) % 2 = 0 AS fit FROM hall WHERE seasonal IS NULL),
own AS (SELECT market, band, count(*) FILTER (WHERE fit) AS n, quantile_cont(actual / level, 0.9) FILTER (WHERE fit) AS q FROM ch GROUP BY ALL), gen AS (SELECT band, quantile_cont(actual / level, 0.9) FILTER (WHERE fit) AS g FROM ch GROUP BY band),
heads AS (SELECT market, band, n, n >= {OWN_ROWS} AS own_head, CASE WHEN n >= {OWN_ROWS} THEN q ELSE g END AS factor FROM own JOIN gen USING (band))
SELECT market, band, n, own_head, round(factor, 6) AS factor, judged, round(covered / judged, 6) AS coverage FROM heads JOIN (SELECT market, band, count(*) FILTER (WHERE NOT fit) AS judged, count(*) FILTER (WHERE NOT fit AND actual <= factor * level + 0.000001) AS covered FROM ch JOIN heads USING (market, band) GROUP BY ALL) USING (market, band)""")
def fc_cold_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P90 of series without a year of history: a factor of their 8-week level by market and band, that of all markets where rows are few.

    Fitted on every second origin; coverage is the share of the other origins' actuals that it holds.
    """
    rows = all_evals(spark, sf_dir).where("seasonal is null").select("market", _band().alias("band"), "actual", F.greatest("ma8", F.lit(1.0)).alias("level"), (week_no("origin") % 2 == 0).alias("fit"))
    upper = F.percentile(F.when(F.col("fit"), F.col("actual") / F.col("level")), 0.9)
    sums = rows.groupingSets([["market", "band"], ["band"]], "market", "band").agg(F.grouping("market").alias("all"), F.count_if("fit").alias("n"), upper.alias("q"))
    # a row for each market and band
    heads = sums.withColumn("g", F.max(F.when(F.col("all") == 1, F.col("q"))).over(Window.partitionBy("band"))).where("all = 0")
    own = F.col("n") >= OWN_ROWS
    heads = heads.select("market", "band", "n", own.alias("own_head"), F.when(own, F.col("q")).otherwise(F.col("g")).alias("factor"))
    within = F.count_if(F.col("actual") <= F.col("factor") * F.col("level") + 0.000001)
    told = rows.where("not fit").join(F.broadcast(heads), ["market", "band"]).groupBy("market", "band").agg(F.max("n").alias("n"), F.bool_and("own_head").alias("own_head"), F.max("factor").alias("factor"), F.count("*").alias("judged"), within.alias("covered"))
    return told.select("market", "band", "n", "own_head", F.round("factor", 6).alias("factor"), "judged", F.round(F.col("covered") / F.col("judged"), 6).alias("coverage"))


@query(f"SELECT market, category, CAST(h AS INTEGER) AS h, n, {_SQL_RATIO}, {_SQL_BEST} AS champion FROM (SELECT market, category, h, count(*) AS n, sum(CAST(actual AS DECIMAL(18,6))) AS act, {_SQL_ERR} FROM hevals GROUP BY GROUPING SETS ((), (h), (market, h), (category, h)))")
def fc_horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error and bias of every baseline at each horizon, whole and by market or category, and the champion of each."""
    return _judged(horizon_evals(spark, sf_dir), [[], ["h"], ["market", "h"], ["category", "h"]], "market", "category", "h")


@query(f"""SELECT scope, slice, n, {_SQL_RATIO}, {_SQL_BEST} AS champion FROM (SELECT scope, slice, count(*) AS n, sum(CAST(actual AS DECIMAL(18,6))) AS act, {_SQL_ERR} FROM (
  SELECT e.*, unnest(['market', 'category', 'series', 'band', 'horizon', 'quarter', 'volume', 'demand']) AS scope,
    unnest([market, category, category || '/' || market, CASE WHEN h <= 4 THEN 'near' WHEN h <= 13 THEN 'mid' ELSE 'far' END, CAST(h AS VARCHAR), CAST(CAST(date_trunc('quarter', origin) AS DATE) AS VARCHAR),
      CASE WHEN ma13 < 50 THEN 'low' WHEN ma13 < 200 THEN 'middle' ELSE 'high' END, CASE WHEN actual = 0 THEN 'none' ELSE 'some' END]) AS slice FROM hevals e) GROUP BY ALL)""")
def fc_horizon_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same errors by eight kinds of slices in one pass."""
    text = lambda c: c.cast("string")
    band = F.when(F.col("h") <= hz.BANDS["near"], "near").when(F.col("h") <= hz.BANDS["mid"], "mid").otherwise("far")
    volume = F.when(F.col("ma13") < 50, "low").when(F.col("ma13") < 200, "middle").otherwise("high")
    of = {
        "market": F.col("market"), "category": F.col("category"), "series": F.concat_ws("/", "category", "market"), "band": band, "horizon": text(F.col("h")),
        "quarter": text(F.trunc("origin", "quarter")), "volume": volume, "demand": F.when(F.col("actual") == 0, "none").otherwise("some"),
    }
    rows = horizon_evals(spark, sf_dir).withColumn("x", F.explode(F.array(*(F.struct(F.lit(k).alias("scope"), v.alias("slice")) for k, v in of.items()))))
    return _judged(rows.select("*", "x.scope", "x.slice"), [["scope", "slice"]], "scope", "slice")


@query(None)
def fc_quantile_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P50 and P90 of each of the next 26 weeks by one model over all horizons, for every second origin of the last year.

    Without SQL: tests hold the share of actuals up to P90 within 0.85 to 0.95 for near, middle and
    far horizons, and the error of P50 below the seasonal naive one's.
    """
    return forecasts(spark, sf_dir).select(*KEYS, "origin", "h", "target_week", "actual", "seasonal", "p50", "p90")


def _driver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each forecast and driver: the level that all rows share, and what the splits on each feature add to P50."""
    named = [F.struct(F.lit("level").alias("driver"), F.col("base").alias("v")), *(F.struct(F.lit(n).alias("driver"), F.get("parts", F.lit(k)).alias("v")) for k, n in enumerate(hz.INPUTS))]
    return forecasts(spark, sf_dir).withColumn("x", F.explode(F.array(*named))).select(*KEYS, "origin", "h", "p50", F.col("x.driver").alias("driver"), F.col("x.v").alias("v"))


@query(None)
def fc_driver_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of the model's features by market and origin, as shares in 0.0001 percent that add up to a whole.

    Confidence is the share of the absolute parts that the sum keeps: parts that cancel out over the
    series tell little. Without SQL: tests hold that level and parts sum to each row's P50.
    """
    rows = _driver_rows(spark, sf_dir).where("driver <> 'level'").groupBy("market", "origin", "driver")
    size = _total(F.abs("v")).cast("double")
    sums = rows.agg(_total(F.col("v")).cast("double").alias("contribution"), F.round(F.abs(_total(F.col("v")).cast("double")) / F.nullif(size, F.lit(0.0)), 6).alias("confidence"))
    return hz.shares(sums, ["market", "origin"]).withColumn("contribution", F.round("contribution", 4))


@query(None)
def fc_driver_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and parts of each series and of the portfolio over the coming weeks, in one pass; they sum to the forecast."""
    sums = _driver_rows(spark, sf_dir).groupingSets([["origin", "driver"], [*KEYS, "origin", "driver"]], *KEYS, "origin", "driver").agg(F.round(_total(F.col("v")).cast("double"), 4).alias("contribution"))
    return sums.select(*(F.coalesce(k, F.lit("portfolio")).alias(k) for k in KEYS), "origin", "driver", "contribution")


_MISSES = """(SELECT market, year, units - mean AS miss FROM (SELECT market, year(week) AS year, units, avg(units) OVER (PARTITION BY sku, market ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS mean
  FROM (SELECT sku, market, CAST(date_trunc('week', business_date) AS DATE) AS week, sum(units) AS units FROM msales GROUP BY ALL)) WHERE mean IS NOT NULL)"""


def _sku_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mean of its last eight weeks with sales missed of each product's week in a market."""
    weeks = market_sales(spark, sf_dir).groupBy("sku", "market", F.to_date(F.date_trunc("week", "business_date")).alias("week")).agg(F.sum("units").alias("units"))
    mean = F.avg("units").over(Window.partitionBy("sku", "market").orderBy("week").rowsBetween(-8, -1))
    return weeks.withColumn("mean", mean).where("mean is not null").select("market", F.year("week").alias("year"), (F.col("units") - F.col("mean")).alias("miss"))


@query(f"SELECT market, count(*) AS n, true AS own, true AS p50_within, true AS p90_within FROM {_MISSES} GROUP BY market")
def fc_calibrate_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P50 and P90 offsets of each market at product grain from yearly sketches, held against the exact ranks of all misses.

    A quantile is within bounds when the share of misses up to it is within RANK_ERROR of its level, ties counted either way.
    """
    path = scratch(spark, "misses")
    _sku_misses(spark, sf_dir).write.partitionBy("year").parquet(path)
    rows = spark.read.parquet(path)
    store, whole = SketchStore(spark, scratch(spark, "sketches"), ["market"], "miss", "year"), SketchStore(spark, scratch(spark, "sketches"), [], "miss", "year")
    for s in (store, whole):
        s.add(rows)
    told = fallback(store.quantiles([0.5, 0.9]), whole.quantiles([0.5, 0.9]), ["market"], 20)
    judged = rows.join(F.broadcast(told), "market")  # a row for each market
    within = {}
    for k, level in enumerate((0.5, 0.9)):
        q = F.col("q")[k]
        up_to, below = F.avg((F.col("miss") <= q).cast("double")), F.avg((F.col("miss") < q).cast("double"))
        within[f"p{int(level * 100)}_within"] = (up_to >= level - RANK_ERROR) & (below <= level + RANK_ERROR)
    return judged.groupBy("market").agg(F.max("n").alias("n"), F.bool_and("own").alias("own"), *(v.alias(k) for k, v in within.items()))


QUERIES, ORACLES = query.queries, query.oracles
