"""Queries of forecast acceptance, cohorts, signal screens and quality classes over evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import sale_lines
from .basics import market_sales
from .forecast import KEYS, PANEL_SQL, _evals, _panel
from .registration import Registry

query = Registry(PANEL_SQL)


@query("SELECT category, market, week, actual, ma13, abs(ma13 - actual) AS abs_error, ma13 - actual AS signed_error, actual <= ma13 + 1.2816 * dev_13 AS covered FROM evals WHERE dev_13 IS NOT NULL")
def fc_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive parts of each evaluation row."""
    e = F.col("ma13") - F.col("actual")
    return _evals(spark, sf_dir).where("dev_13 is not null").select(*KEYS, "week", "actual", "ma13", F.abs(e).alias("abs_error"), e.alias("signed_error"), (F.col("actual") <= F.col("ma13") + 1.2816 * F.col("dev_13")).alias("covered"))


@query("SELECT category, market, week FROM panel WHERE lines = 0")
def fc_missing_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks since its first in which a series sold nothing: the panel made them."""
    return _panel(spark, sf_dir).where("lines = 0").select(*KEYS, "week")


@query("SELECT market, CASE WHEN cold THEN 'cold_start' ELSE 'established' END AS cohort, count(*) AS n, count(DISTINCT category) AS series, round(sum(actual), 4) AS actual FROM evals GROUP BY ALL")
def fc_cohort_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = F.when(F.col("cold"), "cold_start").otherwise("established")
    return _evals(spark, sf_dir).groupBy("market", cohort.alias("cohort")).agg(F.count("*").alias("n"), F.countDistinct("category").alias("series"), F.round(F.sum("actual"), 4).alias("actual"))


@query("SELECT market, count(*) AS paired, count(*) FILTER (WHERE seasonal_naive IS NULL) AS unpaired, round(1 - sum(abs(ma13 - actual)) FILTER (WHERE seasonal_naive IS NOT NULL) / sum(abs(seasonal_naive - actual)), 6) AS gain, 1 - sum(abs(ma13 - actual)) FILTER (WHERE seasonal_naive IS NOT NULL) / sum(abs(seasonal_naive - actual)) >= 0.25 AS passes FROM evals GROUP BY market")
def fc_gate_established(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain over the paired seasonal baseline, a quarter at least."""
    ours = F.sum(F.when(F.col("seasonal_naive").isNotNull(), F.abs(F.col("ma13") - F.col("actual"))))
    gain = 1 - ours / F.sum(F.abs(F.col("seasonal_naive") - F.col("actual")))
    return _evals(spark, sf_dir).groupBy("market").agg(F.count("*").alias("paired"), F.count_if(F.col("seasonal_naive").isNull()).alias("unpaired"), F.round(gain, 6).alias("gain"), (gain >= 0.25).alias("passes"))


@query("SELECT market, round(sum(abs(ma13 - actual)) / sum(actual), 6) AS wape, round(sum(abs(naive - actual)) / sum(actual), 6) AS comparator, sum(abs(ma13 - actual)) <= sum(abs(naive - actual)) AS passes FROM evals WHERE cold GROUP BY market")
def fc_gate_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, theirs = (F.sum(F.abs(F.col(b) - F.col("actual"))) for b in ("ma13", "naive"))
    return _evals(spark, sf_dir).where("cold").groupBy("market").agg(F.round(ours / F.sum("actual"), 6).alias("wape"), F.round(theirs / F.sum("actual"), 6).alias("comparator"), (ours <= theirs).alias("passes"))


@query("SELECT bias, count(*) AS slices FROM (SELECT category, market, CASE WHEN sum(ma13 - actual) > 0.02 * sum(actual) THEN 'over' WHEN sum(ma13 - actual) < -0.02 * sum(actual) THEN 'under' ELSE 'neutral' END AS bias FROM evals GROUP BY ALL) GROUP BY bias")
def fc_bias_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed, actual = F.sum(F.col("ma13") - F.col("actual")), F.sum("actual")
    bias = F.when(signed > 0.02 * actual, "over").when(signed < -0.02 * actual, "under").otherwise("neutral")
    return _evals(spark, sf_dir).groupBy(*KEYS).agg(bias.alias("bias")).groupBy("bias").agg(F.count("*").alias("slices"))


@query("SELECT market, bool_and(NOT (CASE WHEN cold THEN naive ELSE ma13 END IS DISTINCT FROM ma13)) FILTER (WHERE NOT cold) AS unchanged, count(*) FILTER (WHERE cold AND naive <> ma13) AS changed FROM evals GROUP BY market")
def fc_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change meant for cold series leaves all others as they were."""
    after = F.when(F.col("cold"), F.col("naive")).otherwise(F.col("ma13"))
    same = F.bool_and(F.when(~F.col("cold"), after.eqNullSafe(F.col("ma13"))))
    return _evals(spark, sf_dir).groupBy("market").agg(same.alias("unchanged"), F.count_if(F.col("cold") & (F.col("naive") != F.col("ma13"))).alias("changed"))


@query("SELECT market, count(*) AS keys, count(r.sku) AS matched, round(count(r.sku) / count(*), 6) AS share, count(r.sku) * 2 >= count(*) AS passes FROM (SELECT DISTINCT market, sku FROM msales) s LEFT JOIN (SELECT DISTINCT market, sku FROM msales WHERE returned) r USING (market, sku) GROUP BY market")
def sig_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of keys that a signal (here returns) has."""
    keys = market_sales(spark, sf_dir).groupBy("market", "sku").agg(F.bool_or("returned").alias("has"))
    n, m = F.count("*"), F.count_if("has")
    return keys.groupBy("market").agg(n.alias("keys"), m.alias("matched"), F.round(m / n, 6).alias("share"), (m * 2 >= n).alias("passes"))


@query("SELECT channel, round(avg(CASE WHEN date_diff('day', business_date, CAST(known_as_of AS DATE)) = 0 THEN 1.0 ELSE 0.0 END), 6) AS same_day, round(avg(date_diff('day', business_date, CAST(known_as_of AS DATE))), 6) AS mean_lag FROM sales GROUP BY channel")
def sig_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a date field equals the boundary that it should follow."""
    lag = F.datediff(F.col("known_as_of").cast("date"), "business_date")
    return sale_lines(spark, sf_dir).groupBy("channel").agg(F.round(F.avg(F.when(lag == 0, 1.0).otherwise(0.0)), 6).alias("same_day"), F.round(F.avg(lag), 6).alias("mean_lag"))


_MISSING = "(lag_1 IS NULL)::INT + (lag_13 IS NULL)::INT + (lag_52 IS NULL)::INT + (dev_13 IS NULL)::INT"


@query(f"SELECT category, market, week, {_MISSING} AS missing, CASE WHEN {_MISSING} = 0 AND coalesce(zero_share_52, 0) < 0.6 THEN 'Good' WHEN {_MISSING} <= 2 THEN 'Watch' ELSE 'Issue' END AS quality FROM panel")
def cls_quality_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = sum((F.col(c).isNull().cast("int") for c in ("lag_1", "lag_13", "lag_52", "dev_13")), F.lit(0))
    kind = F.when((missing == 0) & (F.coalesce("zero_share_52", F.lit(0.0)) < 0.6), "Good").when(missing <= 2, "Watch").otherwise("Issue")
    return _panel(spark, sf_dir).select(*KEYS, "week", missing.alias("missing"), kind.alias("quality"))


@query("SELECT category, market, week, unnest(list_filter([CASE WHEN actual > 2 * ma13 THEN 'UNDER_FORECAST' END, CASE WHEN ma13 > 2 * actual THEN 'OVER_FORECAST' END, CASE WHEN cold THEN 'SPARSE_HISTORY' END], lambda x: x IS NOT NULL)) AS exception FROM evals")
def cls_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_compact(F.array(F.when(F.col("actual") > 2 * F.col("ma13"), "UNDER_FORECAST"), F.when(F.col("ma13") > 2 * F.col("actual"), "OVER_FORECAST"), F.when(F.col("cold"), "SPARSE_HISTORY")))
    return _evals(spark, sf_dir).select(*KEYS, "week", F.explode(kinds).alias("exception"))


QUERIES, ORACLES = query.queries, query.oracles
