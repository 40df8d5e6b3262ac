"""Weekly panel features, baselines and intermittent-demand forecasts of a series table.

Every function takes the key columns of a series, so one shuffle on the key serves all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAGS = (1, 4, 13, 52)
ROLLS = (4, 8, 13, 52)


def panel(weeks: DataFrame, keys: list[str], *, lags: tuple[int, ...] = LAGS, rolls: tuple[int, ...] = ROLLS, leads: int = 4) -> DataFrame:
    """weeks(keys, week, units, ...) plus lags, rolling means and deviations, share of zero weeks, trend and targets.

    Frames end one row back, so a row's features never hold its own week. Targets are the units of
    the following weeks.
    """
    walk = Window.partitionBy(*keys).orderBy("week")
    units = F.col("units")
    out = weeks.withColumns({f"lag_{n}": F.lag(units, n).over(walk) for n in lags})
    frames = {n: walk.rowsBetween(-n, -1) for n in rolls}
    out = out.withColumns({f"mean_{n}": F.round(F.avg(units).over(w), 6) for n, w in frames.items()} | {f"dev_{n}": F.round(F.stddev_samp(units).over(w), 6) for n, w in frames.items()})
    year = walk.rowsBetween(-52, -1)
    out = out.withColumn("zero_share_52", F.round(F.avg(F.when(units == 0, 1.0).otherwise(0.0)).over(year), 6))
    out = out.withColumn("trend_4v13", F.round(F.col("mean_4") / F.nullif(F.col("mean_13"), F.lit(0.0)), 6))
    return out.withColumns({f"target_{n}": F.lead(units, n).over(walk) for n in range(1, leads + 1)})


def baselines(rows: DataFrame) -> DataFrame:
    """Naive, seasonal naive and moving means from panel columns; the seasonal one stays null without a year."""
    zero = F.lit(0.0)
    return rows.withColumns(
        {
            "naive": F.greatest(F.coalesce(F.col("lag_1").cast("double"), zero), zero),
            "seasonal_naive": F.when(F.col("lag_52").isNotNull(), F.greatest(F.col("lag_52").cast("double"), zero)),
            "ma8": F.greatest(F.coalesce("mean_8", zero), zero),
            "ma13": F.greatest(F.coalesce("mean_13", zero), zero),
        }
    )


def croston(values: Column, alpha: float = 0.10) -> Column:
    """Bias-adjusted Croston forecast of an ordered array: a fold over it, in the row's own task.

    The state holds the smoothed demand and interval and the place of the last demand.
    """
    state = F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("p"), F.lit(-1).alias("last"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        v = F.greatest(x.cast("double"), F.lit(0.0))
        first, hit, gap = s["last"] < 0, v > 0, (s["i"] - s["last"]).cast("double")
        z = F.when(~hit, s["z"]).when(first, v).otherwise(s["z"] + alpha * (v - s["z"]))
        p = F.when(~hit, s["p"]).when(first, (s["i"] + 1).cast("double")).otherwise(s["p"] + alpha * (gap - s["p"]))
        return F.struct(z.alias("z"), p.alias("p"), F.when(hit, s["i"]).otherwise(s["last"]).alias("last"), (s["i"] + 1).alias("i"))

    def done(s: Column) -> Column:
        return F.when(s["last"] < 0, F.lit(0.0)).otherwise((1 - alpha / 2) * s["z"] / F.greatest(s["p"], F.lit(1.0)))

    return F.aggregate(values, state, step, done)


def additive_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """Sums that add over any grouping; ratios are taken of these sums only."""
    both = actual.isNotNull() & predicted.isNotNull()
    return {
        "abs_error": F.sum(F.when(both, F.abs(predicted - actual))),
        "signed_error": F.sum(F.when(both, predicted - actual)),
        "actual": F.sum(F.when(both, actual)),
        "n": F.count_if(both),
    }


def characterise(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lifecycle stage, zero shares, dispersion, lag-1 autocorrelation and event ratio of each series of panel rows.

    The event ratio is the mean of weeks with promoted lines to that of the others; null where a
    series has only one kind. A series is a slow mover if most weeks of its last year are empty.
    """
    n, units, share = F.count("*"), F.col("units"), F.col("zero_share_52")
    last_share = F.max_by(share, F.when(share.isNotNull(), F.col("week")))
    follows = F.corr("units", "lag_1")
    event, other = (F.avg(F.when(c, units)) for c in (F.col("promo_lines") > 0, F.col("promo_lines") == 0))
    return rows.groupBy(*keys).agg(
        F.min("week").alias("first_week"),
        F.max("week").alias("last_week"),
        n.alias("observed_weeks"),
        F.count_if(F.col("lines") > 0).alias("sold_weeks"),
        F.when(n < 52, "cold_start").when(n < 104, "developing").otherwise("established").alias("stage"),
        F.round(F.avg(F.when(units == 0, 1.0).otherwise(0.0)), 6).alias("zero_share"),
        last_share.alias("current_zero_share"),
        F.coalesce(last_share > 0.6, F.lit(False)).alias("slow_mover"),
        F.round(F.avg(units), 6).alias("mean_units"),
        F.round(F.var_samp(units) / F.nullif(F.avg(units), F.lit(0.0)), 5).alias("dispersion"),
        F.round(F.when(~F.isnan(follows), follows), 6).alias("autocorrelation"),
        F.round(event / F.nullif(other, F.lit(0.0)), 6).alias("event_ratio"),
    )
