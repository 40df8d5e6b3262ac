"""Forecasts by horizon: coverage, error and contributions on later weeks, and their building blocks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import horizons as hz
from tidemark.plans import horizons as plans

SF = "/root/testdata/sf0.01"
MONDAY = dt.date(2001, 1, 1)


def week(n):
    return MONDAY + dt.timedelta(weeks=n)


def test_quantiles_cover_and_beat_the_seasonal_forecast_at_all_horizons(spark):
    rows = plans.fc_quantile_model(spark, SF).where("seasonal is not null").cache()
    assert rows.select("h").distinct().count() == 26 and rows.where("p90 < p50 or p50 < 0").count() == 0
    band = F.when(F.col("h") <= 4, "near").when(F.col("h") <= 13, "mid").otherwise("far")
    err = lambda c: F.sum(F.abs(F.col(c) - F.col("actual")))
    got = rows.groupBy(band.alias("band")).agg(F.avg((F.col("actual") <= F.col("p90")).cast("double")).alias("covered"), err("p50").alias("a"), err("seasonal").alias("b")).collect()
    assert {r["band"] for r in got} == {"near", "mid", "far"}
    for r in got:
        assert 0.85 <= r["covered"] <= 0.95 and r["a"] < 0.9 * r["b"], r


def test_level_and_parts_sum_to_every_forecast(spark):
    rows = plans.forecasts(spark, SF)
    total = F.col("base") + F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    assert rows.where(F.abs(total - F.col("p50")) > 1e-6).count() == 0
    assert rows.where(F.exists("parts", lambda v: F.abs(v) > 1e-9)).count() > 0


def test_shares_of_drivers_add_up(spark):
    sums = plans.fc_driver_share(spark, SF).groupBy("market", "origin").agg(F.sum("share_ppm").alias("s")).collect()
    assert sums and {r["s"] for r in sums} == {1_000_000}
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", -1.0), ("a", "z", 1.0), ("b", "x", 0.0)], "g string, driver string, contribution double")
    got = {(r["g"], r["driver"]): (r["share_ppm"], r["direction"]) for r in hz.shares(rows, ["g"]).collect()}
    assert got == {("a", "x"): (333334, "up"), ("a", "y"): (333333, "down"), ("a", "z"): (333333, "up"), ("b", "x"): (0, "none")}


def test_series_parts_sum_to_the_portfolio(spark):
    rows = plans.fc_driver_series(spark, SF)
    whole = F.sum(F.when(F.col("category") == "portfolio", F.col("contribution")).otherwise(0)).alias("whole")
    parts = F.sum(F.when(F.col("category") != "portfolio", F.col("contribution")).otherwise(0)).alias("parts")
    assert rows.groupBy("origin", "driver").agg(whole, parts).where("abs(whole - parts) > 0.01").count() == 0


def test_origins_see_no_later_week_and_dense_series_have_every_week(spark):
    sold = [("a", week(n), 10 + n) for n in range(0, 80, 2)] + [("b", week(70), 5)]
    dense = hz.dense_series(spark.createDataFrame(sold, "k string, week date, units long"), ["k"])
    got = {(r["k"], r["week"]): r["units"] for r in dense.collect()}
    assert len(got) == 79 + 9 and got["a", week(3)] == 0 and got["a", week(4)] == 14 and got["b", week(78)] == 0
    origins = {(r["k"], r["week"]): r for r in hz.origin_rows(dense, ["k"]).collect()}
    at = origins["a", week(60)]
    assert at["mean_4"] == pytest.approx((70 + 0 + 68 + 0) / 4) and at["ahead"] == [got["a", week(n)] for n in range(61, 79)]
    assert at["year_ago"] == [got["a", week(60 + h - 52)] for h in range(1, 27)]
    assert origins["a", week(50)]["year_ago"] is None and origins["a", week(51)]["year_ago"] is not None
    rows = {r["h"]: r for r in hz.horizon_rows(hz.origin_rows(dense, ["k"]), ["k"]).where(F.col("origin") == F.lit(week(60))).collect()}
    assert rows[1]["actual"] == 0.0 and rows[2]["actual"] == 72.0 and rows[26]["actual"] is None and rows[26]["seasonal"] == 44.0


def test_blend_weight_falls_back_to_its_group_and_to_all(spark):
    # (group, h, low, high, actual, used): `low` is right in a, `high` in b; c has too few rows, d none that count
    rows = [("a", 1, 10.0, 0.0, 10.0, True)] * 4 + [("a", 2, 10.0, 0.0, 10.0, True)] + [("b", 1, 10.0, 0.0, 0.0, True)] * 9 + [("c", 1, 5.0, 1.0, 5.0, True)] + [("d", 1, 5.0, 1.0, 5.0, False)] * 9
    df = spark.createDataFrame(rows, "g string, h int, low double, high double, actual double, used boolean")
    got = {(r.g, r.h): (r.n, r.source, r.weight) for r in hz.blend_weights(df, "g", "low", "high", least_rows=4).collect()}
    assert got == {("a", 1): (4, "own", 1.0), ("a", 2): (1, "group", 1.0), ("b", 1): (9, "own", 0.0), ("c", 1): (1, "all", 0.0), ("d", 1): (0, "all", 0.0)}
    assert hz.blend_weights(df.limit(0), "g", "low", "high").count() == 0


def test_characterise_over_made_weeks(spark):
    from tidemark.operators import features

    sold = [("a", dt.date(2020, 1, 6), 8, 1, 1), ("a", dt.date(2020, 1, 27), 2, 1, 0), ("b", dt.date(2020, 1, 27), 3, 2, 0)]
    dense = hz.dense_series(spark.createDataFrame(sold, "k string, week date, units long, lines long, promo_lines long"), ["k"], ("lines", "promo_lines"))
    got = {r.k: r for r in features.characterise(features.panel(dense, ["k"]), ["k"]).collect()}
    a, b = got["a"], got["b"]
    assert (a.observed_weeks, a.sold_weeks, a.zero_share, a.mean_units) == (4, 2, 0.5, 2.5)
    assert abs(a.event_ratio - 8 / (2 / 3)) < 1e-6 and a.slow_mover and abs(a.current_zero_share - 2 / 3) < 1e-6
    assert (b.observed_weeks, b.event_ratio, b.autocorrelation, b.slow_mover) == (1, None, None, False)
