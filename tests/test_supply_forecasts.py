"""Orders follow the forecasts they are given."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import horizons as hz
from tidemark.operators import inventory as inv
from tidemark.plans import inventory as plans

SF = "/root/testdata/sf0.001"


def test_changing_a_forecast_changes_an_order(spark):
    told = plans.cell_forecasts(spark, SF).cache()
    market = told.select("market").orderBy("market").first()["market"]
    more = told.withColumns({c: F.when(F.col("market") == market, F.col(c) * 3).otherwise(F.col(c)) for c in ("p50", "p90")})
    before = {(r["sku"], r["location"]): r for r in plans.ordered(spark, SF, told).collect()}
    after = {(r["sku"], r["location"]): r for r in plans.ordered(spark, SF, more).collect()}
    assert before.keys() == after.keys()
    assert all(after[k]["need"] == pytest.approx(before[k]["need"] * (3 if before[k]["market"] == market else 1)) for k in before)
    changed = {before[k]["market"] for k in before if before[k]["order_units"] != after[k]["order_units"]}
    assert changed <= {market}
    assert any(after[k]["raw"] > before[k]["raw"] for k in before if before[k]["market"] == market)


def test_only_forecasts_known_by_the_day_count_and_shares_sum_to_the_series(spark):
    day = dt.date(2001, 1, 1)
    told = [("a", day + dt.timedelta(weeks=w), h, 10.0 * (w + 1) + h, 10.0 * (w + 1) + h + 2) for w in range(3) for h in (1, 2, 3)]
    forecasts = spark.createDataFrame(told, "k string, origin date, h int, p50 double, p90 double")
    cells = spark.createDataFrame([("a", 1, 1.0, 17.5, None), ("a", 2, 3.0, 17.5, 0.25), ("b", 3, 1.0, 7.0, None)], "k string, cell int, daily double, days double, variance double")
    got = {r["cell"]: r for r in inv.protected(cells, forecasts, ["k"], "2001-01-10", 0.96).collect()}
    assert set(got) == {1, 2}
    week = 21 + 22 + 0.5 * 23
    assert got[1]["need"] == pytest.approx(week / 4) and got[2]["need"] == pytest.approx(week * 3 / 4)
    dev = 2 / inv.service_z(0.90)
    assert got[1]["sigma"] == pytest.approx(math.sqrt(2.5 * dev * dev / 4)) and got[1]["safety"] == pytest.approx(inv.service_z(0.96) * got[1]["sigma"])
    lead = week * 3 / 4 / 2.5 * 0.5
    assert got[2]["safety"] == pytest.approx(inv.service_z(0.96) * math.hypot(got[2]["sigma"], lead))


def test_windows_beyond_the_last_horizon_go_on_with_its_week(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 4.0], d) for d in (0.0, 3.5, 14.0, 21.0, 35.0)], "v array<double>, days double")
    got = [r["s"] for r in rows.orderBy("days").select(inv.horizon_sum(F.col("v"), F.col("days")).alias("s")).collect()]
    assert got == pytest.approx([0.0, 0.5, 3.0, 7.0, 15.0])


def test_baseline_forecasts_learn_their_spread_from_past_misses(spark):
    day = dt.date(2000, 1, 3)
    sold = [(k, "m", day + dt.timedelta(weeks=w), (w * 7919 + ord(k)) % 50) for k in "abc" for w in range(130)]
    dense = hz.dense_series(spark.createDataFrame(sold, "k string, market string, week date, units long"), ["k", "market"])
    rows = hz.baseline_forecasts(dense, ["k", "market"], "market").collect()
    assert len(rows) == 3 * 26 and {r["origin"] for r in rows} == {day + dt.timedelta(weeks=129)}
    of = {(k, w): (w * 7919 + ord(k)) % 50 for k in "abc" for w in range(130)}
    for r in rows:
        mean = sum(of[r["k"], w] for w in range(117, 130)) / 13
        assert r["p50"] == pytest.approx((of[r["k"], 129 + r["h"] - 52] + mean) / 2) and r["p90"] >= r["p50"]
