"""Operators that SQL doesn't express, against plain implementations; and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import money
from tidemark.operators import features, inventory


def croston(values, alpha=0.1):
    z = p = 0.0
    last = -1
    for i, v in enumerate(values):
        if v > 0:
            if last < 0:
                z, p = v, i + 1
            else:
                z, p = z + alpha * (v - z), p + alpha * (i - last - p)
            last = i
    return 0.0 if last < 0 else (1 - alpha / 2) * z / max(p, 1.0)


def test_croston_fold(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([0, 0, 0, 1, 5]) for _ in range(r.randint(0, 40))]) for i in range(50)]
    got = dict(spark.createDataFrame(rows, "i int, v array<int>").select("i", features.croston(F.col("v"))).collect())
    for i, v in rows:
        assert abs(got[i] - croston(v)) < 1e-9


def test_replay_fold(spark):
    def plain(demands, opening, target, lead):
        stock, pipe, served, lost, out = opening, [0] * lead, 0, 0, 0
        for d in demands:
            held = stock + pipe.pop(0)
            s = min(held, d)
            served, lost, out, stock = served + s, lost + d - s, out + (d > s), held - s
            pipe.append(max(0, target - stock - sum(pipe)))
        return stock, served, lost, out

    r = random.Random(2)
    rows = [(i, [r.randint(0, 9) for _ in range(30)], r.randint(0, 20), r.randint(0, 30)) for i in range(20)]
    for lead in (1, 2, 4):
        df = spark.createDataFrame(rows, "i int, d array<int>, o int, t int").select("i", inventory.replay(F.col("d"), F.col("o"), F.col("t"), lead).alias("r"))
        got = {x["i"]: (x["r"]["stock"], x["r"]["served"], x["r"]["lost"], x["r"]["out_weeks"]) for x in df.collect()}
        assert got == {i: plain(d, o, t, lead) for i, d, o, t in rows}


def test_transfers_match_intervals_round_by_round(spark):
    r = random.Random(3)
    areas = "abc"
    lanes = [(0, x, x) for x in areas] + [(1, "a", "b"), (1, "a", "c"), (1, "b", "a")]
    free = [(sku, r.choice(areas), site, r.randint(0, 9)) for sku in range(8) for site in range(6)]
    need = [(sku, r.choice(areas), site, r.randint(0, 9)) for sku in range(8) for site in range(10, 17)]

    def plain():
        left, lack, moves = {(k, s): n for k, _, s, n in free}, {(k, t): n for k, _, t, n in need}, set()
        for k in (0, 1):
            then, owed = dict(left), dict(lack)
            for sku in range(8):
                for origin in areas:
                    to = {d for n, o, d in lanes if n == k and o == origin}
                    sources = sorted(([-then[sku, s], s] for q, a, s, _ in free if q == sku and a == origin and then[sku, s] > 0))
                    targets = sorted(([-owed[sku, t], t] for q, a, t, _ in need if q == sku and a in to and owed[sku, t] > 0))
                    while sources and targets:
                        moved = min(-sources[0][0], -targets[0][0])
                        moves.add((k, sku, sources[0][1], targets[0][1], moved))
                        left[sku, sources[0][1]] -= moved
                        lack[sku, targets[0][1]] -= moved
                        for side in (sources, targets):
                            side[0][0] += moved
                            if side[0][0] == 0:
                                side.pop(0)
        return moves, left, lack

    moves, left, lack = plain()
    supply = spark.createDataFrame(free, "sku long, area string, source long, free long")
    demand = spark.createDataFrame(need, "sku long, area string, target long, need long")
    got = inventory.transfers(supply, demand, spark.createDataFrame(lanes, "round int, origin string, destination string"), 2).collect()
    assert {tuple(x) for x in got} == moves and len(got) == len(moves) and any(x[0] for x in moves)
    assert min(left.values()) >= 0 and min(lack.values()) >= 0
    assert inventory.transfers(supply.limit(0), demand, spark.createDataFrame(lanes, "round int, origin string, destination string"), 2).count() == 0


def test_largest_remainder_sums_to_the_total(spark):
    r = random.Random(4)
    rows = [(g, i, total, r.randint(0, 9)) for g in range(30) for total in [r.randint(0, 10**12)] for i in range(r.randint(1, 7))]
    df = money.largest_remainder(spark.createDataFrame(rows, "g int, i int, total long, w int"), ["g"], "total", "w", "i", "part")
    sums = df.groupBy("g").agg(F.sum("part").alias("s"), F.max("total").alias("t"), F.sum("w").alias("w")).collect()
    assert all(x["s"] == (x["t"] if x["w"] else 0) for x in sums)


def test_exact_minor(spark):
    rows = [("12.34", "EUR"), ("12.345", "EUR"), ("1", "XXX"), (None, "EUR"), ("92233720368547758.07", "USD"), ("92233720368547758.08", "USD")]
    df = spark.createDataFrame(rows, "a string, c string").select(money.exact_minor(F.col("a").cast("decimal(28,6)"), F.col("c")).alias("m"), money.invalid_minor(F.col("a").cast("decimal(28,6)"), F.col("c")).alias("bad"))
    assert [tuple(x) for x in df.collect()] == [(1234, False), (None, True), (None, True), (None, False), (9223372036854775807, False), (None, True)]


def test_service_level_bounds():
    assert abs(inventory.service_z(0.96) - 1.750686) < 1e-6
    with pytest.raises(ValueError):
        inventory.service_z(0.4)


def test_panel_features_never_hold_their_own_week(spark):
    weeks = spark.createDataFrame([("a", i, 10**i) for i in range(6)], "k string, week int, units long")
    rows = {x["week"]: x for x in features.panel(weeks, ["k"]).collect()}
    assert rows[0]["lag_1"] is None and rows[0]["mean_4"] is None and rows[5]["target_1"] is None
    assert rows[3]["lag_1"] == 100 and rows[3]["mean_4"] == 37.0 and rows[3]["target_1"] == 10**4


def test_replay_of_many_cells_equals_the_fold(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import inventory as inv

    rows = [(k, w, (k * 7 + w * 3) % 11 * (1 + k % 4)) for k in range(40) for w in range(12) if (k + w) % 3 and (k * 7 + w * 3) % 11]
    sums = spark.createDataFrame(rows, "cell long, w int, u long")
    cells = sums.groupBy("cell").agg(F.collect_list(F.struct("w", "u")).alias("entries"), F.map_from_entries(F.collect_list(F.struct("w", "u"))).alias("m")).withColumn("target", F.col("cell") % 25)
    fold = cells.withColumn("d", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))))
    want = {r["cell"]: (r["r"]["served"], r["r"]["lost"], r["r"]["out_weeks"], r["r"]["stock"]) for r in fold.select("cell", inv.replay(F.col("d"), F.col("target"), F.col("target"), 2).alias("r")).collect()}
    got = {r["cell"]: (r["served"], r["lost"], r["out_weeks"], r["closing"]) for r in inv.replay_cells(cells, 12, ["cell"]).collect()}
    assert got == want and any(x[1] for x in want.values())
    assert inv.replay_cells(cells.limit(0), 12, ["cell"]).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from tidemark.sources.tables import scratch

    def session(master: str, folder: str | None) -> SimpleNamespace:
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(session("spark://host:7077", None), "x")
    assert scratch(session("spark://host:7077", "/shared/"), "x").startswith("/shared/x-")
    assert "tidemark-" in scratch(session("local[2]", None), "x")


def test_tasks_of_the_panel_grow_with_the_lines(spark, monkeypatch):
    from tidemark.plans import panel as plan
    from tidemark.sources import tables

    sf, lines = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    monkeypatch.setattr(tables.line_tasks, "__defaults__", (200,))
    for name in ("feat_panel", "history_full", "history_partial", "quality_inputs"):
        assert plan.QUERIES[name](spark, sf).rdd.getNumPartitions() == -(-lines // 200) > 8


def test_cells_and_forecasts_read_the_lines_once(spark):
    from tidemark.plans import inventory as plan

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")

    assert scans(plan._cells(spark, "/root/testdata/sf0.001")) == 1
    # cells with demand and weeks of series are written, so neither is computed again
    assert scans(plan._supply(spark, "/root/testdata/sf0.001")) == 0
    found = plan._cells(spark, "/root/testdata/sf0.001").select("sku", "location", "daily").where("daily is not null")
    want = inventory.trailing_daily(plan.sale_lines(spark, "/root/testdata/sf0.001"), plan.TODAY)
    assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0 < want.count()


def test_tasks_of_order_shares_and_roll_ups_grow_with_the_lines(spark, monkeypatch):
    from tidemark.plans import basics, reports
    from tidemark.sources import tables

    sf, lines = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    monkeypatch.setattr(tables.line_tasks, "__defaults__", (400,))
    for query in (basics.QUERIES["largest_remainder"], reports.QUERIES["inv_node_demand"]):
        assert query(spark, sf).rdd.getNumPartitions() == -(-lines // 400) > 8
