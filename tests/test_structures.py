"""Versions, network sums, landing checks and serving tables, against plain ones and with faults."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import topology, versions
from tidemark.sources import landing
from tidemark.sources.serving import ServingTable

DAY = dt.date(2020, 1, 1)


def at(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def test_versions_equal_a_plain_walk_and_do_not_overlap(spark):
    r = random.Random(7)
    rows = [(k, DAY + dt.timedelta(days=r.randint(0, 40)), r.choice(["x", "y", None]), r.choice([1, 2]), at(r.randint(0, 90)).replace(microsecond=i)) for k in range(12) for i in range(25)]
    df = spark.createDataFrame(rows, "k int, day date, a string, b int, known timestamp").repartition(5)
    got = versions.compress(df, ["k"], "day", ["a", "b"], "known").orderBy("k", "version_no").collect()
    want = []
    for k in range(12):
        days = {}
        for row in rows:
            if row[0] == k and (row[1] not in days or row[4] > days[row[1]][4]):
                days[row[1]] = row
        walk = [days[d] for d in sorted(days)]
        starts = [x for i, x in enumerate(walk) if i == 0 or walk[i - 1][2:4] != x[2:4]]
        want += [(k, i + 1, x[2], x[3], x[1], starts[i + 1][1] if i + 1 < len(starts) else None, x[4]) for i, x in enumerate(starts)]
    assert [tuple(x) for x in got] == want and len(want) > 60


def test_a_fact_gets_the_version_of_its_day_or_none_before_the_first(spark):
    seen = [(1, DAY + dt.timedelta(days=n), v, at(n + 5)) for n, v in ((10, "a"), (20, "b"), (30, "b"), (40, "a"))]
    df = spark.createDataFrame(seen, "k int, day date, v string, known timestamp")
    made = versions.compress(df, ["k"], "day", ["v"], "known")
    facts = spark.createDataFrame([(1, DAY + dt.timedelta(days=n)) for n in (9, 10, 19, 20, 39, 40, 400)] + [(2, DAY)], "k int, on date")
    got = {(x["k"], (x["on"] - DAY).days): (x["v"], x["version_no"]) for x in versions.effective(facts, made, ["k"], "on").collect()}
    assert got == {(1, 9): (None, None), (1, 10): ("a", 1), (1, 19): ("a", 1), (1, 20): ("b", 2), (1, 39): ("b", 2), (1, 40): ("a", 3), (1, 400): ("a", 3), (2, 0): (None, None)}
    early = versions.compress(versions.known_at(df, "known", "2020-01-26 00:00:00"), ["k"], "day", ["v"], "known").collect()
    assert [(x["v"], x["valid_to"]) for x in early] == [("a", DAY + dt.timedelta(days=20)), ("b", None)]


def test_three_levels_sum_and_a_second_parent_counts_in_full(spark):
    edges = spark.createDataFrame([("a", "p"), ("b", "p"), ("b", "q"), ("p", "top"), ("q", "top"), ("c", "top"), ("c", "top")], "child string, parent string")
    values = spark.createDataFrame([("a", 1, 5), ("b", 1, 7), ("c", 1, 1), ("p", 1, 100), ("a", 2, 3), ("a", 1, 1)], "node string, h int, v long")
    got = {(x["node"], x["h"]): x["v"] for x in topology.roll_up(values, edges, ["v"], ["h"]).collect()}
    assert got == {("a", 1): 6, ("a", 2): 3, ("b", 1): 7, ("c", 1): 1, ("p", 1): 113, ("p", 2): 3, ("q", 1): 7, ("top", 1): 121, ("top", 2): 3}


def test_a_circle_is_reported(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "child string, parent string")
    values = spark.createDataFrame([("a", 1)], "node string, v long")
    with pytest.raises(ValueError, match="circle"):
        topology.roll_up(values, edges, ["v"], most_levels=6)


def test_planted_faults_come_out_and_files_or_order_do_not_matter(spark):
    rows = spark.range(400).select((F.col("id") % 5).cast("string").alias("object"), "id", F.when(F.col("id") % 9 > 0, F.col("id") % 7).alias("v"))
    manifest = spark.read.parquet(landing.declare(rows))
    assert {x["status"] for x in landing.check_objects(manifest, rows.repartition(13).sortWithinPartitions(F.desc("id"))).collect()} == {"intact"}
    null_moved = rows.withColumn("v", F.when(F.col("id") == 9, F.lit(0)).otherwise(F.col("v")))
    twice = rows.unionByName(rows.where("id = 2"))
    gone = rows.where("object <> '3'").unionByName(rows.where("id < 3").withColumn("object", F.lit("new")))
    for arrived, want in ((null_moved, {"4": "altered"}), (twice, {"2": "altered"}), (gone, {"3": "missing", "new": "extra"})):
        path = landing.land_objects(arrived)
        landed = spark.read.schema(rows.schema).parquet(path)
        got = {x["object"]: x["status"] for x in landing.check_objects(manifest, landed).collect()}
        assert {k: v for k, v in got.items() if v != "intact"} == want


def test_a_write_that_breaks_off_is_not_seen_and_a_rollback_is_one_row(spark, tmp_path):
    table = ServingTable(spark, str(tmp_path / "served"))
    with pytest.raises(ValueError, match="active"):
        table.read()
    first = table.publish(spark.range(10).withColumn("k", F.col("id") % 2), ["k"])
    fails = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        table.publish(fails)
    assert table.active() == first and table.read().count() == 10
    unseen = table.write(spark.range(3))
    assert table.read().count() == 10
    with pytest.raises(ValueError, match="end"):
        table.activate("no-such-version")
    before = table.read()
    table.activate(unseen)
    assert table.read().count() == 3 and before.count() == 10
    table.activate(first)
    assert table.read().count() == 10 and table.manifest().count() == 3
    assert ServingTable(spark, str(tmp_path / "served")).active() == first
