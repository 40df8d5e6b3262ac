"""Quantile sketches by period: rank error, merging, and reruns that read new periods only."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.sketches import RANK_ERROR, SketchStore, fallback


def test_merged_sketches_keep_the_rank_error(spark, tmp_path):
    r = random.Random(9)
    rows = [(g, w, r.expovariate(1) * (1 + w) - w) for g in "ab" for w in range(6) for _ in range(2500 if g == "a" else 40)]
    df = spark.createDataFrame(rows, "g string, w int, v double").repartition(7)
    store = SketchStore(spark, str(tmp_path / "s"), ["g"], "v", "w")
    store.add(df)
    for where, weeks in (("true", range(6)), ("w >= 4", (4, 5))):
        for x in store.quantiles([0.1, 0.5, 0.9], where).collect():
            own = [v for g, w, v in rows if g == x["g"] and w in weeks]
            assert x["n"] == len(own)
            for level, q in zip((0.1, 0.5, 0.9), x["q"]):
                assert sum(v <= q for v in own) / len(own) >= level - RANK_ERROR and sum(v < q for v in own) / len(own) <= level + RANK_ERROR


def test_a_rerun_over_one_more_period_reads_that_one_only(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.range(3000).select((F.col("id") % 3).alias("w"), F.col("id").cast("double").alias("v"))
    rows.write.partitionBy("w").parquet(path)
    store = SketchStore(spark, str(tmp_path / "s"), [], "v", "w")
    store.add(spark.read.parquet(path))
    more = spark.range(500).select(F.lit(3).cast("long").alias("w"), F.lit(-1.0).alias("v"))
    more.write.mode("append").partitionBy("w").parquet(path)
    added = store.add(spark.read.parquet(path))
    assert {x["w"] for x in added.collect()} == {3}
    plan = added._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [NOT w" in plan and "numPartitions" not in plan
    assert store.add(spark.read.parquet(path)).count() == 0
    assert [(x["n"], x["q"][0]) for x in store.quantiles([0.5], "w = 3").collect()] == [(500, -1.0)]
    assert store.quantiles([0.5]).first()["n"] == 3500


def test_small_groups_fall_back_and_new_stores_say_so(spark, tmp_path):
    own = spark.createDataFrame([("a", 100, [1.0]), ("b", 5, [9.0])], "g string, n long, q array<double>")
    whole = spark.createDataFrame([(105, [2.0])], "n long, q array<double>")
    assert {tuple(x[:2]) + (x["q"][0], x["own"]) for x in fallback(own, whole, ["g"], 20).collect()} == {("a", 100, 1.0, True), ("b", 5, 2.0, False)}
    with pytest.raises(ValueError, match="no period"):
        SketchStore(spark, str(tmp_path / "none"), ["g"], "v", "w").quantiles([0.5])
