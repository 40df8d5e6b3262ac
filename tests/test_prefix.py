"""Running sums in two levels equal plain ones."""

import random

from pyspark.sql import functions as F

from tidemark.operators.prefix import running_before


def test_equals_a_plain_walk_with_a_hot_group_and_ties(spark):
    r = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, r.choice([None, 5, 5, 5, r.randint(-3, 90)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(6)
    got = {x["k"]: (x["before"], x["total"]) for x in running_before(df, ["g"], [F.desc_nulls_last("v"), F.asc("k")], "v", total="total", ranges=12).collect()}
    for g in {x[0] for x in rows}:
        walk, whole = 0, sum(v or 0 for h, _, v in rows if h == g)
        for _, k, v in sorted((x for x in rows if x[0] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[1])):
            assert got[k] == (walk, whole)
            walk += v or 0
    assert len(got) == 3000
    assert running_before(df.limit(0), ["g"], [F.asc("k")], "v").count() == 0


def test_a_hot_group_is_in_several_ranges(spark):
    df = spark.range(4000).select(F.lit("a").alias("g"), "id", F.lit(1).alias("v"))
    plan = running_before(df, ["g"], [F.asc("id")], "v", ranges=8)
    assert plan.groupBy(F.col("before") == F.col("id")).count().count() == 1
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" in text and "_range" in text
