"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Slot j of the mix takes the source in whose interval of cumulative target shares the point
frac(j * golden ratio) falls. A source's documents, in an order shuffled by a hash, form a
repeating stream of words that is cut into blocks of equal size; the source's slot of rank r takes
block r. Ranks and stream offsets are prefix sums in two levels (within a chunk, then over chunk
totals), so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import words_column, written

GOLDEN = 0.6180339887498949
CELLS = 1024
CHUNK = 1 << 16
MOST_BLOCK = 1024
SLOTS_A_SOURCE = 2000
MOST_REPEATS = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """key, source, source_size, target, low, high of each source of (key, source, size).

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share all words; a target stops at
    MOST_REPEATS times its source's size and the excess goes to the others by weight. In the order
    of cap by weight, capped sources come first, so one running sum finds the common level.
    """
    by_source = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("w", F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1)
    ranked = ranked.withColumns({"cap": MOST_REPEATS * F.col("source_size"), "total": F.sum("source_size").over(Window.partitionBy())})
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    level = (F.col("total") - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(
        fill.rowsBetween(0, Window.unboundedFollowing)
    )
    filled = ranked.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    common = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "level")))["level"]
    # the first open source has the level of all open ones
    target = F.when(F.col("open"), F.col("common") * F.col("w")).otherwise(F.col("cap").cast("double"))
    placed = filled.join(filled.agg(common.alias("common"))).withColumn("target", target)
    walk = Window.orderBy(F.col("source").asc_nulls_last())
    sums = placed.withColumns({"high": F.sum("target").over(walk.rowsBetween(Window.unboundedPreceding, 0)), "whole": F.sum("target").over(Window.partitionBy())})
    share = sums.withColumn("high", F.when(F.col("whole") > 0, F.col("high") / F.col("whole")).otherwise(0.0))
    return share.select("key", "source", "source_size", "target", F.lag("high", 1, 0.0).over(walk).alias("low"), "high")


def _running(rows: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of `value` over all rows before, by keys, in the order of chunk, then order."""
    own = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    totals = rows.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(before.drop("_sum"), [*keys, chunk]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before")


def _slots(spark: SparkSession, targets: DataFrame, n_slots: int) -> DataFrame:
    """key and rank of each slot, ranks from 0 within the source."""
    point = F.expr(f"(id * {GOLDEN!r}D) % 1D")
    slots = spark.range(n_slots).withColumn("u", point).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    cells = targets.where("high > low").withColumn("cell", F.explode(F.expr(f"sequence(cast(floor(low * {CELLS}) as int), cast(least(floor(high * {CELLS}), {CELLS}) as int))")))
    placed = slots.join(cells.select("key", "low", "high", "cell"), "cell").where("u >= low and u < high")
    chunked = placed.select("key", "id", F.expr(f"id div {CHUNK}").alias("chunk"))
    return _running(chunked, ["key"], "chunk", ["id"], F.lit(1).cast("long"), "rank").select("key", "rank")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for each row of docs(doc_id, source, text).

    taken counts the words that the mix takes, repeats included, MOST_REPEATS times the size at
    most. Null texts have size 0, null sources are a source of their own; rows that repeat a doc_id
    are documents of their own. An empty table, or one without words, takes nothing. The result is
    a function of the rows alone. Extra columns are ignored.
    """
    spark = docs.sparkSession
    sizes = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
            F.size(words_column(F.col("text").cast("string"))).cast("long").alias("size"),
        ).withColumn("shuffled", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    )
    targets = written(source_targets(sizes))
    seen = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.count("*").alias("n")).first()
    block = min(MOST_BLOCK, max(1, seen["total"] // (SLOTS_A_SOURCE * max(1, seen["n"]))))
    slots = written(_slots(spark, targets, seen["total"] // block))
    limits = targets.join(slots.groupBy("key").agg((F.count("*") * block).alias("dealt")), "key", "left").select(
        "key", "source_size", "target", F.least(F.coalesce("dealt", F.lit(0)), MOST_REPEATS * F.col("source_size")).alias("limit")
    )
    ordered = _running(sizes.withColumn("chunk", F.substring("shuffled", 1, 4)), ["key"], "chunk", ["shuffled", "doc_id", "size"], F.col("size"), "start")
    rows = ordered.join(limits, "key")
    pieces = F.expr(
        "if(size > 0 AND start < limit, flatten(transform(sequence(0L, (limit - start - 1) div source_size), p -> transform("
        f"sequence((start + p * source_size) div {block}, (least(start + size + p * source_size, limit) - 1) div {block}), b -> struct(b AS rank,"
        f" least(start + size + p * source_size, limit, (b + 1) * {block}) - greatest(start + p * source_size, b * {block}) AS words)))), array())"
    )
    # documents without a piece get a rank that no slot has, spread to keep join keys even
    nothing = F.struct((-1 - F.pmod(F.xxhash64("shuffled"), F.lit(1 << 40))).alias("rank"), F.lit(0).cast("long").alias("words"))
    whole = rows.withColumn("_piece", F.explode(F.when(F.size(pieces) > 0, pieces).otherwise(F.array(nothing))))
    found = whole.select("key", "doc_id", "source", "size", "source_size", "target", "start", F.col("_piece.rank").alias("rank"), F.col("_piece.words").alias("words"))
    met = found.join(slots.withColumn("met", F.lit(True)), ["key", "rank"], "left")
    taken = F.sum(F.when(F.col("met"), F.col("words")).otherwise(0)).alias("taken")
    once = met.where("size > 0").groupBy("key", "start", "doc_id", "source", "size", "source_size", "target").agg(taken)
    empty = met.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return once.select(cols).union(empty.select(cols))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row as often as its taken words are its size, rounded; so rows
    repeat up to MOST_REPEATS times or go. Columns stay those of docs."""
    plan = mixed(docs).where("taken * 2 >= size and size > 0")
    times = plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "size", F.expr("(2 * taken + size) div (2 * size)").cast("int").alias("_times"))
    # rows that repeat a doc_id with one size count together
    times = times.groupBy("_id", "_source", "size").agg(F.max("_times").alias("_times")).withColumnRenamed("size", "_size")
    rows = docs.withColumn("_n", F.size(words_column(F.col("text").cast("string"))).cast("long"))
    on = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("source").eqNullSafe(F.col("_source"))) & (F.col("_n") == F.col("_size"))
    return rows.join(times, on).withColumn("_copy", F.explode(F.expr("sequence(1, _times)"))).select(*docs.columns)


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, {MOST_REPEATS} * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total, count(*) OVER () AS n FROM s0),
s2 AS (SELECT *, (total - coalesce(CAST(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
         / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl FROM s1),
s3 AS (SELECT *, cap > lvl * w AS is_open FROM s2),
s4 AS (SELECT *, CASE WHEN is_open THEN (SELECT arg_min(lvl, cap / w) FROM s3 WHERE is_open) * w ELSE CAST(cap AS DOUBLE) END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN sum(target) OVER () > 0 THEN sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         / sum(target) OVER () ELSE 0 END AS high,
         greatest(1, least({MOST_BLOCK}, total // ({SLOTS_A_SOURCE} * n))) AS blk FROM s4),
s6 AS (SELECT *, lag(high, 1, 0) OVER (ORDER BY source NULLS LAST) AS low FROM s5),
p AS (SELECT (j * CAST({GOLDEN!r} AS DOUBLE)) % 1 AS u FROM (SELECT unnest(range((SELECT max(total // blk) FROM s6))) AS j)),
s7 AS (SELECT s6.source, any_value(source_size) AS source_size, any_value(target) AS target, least(count(u) * any_value(blk), any_value(cap)) AS lim
       FROM s6 LEFT JOIN p ON u >= low AND u < high GROUP BY s6.source),
r AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY shuffled, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d)
SELECT doc_id, size, s7.source_size, s7.target, CAST(
    greatest(0, least(start + size, lim) - least(start, lim))
  + greatest(0, least(start + size + s7.source_size, lim) - least(start + s7.source_size, lim))
  + greatest(0, least(start + size + 2 * s7.source_size, lim) - least(start + 2 * s7.source_size, lim)) AS BIGINT) AS taken
FROM r JOIN s7 ON r.source IS NOT DISTINCT FROM s7.source
"""
