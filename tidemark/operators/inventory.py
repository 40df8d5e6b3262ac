"""Inventory and replenishment: health, classes, buffers, orders, transfers and policy replay."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch
from .prefix import running_before


def _trails(until: str, days: int) -> Column:
    return (F.col("business_date") <= F.lit(until).cast("date")) & (F.col("business_date") > F.date_sub(F.lit(until).cast("date"), days))


def trailing_daily(lines: DataFrame, until: str, days: int = 91) -> DataFrame:
    """Mean daily units of each cell over the days up to a date."""
    return lines.where(_trails(until, days)).groupBy("sku", "location").agg((F.sum("units") / F.lit(days)).alias("daily"))


def trailing_mean(until: str, days: int = 91) -> Column:
    """The same as an aggregate over all lines of a cell: null where none lies in these days."""
    return F.sum(F.when(_trails(until, days), F.col("units"))) / F.lit(days)


def health(cells: DataFrame, under: float = 7, over: float = 45) -> DataFrame:
    """Class, cover and reason of cells with atp, position, daily and active.

    No demand makes a cell dead whatever its stock; then stockout comes before understock and
    overstock. Cover is null without demand.
    """
    daily = F.coalesce("daily", F.lit(0.0))
    cover = F.col("position") / F.nullif(daily, F.lit(0.0))
    kind = F.when(daily == 0, "dead").when(F.col("atp") == 0, "stockout").when(cover < under, "understock").when(cover > over, "overstock").otherwise("healthy")
    reason = F.when((daily == 0) & ~F.col("active"), "DEAD_STOCK_DEASSORTED").when(daily == 0, "DEAD_STOCK_NO_DEMAND")
    return cells.withColumns({"health": kind, "cover_days": F.round(cover, 6), "reason": reason})


def abc(values: DataFrame, group: str, keys: list[str], value: str, a: float = 0.80, b: float = 0.95) -> DataFrame:
    """Class by the share of value before the row, ranked by value, then keys; null values have none."""
    ranked = running_before(values, [group], [F.desc_nulls_last(value), *(F.asc(k) for k in keys)], value, "_before", "_total")
    before = F.coalesce(F.col("_before") / F.col("_total"), F.lit(0.0))
    # null values come last, so they change no sum before a valued row
    return ranked.withColumn("abc", F.when(F.col(value).isNull(), None).when(before < a, "A").when(before < b, "B").otherwise("C")).drop("_before", "_total")


def service_z(level: float) -> float:
    """Normal quantile of a service level between 0.5 and 0.995."""
    if not 0.50 <= level <= 0.995:
        raise ValueError(f"service level {level} is outside [0.50, 0.995]")
    return NormalDist().inv_cdf(level)


def forecast_arrays(forecasts: DataFrame, keys: list[str], decided: str, level: float = 0.90) -> DataFrame:
    """keys, origin, p50 and dev of forecasts(keys, origin, h, p50, p90): arrays by horizon of the latest origin up to a day.

    dev is the deviation that the distance of P90 to P50 stands for. An array has a week for each horizon.
    """
    known = forecasts.where(F.col("origin") <= F.lit(decided).cast("date"))
    by_origin = known.groupBy(*keys, "origin").agg(F.array_sort(F.collect_list(F.struct("h", "p50", "p90"))).alias("w"))
    latest = by_origin.groupBy(*keys).agg(F.max("origin").alias("origin"), F.max_by("w", "origin").alias("w"))
    z = NormalDist().inv_cdf(level)
    return latest.select(*keys, "origin", F.transform("w", lambda x: x["p50"]).alias("p50"), F.transform("w", lambda x: (x["p90"] - x["p50"]) / z).alias("dev"))


def horizon_weight(days: Column, h: Column, weeks: Column) -> Column:
    """Share of week h, from 0, that a window of days covers; the last week stands for all that is beyond it."""
    left = F.greatest(F.lit(0.0), days / 7.0 - h)
    return F.when(h < weeks - 1, F.least(F.lit(1.0), left)).otherwise(left)


def horizon_sum(values: Column, days: Column) -> Column:
    """Sum of an array of weeks over a window of days, cut within a week."""
    return F.aggregate(F.transform(values, lambda v, h: horizon_weight(days, h, F.size(values)) * v), F.lit(0.0), lambda s, v: s + v)


def horizon_rss(values: Column, days: Column) -> Column:
    """Root of the weighted sum of squares over the window."""
    return F.sqrt(F.aggregate(F.transform(values, lambda v, h: horizon_weight(days, h, F.size(values)) * v * v), F.lit(0.0), lambda s, v: s + v))


def protected(cells: DataFrame, forecasts: DataFrame, keys: list[str], decided: str, level: float) -> DataFrame:
    """cells(keys, daily, days, variance) with need, sigma, weekly, next_week and safety from the forecasts of their series.

    A cell has the share of its series' forecast that it has of the series' recent demand; of the
    deviation, the root of that share, as cells miss independently. Cells of a series without a
    forecast known by the decision day are left out. Cells are written once, as they are read twice.
    """
    path = scratch(cells.sparkSession, "cells")
    cells.write.parquet(path)
    cells = cells.sparkSession.read.parquet(path)
    units = F.sum(F.round(F.col("daily") * 91).cast("long"))
    whole = cells.groupBy(*keys).agg(units.alias("_whole"))
    known = forecast_arrays(forecasts, keys, decided)
    rows = cells.join(whole.join(known, keys), keys).withColumn("share", F.round(F.col("daily") * 91).cast("long") / F.col("_whole"))
    days, share = F.col("days"), F.col("share")
    rows = rows.withColumns({"need": share * horizon_sum(F.col("p50"), days), "sigma": F.sqrt(share) * horizon_rss(F.col("dev"), days), "next_week": share * F.get("p50", F.lit(0))})
    rows = rows.withColumn("weekly", F.col("need") / (days / 7.0))
    return rows.withColumn("safety", safety_stock(F.col("sigma"), F.col("weekly"), F.col("variance"), level)).drop("_whole", "p50", "dev", "origin")


def safety_stock(sigma: Column, mean_weekly: Column, lead_variance: Column, level: float) -> Column:
    """Demand and lead-time parts in quadrature; an unknown variance adds nothing."""
    lead = mean_weekly * F.sqrt(F.coalesce(lead_variance, F.lit(0.0)))
    return service_z(level) * F.sqrt(sigma * sigma + lead * lead)


def order_quantity(raw: Column, moq: Column, pack: Column, position: Column, daily: Column, max_cover: int) -> tuple[Column, Column]:
    """(units, reason): least quantity, then packs, then the cover cap; a conflict orders nothing and says so."""
    wanted = F.ceil(F.greatest(raw, moq.cast("double")) / pack) * pack
    least = F.ceil(moq / pack) * pack
    cap = daily * max_cover - position
    shrunk = F.floor(cap / pack) * pack
    none = (raw <= 0) | (daily < 0) | (cap <= 0)
    conflict = ~none & (wanted > cap) & ((wanted == least) | (shrunk < moq) | (shrunk <= 0))
    units = F.when(none | conflict, F.lit(0)).when(wanted > cap, shrunk).otherwise(wanted).cast("long")
    return units, F.when(conflict, F.lit("CAP_CONFLICT"))


def allocate(demand: DataFrame, group: list[str], wanted: str, pool: str, order: list[str]) -> DataFrame:
    """Units of a pool given out in priority order: what is left of it, but no more than wanted."""
    before = F.coalesce(F.sum(wanted).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return demand.withColumn("allocated", F.least(F.col(wanted), F.greatest(F.lit(0), F.col(pool) - before)))


def match_intervals(supply: DataFrame, demand: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, target and moved: supply(keys, source, free) given to demand(keys, target, need) within each group of keys.

    Sources by free, targets by need, both from the largest down, ties by name, are laid end to end on
    one line of units; a move is where a source's stretch meets a target's. The ends of all stretches
    cut the line into pieces, and a running window finds the source and target that hold each piece, so
    a group of s sources and t targets takes s + t rows and makes fewer moves than that, never pairs.
    """

    def ends(rows: DataFrame, name: str, size: str) -> DataFrame:
        walk = Window.partitionBy(*keys).orderBy(F.desc(size), name).rowsBetween(Window.unboundedPreceding, 0)
        held = {c: F.col(c) if c == name else F.lit(None).cast(rows.schema[name].dataType) for c in ("source", "target")}
        return rows.where(F.col(size) > 0).withColumn("at", F.sum(size).over(walk)).select(*keys, "at", *(v.alias(c) for c, v in held.items()))

    cuts = ends(supply, "source", "free").unionByName(ends(demand, "target", "need"))
    cuts = cuts.groupBy(*keys, "at").agg(F.max("source").alias("source"), F.max("target").alias("target"))
    back = Window.partitionBy(*keys).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("at", 1, 0).over(Window.partitionBy(*keys).orderBy("at"))
    pieces = cuts.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in ("source", "target")} | {"moved": F.col("at") - before})
    return pieces.where("source is not null and target is not null").select(*keys, "source", "target", "moved")


def transfers(supply: DataFrame, demand: DataFrame, lanes: DataFrame, rounds: int) -> DataFrame:
    """round, sku, source, target and moved: supply(sku, area, source, free) moved to demand(sku, area, target, need) over lanes(round, origin, destination).

    Round by round, from 0, what is still free in a lane's origin is matched with what its destinations
    still lack; a destination has one origin a round, so a source or target is in one group a round.
    Each round's moves are written before the next reads them.
    """
    spark = supply.sparkSession
    done = None
    for k in range(rounds):
        lane = lanes.where(F.col("round") == k).select("origin", "destination")
        free, need = supply.withColumnRenamed("area", "origin"), demand.withColumnRenamed("area", "destination")
        if done is not None:
            given = done.groupBy("sku", "source").agg(F.sum("moved").alias("_gone"))
            got = done.groupBy("sku", "target").agg(F.sum("moved").alias("_gone"))
            free = free.join(given, ["sku", "source"], "left").withColumn("free", F.col("free") - F.coalesce("_gone", F.lit(0)))
            need = need.join(got, ["sku", "target"], "left").withColumn("need", F.col("need") - F.coalesce("_gone", F.lit(0)))
        asked = need.join(lane, "destination").select("sku", "origin", "target", "need")
        path = scratch(spark, "moves")
        match_intervals(free.select("sku", "origin", "source", "free"), asked, ["sku", "origin"]).select(F.lit(k).alias("round"), "sku", "source", "target", "moved").write.parquet(path)
        moved = spark.read.parquet(path)
        done = moved if done is None else done.unionByName(moved)
    return done


def replay_cells(cells: DataFrame, weeks: int, keys: list[str]) -> DataFrame:
    """keys, served, lost, out_weeks, closing of cells(keys, entries, target): weekly receive, serve and order-up-to.

    `entries` lists (w, u), the units asked in the weeks that have any. The cells of a batch go
    through the weeks together, as columns of one array; an order arrives two weeks later.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, target = len(frame), frame["target"].to_numpy(np.int64)
            size = frame["ws"].map(len).to_numpy() if n else np.zeros(0, np.int64)
            demand = np.zeros((weeks, n), dtype=np.int64)
            if n:
                demand[np.concatenate(frame["ws"].to_list()), np.repeat(np.arange(n), size)] = np.concatenate(frame["us"].to_list())
            stock, first, second = target.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
            served, lost, out = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for asked in demand:
                stock += first
                given = np.minimum(stock, asked)
                stock -= given
                served += given
                lost += asked - given
                out += asked > given
                first, second = second, np.maximum(0, target - stock - second)
            yield pd.DataFrame({**{k: frame[k] for k in keys}, "served": served, "lost": lost, "out_weeks": out, "closing": stock})

    lists = cells.select(*keys, "target", F.col("entries.w").alias("ws"), F.col("entries.u").alias("us"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema)
    return lists.mapInPandas(run, f"{shape}, served long, lost long, out_weeks long, closing long")


def replay(demands: Column, opening: Column, target: Column, lead: int) -> Column:
    """Weekly receive, serve and order-up-to over an ordered array of demands, as a fold.

    Returns served and lost units, weeks with a stockout, and the closing stock. An order of week t
    arrives `lead` weeks later.
    """
    zero = F.lit(0).cast("long")
    pipe = F.transform(F.sequence(F.lit(1), F.lit(lead)), lambda _: zero)
    start = F.struct(opening.cast("long").alias("stock"), pipe.alias("pipe"), zero.alias("served"), zero.alias("lost"), zero.alias("out_weeks"))

    def step(s: Column, d: Column) -> Column:
        held = s["stock"] + F.element_at(s["pipe"], 1)
        served = F.least(held, d.cast("long"))
        lost = d.cast("long") - served
        close = held - served
        waiting = F.aggregate(F.slice(s["pipe"], 2, lead), zero, lambda a, x: a + x)
        order = F.greatest(zero, target.cast("long") - close - waiting)
        pipe = F.concat(F.slice(s["pipe"], 2, lead), F.array(order)) if lead > 1 else F.array(order)
        return F.struct(close.alias("stock"), pipe.alias("pipe"), (s["served"] + served).alias("served"), (s["lost"] + lost).alias("lost"), (s["out_weeks"] + F.when(lost > 0, 1).otherwise(0)).alias("out_weeks"))

    return F.aggregate(demands, start, step)


def cohort(key: Column, salt: str, percent: int = 5) -> Column:
    """Stable split of keys by a salted hash: `percent` of a hundred are candidates."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "|"), key.cast("string")), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return F.when(head % 100 < percent, "candidate").otherwise("incumbent")
