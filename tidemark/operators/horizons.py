"""Forecasts of each of the coming weeks by quantile trees, and what each feature adds to them.

A row is a series, an origin week and a horizon, so one model serves all horizons. Trees of
`pyspark.ml` split the rows by the mean of the ratio to the series' level; every leaf is then given
the quantiles of its own rows by mergeable sketches, and a row's quantile is the mean over its
leaves. The model is a table of nodes, bounded by trees and depth whatever the input, so leaves and
paths become literals and scoring is a projection without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch

HORIZONS = 26
#: horizon bands that share a correction of the spread: their last horizons
BANDS = {"near": 4, "mid": 13, "far": 26}
INPUTS = ("horizon", "season", "season_mean", "last", "mean_4", "mean_8", "mean_26", "mean_52", "dev_13", "zero_share_52", "trend", "week_of_year")


def dense_series(weeks: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """weeks(keys, week, units) with every Monday week of a series from its first to the last of all series, zero where it sold nothing.

    The last week of the table is one row; a series that stopped selling goes on with zeros. Columns
    in `more` are counted like units. The weeks that sold are written once, as they are read twice.
    """
    path = scratch(weeks.sparkSession, "weeks")
    weeks.select(*keys, "week", "units", *more).write.parquet(path)
    weeks = weeks.sparkSession.read.parquet(path)
    last = weeks.agg(F.max("week").alias("_end"))  # one row
    walk = Window.partitionBy(*keys).orderBy("week")
    rows = weeks.select(*keys, "week", "units", *more).crossJoin(F.broadcast(last))
    until = F.coalesce(F.date_sub(F.lead("week").over(walk), 7), F.col("_end"))
    each = rows.withColumn("_until", until).withColumn("at", F.explode(F.sequence("week", "_until", F.expr("interval 7 days"))))
    sold = F.col("at") == F.col("week")
    return each.select(*keys, F.col("at").alias("week"), *(F.when(sold, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("units", *more)))


def origin_rows(weeks: DataFrame, keys: list[str], *, horizons: int = HORIZONS) -> DataFrame:
    """A row for each week of dense weeks(keys, week, units): what is known at its end, and the coming weeks.

    `ahead` has the units of the coming weeks as far as they are in the table, `year_ago` those of
    52 weeks before each coming week; null where the series is younger.
    """
    walk = Window.partitionBy(*keys).orderBy("week")
    units = F.col("units")
    mean = {f"mean_{n}": F.avg(units).over(walk.rowsBetween(1 - n, 0)) for n in (4, 8, 13, 26, 52)}
    last13 = walk.rowsBetween(-12, 0)
    n, s, q = F.count("*").over(last13), F.sum(units).over(last13), F.sum(units * units).over(last13)
    more = {
        "dev_13": F.when(n > 1, F.sqrt((n * q - s * s) / (n * (n - 1)))),
        "zero_share_52": F.avg(F.when(units == 0, 1.0).otherwise(0.0)).over(walk.rowsBetween(-51, 0)),
        "age": F.row_number().over(walk),
        "ahead": F.collect_list(units).over(walk.rowsBetween(1, horizons)),
        "_past": F.collect_list(units).over(walk.rowsBetween(-51, horizons - 52)),
        "year_sum": F.sum(units).over(walk.rowsBetween(-56, -47)),
    }
    out = weeks.withColumns(mean | more)
    return out.withColumn("year_ago", F.when(F.col("age") >= 52, F.col("_past"))).drop("_past")


def horizon_rows(origins: DataFrame, keys: list[str], *, horizons: int = HORIZONS) -> DataFrame:
    """A row for each coming week of each origin: its features, `scale`, `actual` (null beyond the table) and `seasonal`."""
    scale = F.greatest(F.col("mean_13"), F.lit(1.0))
    each = origins.withColumn("scale", scale).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    seasonal = F.get("year_ago", F.col("h") - 1).cast("double")
    near_year = F.when(F.col("age") >= 57, F.col("year_sum") / 10)
    none = F.lit(-1.0)
    ratio = {c: F.coalesce(F.col(c) / F.col("scale"), none) for c in ("mean_4", "mean_8", "mean_26", "mean_52", "dev_13")}
    return each.select(
        *keys,
        F.col("week").alias("origin"),
        "h",
        F.date_add("week", F.col("h") * 7).alias("target_week"),
        F.get("ahead", F.col("h") - 1).cast("double").alias("actual"),
        seasonal.alias("seasonal"),
        "scale",
        "age",
        F.col("h").cast("double").alias("horizon"),
        F.coalesce(seasonal / F.col("scale"), none).alias("season"),
        F.coalesce(near_year / F.col("scale"), none).alias("season_mean"),
        (F.col("units") / F.col("scale")).alias("last"),
        *(v.alias(c) for c, v in ratio.items()),
        "zero_share_52",
        (F.col("mean_4") / F.greatest("mean_26", F.lit(0.5))).alias("trend"),
        F.weekofyear(F.date_add("week", F.col("h") * 7)).cast("double").alias("week_of_year"),
    )


def blend_weights(rows: DataFrame, group: str, low: str, high: str, *, steps: int = 20, least_rows: int = 2000) -> DataFrame:
    """group, h, n, source and weight of `low` in its mix with `high`, of steps + 1 weights the one of least absolute error.

    Rows have the group, h, both forecasts, `actual` and `used`; only used ones count, a group and
    horizon without any gets a row too. With fewer than `least_rows` the weight is that of all
    horizons of the group (source `group`), with fewer even there that of all rows (source `all`).
    Of equal errors the smaller weight wins. Weights are columns of one aggregate, so rows don't
    multiply; the windows go over a row for each group and horizon.
    """

    def missed(k: int) -> Column:
        value = F.lit(k / steps) * F.col(low) + F.lit(1 - k / steps) * F.col(high) - F.col("actual")
        return F.coalesce(F.sum(F.when(F.col("used"), F.abs(value).cast("decimal(18,6)"))), F.lit(0).cast("decimal(28,6)"))

    names = [f"_e{k}" for k in range(steps + 1)]
    sums = rows.groupBy(group, "h").agg(F.count_if("used").alias("n"), *(missed(k).alias(e) for k, e in enumerate(names)))
    wide = {"group": Window.partitionBy(group), "all": Window.partitionBy()}
    sums = sums.withColumns({f"{c}_{k}": F.sum(c).over(w) for k, w in wide.items() for c in ("n", *names)})

    def best(suffix: str) -> Column:
        return F.array_min(F.array(*(F.struct(F.col(e + suffix).alias("e"), F.lit(k).alias("k")) for k, e in enumerate(names))))["k"] / steps

    own, grouped = F.col("n") >= least_rows, F.col("n_group") >= least_rows
    source = F.when(own, "own").when(grouped, "group").otherwise("all")
    weight = F.when(own, best("")).when(grouped, best("_group")).otherwise(best("_all"))
    return sums.select(group, "h", "n", source.alias("source"), weight.alias("weight"))


def blended(rows: DataFrame) -> DataFrame:
    """rows with `middle`: half the week a year before each coming week and half the 13-week mean, the mean alone without a year."""
    return rows.withColumn("middle", F.when(F.col("seasonal").isNull(), F.col("mean_13")).otherwise((F.col("seasonal") + F.col("mean_13")) / 2))


def baseline_forecasts(weeks: DataFrame, keys: list[str], group: str, *, horizons: int = HORIZONS, history: int = 52, level: float = 0.9) -> DataFrame:
    """keys, origin, h, p50 and p90 of the coming weeks after the last week of dense weeks(keys, week, units).

    P50 is the blended baseline; P90 adds the quantile, by group and horizon, of what the same
    baseline missed at the origins of the last `history` weeks, relative to each series' level. A
    series of under 13 weeks has no forecast.
    """
    origins = origin_rows(weeks, keys, horizons=horizons).where("age >= 13")
    last = origins.agg(F.max("week").alias("_last"))  # one row
    each = origins.crossJoin(F.broadcast(last)).where(F.col("week") > F.date_sub("_last", 7 * history)).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    rows = blended(each.withColumns({"seasonal": F.get("year_ago", F.col("h") - 1).cast("double"), "actual": F.get("ahead", F.col("h") - 1).cast("double"), "scale": F.greatest(F.col("mean_13"), F.lit(1.0))}))
    missed = rows.where("actual is not null").groupBy(group, "h").agg(F.percentile((F.col("actual") - F.col("middle")) / F.col("scale"), level).alias("_q"))
    now = rows.where("week = _last").join(missed, [group, "h"], "left")
    spread = F.greatest(F.coalesce("_q", F.lit(0.0)), F.lit(0.0)) * F.col("scale")
    return now.select(*keys, F.col("week").alias("origin"), "h", F.col("middle").alias("p50"), (F.col("middle") + spread).alias("p90"))


@dataclass
class QuantileTrees:
    """Trees with the quantiles of each leaf and, for the first of them, what each split adds."""

    model: RandomForestRegressionModel
    inputs: tuple[str, ...]
    levels: tuple[float, ...]
    width: int
    #: leaves[q][tree * width + leaf]
    leaves: list[list[float]]
    base: float
    #: parts[feature][tree * width + leaf]
    parts: list[list[float]]
    #: spread of each band over that of the leaves
    bands: dict[str, float]

    def _mean(self, table: list[float]) -> Column:
        """Mean over the trees of the table's entry of the row's leaf."""
        return F.aggregate("_leaf", F.lit(0.0), lambda s, at: s + F.get(F.lit(table), at)) / self.model.getNumTrees

    def place(self, rows: DataFrame) -> DataFrame:
        """rows with `_leaf`: a place in the tables for each tree."""
        found = self.model.transform(VectorAssembler(inputCols=list(self.inputs), outputCol="_features").transform(rows)).withColumn("_array", vector_to_array("_leaves"))
        return found.withColumn("_leaf", F.transform("_array", lambda leaf, tree: (tree * self.width + leaf.cast("int")))).drop("_features", "_array", "_leaves", "prediction")

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with p50, p90 in units and `parts`, an array over the inputs that sums with `base` to p50."""
        scale, h = F.col("scale"), F.col("h")
        spread = F.lit(self.bands["far"])
        for band in ("mid", "near"):
            spread = F.when(h <= BANDS[band], self.bands[band]).otherwise(spread)
        parts = F.array(*(self._mean(t) * F.col("scale") for t in self.parts))
        out = self.place(rows).withColumns({"_q50": self._mean(self.leaves[0]), "_q90": self._mean(self.leaves[1])})
        middle = F.col("_q50") * scale
        out = out.withColumns({"p50": middle, "p90": middle + F.greatest(F.col("_q90") - F.col("_q50"), F.lit(0.0)) * spread * scale, "base": F.lit(self.base) * scale, "parts": parts})
        return out.drop("_leaf", "_q50", "_q90")


def _paths(nodes: list, value: dict[tuple[int, int], float], weight: dict[tuple[int, int], float], width: int, trees: int, features: int) -> tuple[float, list[list[float]]]:
    """The mean of the root values, and of each leaf what the splits above it add, by feature.

    A node's value is the mean of its leaves' by their rows, so the steps from the root add up to the leaf's value.
    """
    parts = [[0.0] * (trees * width) for _ in range(features)]
    base = 0.0
    for tree in range(trees):
        own = {n.nodeData.id: n.nodeData for n in nodes if n.treeID == tree}
        order = iter(range(width))
        leaf_of = {i: next(order) for i in sorted(own) if own[i].leftChild < 0}
        size: dict[int, float] = {}
        mean: dict[int, float] = {}
        for i in sorted(own, reverse=True):  # children have larger ids
            node = own[i]
            if node.leftChild < 0:
                size[i], mean[i] = weight.get((tree, leaf_of[i]), 0.0), value.get((tree, leaf_of[i]), 0.0)
            else:
                a, b = node.leftChild, node.rightChild
                size[i] = size[a] + size[b]
                mean[i] = (size[a] * mean[a] + size[b] * mean[b]) / size[i] if size[i] else (mean[a] + mean[b]) / 2
        base += mean[0] / trees
        walk = [(0, {})]
        while walk:
            i, gained = walk.pop()
            node = own[i]
            if node.leftChild < 0:
                for f, v in gained.items():
                    parts[f][tree * width + leaf_of[i]] = v
            else:
                f = node.split.featureIndex
                walk += [(c, gained | {f: gained.get(f, 0.0) + mean[c] - mean[i]}) for c in (node.leftChild, node.rightChild)]
    return base, parts


def fit_quantiles(
    train: DataFrame, held: DataFrame, *, inputs: tuple[str, ...] = INPUTS, levels: tuple[float, float] = (0.5, 0.9), trees: int = 8, depth: int = 6, bins: int = 48, seed: int = 11, accuracy: int = 2000
) -> QuantileTrees:
    """Fit trees on `train` and correct the spread of each band on `held`, rows of later weeks; both have an actual.

    The correction makes the upper quantile cover its share of `held`: the quantile at that level of
    the actual's distance from the middle, in spreads.
    """
    spark = train.sparkSession
    labelled = VectorAssembler(inputCols=list(inputs), outputCol="_features").transform(train.withColumn("_label", F.col("actual") / F.col("scale")))
    forest = RandomForestRegressor(featuresCol="_features", labelCol="_label", leafCol="_leaves", numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, subsamplingRate=0.7, minInstancesPerNode=20)
    model = forest.fit(labelled)
    width = 1 << depth
    fitted = QuantileTrees(model, inputs, levels, width, [], 0.0, [], {})
    at = fitted.place(train).select((F.col("actual") / F.col("scale")).alias("y"), F.explode("_leaf").alias("at"))
    # a row for each leaf: trees * 2 ** depth at most
    found = at.groupBy("at").agg(F.percentile_approx("y", list(levels), accuracy).alias("q"), F.count("*").alias("n")).collect()
    tables = [[0.0] * (trees * width) for _ in levels]
    for r in found:
        for k in range(len(levels)):
            tables[k][r["at"]] = float(r["q"][k])
    value = {(r["at"] // width, r["at"] % width): float(r["q"][0]) for r in found}
    weight = {(r["at"] // width, r["at"] % width): float(r["n"]) for r in found}
    path = scratch(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").collect()  # the nodes of the model
    fitted.leaves = tables
    fitted.base, fitted.parts = _paths(nodes, value, weight, width, trees, len(inputs))
    fitted.bands = dict.fromkeys(BANDS, 1.0)
    band = F.when(F.col("h") <= BANDS["near"], "near").when(F.col("h") <= BANDS["mid"], "mid").otherwise("far")
    away = (F.col("actual") - F.col("p50")) / F.greatest(F.col("p90") - F.col("p50"), F.lit(1e-6))
    for r in fitted.score(held).groupBy(band.alias("band")).agg(F.percentile_approx(away, levels[1], accuracy).alias("q")).collect():  # a row for each band
        fitted.bands[r["band"]] = max(0.0, float(r["q"]))
    return fitted


def shares(totals: DataFrame, keys: list[str], *, whole: int = 1_000_000) -> DataFrame:
    """totals(keys, driver, contribution) with `share_ppm`, whole shares of the absolute sum that add up to `whole`, and direction.

    The largest remainders get what rounding down leaves, ties by driver; a group whose parts are all zero has shares of 0.
    """
    own = Window.partitionBy(*keys)
    size = F.abs("contribution")
    exact = F.col("_size") / F.nullif(F.col("_sum"), F.lit(0.0)) * whole
    rows = totals.withColumns({"_size": size, "_sum": F.sum(size).over(own)}).withColumn("_exact", F.coalesce(exact, F.lit(0.0)))
    rows = rows.withColumn("_low", F.floor("_exact")).withColumn("_rest", F.col("_exact") - F.col("_low"))
    left = F.when(F.col("_sum") > 0, whole - F.sum("_low").over(own)).otherwise(0)
    rows = rows.withColumns({"_left": left, "_place": F.row_number().over(own.orderBy(F.desc("_rest"), "driver"))})
    share = F.col("_low") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)
    way = F.when(F.col("contribution") > 0, "up").when(F.col("contribution") < 0, "down").otherwise("none")
    return rows.withColumns({"share_ppm": share.cast("long"), "direction": way}).drop("_size", "_sum", "_exact", "_low", "_rest", "_left", "_place")
