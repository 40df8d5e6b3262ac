"""The dense weekly panel of categories and sites, with features that are exact whatever the order of rows.

One shuffle on the series key serves the sums by week, the missing weeks and every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["category", "location"]
LAGS = (1, 2, 4, 13, 26, 52)
ROLLS = (4, 8, 13, 26)
#: columns whose missing share tells how ready a row is
INPUTS = ("lag_1", "lag_4", "lag_13", "lag_52", "mean_4", "mean_13", "mean_26", "dev_13", "zero_share_13", "price_ratio", "trend_4v13", "weeks_since_sale")


def dense_weeks(lines: DataFrame, tasks: int) -> DataFrame:
    """Units, money and lines of each series and Monday week from its first to its last sale; weeks without one are zero.

    A line may stand for many missing weeks, which are sorted in its task, so there are `tasks` of them.
    """
    rows = lines.select(*SERIES, "market", "business_date", "units", "net_minor").repartition(tasks, *SERIES)
    sums = rows.groupBy(*SERIES, "market", F.to_date(F.date_trunc("week", "business_date")).alias("week")).agg(F.sum("units").alias("units"), F.sum("net_minor").alias("net_minor"), F.count("*").alias("lines"))
    after = F.coalesce(F.date_sub(F.lead("week").over(Window.partitionBy(*SERIES).orderBy("week")), 7), F.col("week"))
    # a sold week stands for itself and the empty ones up to the next
    each = sums.withColumn("until", after).withColumn("at", F.explode(F.sequence("week", "until", F.expr("interval 7 days"))))
    sold = F.col("at") == F.col("week")
    return each.select(*SERIES, "market", F.col("at").alias("week"), *(F.when(sold, F.col(c)).otherwise(0).alias(c) for c in ("units", "net_minor", "lines")))


def windows(weeks: DataFrame) -> DataFrame:
    """weeks with lags, means and deviations of the weeks before, and the units of the next four."""
    walk = Window.partitionBy(*SERIES).orderBy("week")
    units = F.col("units")
    out = weeks.withColumns({f"lag_{n}": F.lag(units, n).over(walk) for n in LAGS} | {f"target_{n}": F.lead(units, n).over(walk) for n in (1, 2, 3, 4)})
    past = {n: walk.rowsBetween(-n, -1) for n in ROLLS}
    sums = {f"_s{n}": F.sum(units).over(w) for n, w in past.items()} | {f"_q{n}": F.sum(units * units).over(w) for n, w in past.items()} | {f"_c{n}": F.count("*").over(w) for n, w in past.items()}
    last = F.max(F.when(units > 0, F.col("week"))).over(walk.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumns(sums | {"_m13": F.sum("net_minor").over(past[13]), "_z13": F.count_if(units == 0).over(past[13]), "_last": last})
    more: dict[str, Column] = {}
    for n in ROLLS:
        s, q, c = (F.col(f"_{k}{n}") for k in "sqc")
        more[f"mean_{n}"] = F.round(s / c, 6)
        # of whole numbers, so exact until the root
        more[f"dev_{n}"] = F.when(c > 1, F.round(F.sqrt((c * q - s * s) / (c * (c - 1))), 6))
    price, usual = F.col("net_minor") / F.nullif(units, F.lit(0)), F.col("_m13") / F.nullif(F.col("_s13"), F.lit(0))
    more |= {
        "zero_share_13": F.round(F.col("_z13") / F.nullif(F.col("_c13"), F.lit(0)), 6),
        "price_ratio": F.round(price / usual, 12),
        "trend_4v13": F.round((F.col("_s4") / F.col("_c4")) / F.nullif(F.col("_s13") / F.col("_c13"), F.lit(0.0)), 12),
        "weeks_since_sale": (F.datediff("week", "_last") / 7).cast("long"),
    }
    out = out.withColumns(more)
    return out.drop(*(c for c in out.columns if c.startswith("_")))


_W = "OVER (PARTITION BY category, location ORDER BY week"
_PAST = {n: f"{_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in ROLLS}
#: The same frames in DuckDB SQL, after the base frames.
SITE_SQL = f"""
, sw AS (SELECT category, location, market, CAST(date_trunc('week', business_date) AS DATE) AS week, CAST(sum(units) AS BIGINT) AS units, CAST(sum(net_minor) AS BIGINT) AS net_minor, count(*) AS lines
  FROM msales JOIN products USING (sku) GROUP BY ALL),
sgrid AS (SELECT category, location, market, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS week FROM (SELECT category, location, market, min(week) AS a, max(week) AS b FROM sw GROUP BY ALL)),
dense AS (SELECT g.category, g.location, g.market, g.week, coalesce(units, 0) AS units, coalesce(net_minor, 0) AS net_minor, coalesce(lines, 0) AS lines
  FROM sgrid g LEFT JOIN sw s ON s.category = g.category AND s.location = g.location AND s.week = g.week),
swin AS (SELECT *, {", ".join(f"lag(units, {n}) {_W}) AS lag_{n}" for n in LAGS)}, {", ".join(f"lead(units, {n}) {_W}) AS target_{n}" for n in (1, 2, 3, 4))},
  {", ".join(f"CAST(sum(units) {_PAST[n]} AS BIGINT) AS s{n}, CAST(sum(units * units) {_PAST[n]} AS BIGINT) AS q{n}, count(*) {_PAST[n]} AS c{n}" for n in ROLLS)},
  CAST(sum(net_minor) {_PAST[13]} AS BIGINT) AS m13, count(*) FILTER (WHERE units = 0) {_PAST[13]} AS z13,
  max(CASE WHEN units > 0 THEN week END) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_sale FROM dense),
site AS (SELECT category, location, market, week, units, net_minor, lines, {", ".join(f"lag_{n}" for n in LAGS)}, target_1, target_2, target_3, target_4,
  {", ".join(f"round(s{n} / c{n}, 6) AS mean_{n}, CASE WHEN c{n} > 1 THEN round(sqrt((c{n} * q{n} - s{n} * s{n}) / (c{n} * (c{n} - 1))), 6) END AS dev_{n}" for n in ROLLS)},
  round(z13 / nullif(c13, 0), 6) AS zero_share_13, round((net_minor / nullif(units, 0)) / (m13 / nullif(s13, 0)), 12) AS price_ratio,
  round((s4 / c4) / nullif(s13 / c13, 0), 12) AS trend_4v13, date_diff('day', last_sale, week) // 7 AS weeks_since_sale FROM swin)
"""
