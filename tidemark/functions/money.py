"""Exact money: minor units, shares, remainders and currency conversion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimal places of each known currency.
SCALES = {"GBP": 2, "EUR": 2, "USD": 2, "SEK": 2}


def minor_scale(currency: Column) -> Column:
    """Decimal places of a currency, null where it is unknown."""
    chain = F.lit(None).cast("int")
    for code, scale in SCALES.items():
        chain = F.when(currency == code, F.lit(scale)).otherwise(chain)
    return chain


def exact_minor(amount: Column, currency: Column) -> Column:
    """Long minor units of a decimal amount; null where unknown, over-precise or out of range."""
    scaled = amount.cast("decimal(28,6)") * F.pow(F.lit(10), minor_scale(currency)).cast("decimal(9,0)")
    whole = scaled.cast("decimal(28,0)")
    return F.when(scaled == whole, whole.try_cast("long"))


def invalid_minor(amount: Column, currency: Column) -> Column:
    return amount.isNotNull() & exact_minor(amount, currency).isNull()


def to_major(minor: Column, currency: Column) -> Column:
    return (minor.cast("decimal(28,0)") / F.pow(F.lit(10), minor_scale(currency)).cast("decimal(9,0)")).cast("decimal(28,2)")


def first_units_share(total: Column, first: Column, units: Column) -> Column:
    """Exact share of the first units of a line; earlier units carry the odd minor units."""
    odd = F.pmod(total, units)
    return F.floor((total - odd) / units).cast("long") * first + F.least(odd, first)


def largest_remainder(rows: DataFrame, keys: list[str], total: str, weight: str, index: str, name: str) -> DataFrame:
    """rows with `name`: integer parts of `total` by weight within keys, that sum to it exactly.

    The floor of each exact share comes first; what is left goes one by one to the largest
    remainders, ties to the lowest index. Groups without weight get none.
    """
    group = Window.partitionBy(*keys)
    whole = F.sum(weight).over(group)
    rows = rows.withColumn("_w", whole)
    product = F.col(total).cast("decimal(38,0)") * F.col(weight).cast("decimal(18,0)")
    rows = rows.withColumns({"_floor": F.when(F.col("_w") > 0, F.floor(product / F.col("_w"))).otherwise(0).cast("long")})
    rows = rows.withColumn("_rest", F.when(F.col("_w") > 0, product - F.col("_floor") * F.col("_w")))
    rows = rows.withColumn("_left", F.when(F.col("_w") > 0, F.col(total) - F.sum("_floor").over(group)).otherwise(0))
    rank = F.row_number().over(group.orderBy(F.desc("_rest"), index))
    return rows.withColumn(name, F.col("_floor") + (rank <= F.col("_left")).cast("long")).drop("_w", "_floor", "_rest", "_left")


def convert(minor: Column, rate: Column) -> Column:
    """Half-even conversion of minor units at a decimal rate."""
    return F.bround(minor.cast("decimal(20,0)") * rate.cast("decimal(18,10)"), 0).cast("long")
