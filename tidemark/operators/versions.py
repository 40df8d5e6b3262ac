"""Bitemporal versions of slowly changing rows.

An observation says what a key's attributes were on a day, and when that was known. Observations
equal to the one before them tell nothing new; what is left are versions, each valid from its day to
the next version's, and known from the instant its first observation was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compress(observed: DataFrame, keys: list[str], valid: str, attributes: list[str], known: str) -> DataFrame:
    """keys, version_no, attributes, valid_from, valid_to and known_from of observed(keys, valid, attributes, known).

    Of several observations of a key and day the one known last counts, ties by attributes; a change
    back is a version of its own. valid_to is exclusive and null for the last version. Nulls of an
    attribute are a value like any other.
    """
    last = F.max_by(F.struct(*attributes, known), F.struct(known, *attributes)).alias("_o")
    days = observed.groupBy(*keys, valid).agg(last).select(*keys, valid, "_o.*")
    walk = Window.partitionBy(*keys).orderBy(valid)
    row = F.struct(*attributes)
    marked = days.withColumns({"_first": F.row_number().over(walk) == 1, "_same": F.lag(row).over(walk).eqNullSafe(row)})
    starts = marked.where("_first or not _same")
    return starts.select(
        *keys, F.row_number().over(walk).alias("version_no"), *attributes, F.col(valid).alias("valid_from"), F.lead(valid).over(walk).alias("valid_to"), F.col(known).alias("known_from")
    )


def known_at(observed: DataFrame, known: str, instant: str) -> DataFrame:
    """The observations that were known at an instant: versions of these are what could be seen then."""
    return observed.where(F.col(known) <= F.lit(instant).cast("timestamp"))


def effective(facts: DataFrame, versions: DataFrame, keys: list[str], day: str) -> DataFrame:
    """facts with the version of their key that was valid on their day; versions don't overlap, so a fact gets one or, before the first, none."""
    of = versions.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in versions.columns if c not in keys))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    within = (F.col(day) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(day) < F.col("valid_to")))
    for c in same:
        within = within & c
    return facts.join(of, within, "left").drop(*(f"_{k}" for k in keys))
