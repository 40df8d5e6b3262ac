"""Monday weeks, ISO parts and local cutoffs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def week_cutoff(week: Column, zone: str) -> Column:
    """Local midnight after a week's Sunday, as an instant."""
    return F.to_utc_timestamp(F.date_add(week, 7).cast("timestamp"), zone)


def iso_parts(day: Column) -> tuple[Column, Column]:
    """ISO year and week."""
    return F.extract(F.lit("YEAROFWEEK"), day).cast("long"), F.weekofyear(day).cast("long")


def seasonal(day: Column) -> tuple[Column, Column]:
    angle = 2 * F.pi() * F.weekofyear(day) / 52.0
    return F.sin(angle), F.cos(angle)


def exposure(week: Column, first: Column, last: Column) -> Column:
    """Days of a week within an inclusive window."""
    return F.datediff(F.least(F.date_add(week, 6), last), F.greatest(week, first)) + 1
