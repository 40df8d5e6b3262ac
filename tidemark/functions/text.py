"""Keys, labels and the tolerant parsing of mapped files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compose_key(separator: str, *parts: str) -> Column:
    """Parts as text with a separator; a null part makes the key null."""
    whole = F.concat_ws(separator, *(F.col(p).cast("string") for p in parts))
    missing = F.lit(False)
    for p in parts:
        missing = missing | F.col(p).isNull()
    return F.when(~missing, whole)


def hash_key(*parts: str) -> Column:
    """SHA-256 of the composed key."""
    return F.sha2(compose_key("|", *parts), 256)


def tag(value: Column, delimiter: str, n: int) -> Column:
    """The n-th part of a delimited text, null where there is none."""
    return F.nullif(F.split_part(value, F.lit(delimiter), F.lit(n)), F.lit(""))


def label(slug: Column) -> Column:
    """Words of a slug with a capital each."""
    return F.array_join(F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def value_map(value: Column, mapping: dict[str, str]) -> Column:
    """A closed mapping: what isn't in it is null."""
    chain: Column | None = None
    for key, to in mapping.items():
        chain = F.when(value == key, to) if chain is None else chain.when(value == key, to)
    return chain if chain is not None else F.lit(None).cast("string")


def parse_date(raw: Column, pattern: str) -> Column:
    return F.coalesce(F.try_to_timestamp(raw, F.lit(pattern)).cast("date"), raw.try_cast("date"))


def parse_instant(raw: Column, pattern: str, zone: str) -> Column:
    """Wall-clock text of a zone as an instant; null where it can't be read."""
    return F.to_utc_timestamp(F.try_to_timestamp(raw, F.lit(pattern)), zone)


def quantity(value: Column, per: int, places: int) -> Column:
    return F.round(value.cast("decimal(18,4)") / per, places)


def row_filters(rows: DataFrame, filters: list[tuple[str, str, list, str]]) -> DataFrame:
    """rows with `reason`: the code of the first of (column, in or not_in, values, code) that drops them."""
    chain = F.lit(None).cast("string")
    for column, kind, values, code in reversed(filters):
        within = F.coalesce(F.col(column).isin(values), F.lit(False))
        chain = F.when(~within if kind == "in" else within, F.lit(code)).otherwise(chain)
    return rows.withColumn("reason", chain)
