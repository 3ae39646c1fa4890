"""Maps and arrays to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_map(key: Column, value: Column) -> Column:
    """Aggregate: a map with its keys in order."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), value.alias("value")))))


def map_rows(df: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """A row for each entry of a map column, in place of it."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(column).alias(key, value))


def last(items: Column) -> Column:
    """Last element; null for an empty or null array."""
    return F.try_element_at(items, F.lit(-1))


def is_subset(some: Column, whole: Column) -> Column:
    return F.size(F.array_except(some, whole)) == 0


def all_sources(claims: Column) -> Column:
    """Distinct sources over an array of structs with an array field sources, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(claims, lambda c: c["sources"]))))
