"""Algebra of sparse count and measurement maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge(a: Column, b: Column, value: str = "double") -> Column:
    """Adds two maps key by key; null counts as empty, and two nulls give an empty map."""
    none = F.create_map().cast(f"map<string,{value}>")
    zero = F.lit(0).cast(value)
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def simplify(m: Column) -> Column:
    """Drops zero and null entries."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != 0))


def total(m: Column) -> Column:
    """Sum of the values; 0 for an empty map, null for null."""
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0)).cast("long"))


def null_if_empty(m: Column) -> Column:
    return F.when(F.size(m) > 0, m)


def from_columns(names: list[str], prefix: str = "") -> Column:
    """Map of the named columns without zero entries: the last step of a wide aggregation."""
    return simplify(F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"{prefix}{n}"))]))


def count_values(df, group: list[str], array: str):
    """(group..., key, n): occurrences of array elements, as rows."""
    return df.select(*group, F.explode(array).alias("key")).groupBy(*group, "key").agg(F.count("*").alias("n"))
