"""The relational operators by themselves, for use without SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.aggregates import aggregate as _aggregate
from tessera.functions.text import sort_keys


def sequential_scan(df: DataFrame, keep: Column | None = None) -> DataFrame:
    return df if keep is None else df.where(keep)


def point_lookup(df: DataFrame, key: object, column: str | None = None) -> DataFrame:
    """All rows whose key (the first column) equals a value; a store sorted by it reads few row groups."""
    return df.where(F.col(column or df.columns[0]) == F.lit(key))


def range_scan(df: DataFrame, low: object, high: object, column: str | None = None) -> DataFrame:
    """All rows whose key is between two values, both included."""
    return df.where(F.col(column or df.columns[0]).between(F.lit(low), F.lit(high)))


def project(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def join(left: DataFrame, right: DataFrame, condition: Callable[[DataFrame, DataFrame], Column] | None = None) -> DataFrame:
    """Inner join on any condition of both sides, or all pairs without one; rows are the left's values, then the right's."""
    a, b = left.alias("l"), right.alias("r")
    return a.crossJoin(b) if condition is None else a.join(b, condition(a, b), "inner")


def group(df: DataFrame, keys: list[str], **aggregates: tuple[str, str | None]) -> DataFrame:
    """Independent aggregates, as name=("SUM", column), by keys; one row without keys."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    made = [_aggregate(function, None if c is None else F.col(c), kinds.get(c)).alias(name) for name, (function, c) in aggregates.items()]
    return df.groupBy(*keys).agg(*made)


def order(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sorted by a column; numbers in text by value."""
    if dict(df.dtypes)[column] == "string":
        return df.orderBy(*sort_keys(F.col(column), descending))
    return df.orderBy(F.col(column).desc() if descending else F.col(column))
