"""Aggregate functions; over text columns SUM, AVG, MIN and MAX take the texts that are numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import parsed_number


def aggregate(function: str, column: Column | None, kind: T.DataType | None, distinct: bool = False) -> Column:
    if function == "COUNT":
        if column is None:
            return F.count(F.lit(1))
        return F.count_distinct(column) if distinct else F.count(column)
    value = parsed_number(column) if isinstance(kind, T.StringType) else column
    if distinct and function in ("SUM", "AVG"):
        return (F.sum_distinct if function == "SUM" else lambda c: F.sum_distinct(c) / F.count_distinct(c))(value)
    return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[function](value)
