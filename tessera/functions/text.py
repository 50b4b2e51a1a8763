"""Numbers in text: which texts are numbers, how texts compare and sort, how numbers are shown."""

from __future__ import annotations

import operator
import re
from decimal import Decimal
from math import isfinite

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def is_number(text: str) -> bool:
    """An optional minus, digits and at most one point; at least one digit."""
    return bool(re.fullmatch(r"-?[0-9]*\.?[0-9]*", text) and re.search("[0-9]", text))


def looks_numeric(c: Column) -> Column:
    """`is_number` of a text column. \\A and \\z, since $ also matches before a final line end."""
    return c.rlike(r"\A-?[0-9]*[.]?[0-9]*\z") & c.rlike("[0-9]")


def as_number(c: Column) -> Column:
    """The number that a text is, else null."""
    return F.when(looks_numeric(c), c.try_cast("double"))


def parsed_number(c: Column) -> Column:
    """The number that aggregates take a text for: signs, exponents and blanks before it are allowed; else null."""
    return F.when(c.rlike(r"(?i)\A\s*[+-]?(?:(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?|nan)\z"), F.trim(c).try_cast("double"))


def compare(op: str, c: Column, text: str) -> Column:
    """A text column with a literal: as numbers if both are numbers, else by bytes.

    With a literal that is no number this is one comparison that a file scan can filter by.
    """
    f = OPERATORS[op]
    if not is_number(text):
        return f(c, F.lit(text))
    return F.when(looks_numeric(c), f(c.try_cast("double"), F.lit(float(text)))).otherwise(f(c, F.lit(text)))


def compare_columns(op: str, a: Column, b: Column) -> Column:
    """Two text columns. Equality is that of the bytes, so that joins on it stay hash or merge joins."""
    f = OPERATORS[op]
    if op in ("=", "<>"):
        return f(a, b)
    return F.when(looks_numeric(a) & looks_numeric(b), f(a.try_cast("double"), b.try_cast("double"))).otherwise(f(a, b))


def compare_mixed(op: str, a: Column, b: Column, text_first: bool) -> Column:
    """A text column with one of numbers: as numbers if the text is one, else by bytes with the number as it is shown."""
    f = OPERATORS[op]
    text, number = (a, b) if text_first else (b, a)
    if not text_first:
        f = OPERATORS[{"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)]
    plain = F.regexp_replace(F.format_string("%.6f", number.cast("double")), r"\.?0+\z", "")
    return F.when(looks_numeric(text), f(text.try_cast("double"), number.cast("double"))).otherwise(f(text, plain))


def sort_keys(c: Column, descending: bool) -> list[Column]:
    """A total order of texts: numbers by value before other texts by bytes."""
    numbers_first = F.coalesce(looks_numeric(c), F.lit(False))
    if descending:
        return [numbers_first.asc(), as_number(c).desc(), c.desc()]
    return [numbers_first.desc(), as_number(c), c]


def shown(value: object) -> str:
    """A value as it is printed: nothing for null, numbers without needless digits and with six decimals at most."""
    if value is None:
        return ""
    if isinstance(value, float | Decimal) and isfinite(value):
        return f"{value:.0f}" if value == int(value) else f"{value:.6f}".rstrip("0").rstrip(".")
    return str(value)
