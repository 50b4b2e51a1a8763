"""Column expressions over arrays for the operators that stay inside Spark's own functions.

A lambda evaluates every expression in it anew for each element, so values used in a lambda are first
bound by `let`, which evaluates them once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes up to which a side is broadcast; a number counts as 16 bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def split_words(text: Column, between: str) -> Column:
    """Words of a text, given what stands between them. Cheaper than extracting matches."""
    return F.array_remove(F.split(text, between, -1), "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def hashed_lower(words: Column) -> Column:
    """Hashes of the words with A-Z in lower case; for a word of ASCII alone that is lower()."""
    return F.transform(words, lambda w: F.xxhash64(F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(ascii_lower(w))))


def head(a: Column, n: Column) -> Column:
    return F.slice(a, 1, F.greatest(n, F.lit(0)))


def window_hashes(a: Column, width: int) -> Column:
    """Hash of every run of `width` elements of a bound array."""
    return head(F.transform(a, lambda x, i: F.xxhash64(x, *[F.get(a, i + k) for k in range(1, width)])), F.size(a) - width + 1)


def window_minima(a: Column, width: int) -> Column:
    """Smallest of every run of `width` elements of a bound array."""
    return head(F.transform(a, lambda x, i: F.least(x, *[F.get(a, i + k) for k in range(1, width)])), F.size(a) - width + 1)


def running(lengths: Column) -> Column:
    """Sums of all elements before each, in log2(size) passes."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)))).cast("int"))
    inclusive = F.aggregate(
        F.transform(steps, lambda s: F.call_function("shiftleft", F.lit(1), s)),
        lengths,
        lambda acc, by: F.transform(acc, lambda x, i: x + F.when(i >= by, F.get(acc, i - by)).otherwise(F.lit(0))),
    )
    return F.zip_with(inclusive, lengths, lambda a, b: a - b)


def located(text: Column, pattern: str) -> Column:
    """Array of (value, start, end) of the leftmost non-overlapping matches, in code points; patterns match no empty string."""
    empty = F.expr("cast(array() as array<struct<value: string, start: int, end: int>>)")

    def at(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        own = F.transform(found, lambda m: F.length(m))
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), F.concat(F.array(F.lit(0)), F.slice(own, 1, F.size(own) - 1)), lambda g, m: g + m)
        starts = let(steps, lambda s: F.zip_with(running(s), s, lambda a, b: a + b))
        return F.zip_with(found, starts, lambda m, s: F.struct(m.alias("value"), s.cast("int").alias("start"), (s + F.length(m)).cast("int").alias("end")))

    return let(matches(text, pattern), lambda found: F.when(F.size(found) == 0, empty).otherwise(at(found)))


def covered(spans: Column) -> Column:
    """Number of integers in the union of half-open (start, end) spans, given sorted."""
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["end"].cast("long")).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"].cast("long") - F.greatest(acc["upto"], s["start"].cast("long")))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def with_struct(df: DataFrame, keep: list[str | Column], value: Column) -> DataFrame:
    """The kept columns and the fields of a struct that is evaluated once for each row."""
    return df.select(*keep, F.inline(F.array(value)))


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if it has at most `rows` rows of BROADCAST_BYTES in all, both measured; else joins shuffle it."""

    def width(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.octet_length(c) + 16
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return F.aggregate(F.transform(c, F.octet_length), F.lit(16), lambda n, x: n + x + 16)
        return F.size(c) * 32 + 16 if isinstance(kind, T.ArrayType | T.MapType) else F.lit(16)

    widths = [F.coalesce(width(F.col(f"`{f.name}`"), f.dataType).cast("long"), F.lit(16)) for f in df.schema.fields]
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(sum(widths, F.lit(0)))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df
