"""Visibility of row versions, as a predicate on their creator (xmin) and deleter (xmax)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Creator of rows that no transaction made, and deleter of rows that none deleted.
NONE = 0


@dataclass(frozen=True)
class Snapshot:
    """Transactions that count as committed and as aborted for a reader."""

    committed: frozenset[int] = frozenset()
    aborted: frozenset[int] = frozenset()


def visible(xmin: Column, xmax: Column, reader: int, committed: Iterable[int], aborted: Iterable[int]) -> Column:
    """Whether the reader sees a row version.

    Its own rows, even deleted by itself, are visible; rows of others need a committed creator, or none at all, and a
    deleter that is none, the reader or aborted. A deleter that is still active hides the row.
    """
    kept = xmax.isin(NONE, reader, *aborted)
    made = (xmin == NONE) | xmin.isin(*committed) if (committed := list(committed)) else xmin == NONE
    return (xmin == reader) | (made & kept)


def visible_rows(versions: DataFrame, reader: int, snapshot: Snapshot, xmin: str = "xmin", xmax: str = "xmax") -> DataFrame:
    return versions.where(visible(F.col(xmin), F.col(xmax), reader, sorted(snapshot.committed), sorted(snapshot.aborted)))


def visible_by_status(versions: DataFrame, reader: int, status: DataFrame, xmin: str = "xmin", xmax: str = "xmax") -> DataFrame:
    """The same with the transactions' states in a table (txn, state): for histories too long for a predicate."""
    of = lambda side: status.select(F.col("txn").alias(f"__{side}"), F.col("state").alias(f"__{side}_state"))
    joined = versions.join(of("xmin"), F.col(xmin) == F.col("__xmin"), "left").join(of("xmax"), F.col(xmax) == F.col("__xmax"), "left")
    kept = F.col(xmax).isin(NONE, reader) | F.coalesce(F.col("__xmax_state") == "aborted", F.lit(False))
    made = (F.col(xmin) == NONE) | F.coalesce(F.col("__xmin_state") == "committed", F.lit(False))
    return joined.where((F.col(xmin) == reader) | (made & kept)).select(*versions.columns)
