"""Recovery as queries over a log of row operations (lsn, txn, op, key and images).

A log too large for one machine is replayed by partitions of its keys or transactions: nothing here orders the whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("COMMIT", "ABORT")


def previous_lsn(log: DataFrame, lsn: str = "lsn", txn: str = "txn") -> DataFrame:
    """The log with each record's predecessor in its transaction, -1 for the first."""
    own = Window.partitionBy(txn).orderBy(lsn)
    return log.withColumn("prev_lsn", F.coalesce(F.lag(lsn).over(own), F.lit(-1)))


def outcomes(log: DataFrame, lsn: str = "lsn", txn: str = "txn", op: str = "op") -> DataFrame:
    """(txn, state): by each transaction's last terminal record; without one it is aborted."""
    ended = F.max_by(F.when(F.col(op).isin(*TERMINAL), F.col(op)), F.when(F.col(op).isin(*TERMINAL), F.col(lsn)))
    return log.groupBy(txn).agg(F.when(ended == "COMMIT", F.lit("committed")).otherwise(F.lit("aborted")).alias("state"))


def redo(log: DataFrame, key: str = "k", lsn: str = "lsn", op: str = "op") -> DataFrame:
    """The rows that the (committed) operations leave: each key's last record unless it deletes."""
    rest = [c for c in log.columns if c != key]
    last = log.where(~F.col(op).isin(*TERMINAL)).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(lsn)).alias("last"))
    return last.select(F.col(key), "last.*").where(F.col(op) != "DELETE").select(*log.columns)


def undo(log: DataFrame, key: str = "k", lsn: str = "lsn", op: str = "op", txn: str = "txn", before: str = "old") -> DataFrame:
    """(txn, key, action, before): what takes back each (aborted) transaction's changes of a key: its first record's before-image, or a delete."""
    first = log.where(~F.col(op).isin(*TERMINAL)).groupBy(txn, key).agg(F.min_by(F.struct(op, before), F.col(lsn)).alias("first"))
    insert = F.col(f"first.{op}") == "INSERT"
    return first.select(txn, key, F.when(insert, F.lit("DELETE")).otherwise(F.lit("RESTORE")).alias("action"), F.when(~insert, F.col(f"first.{before}")).alias(before))
