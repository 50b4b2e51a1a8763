from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.operators.replay import outcomes, previous_lsn, redo, undo


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_joins(spark):
    people = spark.createDataFrame([("1", "Alice"), ("2", "Bob")], "id string, name string")
    teams = spark.createDataFrame([("1", "Eng"), ("3", "Sales")], "id string, dept string")
    assert len(tuples(R.join(people, teams))) == 4
    same = lambda a, b: F.col("l.id") == F.col("r.id")
    assert tuples(R.join(people, teams, same)) == [("1", "Alice", "1", "Eng")]
    assert tuples(R.join(people.limit(0), teams, same)) == []
    assert len(tuples(R.join(people, teams, lambda a, b: F.col("l.id") < F.col("r.id")))) == 2


def test_lookups_group_and_order(spark):
    df = spark.createDataFrame([(1, "9"), (2, "10"), (2, "x")], "k int, v string")
    assert tuples(R.point_lookup(df, 2)) == [(2, "10"), (2, "x")]
    assert tuples(R.range_scan(df, 1, 2)) == tuples(df)
    assert tuples(R.group(df, ["k"], n=("COUNT", None), s=("SUM", "v"))) == [(1, 1, 9.0), (2, 2, 10.0)]
    assert tuples(R.group(df.limit(0), [], n=("COUNT", None), s=("SUM", "v"))) == [(0, None)]
    assert [r["v"] for r in R.order(df, "v").collect()] == ["9", "10", "x"]
    assert tuples(R.project(df, "v")) == [("10",), ("9",), ("x",)] and tuples(R.sequential_scan(df, F.col("k") == 1)) == [(1, "9")]


def test_replay(spark):
    log = spark.createDataFrame(
        [(1, 1, "INSERT", "a", None), (2, 2, "INSERT", "b", None), (3, 1, "UPDATE", "a", "0"), (4, 1, "COMMIT", None, None), (5, 2, "DELETE", "a", "1"), (6, 3, "INSERT", "c", None), (7, 2, "ABORT", None, None)],
        "lsn long, txn long, op string, k string, old string",
    )
    assert tuples(outcomes(log)) == [(1, "committed"), (2, "aborted"), (3, "aborted")]
    assert [r["prev_lsn"] for r in previous_lsn(log).orderBy("lsn").collect()] == [-1, -1, 1, 3, 2, -1, 5]
    committed = log.join(outcomes(log).where("state = 'committed'"), "txn", "left_semi")
    assert [(r["k"], r["lsn"]) for r in redo(committed).collect()] == [("a", 3)]
    aborted = log.join(outcomes(log).where("state = 'aborted'"), "txn", "left_semi")
    assert tuples(undo(aborted).select("txn", "k", "action")) == [(2, "a", "RESTORE"), (2, "b", "DELETE"), (3, "c", "DELETE")]
