import pytest
from pyspark.sql import functions as F

from tessera.operators.mvcc import Snapshot, visible_by_status, visible_rows
from tessera.transactions.manager import Isolation, TransactionManager

READER, COMMITTED, ABORTED, ACTIVE = 7, 1, 2, 3
CASES = [
    (READER, 0, True), (READER, READER, True), (READER, COMMITTED, True),  # own rows
    (0, 0, True), (0, READER, True), (0, ABORTED, True), (0, COMMITTED, False), (0, ACTIVE, False),  # rows of nobody
    (ACTIVE, 0, False), (ABORTED, 0, False), (ACTIVE, READER, False),  # creator not committed
    (COMMITTED, 0, True), (COMMITTED, READER, True), (COMMITTED, ABORTED, True), (COMMITTED, COMMITTED, False), (COMMITTED, ACTIVE, False),
]


def test_truth_table(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(CASES)], "id int, xmin int, xmax int")
    want = [k for k, c in enumerate(CASES) if c[2]]
    seen = visible_rows(rows, READER, Snapshot(frozenset({COMMITTED}), frozenset({ABORTED})))
    assert sorted(r["id"] for r in seen.collect()) == want
    status = spark.createDataFrame([(COMMITTED, "committed"), (ABORTED, "aborted"), (ACTIVE, "active")], "txn int, state string")
    assert sorted(r["id"] for r in visible_by_status(rows, READER, status).collect()) == want


def test_without_history_only_own_and_nobodys_rows_show(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (7, 0)], "xmin int, xmax int")
    assert {r["xmin"] for r in visible_rows(rows, 7, Snapshot()).collect()} == {0, 7}


@pytest.mark.parametrize(("isolation", "later_seen"), [(Isolation.REPEATABLE_READ, False), (Isolation.READ_COMMITTED, True), (Isolation.SERIALIZABLE, True)])
def test_repeatable_read_keeps_its_snapshot(spark, isolation, later_seen):
    t = TransactionManager()
    before, gone = t.begin(), t.begin()
    t.commit(before)
    t.abort(gone)
    reader = t.begin(isolation)
    later = t.begin()
    t.commit(later)
    rows = spark.createDataFrame([("before", before.id, 0), ("later", later.id, 0), ("undeleted", before.id, gone.id)], "what string, xmin int, xmax int")
    seen = {r["what"] for r in visible_rows(rows, reader.id, t.view(reader)).select(F.col("what")).collect()}
    assert seen == {"before", "undeleted"} | ({"later"} if later_seen else set())
