import pytest

from tessera.errors import BindProblem, EngineError, LockConflict, TransactionProblem
from tessera.session import Engine


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


@pytest.fixture
def products(engine):
    engine.execute("CREATE TABLE products (pid, pname, price)")
    engine.execute("INSERT INTO products VALUES ('400', 'Monitor', '299')")
    engine.execute("INSERT INTO products VALUES ('500', 'Desk', '450')")
    return engine


def test_users_script(engine):
    engine.execute("CREATE TABLE users (name, data)")
    for lo, hi in ((0, 100), (0, 800)):
        values = ", ".join(f"('User_{i}', '{'X' * 100}')" for i in range(lo, hi))
        assert engine.execute(f"INSERT INTO users VALUES {values}").rows == hi - lo
        if hi == 100:
            assert len(rows(engine, "SELECT * FROM users")) == 100
            assert rows(engine, "SELECT name FROM users WHERE name = 'User_50'") == [("User_50",)]
            assert engine.execute("UPDATE users SET data = 'UPDATED'").rows == 100
            assert engine.execute("DELETE FROM users WHERE name = 'User_0'").rows == 1
            assert len(rows(engine, "SELECT * FROM users")) == 99
    assert rows(engine, "SELECT COUNT(*) FROM users") == [(899,)]
    assert len(rows(engine, "SELECT * FROM users WHERE name = 'User_10' AND data = 'UPDATED'")) == 1
    assert len(rows(engine, "SELECT * FROM users WHERE name = 'User_1' OR name = 'User_2'")) == 4
    assert sorted(rows(engine, "SELECT data, COUNT(*) FROM users GROUP BY data")) == [("UPDATED", 99), ("X" * 100, 800)]
    assert engine.execute("UPDATE users SET data = 'SPECIAL' WHERE name = 'User_5'").rows == 2
    assert rows(engine, "SELECT data FROM users WHERE name = 'User_5'") == [("SPECIAL",)] * 2


def test_products_script(products):
    assert len(rows(products, "SELECT * FROM products WHERE price > '50'")) == 2
    assert rows(products, "SELECT * FROM products WHERE price < '200'") == []
    assert len(rows(products, "SELECT * FROM products WHERE price > '50' AND price < '500'")) == 2
    assert rows(products, "SELECT pname FROM products WHERE pname <> 'Monitor'") == [("Desk",)]
    assert rows(products, "SELECT COUNT(pname), SUM(price), AVG(price), MIN(price), MAX(price) FROM products") == [(2, 749.0, 374.5, 299.0, 450.0)]
    assert [r[0] for r in rows(products, "SELECT pid FROM products ORDER BY price")] == ["400", "500"]
    assert [r[0] for r in rows(products, "SELECT pid FROM products ORDER BY price DESC;")] == ["500", "400"]
    assert products.execute("DELETE FROM products").rows == 2 and rows(products, "SELECT * FROM products") == []
    assert rows(products, "SELECT COUNT(*), SUM(price) FROM products") == [(0, None)]


@pytest.mark.parametrize(
    "changes",
    [
        ["INSERT INTO products VALUES ('999', 'TxnProduct', '99.99')"],
        ["INSERT INTO products VALUES ('999', 'RollbackTest', '777.77')", "UPDATE products SET price = '888.88' WHERE pid = '999'"],
        ["INSERT INTO products VALUES ('999', 'DeleteTest', '666.66')", "DELETE FROM products WHERE pid = '999'"],
        ["DROP TABLE products"],
    ],
)
def test_abort_takes_all_changes_back(products, changes):
    before = rows(products, "SELECT * FROM products")
    products.execute("BEGIN")
    for c in changes:
        products.execute(c)
    if len(changes) == 2 and "UPDATE" in changes[1]:
        assert rows(products, "SELECT price FROM products WHERE pid = '999'") == [("888.88",)]
    products.execute("ABORT")
    assert sorted(rows(products, "SELECT * FROM products")) == sorted(before)


def test_auto_commit_and_reopening(spark, products):
    products.execute("INSERT INTO products VALUES ('555', 'AutoCommit', '555.55')")
    again = Engine(spark, products.store.files.root)
    assert len(rows(again, "SELECT * FROM products WHERE pid = '555'")) == 1
    again.execute("DELETE FROM products WHERE pid = '555'")
    assert rows(Engine(spark, products.store.files.root), "SELECT * FROM products WHERE pid = '555'") == []


def test_joins(engine):
    engine.execute("CREATE TABLE join_a (id, info)")
    engine.execute("CREATE TABLE join_b (id, detail)")
    engine.execute("INSERT INTO join_a VALUES ('1', 'Alpha'), ('2', 'Beta')")
    engine.execute("INSERT INTO join_b VALUES ('1', 'Detail-A'), ('2', 'Detail-B'), ('3', 'Detail-C')")
    both = [("1", "Alpha", "1", "Detail-A"), ("2", "Beta", "2", "Detail-B")]
    assert sorted(rows(engine, "SELECT * FROM join_a, join_b WHERE join_a.id = join_b.id")) == both
    assert sorted(rows(engine, "SELECT * FROM join_a JOIN join_b ON join_a.id = join_b.id")) == both
    assert len(rows(engine, "SELECT * FROM join_a, join_b")) == 6
    assert rows(engine, "SELECT * FROM join_a, join_b WHERE join_a.id = join_b.id AND join_a.info = 'Alpha'") == both[:1]
    assert rows(engine, "SELECT x.id FROM join_a x JOIN join_a y ON x.id < y.id") == [("1",)]
    assert rows(engine, "SELECT COUNT(*) AS n FROM join_a, join_b, join_a c WHERE join_a.id = join_b.id AND c.id = join_b.id") == [(2,)]
    assert rows(engine, "SELECT * FROM join_a WHERE id = 'none'") == []
    with pytest.raises(BindProblem):
        engine.sql("SELECT id FROM join_a, join_b")


def test_errors(products):
    for sql in ["SELECT * FROM none", "SELECT nope FROM products", "DROP TABLE none", "UPDATE products SET nope = 1", "INSERT INTO products VALUES ('1')", "CREATE TABLE products (a)", "SELECT pid, COUNT(*) FROM products", "DELETE FROM products WHERE nope = 1"]:
        with pytest.raises(BindProblem):
            products.execute(sql)
    for sql in ["COMMIT", "ABORT"]:
        with pytest.raises(TransactionProblem):
            products.execute(sql)
    products.execute("BEGIN")
    with pytest.raises(TransactionProblem):
        products.execute("BEGIN")


def test_null_rows_survive_a_delete_that_they_do_not_match(engine):
    engine.execute("CREATE TABLE t (a INT, b)")
    engine.execute("INSERT INTO t VALUES (1, 'x'), (NULL, 'y')")
    assert engine.execute("DELETE FROM t WHERE a = 1").rows == 1
    assert rows(engine, "SELECT a, b FROM t WHERE a IS NULL") == [(None, "y")]


def test_isolation_levels(products):
    other = products.warehouse.session()
    for level, seen in (("READ COMMITTED", 3), ("REPEATABLE READ", 2)):
        before = len(rows(other, "SELECT * FROM products"))
        other.execute(f"BEGIN TRANSACTION ISOLATION LEVEL {level}")
        products.execute("INSERT INTO products VALUES ('600', 'Lamp', '20')")
        assert len(rows(other, "SELECT pid FROM products")) == before + seen - 2
        other.execute("COMMIT")
        products.execute("DELETE FROM products WHERE pid = '600'")
    other.execute("BEGIN TRANSACTION ISOLATION LEVEL SERIALIZABLE")
    rows(other, "SELECT * FROM products")
    with pytest.raises(LockConflict):
        products.execute("DELETE FROM products")
    other.execute("COMMIT")
    assert products.execute("DELETE FROM products").rows == 2


def test_first_committer_wins_under_repeatable_read(spark, products):
    other = Engine(spark, products.store.files.root)  # another process: no locks in common
    other.execute("BEGIN TRANSACTION ISOLATION LEVEL REPEATABLE READ")
    other.execute("UPDATE products SET price = '1'")
    products.execute("UPDATE products SET price = '2'")
    with pytest.raises(TransactionProblem):
        other.execute("COMMIT")
    assert set(rows(products, "SELECT price FROM products")) == {("2",)}


def test_a_crash_before_the_manifest_leaves_the_old_state(spark, products):
    before = products.store.current()
    products.load("copy", products.sql("SELECT * FROM products"))
    products.execute("BEGIN")
    products.execute("UPDATE copy SET price = '0'")  # writes a segment; then the process dies
    again = Engine(spark, products.store.files.root)
    assert {r[0] for r in rows(again, "SELECT price FROM copy")} == {"299", "450"}
    assert len(again.recover(retention=0)) == 1
    assert {r[0] for r in rows(again, "SELECT price FROM copy")} == {"299", "450"}
    assert again.store.current().next_txn >= before.next_txn


def test_update_rewrites_only_segments_that_hold_matches(spark, engine):
    engine.load("t", spark.createDataFrame([(i, "a") for i in range(10)], "id long, v string"))
    engine.execute("BEGIN")
    more = engine.store.added(engine._table("t", engine.transaction), [(100 + i, "b") for i in range(600)])
    engine.warehouse.work[engine.transaction.id].changes["t"] = more
    engine.execute("COMMIT")
    before = engine.store.current().tables["t"].segments
    assert engine.execute("UPDATE t SET v = 'c' WHERE id >= 100 AND id < 103").rows == 3
    after = engine.store.current().tables["t"].segments
    assert len(set(before) - set(after)) == len(set(after) - set(before)) == 1
    assert sorted(rows(engine, "SELECT v, COUNT(*) FROM t GROUP BY v")) == [("a", 10), ("b", 597), ("c", 3)]


def test_log_holds_the_chain_of_a_transaction(products):
    products.execute("BEGIN")
    products.execute("INSERT INTO products VALUES ('1', 'a', '1'), ('2', 'b', '2')")
    products.execute("DELETE FROM products WHERE pid = '1'")
    products.execute("COMMIT")
    log = products.warehouse.log.frame()
    last = log.where(log.txn == log.agg({"txn": "max"}).first()[0]).orderBy("lsn").collect()
    assert [r["op"] for r in last] == ["INSERT", "DELETE", "COMMIT"] and [r["n_rows"] for r in last] == [2, 1, None]
    assert [r["prev_lsn"] for r in last] == [-1, last[0]["lsn"], last[1]["lsn"]]


def test_run_prints(products, capsys):
    products.run("SELECT pname, price FROM products WHERE pid = '400'")
    products.run("SELECT * FROM none")
    out = capsys.readouterr()
    assert out.out == "[Monitor, 299]\n[OK] 1 row(s) returned.\n" and "none is unknown" in out.err


def test_cleaning_up_takes_nothing_from_open_transactions_and_lazy_frames(spark, engine):
    engine.load("t", spark.createDataFrame([(i, "a") for i in range(50)], "id long, v string"))
    before = engine.sql("SELECT v FROM t")
    other = engine.warehouse.session()
    for k in range(12):
        other.execute(f"UPDATE t SET v = 'b{k}'")
    assert other.recover() == [] and {r[0] for r in before.collect()} == {"a"}
    engine.execute("BEGIN")
    engine.execute("UPDATE t SET v = 'z'")
    other.recover(retention=0)
    engine.execute("COMMIT")
    assert set(rows(engine, "SELECT v FROM t")) == {("z",)}
    assert other.recover(retention=0) and len(rows(engine, "SELECT id FROM t")) == 50


def test_a_commit_whose_files_are_gone_fails(spark, engine):
    engine.load("t", spark.createDataFrame([(1, "a")], "id long, v string"))
    engine.execute("BEGIN")
    engine.execute("UPDATE t SET v = 'z'")
    Engine(spark, engine.store.files.root).recover(retention=0)  # another process that keeps nothing
    with pytest.raises(TransactionProblem):
        engine.execute("COMMIT")
    assert rows(engine, "SELECT v FROM t") == [("a",)]


def test_an_update_leaves_files_without_matches_in_place(spark, engine):
    engine.load("t", spark.createDataFrame([(i, "a") for i in range(40)], "id long, v string"))
    engine.execute("INSERT INTO t SELECT id, v FROM t WHERE id < 0")  # no rows
    engine.execute("CREATE TABLE more AS SELECT id, v FROM t")
    for low in (100, 200, 300):
        values = ", ".join(f"({low + k}, 'x')" for k in range(5))
        engine.execute(f"CREATE TABLE s{low} (id BIGINT, v)")
        engine.execute(f"INSERT INTO s{low} VALUES {values}")
        engine.execute(f"INSERT INTO t SELECT id, v FROM s{low}")
    before = engine.store.current().tables["t"].segments
    assert engine.execute("UPDATE t SET v = 'c' WHERE id = 203").rows == 1
    after = engine.store.current().tables["t"].segments
    assert len(set(before) & set(after)) == len(before) - 1
    assert sorted(rows(engine, "SELECT v, COUNT(*) FROM t GROUP BY v")) == [("a", 40), ("c", 1), ("x", 14)]


def test_a_frequent_first_value_is_cut_into_several_files(spark, tmp_path):
    store = Engine(spark, str(tmp_path / "w")).store
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len(store.write(spark.createDataFrame([("same", i) for i in range(4000)], "k string, i long").repartition(8))) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_texts_against_numbers_take_plain_numbers_only(spark, engine):
    engine.execute("CREATE TABLE t (id INT, v)")
    engine.execute("INSERT INTO t VALUES (100000, '1e5'), (5, ' 5'), (5, '5.0'), (7, '12')")
    assert rows(engine, "SELECT v FROM t WHERE v = id") == [("5.0",)]
    assert sorted(rows(engine, "SELECT v FROM t WHERE id < v")) == [("12",), ("1e5",)]  # '1e5' after '100000' by bytes


def test_more_statements(engine):
    engine.execute("CREATE TABLE a (k INT, v)")
    engine.execute("INSERT INTO a VALUES (1, 'x'), (2, 'y'), (2, 'y'), (3, NULL)")
    engine.execute("CREATE TABLE b AS SELECT k AS j, k * 10 + 1 AS t FROM a WHERE k > 1")
    assert sorted(rows(engine, "SELECT j, t FROM b")) == [(2, 21), (2, 21), (3, 31)]
    assert sorted(rows(engine, "SELECT k, j FROM a LEFT JOIN b ON k = j AND t > 30"), key=str) == [(1, None), (2, None), (2, None), (3, 3)]
    assert sorted(rows(engine, "SELECT k FROM a INTERSECT ALL SELECT j FROM b")) == [(2,), (2,), (3,)]
    assert rows(engine, "SELECT k FROM a EXCEPT SELECT j FROM b") == [(1,)]
    assert rows(engine, "SELECT k FROM a UNION SELECT j FROM b ORDER BY k DESC LIMIT 2 OFFSET 1") == [(2,), (1,)]
    assert rows(engine, "SELECT CASE WHEN v IS NULL THEN 'none' ELSE v END AS w FROM a WHERE (k + 1) * 2 > 7") == [("none",)]
    assert rows(engine, "SELECT k / 0 AS q FROM a WHERE k = 1") == [(None,)]
    with pytest.raises(EngineError):
        engine.execute("SELECT k, v FROM a UNION SELECT j FROM b")
    with pytest.raises(EngineError):
        engine.execute("INSERT INTO a SELECT j FROM b")
    assert engine.execute("INSERT INTO a (k) SELECT j FROM b").rows == 3


def test_a_deadlock_victim_leaves_no_pin(spark, engine):
    engine.load("x", spark.createDataFrame([(1,)], "id long"))
    engine.load("y", spark.createDataFrame([(1,)], "id long"))
    other = engine.warehouse.session()
    for session, table in ((engine, "x"), (other, "y")):
        session.execute("BEGIN")
        session.execute(f"DELETE FROM {table}")
    for session, table in ((engine, "y"), (other, "x")):
        with pytest.raises(TransactionProblem):
            session.execute(f"DELETE FROM {table}")
    with pytest.raises(TransactionProblem):
        other.execute("COMMIT")
    engine.execute("COMMIT")
    assert not engine.warehouse.work and not engine.store.pinned
