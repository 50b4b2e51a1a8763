"""The engine's registered queries, each through the engine, and the SQL that they must agree with."""

from __future__ import annotations

import contextlib
import io
import threading
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational
from tessera.operators.mvcc import Snapshot, visible_rows
from tessera.operators.replay import previous_lsn, redo
from tessera.errors import EngineError, LockConflict
from tessera.session import Engine
from tessera.transactions.locks import LockManager
from tessera.transactions.manager import Isolation, TransactionManager

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

#: Queries whose text is the engine's and the oracle's alike.
SELECTS = {
    "scan_seq": "SELECT * FROM nation",
    "project_columns": "SELECT c_name, c_mktsegment FROM customer",
    "filter_eq": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "filter_neq": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
    "filter_lt": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5",
    "filter_le": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 5",
    "filter_gt": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45",
    "filter_ge": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45",
    "filter_and": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 12",
    "filter_or": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3",
    "filter_and_or_precedence": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3 AND c_acctbal > 0",
    "filter_parens": "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_nationkey = 3) AND c_acctbal > 0",
    "filter_lexicographic": "SELECT p_partkey, p_brand FROM part WHERE p_brand >= 'Brand#3'",
    "filter_column_vs_column": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey OR l_tax > l_discount AND l_quantity = 1",
    "index_point_lookup": "SELECT * FROM orders WHERE o_orderkey = 42",
    "index_range_scan": "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 200",
    "cross_join": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "inner_join_on": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "implicit_join_where": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_where_filter": "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING'",
    "join_qualified_names": "SELECT customer.c_name, n.n_name FROM customer, nation n WHERE customer.c_nationkey = n.n_nationkey",
    "join_three_tables": "SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    "theta_join": "SELECT a.n_name AS l, b.n_name AS r FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "join_group_by": "SELECT c_mktsegment, COUNT(*) AS cnt, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "agg_count_star": "SELECT COUNT(*) AS cnt FROM lineitem",
    "agg_count_col": "SELECT COUNT(o_orderpriority) AS cnt FROM orders",
    "agg_sum": "SELECT ROUND(SUM(l_quantity), 2) AS s FROM lineitem",
    "agg_avg": "SELECT ROUND(AVG(l_extendedprice), 4) AS a FROM lineitem",
    "agg_min": "SELECT MIN(o_totalprice) AS m FROM orders",
    "agg_max": "SELECT MAX(o_totalprice) AS m FROM orders",
    "agg_multi": "SELECT COUNT(*) AS cnt, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_discount), 6) AS a, MIN(l_tax) AS mn, MAX(l_tax) AS mx FROM lineitem",
    "agg_empty_input": "SELECT COUNT(*) AS cnt, SUM(l_quantity) AS s FROM lineitem WHERE l_quantity < 0",
    "group_by_single": "SELECT l_returnflag, COUNT(*) AS cnt FROM lineitem GROUP BY l_returnflag",
    "group_by_multi": "SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt, ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_by_filtered": "SELECT o_orderpriority, ROUND(AVG(o_totalprice), 4) AS a FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority",
    "group_by_without_aggregate": "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "filter_not": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 100000)",
    "filter_in": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_not_in": "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)",
    "filter_between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12",
    "filter_like": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%' AND p_brand NOT LIKE '%2'",
    "filter_is_null": "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL",
    "left_join": "SELECT c_custkey, CASE WHEN o_orderkey IS NULL THEN -1 ELSE o_orderkey END AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "right_join": "SELECT CASE WHEN c_custkey IS NULL THEN -1 ELSE c_custkey END AS c_custkey, n_name FROM customer RIGHT OUTER JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 5000",
    "full_join": "SELECT CASE WHEN a.n_nationkey IS NULL THEN -1 ELSE a.n_nationkey END AS l, CASE WHEN b.r_regionkey IS NULL THEN -1 ELSE b.r_regionkey END AS r FROM nation a FULL JOIN region b ON a.n_nationkey = b.r_regionkey",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "select_arithmetic": "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount) + l_quantity / 4, 5) AS v FROM lineitem WHERE l_quantity * 2 > 90 - l_linenumber",
    "case_expression": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'other' END AS kind FROM orders",
    "having": "SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 100000",
    "agg_count_distinct": "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS cnt FROM orders GROUP BY o_orderstatus",
    "limit_offset": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 5",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier ORDER BY k",
    "intersect_rows": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    "except_rows": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 2 AS limit_price FROM orders)",
    "exists_subquery": "SELECT n_name FROM nation WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_totalprice < 0) OR n_regionkey = 1",
    "derived_table": "SELECT t.k, c.c_name FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) t JOIN customer c ON t.k = c.c_custkey WHERE t.n > 15",
    "with_query": "WITH big AS (SELECT o_custkey AS k, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT k FROM big WHERE total > 2000000) SELECT c_name FROM customer, top WHERE c_custkey = k",
    "order_by_asc": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey",
    "order_by_desc": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
}

_EVENTS = "SELECT event_id AS lsn, user_id AS k, value AS v, event_id % 11 AS txn, CASE WHEN event_id % 5 = 4 THEN 'DELETE' WHEN event_id % 5 = 3 THEN 'UPDATE' ELSE 'INSERT' END AS op FROM events"
_VERSIONS = "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN 100 ELSE o_orderkey % 9 END AS xmin, CASE WHEN o_custkey % 10 = 9 THEN 100 WHEN o_custkey % 10 = 8 THEN 0 ELSE o_custkey % 8 END AS xmax FROM orders"

#: Orders' customers as texts of which some are no plain numbers.
_TEXTS = "SELECT o_orderkey, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS VARCHAR) || 'e1' WHEN 1 THEN ' ' || CAST(o_custkey AS VARCHAR) WHEN 2 THEN 'c' || CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey + 1 AS VARCHAR) || '.50' END AS t FROM orders"
_PLAIN = "regexp_full_match(t, '-?[0-9]*[.]?[0-9]*') AND regexp_matches(t, '[0-9]')"
_SHOWN = "rtrim(rtrim(printf('%.6f', {0}), '0'), '.')"

#: Oracles of the other queries.
OTHERS = {
    "text_numeric_filter": "SELECT doc_id FROM documents WHERE n_chars > 500",
    "text_column_vs_number_column": f"SELECT o_orderkey, t FROM ({_TEXTS}) x WHERE CASE WHEN {_PLAIN} THEN CAST(t AS DOUBLE) > o_custkey ELSE t > CAST(o_custkey AS VARCHAR) END",
    "text_column_equals_number_column": f"SELECT o_orderkey, t FROM ({_TEXTS}) x WHERE CASE WHEN {_PLAIN} THEN CAST(t AS DOUBLE) = o_custkey + 1 ELSE t = CAST(o_custkey + 1 AS VARCHAR) END",
    "agg_text": f"SELECT o_custkey, COUNT(t) AS cnt, ROUND(SUM(v), 3) AS s, ROUND(AVG(v), 3) AS a, MIN(v) AS mn, MAX(v) AS mx FROM (SELECT *, CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE CAST(trim(t) AS DOUBLE) END AS v FROM ({_TEXTS}) x) y GROUP BY o_custkey",
    "console_rows": "SELECT '[' || n_nationkey || ', ' || n_name || ', ' || n_regionkey || ']' AS line FROM nation UNION ALL SELECT '[OK] ' || COUNT(*) || ' row(s) returned.' FROM nation",
    "number_formatting": f"SELECT '[' || l_linenumber || ', ' || {_SHOWN.format('s')} || ', ' || {_SHOWN.format('a')} || ', ' || {_SHOWN.format('m')} || ']' AS line FROM (SELECT l_linenumber, SUM(l_quantity) AS s, AVG(l_quantity) AS a, MIN(l_extendedprice) AS m FROM lineitem GROUP BY l_linenumber) x UNION ALL SELECT '[OK] ' || COUNT(DISTINCT l_linenumber) || ' row(s) returned.' FROM lineitem",
    "unknown_names": "SELECT * FROM (VALUES ('SELECT nothing FROM nation', 'column nothing is unknown'), ('SELECT n_name FROM nation, nation n', 'column n_name is ambiguous'), ('SELECT * FROM nowhere', 'table nowhere is unknown'), ('SELECT nation.r_name FROM nation, region', 'column nation.r_name is unknown')) t(statement, error)",
    "catalog_reopened": "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 77, 'ELSEWHERE'",
    "insert_multi_row": "SELECT id, name, CAST(price AS DOUBLE) AS price FROM (VALUES (1, 'a', 2.5), (2, NULL, NULL), (3, 'c', NULL)) t(id, name, price)",
    "insert_select": "SELECT c_custkey AS id, c_mktsegment AS name FROM customer WHERE c_nationkey = 3 UNION ALL SELECT n_nationkey, n_name FROM nation",
    "create_table_as": "SELECT c_nationkey, COUNT(*) AS cnt FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 1",
    "lock_modes": "SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, true), (5, true), (6, false), (7, true), (8, true), (9, true), (10, false)) t(step, granted)",
    "lock_deadlock": "SELECT * FROM (VALUES (1, 'committed'), (2, 'committed'), (3, 'aborted')) t(txn, state)",
    "lock_timeout": "SELECT * FROM (VALUES ('held', false), ('freed', true)) t(step, granted)",
    "txn_serializable": "SELECT * FROM (VALUES ('reader', 'READ COMMITTED', true), ('writer', 'SERIALIZABLE', false)) t(who, isolation, granted)",
    "mvcc_snapshot_view": f"SELECT 'RC' AS isolation, o_orderkey FROM ({_VERSIONS}) v WHERE xmin IN (0, 1, 2) AND xmax IN (0, 3, 4) UNION ALL SELECT 'RR', o_orderkey FROM ({_VERSIONS}) v WHERE xmin IN (0, 1) AND xmax IN (0, 4) OR xmin = 4",
    "log_records": "SELECT op, CAST(coalesce(n_rows, -1) AS BIGINT) AS n_rows, chained FROM (VALUES ('CREATE', 0, false), ('INSERT', 2, true), ('UPDATE', 1, true), ('DELETE', 1, true), ('COMMIT', NULL, true)) t(op, n_rows, chained)",
    "log_images": "SELECT 'before' AS image, c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'after', c_custkey, 'MOVED' FROM customer WHERE c_nationkey = 3",
    "log_replayed": "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey <> 4",
    "log_truncated": "SELECT what, CAST(n AS BIGINT) AS n FROM (VALUES ('after the second', 2), ('all', 0)) t(what, n)",
    "compact_keeps_rows": "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_nationkey < 5 AND c_nationkey <> 3",
    "recover_keeps_live": "SELECT COUNT(*) AS cnt FROM customer",
    "order_by_text_numbers": "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS c_text FROM customer ORDER BY c_custkey DESC",
    "operator_range_scan": "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 200",
    "operator_group": "SELECT o_orderstatus, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_orderstatus",
    "dml_create_insert": "SELECT * FROM (VALUES ('400', 'Monitor', '299'), ('500', 'Desk', '450')) t(pid, pname, price)",
    "dml_insert": "SELECT * FROM region UNION ALL SELECT CAST(99 AS INT) AS r_regionkey, 'ATLANTIS' AS r_name",
    "dml_update_where": "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "dml_update_all": "SELECT c_custkey, 'UPDATED' AS c_mktsegment FROM customer",
    "dml_delete_where": "SELECT * FROM customer WHERE NOT (c_acctbal < 0)",
    "dml_delete_all": "SELECT COUNT(*) AS cnt FROM customer WHERE false",
    "txn_commit_keeps": "SELECT COUNT(*) AS cnt FROM customer WHERE NOT (c_nationkey = 3)",
    "txn_abort_restores": "SELECT COUNT(*) AS cnt FROM customer",
    "txn_repeatable_read": "SELECT COUNT(*) AS cnt FROM customer",
    "mvcc_visible_rows": f"SELECT o_orderkey, xmin, xmax FROM ({_VERSIONS}) v WHERE CASE WHEN xmin = 100 THEN true WHEN xmin = 0 THEN xmax IN (0, 100, 5, 6) WHEN xmin NOT IN (1, 2, 3) THEN false ELSE xmax IN (0, 100, 5, 6) END",
    "wal_redo_committed": f"SELECT k, lsn, op, v FROM (SELECT w.*, ROW_NUMBER() OVER (PARTITION BY k ORDER BY lsn DESC) AS rn FROM ({_EVENTS}) w WHERE txn NOT IN (3, 7)) z WHERE rn = 1 AND op <> 'DELETE'",
    "wal_undo_aborted": f"SELECT txn, k, CASE WHEN op = 'INSERT' THEN 'DELETE' ELSE 'RESTORE' END AS action, CASE WHEN op = 'INSERT' THEN NULL ELSE v END AS v FROM (SELECT w.*, ROW_NUMBER() OVER (PARTITION BY txn, k ORDER BY lsn) AS rn FROM ({_EVENTS}) w WHERE txn IN (3, 7)) z WHERE rn = 1",
    "wal_outcomes": f"SELECT txn, CASE WHEN max(lsn) % 2 = 0 THEN 'committed' ELSE 'aborted' END AS state FROM ({_EVENTS}) w GROUP BY txn",
    "wal_prev_lsn_chain": f"SELECT lsn, txn, COALESCE(LAG(lsn) OVER (PARTITION BY txn ORDER BY lsn), -1) AS prev_lsn FROM ({_EVENTS}) w",
}


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one; without one, in Spark's own warehouse folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/warehouse-{uuid4().hex}"


def engine(spark: SparkSession, sf_dir: str, *load: str) -> Engine:
    """An engine over the driver's tables; `load` are copied into its warehouse, so that they can be changed."""
    out = Engine(spark, scratch(spark))
    for name in TABLES:
        if name not in load:
            out.attach(name, f"{sf_dir}/{name}.parquet")
    for name in load:
        out.load(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return out


def _changed(table: str, statements: list[str], query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = engine(spark, sf_dir, table)
        for s in statements:
            own.execute(s)
        return own.sql(query)

    return run


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    op = F.when(n % 5 == 4, "DELETE").when(n % 5 == 3, "UPDATE").otherwise("INSERT")
    return e.select(n.alias("lsn"), F.col("user_id").alias("k"), F.col("value").alias("v"), (n % 11).alias("txn"), op.alias("op"))


def text_numeric_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir)
    docs = own.external("documents")
    own.warehouse.external["documents"] = docs.select("doc_id", docs.n_chars.cast("string").alias("n_chars"))
    return own.sql("SELECT doc_id FROM documents WHERE n_chars > '500'")


def order_by_text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir)
    customers = own.external("customer")
    own.warehouse.external["customer"] = customers.select("c_custkey", customers.c_custkey.cast("string").alias("c_text"))
    return own.sql("SELECT c_custkey, c_text FROM customer ORDER BY c_text DESC")


def _texts(spark: SparkSession, sf_dir: str) -> Engine:
    own = engine(spark, sf_dir)
    o, key = own.external("orders"), F.col("o_orderkey") % 5
    cust = F.col("o_custkey").cast("string")
    t = F.when(key == 0, F.concat(cust, F.lit("e1"))).when(key == 1, F.concat(F.lit(" "), cust)).when(key == 2, F.concat(F.lit("c"), cust)).otherwise(F.concat((F.col("o_custkey") + 1).cast("string"), F.lit(".50")))
    own.warehouse.external["texts"] = o.select("o_orderkey", "o_custkey", (F.col("o_custkey") + 1).alias("after"), t.alias("t"))
    return own


def text_column_vs_number_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).sql("SELECT o_orderkey, t FROM texts WHERE o_custkey < t")


def text_column_equals_number_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).sql("SELECT o_orderkey, t FROM texts WHERE t = after")


def agg_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).sql("SELECT o_custkey, COUNT(t) AS cnt, ROUND(SUM(t), 3) AS s, ROUND(AVG(t), 3) AS a, MIN(t) AS mn, MAX(t) AS mx FROM texts GROUP BY o_custkey")


def _printed(own: Engine, text: str) -> DataFrame:
    """The lines that a statement prints."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        own.run(text)
    return own.spark.createDataFrame([(line,) for line in out.getvalue().splitlines()], "line string")


def console_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(engine(spark, sf_dir), "SELECT * FROM nation")


def number_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(engine(spark, sf_dir), "SELECT l_linenumber, SUM(l_quantity), AVG(l_quantity), MIN(l_extendedprice) FROM lineitem GROUP BY l_linenumber")


def unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, rows = engine(spark, sf_dir), []
    for statement in ("SELECT nothing FROM nation", "SELECT n_name FROM nation, nation n", "SELECT * FROM nowhere", "SELECT nation.r_name FROM nation, region"):
        try:
            own.sql(statement)
        except EngineError as e:
            rows.append((statement, str(e)))
    return spark.createDataFrame(rows, "statement string, error string")


def catalog_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir, "region")
    own.execute("INSERT INTO region VALUES (77, 'ELSEWHERE')")
    own.execute("DELETE FROM region WHERE r_regionkey = 2")
    return Engine(spark, own.store.files.root).sql("SELECT r_regionkey, r_name FROM region")


def insert_multi_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir)
    own.execute("CREATE TABLE t (id INT, name, price DOUBLE)")
    own.execute("INSERT INTO t VALUES (1, 'a', 2.5), (2, NULL, NULL)")
    own.execute("INSERT INTO t (name, id) VALUES ('c', 3)")
    return own.sql("SELECT * FROM t")


def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir)
    own.execute("CREATE TABLE t (id BIGINT, name)")
    own.execute("INSERT INTO t SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 3")
    own.execute("INSERT INTO t (name, id) SELECT n_name, n_nationkey FROM nation")
    return own.sql("SELECT id, name FROM t")


def create_table_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir)
    own.execute("CREATE TABLE t AS SELECT c_nationkey, COUNT(*) AS cnt FROM customer GROUP BY c_nationkey")
    return own.sql("SELECT * FROM t WHERE cnt > 1")


def lock_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared locks go together, an exclusive one with none of another; the only holder upgrades; unlocking frees."""
    m = LockManager()
    steps = [m.lock_shared(1, "a"), m.lock_shared(2, "a"), m.lock_exclusive(1, "a"), m.unlock(2, "a"), m.lock_exclusive(1, "a")]
    steps += [m.lock_shared(2, "a"), m.lock_shared(1, "a"), m.unlock_all(1), m.lock_exclusive(2, "a"), m.lock_shared(3, "a")]
    return spark.createDataFrame(list(enumerate(steps, 1)), "step int, granted boolean")


def lock_deadlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three transactions wait in a circle: the youngest is the victim, the others go on."""
    manager = TransactionManager()
    a, b, c = (manager.begin() for _ in range(3))
    for txn, key in ((a, "x"), (b, "y"), (c, "z")):
        manager.locks.lock_exclusive(txn.id, key)
    for txn, key in ((a, "y"), (b, "z"), (c, "x"), (b, "z")):
        manager.locks.lock_exclusive(txn.id, key)
    for txn in (b, a):
        manager.commit(txn)
    return spark.createDataFrame([(t.id, t.state.value) for t in (a, b, c)], "txn int, state string")


def lock_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = LockManager(timeout=0.2)
    m.lock_exclusive(1, "a")
    rows = [("held", m.lock_shared(2, "a"))]
    m.timeout = 10
    threading.Timer(0.1, m.unlock_all, (1,)).start()
    return spark.createDataFrame([*rows, ("freed", m.lock_shared(2, "a"))], "step string, granted boolean")


def txn_serializable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader shares a table with a reader; under SERIALIZABLE it holds the table alone."""
    first, rows = engine(spark, sf_dir, "region"), []
    second = first.warehouse.session()
    for who, isolation in (("reader", "READ COMMITTED"), ("writer", "SERIALIZABLE")):
        first.execute(f"BEGIN TRANSACTION ISOLATION LEVEL {isolation}")
        first.sql("SELECT * FROM region")
        try:
            second.sql("SELECT * FROM region")
            rows.append((who, isolation, True))
        except LockConflict:
            rows.append((who, isolation, False))
        first.execute("COMMIT")
    return spark.createDataFrame(rows, "who string, isolation string, granted boolean")


def mvcc_snapshot_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction 1 has committed when 4 begins; 2 commits and 3 aborts afterwards, which only READ COMMITTED sees."""
    versions = _versions(spark, sf_dir)
    manager = TransactionManager()
    one, two, three = (manager.begin() for _ in range(3))
    manager.commit(one)
    reader = manager.begin(Isolation.REPEATABLE_READ)
    manager.commit(two)
    manager.abort(three)
    later = manager.begin()
    rr = visible_rows(versions, reader.id, manager.view(reader)).select(F.lit("RR").alias("isolation"), "o_orderkey")
    rc = visible_rows(versions.where("xmax <> 5 AND xmin <> 5"), later.id, manager.view(later))
    with_four = versions.where("xmax = 4 AND xmin IN (0, 1, 2)")  # 4 is still open: to others its deletions hide rows
    return rr.unionByName(rc.unionByName(with_four).select(F.lit("RC").alias("isolation"), "o_orderkey"))


def _logged(spark: SparkSession, sf_dir: str) -> Engine:
    own = engine(spark, sf_dir)
    for s in ("BEGIN", "CREATE TABLE t (a, b)", "INSERT INTO t VALUES ('1', 'x'), ('2', 'y')", "UPDATE t SET b = 'z' WHERE a = '2'", "DELETE FROM t WHERE a = '1'", "COMMIT"):
        own.execute(s)
    return own


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _logged(spark, sf_dir).warehouse.log.frame()
    known = log.select(F.col("lsn").alias("prev_lsn"), F.lit(True).alias("known"))
    return log.join(known, "prev_lsn", "left").select("op", F.when(F.col("op") == "CREATE", 0).otherwise(F.coalesce("n_rows", F.lit(-1))).alias("n_rows"), F.coalesce("known", F.lit(False)).alias("chained"))


def _customers_logged(spark: SparkSession, sf_dir: str) -> tuple[Engine, list[int]]:
    """Customers with an update and a delete, and the log numbers of both."""
    own = engine(spark, sf_dir, "customer")
    own.execute("UPDATE customer SET c_mktsegment = 'MOVED' WHERE c_nationkey = 3 AND c_mktsegment <> 'MOVED'")
    own.execute("DELETE FROM customer WHERE c_nationkey = 4")
    return own, [r["lsn"] for r in own.warehouse.log.frame().where("op in ('UPDATE', 'DELETE')").orderBy("lsn").collect()]


def log_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, (update, _) = _customers_logged(spark, sf_dir)
    return own.images(update).select("image", "c_custkey", "c_mktsegment")


def log_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as it was loaded, with the engine's own log replayed over it."""
    own, lsns = _customers_logged(spark, sf_dir)
    loaded = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit(0).cast("long").alias("lsn"), F.lit("INSERT").alias("op"), "c_custkey", "c_mktsegment")
    for lsn, op in zip(lsns, ("UPDATE", "DELETE"), strict=True):
        image = "after" if op == "UPDATE" else "before"
        loaded = loaded.unionByName(own.images(lsn).where(F.col("image") == image).select(F.lit(lsn).alias("lsn"), F.lit(op).alias("op"), "c_custkey", "c_mktsegment"))
    return redo(loaded, key="c_custkey").select("c_custkey", "c_mktsegment")


def log_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, rows = _logged(spark, sf_dir).warehouse.log, []
    lsns = [r["lsn"] for r in log.frame().orderBy("lsn").collect()]
    log.truncate(after=lsns[1])
    rows.append(("after the second", log.frame().count()))
    log.truncate()
    return spark.createDataFrame([*rows, ("all", log.frame().count())], "what string, n long")


def compact_keeps_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small files of several inserts and a delete become few; rows stay."""
    own = engine(spark, sf_dir)
    own.execute("CREATE TABLE t AS SELECT n_nationkey, n_name FROM nation")
    for k in range(5):
        own.execute(f"INSERT INTO t SELECT c_custkey, CASE WHEN c_nationkey = {k} THEN 'customer' END AS n_name FROM customer WHERE c_nationkey = {k} AND c_nationkey <> 3")
    before, after = own.compact("t")
    if after >= before:
        raise EngineError(f"{before} files became {after}")
    return own.sql("SELECT n_nationkey, n_name FROM t")


def recover_keeps_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning up between a transaction's change and its commit takes nothing from it."""
    own = engine(spark, sf_dir, "customer")
    own.execute("BEGIN")
    own.execute("UPDATE customer SET c_mktsegment = 'LIVE'")
    own.warehouse.session().recover(retention=0)
    own.execute("COMMIT")
    return own.sql("SELECT COUNT(*) AS cnt FROM customer WHERE c_mktsegment = 'LIVE'")


def dml_create_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir)
    own.execute("CREATE TABLE products (pid, pname, price)")
    own.execute("INSERT INTO products VALUES ('400', 'Monitor', '299')")
    own.execute("INSERT INTO products VALUES ('500', 'Desk', '450')")
    own.execute("CREATE TABLE other (a)")
    own.execute("DROP TABLE other")
    return own.sql("SELECT * FROM products")


def txn_repeatable_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = engine(spark, sf_dir, "customer")
    writer = reader.warehouse.session()
    reader.execute("BEGIN TRANSACTION ISOLATION LEVEL REPEATABLE READ")
    writer.execute("DELETE FROM customer WHERE c_nationkey = 3")
    return reader.sql("SELECT COUNT(*) AS cnt FROM customer")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    xmin = F.when(key % 9 == 8, 100).otherwise(key % 9).alias("xmin")
    xmax = F.when(cust % 10 == 9, 100).when(cust % 10 == 8, 0).otherwise(cust % 8).alias("xmax")
    return o.select(key, xmin, xmax)


def mvcc_visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_rows(_versions(spark, sf_dir), 100, Snapshot(frozenset({1, 2, 3}), frozenset({5, 6})))


def wal_redo_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redo(_events(spark, sf_dir).where(~F.col("txn").isin(3, 7))).select("k", "lsn", "op", "v")


def wal_undo_aborted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.replay import undo

    return undo(_events(spark, sf_dir).where(F.col("txn").isin(3, 7)), before="v")


def wal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log in which each transaction's last record ends it: an even number commits, an odd one aborts."""
    from tessera.operators.replay import outcomes

    log = _events(spark, sf_dir)
    ends = log.groupBy("txn").agg(F.max("lsn").alias("lsn")).select("lsn", "txn", F.when(F.col("lsn") % 2 == 0, "COMMIT").otherwise("ABORT").alias("op"))
    return outcomes(log.select("lsn", "txn", "op").unionByName(ends))


def wal_prev_lsn_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return previous_lsn(_events(spark, sf_dir)).select("lsn", "txn", "prev_lsn")


def operator_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.range_scan(spark.read.parquet(f"{sf_dir}/orders.parquet"), 100, 200)


def operator_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.group(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderstatus"], n=("COUNT", None), top=("MAX", "o_totalprice"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: (lambda spark, sf_dir, text=text: engine(spark, sf_dir).sql(text)) for name, text in SELECTS.items()},
    **{f.__name__: f for f in (text_column_vs_number_column, text_column_equals_number_column, agg_text, console_rows, number_formatting, unknown_names, catalog_reopened, insert_multi_row, insert_select, create_table_as, lock_modes, lock_deadlock, lock_timeout, txn_serializable, mvcc_snapshot_view, log_records, log_images, log_replayed, log_truncated, compact_keeps_rows, recover_keeps_live)},
    **{f.__name__: f for f in (text_numeric_filter, order_by_text_numbers, operator_range_scan, operator_group, dml_create_insert, txn_repeatable_read, mvcc_visible_rows, wal_redo_committed, wal_undo_aborted, wal_outcomes, wal_prev_lsn_chain)},
    "dml_insert": _changed("region", ["INSERT INTO region VALUES (99, 'ATLANTIS')"], "SELECT * FROM region"),
    "dml_update_where": _changed("customer", ["UPDATE customer SET c_mktsegment = 'UPDATED' WHERE c_nationkey = 3"], "SELECT c_custkey, c_mktsegment FROM customer"),
    "dml_update_all": _changed("customer", ["UPDATE customer SET c_mktsegment = 'UPDATED'"], "SELECT c_custkey, c_mktsegment FROM customer"),
    "dml_delete_where": _changed("customer", ["DELETE FROM customer WHERE c_acctbal < 0"], "SELECT * FROM customer"),
    "dml_delete_all": _changed("customer", ["DELETE FROM customer"], "SELECT COUNT(*) AS cnt FROM customer"),
    "txn_commit_keeps": _changed("customer", ["BEGIN", "DELETE FROM customer WHERE c_nationkey = 3", "COMMIT"], "SELECT COUNT(*) AS cnt FROM customer"),
    "txn_abort_restores": _changed("customer", ["BEGIN", "DELETE FROM customer", "ABORT"], "SELECT COUNT(*) AS cnt FROM customer"),
}
ORACLES: dict[str, str] = SELECTS | OTHERS

#: The flagship: a join, a filter, a group and an order.
FLAGSHIP = "SELECT c_mktsegment, COUNT(*) AS cnt, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment ORDER BY c_mktsegment"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql(FLAGSHIP)
