import os

import pytest

from tessera import queries as Q

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_agrees_with_its_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in Q.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.sql(Q.ORACLES[name]), Q.QUERIES[name](spark, DATA)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got.select(*columns).collect()) == plain(tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_plans(spark):
    plan = lambda name: Q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,42)" in plan("index_point_lookup")
    assert "Cartesian" not in plan("implicit_join_where") and "NestedLoop" not in plan("join_three_tables")
    assert "ReadSchema: struct<l_quantity:double,l_returnflag" not in plan("group_by_single") and "partial_count" in plan("group_by_single")
    ordered = [r["o_totalprice"] for r in Q.QUERIES["order_by_desc"](spark, DATA).collect()]
    assert ordered == sorted(ordered, reverse=True)
