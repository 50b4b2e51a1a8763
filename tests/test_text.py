import operator

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import OPERATORS, as_number, compare, is_number, shown, sort_keys

VALUES = ["5", "5.0", "-5", "05", "50", "9", "10", "", ".", "-", "-.", "5\n", "+5", " 5", "1e5", "inf", "nan", "1d", "abc", "a5", "5a", "-0", "0", ".5", "5.", "é", "0x10", "10a"]


def model(op: str, a: str, b: str) -> bool:
    f = OPERATORS[op]
    return f(float(a), float(b)) if is_number(a) and is_number(b) else f(a.encode(), b.encode())


def test_compare_agrees_with_the_model_on_every_pair(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    row = df.select("v", *[compare(op, F.col("v"), b).alias(f"{op}{k}") for op in OPERATORS for k, b in enumerate(VALUES)]).collect()
    for r in row:
        for op in OPERATORS:
            for k, b in enumerate(VALUES):
                assert r[f"{op}{k}"] == model(op, r["v"], b), (r["v"], op, b)


def test_non_numeric_literals_push_down(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "v string").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(compare("=", F.col("v"), "a"))._jdf.queryExecution().toString()
    assert "EqualTo(v,a)" in plan


def test_numbers_in_text_sort_by_value_before_other_texts(spark):
    df = spark.createDataFrame([(v,) for v in ["abc", "10", "9", "10a", "-1", ""]], "v string")
    up = [r["v"] for r in df.orderBy(*sort_keys(F.col("v"), False)).collect()]
    assert up == ["-1", "9", "10", "", "10a", "abc"]
    assert [r["v"] for r in df.orderBy(*sort_keys(F.col("v"), True)).collect()] == up[::-1]


def test_only_plain_numbers_are_numbers(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    assert {r["v"] for r in df.where(as_number(F.col("v")).isNotNull()).collect()} == {v for v in VALUES if is_number(v)}


@pytest.mark.parametrize(("value", "text"), [(None, ""), (3.0, "3"), (374.5, "374.5"), (1 / 3, "0.333333"), (7, "7"), ("x", "x"), (float("inf"), "inf")])
def test_shown(value, text):
    assert shown(value) == text


def test_operators_are_pythons():
    assert OPERATORS["<>"] is operator.ne
