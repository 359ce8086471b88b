"""Column functions at their edges."""

import math

import pytest
from pyspark.sql import functions as F

from colscope import functions as fx


def values(spark, column, rows="SELECT 1 AS one"):
    return [r[0] for r in spark.sql(rows).select(column.alias("v")).collect()]


@pytest.mark.parametrize("column, expected", [
    (lambda: fx.divide(F.lit(1), F.lit(0)), None),
    (lambda: fx.remainder(F.lit(-7), F.lit(3)), -1),
    (lambda: fx.remainder(F.lit(7), F.lit(0)), None),
    (lambda: fx.positive_mod(F.lit(-7), F.lit(3)), 2),
    (lambda: fx.positive_mod(F.lit(7), F.lit(0)), None),
    (lambda: fx.row_min(F.lit(3), F.lit(1), F.lit(2)), 1),
    (lambda: fx.row_min(F.lit(3), F.lit(None).cast("int")), None),
    (lambda: fx.row_max(F.lit(3), F.lit(None).cast("int")), None),
    (lambda: fx.row_max(F.lit(3), F.lit(9)), 9),
    (lambda: fx.log10(F.lit(0)), None),
    (lambda: fx.ln(F.lit(-1)), None),
    (lambda: fx.round_half_up(F.lit(2.5)), 3.0),
    (lambda: fx.round_half_up(F.lit(-2.5)), -3.0),
    (lambda: fx.concat(F.lit("a"), F.lit(None)), None),
    (lambda: fx.concat(F.lit("F"), F.lit("-"), F.lit(0.5)), "F-0.5"),
    (lambda: fx.find(F.lit("0.455"), "4"), 3),
    (lambda: fx.find(F.lit("0.455"), "9"), 0),
    (lambda: fx.replace(F.lit("0.405"), "0", "1"), "1.415"),
    (lambda: fx.replace(F.lit("a1b22"), "[0-9]+", "#"), "a#b#"),
    (lambda: fx.left(F.lit("abc"), 2), "ab"),
    (lambda: fx.right(F.lit("abc"), 2), "bc"),
    (lambda: fx.right(F.lit("abc"), 9), "abc"),
    (lambda: fx.substring(F.lit("abcdef"), 2, 3), "bcd"),
    (lambda: fx.all_of(F.lit(1), F.lit(1)), True),
    (lambda: fx.all_of(F.lit(0), F.lit(None)), False),
    (lambda: fx.any_of(F.lit(0), F.lit(None)), None),
    (lambda: fx.negate(F.lit(0)), True),
    (lambda: fx.contains(F.lit("a%b"), "%"), True),
    (lambda: fx.contains(F.lit("ab"), "a_"), False),
    (lambda: fx.one_of(F.lit("F"), ["F", "M"]), True),
    (lambda: fx.if_null(F.lit(None).cast("int"), 0), 0),
    (lambda: fx.if_then_else(F.lit(None).cast("boolean"), F.lit(1), F.lit(-1)), None),
    (lambda: fx.case_when(F.lit(0), [(0, F.lit(-1)), (0, F.lit(-2))]), -2),
    (lambda: fx.case_when(F.lit(5), [(0, F.lit(-1))]), None),
])
def test_value(spark, column, expected):
    assert values(spark, column()) == [expected]


def test_square_root_below_zero_is_nan(spark):
    assert math.isnan(values(spark, fx.square_root(F.lit(-1.0)))[0])


def test_normalize(spark):
    df = spark.sql("SELECT * FROM VALUES (1), (3), (5), (null) AS t(x)")
    assert [r[0] for r in df.select(fx.normalize(df, "x", 1, 2)).collect()] == [1.0, 1.5, 2.0, None]


def test_normalize_constant_and_text(spark):
    df = spark.sql("SELECT * FROM VALUES (4, 'a'), (4, 'b') AS t(x, s)")
    assert df.select(fx.normalize(df, "x", 0, 1), fx.normalize(df, "s", 0, 1)).collect() == [(None, None)] * 2


def test_outliers(spark):
    df = spark.range(100).select(F.when(F.col("id") == 7, 1000.0).when(F.col("id") == 8, None).otherwise(1.0).alias("x"))
    rows = df.select("x", fx.is_outlier(df, "x").alias("o"), fx.replace_outlier(df, "x", F.lit(0.0)).alias("r")).collect()
    assert {(r.x, r.o, r.r) for r in rows} == {(1000.0, True, 0.0), (1.0, False, 1.0), (None, None, None)}


def test_statistics_come_from_one_subquery_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = df.select(fx.normalize(df, "l_tax", 0, 1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "mergedValue" in plan
