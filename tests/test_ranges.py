"""Range joins: equal to comparing all pairs, with no step above its share."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from colscope.operators.ranges import point_grid, range_join, stepped_points


@pytest.mark.parametrize("closed", [True, False])
def test_equal_to_all_pairs(spark, closed):
    pick = random.Random(3)
    values = [None, float("nan"), float("inf"), 5.0, 5.0]
    points = [(i, pick.choice([*values, *[round(pick.expovariate(0.2), 1)] * 9])) for i in range(600)]
    bands = [(i, lo, None if lo is None else lo + pick.choice([0.0, 0.3, 2.0, 50.0, -1.0])) for i, lo in
             enumerate(pick.choice([None, 5.0, *[round(pick.uniform(0, 30), 1)] * 9]) for _ in range(80))]
    left = spark.createDataFrame(points, "p long, `a.x` double").repartition(3)
    right = spark.createDataFrame(bands, "b long, lo double, hi double")
    # Not-a-number is above every band, as Spark orders it.
    expected = sorted((p, b) for p, x in points for b, lo, hi in bands
                      if x is not None and lo is not None and (lo <= x <= hi if closed else lo <= x < hi))
    for steps in (4, 128):
        found = range_join(left, right, "a.x", "lo", "hi", closed, steps=steps)
        assert found.columns == ["p", "a.x", "b", "lo", "hi"]
        assert sorted((r.p, r.b) for r in found.collect()) == expected
    assert range_join(left.limit(0), right, "a.x", "lo", "hi").count() == 0
    assert range_join(left, right.limit(0), "a.x", "lo", "hi").count() == 0


def test_dates_and_long_numbers_keep_their_own_order(spark):
    day = datetime.date(2024, 1, 1)
    days = spark.createDataFrame([(day + datetime.timedelta(i),) for i in range(40)], "d date")
    weeks = spark.createDataFrame([(day + datetime.timedelta(7 * i), day + datetime.timedelta(7 * i + 6)) for i in range(5)], "lo date, hi date")
    assert range_join(days, weeks, "d", "lo", "hi").groupBy("lo").count().filter("count = 7").count() == 5
    big = 2 ** 60
    near = spark.createDataFrame([(big + i,) for i in range(100)], "x long")  # equal as doubles
    band = spark.createDataFrame([(big + 10, big + 12)], "lo long, hi long")
    assert sorted(r.x - big for r in range_join(near, band, "x", "lo", "hi").collect()) == [10, 11, 12]


def test_no_step_above_its_share(spark):
    x = F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.exp(F.rand(1) * 20))
    points = spark.range(0, 60_000, 1, 4).select("id", x.alias("x"))
    points = spark.createDataFrame(points.collect())
    grid = point_grid(points, "x", 64)
    parts = [r["count"] for r in stepped_points(points, "x", grid).groupBy("__step", "__part").count().collect()]
    assert max(parts) <= 2.6 * 60_000 / 64 and sum(parts) == 60_000


def test_steps_follow_from_rows_and_hold_few_points_and_bands(spark):
    """Steps stay small however many rows there are, and bands where no points are go nowhere."""
    points = spark.range(0, 40_000, 1, 4).select("id", F.when(F.col("id") % 4 == 0, 7.0).otherwise(F.sqrt("id")).alias("x"))
    bands = spark.range(20_000).select(F.col("id").alias("b"), (F.col("id") / 50).alias("lo"), (F.col("id") / 50 + 0.01).alias("hi"))
    ends = bands.select(F.explode(F.array("lo", "hi")).alias("x"))
    grid = point_grid(points, "x", 8, ends=ends, per_step=100)
    sizes = [r["count"] for r in stepped_points(points, "x", grid).groupBy("__step", "__part").count().collect()]
    assert len(grid.cuts) > 600 and max(sizes) < 300 and sum(sizes) == 40_000 and grid.parts.count(0) > 200
    pairs = range_join(points, bands, "x", "lo", "hi", grid=grid)
    assert pairs.filter("x < lo or x > hi").count() == 0
    expected = points.crossJoin(F.broadcast(bands.filter("lo <= 200"))).filter("x >= lo and x <= hi")
    totals = [F.count("*"), F.sum("id"), F.sum("b")]
    assert pairs.agg(*totals).first() == expected.agg(*totals).first()


def test_clashing_names_are_refused(spark):
    df = spark.range(3).select(F.col("id").alias("x"))
    with pytest.raises(ValueError):
        range_join(df, df.withColumn("lo", F.col("x")).withColumn("hi", F.col("x")), "x", "lo", "hi")
