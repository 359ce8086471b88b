"""Exact quantiles: no task orders more values than the bound, whatever the distribution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.operators import quantiles as qu

PROBS = [0.0, 0.25, 0.5, 0.95, 0.999, 1.0]


def expected(values, probs=PROBS):
    return {p: float(np.quantile(values, p)) for p in probs}


def frame(spark, columns):
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(6)


@pytest.mark.parametrize("most", [5, 50, 100_000])
def test_long_tails_ties_and_small_groups(spark, monkeypatch, most):
    monkeypatch.setattr(qu, "MOST_ORDERED", most)
    random = np.random.default_rng(1)
    groups = {
        "tail": np.exp(random.normal(0, 6, 20_000)), "hot": np.where(random.random(20_000) < 0.7, 3.0, random.normal(size=20_000)),
        "same": np.full(5_000, 7.0), "two": np.array([1.0, 2.0]), "one": np.array([-4.0]), "wide": 10.0 ** random.uniform(-300, 300, 9_000),
        "ten": np.arange(10.0), "far": np.append(np.zeros(8_000), [1e300, -1e300]),
    }
    df = frame(spark, {"g": np.repeat(list(groups), [len(v) for v in groups.values()]), "x": np.concatenate(list(groups.values()))})
    found = {}
    for r in qu.exact_quantiles(df, ["g"], "x", PROBS).collect():
        found.setdefault(r.g, {})[r.prob] = r.quantile
    for g, values in groups.items():
        assert found[g] == pytest.approx(expected(values), rel=1e-12), g


def test_the_bound_holds_on_five_million_skewed_rows(spark, monkeypatch):
    """p99.9 of a log-normal: every round leaves a small share of the values, and the last is within the bound."""
    monkeypatch.setattr(qu, "MOST_ORDERED", 1000)
    rounds, plain = [], qu._narrowed
    monkeypatch.setattr(qu, "_narrowed", lambda *a: rounds.append((r := plain(*a))[2]) or r)
    x = F.exp(3 * F.sqrt(-2 * F.log((F.col("id") * 7919 % 5_000_011 + 1) / 5_000_013.0)))
    df = spark.range(0, 5_000_000, 1, 8).select(F.lit(1).alias("k"), x.alias("x"))
    found = qu.exact_quantiles(df, ["k"], "x", [0.999]).first().quantile
    values = np.exp(3 * np.sqrt(-2 * np.log((np.arange(5_000_000) * 7919 % 5_000_011 + 1) / 5_000_013.0)))
    assert found == pytest.approx(float(np.quantile(values, 0.999)), rel=1e-9)
    assert rounds and rounds[-1] <= 1000 and len(rounds) <= 2


def test_counted_values_and_no_rows(spark, monkeypatch):
    random = np.random.default_rng(2)
    values, counts = np.unique(np.round(np.exp(random.normal(0, 3, 3000)), 2), return_counts=True)
    whole = np.repeat(values, counts)
    df = frame(spark, {"x": values, "n": counts})
    stats = frame(spark, {"x": whole}).agg(*qu.bracket_columns(F.col("x"), PROBS))
    for most in (20, 100_000):
        monkeypatch.setattr(qu, "MOST_ORDERED", most)
        found = qu.pick_quantiles(df.withColumn("c", F.lit("a")), stats.withColumn("c", F.lit("a")), ["c"], "x", PROBS, "n")
        assert {r.prob: r.quantile for r in found.collect()} == pytest.approx(expected(whole), rel=1e-12)
        assert {r["values"] for r in found.collect()} == {len(values)}
    assert qu.exact_quantiles(spark.createDataFrame([], "g int, x double"), ["g"], "x", [0.5]).count() == 0
    assert qu.exact_quantiles(spark.createDataFrame([(1, None)], "g int, x double"), ["g"], "x", [0.5]).count() == 0
