"""Most frequent values: equal to counting all of them, with few counters and by every way."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colscope.operators import frequent as fr
from colscope.operators import univariate as uni


def brute(values, most):
    ranked = sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))
    out = {(v, n, False) for v, n in ranked[:most]}
    return out | ({(None, sum(n for _, n in ranked[most:]), True)} if ranked[most:] else set())


@pytest.mark.parametrize("most,counters", [(1, 2), (3, 4), (10, 12), (10, 4096)])
def test_equal_to_counting_every_value(spark, most, counters):
    pick = random.Random(most * counters)
    rows = [(pick.choice(["Others", "a", "b"]), str(i), f"v{int(pick.paretovariate(1.1))}", None, pick.choice([None, 1, 2, 3]),
             "x" * 70 + str(i % 5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "a string, `b.c` string, c string, d string, e int, f string").repartition(7)
    found = {}
    for r in fr.frequent_values(df, df.columns, most, counters).collect():
        found.setdefault(r["column"], set()).add((r.value, r.n, r.remainder))
    for i, c in enumerate(df.columns[:5]):
        values = [None if r[i] is None else str(r[i]) for r in rows]
        assert found.get(c, set()) == brute(values, most), c
    assert sorted(n for _, n, _ in found["f"])[-1] >= 800
    assert fr.frequent_values(df.limit(0), ["a"], most).count() == 0


def test_counters_are_never_too_high_and_too_low_by_the_error_at_most():
    pick = random.Random(5)
    held, true = fr.Counters(20), Counter()
    for _ in range(300):
        part = Counter(f"v{int(pick.paretovariate(0.7))}" for _ in range(50))
        true.update(part)
        held.add(part)
        assert len(held.counts) <= 40
    assert held.error > 0
    assert all(held.counts[v] <= n <= held.counts[v] + held.error for v, n in true.items())


def test_only_candidates_are_counted_where_the_bound_tells_them(spark, monkeypatch):
    """A column of a few frequent values among many rare ones does not have all of its values counted."""
    x = F.when(F.col("id") % 2 == 0, F.concat(F.lit("hot"), F.col("id") % 6)).otherwise(F.col("id").cast("string"))
    df = spark.range(0, 100_000, 1, 4).select(x.alias("x"))
    seen = []
    monkeypatch.setattr(fr, "_counted", lambda *a, plain=fr._counted: seen.append(a[2]) or plain(*a))
    found = {(r.value, r.n) for r in fr.frequent_values(df, ["x"], 3, 64).collect()}
    assert found == {("hot0", 16667), ("hot2", 16667), ("hot4", 16666), (None, 50000)} and seen == [[0]]


def test_a_value_called_others_is_not_the_remainder(spark):
    df = spark.createDataFrame([("Others",)] * 3 + [(f"v{i}",) for i in range(5)], "x string")
    bars = uni.category_histogram(df, ["x"], limit=3).collect()
    assert {(r.label, r.n, r.remainder) for r in bars} == {("Others", 3, False), ("v0", 1, False), ("Others", 4, True)}
