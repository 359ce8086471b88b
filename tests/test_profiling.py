"""Profiling against plain Python on small tables, and at the edges: nothing, only nulls, one value, hot values."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.operators import bivariate as bi
from colscope.operators import quantiles as qu
from colscope.operators import univariate as uni
from colscope.operators.distinct import distinct_counts, small_distinct_counts, text_key
from colscope.specs import CATEGORY, NUMBER, TEXT, ColumnSpec

NUMBERS = [ColumnSpec("x", NUMBER, 0)]


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_empty_table(spark):
    df = frame(spark, [])
    row = uni.summarize(df, NUMBERS).first()
    assert (row.rows, row.missing, row.distinct, row["mean"], row["median"]) == (0, 0, 0, None, None)
    assert uni.summarize(df, NUMBERS, exact=False).first().distinct == 0
    assert uni.histograms(df, NUMBERS).count() == 0


def test_only_nulls(spark):
    row = uni.summarize(frame(spark, [None, None]), NUMBERS).first()
    assert (row.rows, row.missing, row.distinct, row["median"]) == (2, 2, 1, None)


def test_one_value_makes_one_bar(spark):
    bars = uni.histograms(frame(spark, [4.0] * 5), NUMBERS).collect()
    assert [(r.label, r.n) for r in bars] == [("4.0", 5)]


def test_wide_integers_stay_apart(spark):
    df = frame(spark, [2**53, 2**53 + 1, 2**53 + 2], "long")
    assert uni.summarize(df, NUMBERS).first().distinct == 3


def test_edges_collapse_when_the_middle_is_constant(spark):
    edges = uni.bucket_edges(frame(spark, [0.0] + [5.0] * 98 + [9.0]), ["x"], exact=True).first().edges
    assert edges == [0.0, 9.0]


def test_buckets_are_half_open_and_the_last_is_closed(spark):
    bars = uni.bucket_counts(frame(spark, [-1.0, 0.0, 9.9, 10.0, 20.0, 20.1, None]), {"x": [0.0, 10.0, 20.0]}).orderBy("bin").collect()
    assert [(r.label, r.n) for r in bars] == [("0.0 - 10.0", 2), ("10.0 - 20.0", 2)]


@pytest.mark.parametrize("bins, ends, steps", [(22, (0.05, 0.95), 20), (14, (0, 0.95), 13), (10, (0.1, 1), 9), (8, (0, 1), 8), (2, (0.1, 0.9), 0)])
def test_inner_steps(bins, ends, steps):
    assert uni.inner_steps(bins, ends) == steps


def test_category_bars_in_both_orders(spark):
    words = [f"w{i:03d}" for i in range(150) for _ in range(i + 1)]
    df = frame(spark, words, "string")
    for order, kept in (("desc", range(149, 50, -1)), ("asc", range(99))):
        bars = {r.label: r.n for r in uni.category_histogram(df, ["x"], order).collect()}
        expected = {f"w{i:03d}": i + 1 for i in kept}
        assert bars == {**expected, "Others": len(words) - sum(expected.values())}


def test_long_texts_keep_their_label(spark):
    long_a, long_b = "a" * 500, "sha256:" + "0" * 64
    df = frame(spark, [long_a] * 3 + [long_b] * 2 + ["short"], "string")
    assert {r.label: r.n for r in uni.category_histogram(df, ["x"]).collect()} == {long_a: 3, long_b: 2, "short": 1}
    assert distinct_counts(df, ["x"]).first()["distinct"] == 3
    assert df.select(F.max(F.length(text_key(F.col("x"))))).first()[0] == 71


def test_small_distinct_counts(spark):
    df = spark.range(5000).select(F.col("id").alias("many"), (F.col("id") % 20).alias("twenty"), (F.col("id") % 19).alias("nineteen"),
                                  F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("holes"), F.lit(None).cast("int").alias("nothing"))
    assert small_distinct_counts(df, df.columns, 20) == {"nineteen": 19, "holes": 3, "nothing": 1}
    assert small_distinct_counts(df, ["holes", "nothing"], 20, nulls=False) == {"holes": 2, "nothing": 0}


def numpy_quantiles(groups, probs):
    return {(k, p): float(np.quantile(v, p)) for k, v in groups.items() for p in probs}


@pytest.mark.parametrize("most", [100_000, 50])
def test_quantiles_match_numpy(spark, monkeypatch, most):
    """With a low bound, 6,000-row groups go through sketch brackets, which are cut again."""
    monkeypatch.setattr(qu, "MOST_ORDERED", most)
    rng = random.Random(3)
    groups = {
        "smooth": [rng.gauss(0, 1) for _ in range(6000)], "heavy": [rng.paretovariate(0.5) for _ in range(6000)],
        "hot": [1.0] * 5000 + [rng.random() for _ in range(1000)], "negative": [-float(i) for i in range(6000)], "constant": [2.0] * 6000,
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("smooth", None)] * 50
    rng.shuffle(rows)
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    found = qu.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probs).collect()
    assert {(r.k, r.prob): r.quantile for r in found} == pytest.approx(numpy_quantiles(groups, probs), rel=1e-12)


@pytest.mark.parametrize("n", range(1, 8))
def test_quantiles_of_few_rows(spark, n):
    values = [float(i * i) for i in range(n)]
    found = qu.exact_quantiles(frame(spark, values).withColumn("k", F.lit(1)), ["k"], "x", [0.05, 0.5, 0.75]).collect()
    assert {r.prob: r.quantile for r in found} == pytest.approx({p: float(np.quantile(values, p)) for p in (0.05, 0.5, 0.75)})


def test_correlations_equal_the_built_in_aggregates(spark):
    df = spark.range(500).select(F.col("id").cast("double").alias("a"), F.sin("id").alias("b"), F.when(F.col("id") % 3 > 0, F.cos("id")).alias("c"))
    for r in bi.correlations(df, bi.all_pairs(["a", "b", "c"])).collect():
        x, y = F.col(r.c1), F.col(r.c2)
        n, corr, cov = df.agg(F.count_if(x.isNotNull() & y.isNotNull()), F.corr(x, y), F.covar_samp(x, y)).first()
        assert r.n == n and r.correlation == pytest.approx(corr) and r.covariance == pytest.approx(cov)


def test_mosaic_against_counting(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "z"]), rng.choice([None, -5.0, 1.0, 3.0, 99.0])) for _ in range(400)]
    df = spark.createDataFrame(rows, "s string, x double")
    s, x = bi.BinnedColumn("s", ("a", "b", "q"), False), bi.BinnedColumn("x", ("2.0 - 50.0", "0.0 - 2.0"))
    counts = Counter((a, "2.0 - 50.0" if b >= 2 else "0.0 - 2.0") for a, b in rows if a in ("a", "b") and b is not None)
    cells = bi.mosaic(df, [(s, x)]).collect()
    assert len(cells) == 6
    for r in cells:
        bar = sum(n for (a, _), n in counts.items() if a == r.x)
        assert r.n == counts[(r.x, r.y)]
        assert r.x_share == pytest.approx(bar / sum(counts.values()))
        assert r.y_share == pytest.approx(counts[(r.x, r.y)] / bar if bar else 0.0)


def test_eligible_columns(spark):
    rows = [(0, "a", NUMBER, 900), (1, "b", CATEGORY, 19), (2, "c", CATEGORY, 20), (3, "d", TEXT, 2), (4, "e", "Date", 2)]
    summary = spark.createDataFrame(rows, "position int, column string, datatype string, distinct long")
    assert sorted(r["column"] for r in bi.eligible_columns(summary).collect()) == ["a", "b"]


def test_partial_top_k_comes_before_the_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    from colscope.operators.catalog import latest_per_key
    plan = latest_per_key(df, ["c_nationkey"], [F.desc("c_acctbal")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_text_declared_as_numbers(spark):
    """``NA`` is 0 in bars, left out of metrics, and nothing raises."""
    from colscope.operators.bivariate import correlations
    from colscope.operators.univariate import bucket_counts, bucket_edges, summarize
    from colscope.specs import NUMBER, ColumnSpec

    df = spark.createDataFrame([(str(i), float(i)) for i in range(1, 41)] + [("NA", 1.0), ("\t7 ", 7.0), (None, 2.0), ("x", 3.0)],
                               "a string, b double")
    for exact in (True, False):
        row = summarize(df, [ColumnSpec("a", NUMBER)], exact).first()
        assert (row["rows"], row["missing"], row["min"], row["max"]) == (44, 1, 1.0, 40.0)
    assert bucket_edges(df, ["a"]).first()["edges"][0] == 0.0
    assert sum(r.n for r in bucket_counts(df, {"a": [0.0, 20.0, 40.0]}).collect()) == 42
    found = correlations(df, [("a", "b"), ("b", "b")]).orderBy("c1").collect()
    assert found[0].n == 41 and found[0].correlation == pytest.approx(1.0) and found[1].n == 44


def test_pairs_of_many_columns_and_of_none(spark):
    import numpy as np

    from colscope.operators.bivariate import correlations

    values = np.random.default_rng(1).normal(1e6, 3, (500, 12)).round(3)
    values[:, 1] = 5.0
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in values], ", ".join(f"{c} double" for c in names)).repartition(5)
    pairs = [(a, b) for a in names for b in names]
    found = {(r.c1, r.c2): r for r in correlations(df, pairs).collect()}
    with np.errstate(all="ignore"):
        expected = np.corrcoef(values.T)
    for (a, b), r in found.items():
        i, j = names.index(a), names.index(b)
        if 1 in (i, j):
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(expected[i, j], abs=1e-9)
    assert [r.n for r in correlations(df.limit(0), [("c0", "c1")]).collect()] == [0]


def test_new_columns_are_typed_before_they_are_profiled(spark):
    from colscope.plans.profile import profile, reprofile
    from colscope.specs import AUTO_DETECT, NUMBER, ColumnSpec

    df = spark.range(60).select(F.col("id").cast("double").alias("x"))
    before = profile(df, [ColumnSpec("x", NUMBER)], edges={"x": [0.0, 10.0, 60.0]})
    assert [r.n for r in before.histograms.orderBy("bin").collect()] == [10, 50]
    after = reprofile(before, [ColumnSpec("x", NUMBER), ColumnSpec("y", AUTO_DETECT, status="new", formula="x * 2")])
    assert {s.name: s.datatype for s in after.specs} == {"x": NUMBER, "y": NUMBER}
    assert after.summary.filter("column = 'y'").first()["mean"] == 59.0
    assert after.correlations.filter("c1 = 'x' and c2 = 'y'").count() == 1


def test_quantiles_of_many_keys(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 300).alias("k"), F.sin("id").alias("x"))
    few = sorted(map(tuple, qu.exact_quantiles(df, ["k"], "x", [0.5, 0.9]).collect()))
    monkeypatch.setattr(qu, "_FEW_KEYS", 10)
    assert sorted(map(tuple, qu.exact_quantiles(df, ["k"], "x", [0.5, 0.9]).collect())) == few and len(few) == 600


def test_pages_refuse_null_keys(spark):
    from colscope.operators.catalog import deep_page, page

    df = spark.range(25).select(F.col("id").alias("k"))
    for n in range(1, 7):
        assert deep_page(df, "k", n, 5).collect() == page(df, ["k"], n, 5).collect()
    with pytest.raises(ValueError, match="null"):
        deep_page(df.select(F.nullif(F.col("k"), F.lit(3)).alias("k")), "k", 1, 5)


def test_names_with_dots(spark):
    from colscope.operators.clean import cast_columns
    from colscope.operators.infer import infer_types

    df = spark.createDataFrame([(1, "5", "u"), (2, "7", "v")], "`a.b` int, `c``d` string, e string")
    specs = [ColumnSpec("a.b", NUMBER), ColumnSpec("c`d", NUMBER), ColumnSpec("e", TEXT)]
    for exact in (True, False):
        found = {r["column"]: (r["distinct"], r["max"]) for r in uni.summarize(df, specs, exact).collect()}
        assert found == {"a.b": (2, 2.0), "c`d": (2, 7.0), "e": (2, None)}
    assert {r["column"]: r["datatype"] for r in infer_types(df).collect()} == {"a.b": "Number", "c`d": "Number", "e": "Category"}
    assert cast_columns(df, specs).dtypes == [("a.b", "int"), ("c`d", "int"), ("e", "string")]
