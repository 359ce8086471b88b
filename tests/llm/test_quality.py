import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.llm.quality import Quality, Shapes, descend, grams, quality, ratios

SMALL = "/root/testdata/sf0.1"


def test_held_out_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality(docs.repartition(8), labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(bad) > 100 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == 1 for r in good]) >= 0.99 and np.mean([r.predicted == 0 for r in bad]) >= 0.97


def test_scores_do_not_depend_on_partitions_or_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    first = {r.doc_id: r.score for r in quality(docs, labels).collect()}
    kept = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    turned = labels.withColumn("quality", F.when(kept, F.col("quality")).otherwise(1 - F.col("quality")))
    assert first == {r.doc_id: r.score for r in quality(docs.repartition(5), turned.repartition(3)).collect()}


def sets_of(texts, rule):
    shapes = Shapes()
    return [grams(t, rule, shapes) for t in texts]


def test_ratios_equal_counts():
    rule = Quality(bits=10)
    texts, good = ["a b c", "a b d", "x!! y!!", "x!! a", ""], np.array([True, True, False, False, True])
    sets = sets_of(texts, rule)
    found = ratios(sets, good, rule)
    for f in range(1 << 10):
        n1, n0 = (sum(f in s for s, y in zip(sets, good) if y == k) for k in (True, False))
        assert found[f] == pytest.approx(np.log((n1 + 1) / (3 + 2) / ((n0 + 1) / (2 + 2))), abs=1e-6)


def test_descent_ends_where_the_dual_meets_the_primal():
    random, rule = np.random.default_rng(1), Quality(bits=6, epochs=400, cost=0.3)
    sets = [np.sort(random.choice(64, random.integers(1, 20), replace=False)) for _ in range(120)]
    values = [random.normal(size=len(s)) for s in sets]
    good = random.random(120) < 0.3
    weights = descend(sets, values, good, rule)
    cost = rule.cost * 60 / np.where(good, good.sum(), (~good).sum())
    dense = np.zeros((120, 65))
    for i, (s, v) in enumerate(zip(sets, values)):
        dense[i, s], dense[i, 64] = v, 1
    sign = np.where(good, 1, -1)

    def primal(w):
        return w @ w / 2 + cost @ np.maximum(0, 1 - sign * (dense @ w))

    best = primal(weights)
    assert all(primal(weights + random.normal(size=65) * scale) >= best - 1e-3 for scale in (0.3, 0.1, 0.01) for _ in range(200))
    loose = weights + 0.0
    for step in range(3000):  # subgradients do no better, but for the step at which the descent stops
        slope = loose - (sign * cost * (sign * (dense @ loose) < 1)) @ dense
        loose -= 0.02 / (1 + step / 50) * slope
        assert primal(loose) >= 0.998 * best


def test_shapes_are_shared_by_texts_that_share_no_words():
    rule = Quality(word_grams=0)
    a, b = sets_of(["Äß!! OPQ!! RST!! rr rr", "ÉÇ!! XYZ!! WWW!! qq qq"], rule)
    assert a.tolist() == b.tolist()
    assert grams("w w w", rule, Shapes()).tolist() != grams("w v w", rule, Shapes()).tolist()
    # Separators of other scripts and words of continuation bytes alone change nothing about the number of words.
    assert len(grams("  ﻿ a", Quality(), Shapes())) > 0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(4, 1, 0), (4, 0, 0), (5, 1, None), (6, 0, 1), (7, 0, 1), (8, 0, 1), (None, 1, 1), (3, None, 1), (99, 1, 1)],
        "doc_id long, quality int, lang int")
    rows = quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in rows if r.doc_id == 4}) == 1
    assert next(r.held_out for r in rows if r.doc_id is None) is True  # the checksum of empty text is 0
    assert quality(no_docs, labels).count() == 0
    assert {r.score for r in quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in quality(odd_docs, labels.filter("quality = 0")).collect()} == {0}
