"""Summaries that add up equal those of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.operators import additive as ad
from colscope.operators import univariate as uni
from colscope.specs import CATEGORY, DATE, NUMBER, ColumnSpec

SPECS = [ColumnSpec("a.x", NUMBER, 0), ColumnSpec("t", CATEGORY, 1), ColumnSpec("d", DATE, 2), ColumnSpec("n", NUMBER, 3)]


@pytest.fixture(scope="module")
def rows(spark):
    x = F.when(F.col("id") % 11 != 0, 1e6 + F.sin("id") * F.col("id"))
    return spark.range(0, 6000, 1, 4).select(
        "id", x.alias("a.x"), F.concat(F.lit("v"), F.col("id") % 700).alias("t"), F.lit(None).cast("date").alias("d"),
        F.when(F.col("id") % 5 == 0, "text").otherwise((F.col("id") % 9).cast("string")).alias("n")).cache()


def plain(df):
    return {r["column"]: r.asDict() for r in ad.finished(df).collect()}


def test_parts_add_up_to_the_whole(rows):
    whole = plain(ad.partial_summary(rows.drop("id"), SPECS))
    parts = [ad.partial_summary(rows.filter(c).drop("id"), SPECS) for c in ("id < 10", "id >= 10 and id < 4000", "id >= 4000", "id < 0")]
    found = plain(ad.merged(parts))
    exact = {r["column"]: r.asDict() for r in uni.summarize(rows.drop("id"), SPECS).collect()}
    assert list(sorted(found)) == ["a.x", "d", "n", "t"]
    for c, row in found.items():
        for k in ("position", "datatype", "rows", "missing", "min", "max"):
            assert row[k] == whole[c][k] == exact[c][k], (c, k)
        for k in ("mean", "stddev"):
            assert row[k] == pytest.approx(exact[c][k], rel=1e-9) if exact[c][k] is not None else row[k] is None
        assert abs(row["distinct"] - exact[c]["distinct"]) <= 0.04 * exact[c]["distinct"] + 1
    values = np.array([r["a.x"] for r in rows.collect() if r["a.x"] is not None])
    assert abs((values <= found["a.x"]["median"]).mean() - 0.5) < 0.02
    assert found["d"]["median"] is None and found["d"]["missing"] == 6000 and found["d"]["distinct"] == 1


def test_stored_profile_grows_by_new_rows(spark, rows, tmp_path):
    path = str(tmp_path / "p")
    for low in range(0, 6000, 2000):
        ad.add_rows(spark, path, rows.filter(F.col("id").between(low, low + 1999)).drop("id"), SPECS)
    some = ad.add_rows(spark, path, rows.limit(5).drop("id"), SPECS[1:2])  # one column alone
    found = plain(some)
    assert found["t"]["rows"] == 6005 and found["a.x"]["rows"] == 6000
    assert found["a.x"]["max"] == rows.agg(F.max("`a.x`")).first()[0]
    assert plain(ad.add_rows(spark, path, rows.limit(0).drop("id"), SPECS)) == found
