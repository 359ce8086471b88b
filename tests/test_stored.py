"""Stored summaries and rank indexes."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colscope.operators import stored


def files(path):
    return {p.parent.name: p.name for p in Path(path).glob("*=*/*.parquet")}


def test_upserts_rewrite_their_keys_only(spark, tmp_path):
    path = str(tmp_path / "s")
    first = spark.createDataFrame([("a", 1, 1.0), ("b/c", 2, None), ("007", 3, 3.0), ("a", 4, 4.0)], "name string, n int, x double")
    stored.store_keys(first, path, "name")
    before = files(path)
    stored.store_keys(spark.createDataFrame([("a", 9, 9.0), ("new", 5, 5.0)], first.schema), path, "name")
    after = files(path)
    assert len(before) == 3 and len(after) == 4
    assert {k for k in before if before[k] == after[k]} == {k for k in before if k != "name=a"}
    rows = {tuple(r) for r in stored.stored_keys(spark, path, "name", first.schema).collect()}
    assert rows == {("a", 9, 9.0), ("b/c", 2, None), ("007", 3, 3.0), ("new", 5, 5.0)}
    stored.drop_keys(spark, path, "name", first.schema, ["007", "never there"])
    assert {r.name for r in stored.stored_keys(spark, path, "name", first.schema).collect()} == {"a", "b/c", "new"}
    stored.store_keys(first.filter("name = '007'"), path, "name")
    assert stored.stored_keys(spark, path, "name", first.schema).filter("name = '007'").first().n == 3
    stored.store_keys(first.limit(0), path, "name")
    assert stored.stored_keys(spark, path, "name", first.schema).count() == 4


def test_a_failed_upsert_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    stored.store_keys(first, path, "name")
    broken = first.withColumn("n", F.when(F.col("name") == "b", F.raise_error(F.lit("lost"))).otherwise(F.lit(7)).cast("int"))
    for bad in (broken, spark.createDataFrame([(None, 1)], first.schema), spark.createDataFrame([("", 1)], first.schema)):
        with pytest.raises(Exception):
            stored.store_keys(bad, path, "name")
    assert {tuple(r) for r in stored.stored_keys(spark, path, "name", first.schema).collect()} == {("a", 1), ("b", 2)}


def test_pages_of_text_and_compound_keys_with_nulls_and_ties(spark, tmp_path):
    pick = random.Random(1)
    rows = [(pick.choice([None, "", "x", "hot", "hot", "hot", "\u00e9"]), pick.choice([None, 1.5, -2.0]), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "t string, x double, `i.d` long").repartition(5)
    path = str(tmp_path / "i")
    stored.write_rank_index(df, path, [F.asc_nulls_last("t"), F.desc("x")], 100)
    pages = [[tuple(r) for r in stored.ranked_page(spark, path, k, 130).collect()] for k in range(1, 10)]
    assert [len(p) for p in pages] == [130] * 7 + [90, 0]
    flat = [r for p in pages for r in p]
    assert sorted(flat, key=str) == sorted(rows, key=str)
    keys = [(r[0] is None, (r[0] or "").encode(), 1e9 if r[1] is None else -r[1]) for r in flat]
    assert keys == sorted(keys)
    assert stored.ranked_page(spark, path, 1, 5).columns == df.columns
    counts = [r.n for r in spark.read.parquet(path + "/counts").collect()]
    assert len(counts) > 6 and max(counts) < 300  # the tied rows lie in several parts


def test_a_deep_page_reads_one_part(spark, tmp_path):
    path = str(tmp_path / "i")
    stored.write_rank_index(spark.range(40_000).withColumn("s", F.sha2(F.col("id").cast("string"), 256)), path, ["s"], 2000)
    page = [r.s for r in stored.ranked_page(spark, path, 1000, 20).collect()]
    ordered = sorted(r.s for r in spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("s")).collect())
    assert page == ordered[19_980:20_000]
    # All parts but those of the page may be lost.
    counts = {r["__part"]: r.n for r in spark.read.parquet(path + "/counts").collect()}
    end, held = 0, set()
    for part in sorted(counts):
        if end < 20_000 and end + counts[part] > 19_980:
            held.add(f"__part={part}")
        end += counts[part]
    for folder in Path(path, "rows").glob("__part=*"):
        if folder.name not in held:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"")
    assert len(held) <= 2 < len(counts)
    spark.catalog.refreshByPath(path)
    schema = "id long, s string, __rank long, __part int"
    left = spark.read.schema(schema).parquet(path + "/rows").filter(F.col("__part").isin([int(h.split("=")[1]) for h in held]))
    assert left.count() == sum(counts[int(h.split("=")[1])] for h in held)


def test_small_parts_share_files_and_pages_cross_them(spark, tmp_path):
    path, rows = str(tmp_path / "i"), 5_000
    df = spark.range(rows).select((F.col("id") * 7919 % rows).alias("k"), F.lit("x").alias("s"))
    stored.write_rank_index(df.repartition(4), path, ["k"], 10, rows_per_file=1000)
    assert len(list(Path(path, "rows").rglob("*.parquet"))) == 5
    counts = [r.n for r in spark.read.parquet(path + "/counts").collect()]
    assert 500 <= len(counts) <= 505 and max(counts) == 10
    for number, size in ((1, 3), (4, 25), (2, 1700), (1, rows + 1), (3, rows)):
        page = [r.k for r in stored.ranked_page(spark, path, number, size).collect()]
        assert page == list(range(rows))[size * (number - 1):size * number]
    again = str(tmp_path / "same")  # equal rows lie in one file, and its last part takes what is over
    stored.write_rank_index(spark.range(300).select(F.lit(1).alias("k")).repartition(3), again, ["k"], 10, rows_per_file=20)
    assert sum(stored.ranked_page(spark, again, i, 70).count() for i in range(1, 6)) == 300
    read = spark.read.parquet(again + "/rows")
    assert read.select("__part", "__rank").distinct().count() == 300
