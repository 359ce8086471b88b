"""Scans, sinks, cleaning and catalog operators."""

import pytest
from pyspark.sql import functions as F

from colscope import sinks
from colscope.operators import catalog as cat
from colscope.operators import clean as cl
from colscope.session import shared_folder
from colscope.sources import jdbc_options, read_csv, schema_of
from colscope.specs import CATEGORY, NUMBER, TEXT, ColumnSpec


def test_jdbc_options():
    options = jdbc_options("jdbc:mysql://host/db", table="t", split_column="id", bounds=(1, 100), splits=4, user="u")
    assert options == {"url": "jdbc:mysql://host/db", "dbtable": "t", "user": "u", "partitionColumn": "id",
                       "lowerBound": "1", "upperBound": "100", "numPartitions": "4"}
    assert jdbc_options("u", query="SELECT 1") == {"url": "u", "query": "SELECT 1"}
    for bad in ({}, {"table": "t", "query": "q"}, {"table": "t", "split_column": "id"}):
        with pytest.raises(ValueError):
            jdbc_options("u", **bad)


def test_csv_with_empty_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("segment,kind,mob\n1,A,10\n2,,11\n3,B,\n")
    df = read_csv(spark, str(tmp_path))
    assert df.dtypes == [("segment", "int"), ("kind", "string"), ("mob", "int")]
    cleaned = cl.clean(df, [ColumnSpec("s", NUMBER), ColumnSpec("k", CATEGORY), ColumnSpec("m", NUMBER)])
    assert sorted(map(tuple, cleaned.collect())) == [(1, "A", 10), (2, "_MISSING_", 11), (3, "B", None)]


def test_single_file_export(spark, tmp_path):
    sinks.export_csv(spark.range(100).repartition(5), str(tmp_path / "out"), files=1)
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 1


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d: "")})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        shared_folder(Cluster, "x")
    Cluster.conf = type("C", (), {"get": staticmethod(lambda k, d: "s3a://bucket/tmp/")})
    assert shared_folder(Cluster, "x").startswith("s3a://bucket/tmp/x-")


def test_semantic_types(spark):
    df = spark.sql("SELECT 1 AS a, 1.5D AS b, 'x' AS c, current_date() AS d, current_timestamp() AS e, 1.5 AS f, true AS g")
    found = {r.column_name: (r.datatype, r.format) for r in schema_of(df).collect()}
    assert found == {"a": ("Number", ""), "b": ("Number", ""), "c": ("Category", ""), "d": ("Date", "YYYY-MM-DD"),
                     "e": ("Date", "YYYYMMDDHHMMSS"), "f": ("Number", ""), "g": ("Category", "")}


@pytest.mark.parametrize("values, dtype, expected", [
    ([" 1 ", "+2", "-3", "x", None, ""], "int", [1, 2, -3, None, None, None]),
    (["1", "2.5", "1e3", ".5", "5."], "double", [1.0, 2.5, None, None, None]),
    (["3000000000", "1"], "bigint", [3000000000, 1]),
    (["x", None], "int", [None, None]),
])
def test_clean_number_types(spark, values, dtype, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = cl.cast_columns(df, [ColumnSpec("i", NUMBER), ColumnSpec("v", NUMBER)])
    assert out.dtypes[1] == ("v", dtype) and [r.v for r in out.orderBy("i").collect()] == expected


def test_numeric_columns_keep_exponents(spark):
    out = cl.cast_columns(spark.sql("SELECT 1.0E10D AS v"), [ColumnSpec("v", NUMBER)])
    assert out.first().v == 1.0e10


def test_nothing_visible(spark):
    assert cl.clean(spark.range(3), [ColumnSpec("id", NUMBER, ignored=True)]).columns == []


def test_marker_stays_text_after_cleaning(spark):
    df = spark.createDataFrame([("NA",), (None,)], "v string")
    assert [r.v for r in cl.cast_columns(df, [ColumnSpec("v", TEXT)]).collect()] == ["NA", "_MISSING_"]


def test_formulas_see_deleted_and_original_names(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    specs = [ColumnSpec("a", status="deleted"), ColumnSpec("b", NUMBER, new_name="a"), ColumnSpec("p", NUMBER, status="new", formula="a * b")]
    assert cl.update_columns(df, specs).first().asDict() == {"a": 3.0, "p": 6.0}


def test_pages_cover_every_row_once(spark):
    df = spark.range(53)
    for pages in ([cat.page(df, ["id"], i, 10) for i in range(1, 7)], [cat.deep_page(df, "id", i, 10) for i in range(1, 7)]):
        assert [[r.id for r in p.collect()] for p in pages] == [list(range(i, min(i + 10, 53))) for i in range(0, 53, 10)]
    assert cat.deep_page(df, "id", 9, 10).count() == 0


def test_deep_page_of_a_large_table(spark):
    df = spark.range(150_000).select((F.col("id") * 3).alias("k")).repartition(8)
    assert [r.k for r in cat.deep_page(df, "k", 12_000, 10).collect()] == [3 * i for i in range(119_990, 120_000)]


def test_latest_and_taken(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, name string")
    assert sorted(r.id for r in cat.latest_per_key(df, ["name"], [F.desc("id")]).collect()) == [2, 3]
    assert sorted(r.id for r in cat.taken_names(df, df, "name", "id").collect()) == [1, 2]


def test_pair_upsert_ignores_order(spark):
    old = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "c1 string, c2 string, v int")
    new = spark.createDataFrame([("b", "a", 9)], "c1 string, c2 string, v int")
    assert sorted(map(tuple, cat.upsert_pairs(old, new).collect())) == [("a", "c", 2), ("b", "a", 9)]


def test_catalog_listings(spark):
    from colscope.sources.schema import list_databases, list_tables

    spark.range(1).createOrReplaceTempView("listed_view")
    assert "default" in [r.database for r in list_databases(spark).collect()]
    assert "listed_view" in [r.table_name for r in list_tables(spark).collect()]


def test_wide_whole_numbers_and_padding(spark):
    from colscope.operators.clean import cast_columns
    from colscope.specs import NUMBER, ColumnSpec

    df = spark.createDataFrame([("\t7 ", "99999999999999999999", "1" * 40), ("8\n", "-1", "2")], "a string, b string, c string")
    out = cast_columns(df, [ColumnSpec(c, NUMBER) for c in "abc"])
    assert [t for _, t in out.dtypes] == ["int", "decimal(38,0)", "double"]
    assert [r.a for r in out.collect()] == [7, 8] and int(out.first().b) == 99999999999999999999
