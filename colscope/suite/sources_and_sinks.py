"""Scans, writes and schema listings."""

from pyspark.sql import functions as F

from .. import sinks
from ..session import shared_folder
from ..sources import external_table, list_columns, read_csv, read_parquet, read_parquet_na, register_views, schema_of, typed_view
from ..specs import CATEGORY, NUMBER, ColumnSpec
from .registry import query, table

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("scan_parquet", "SELECT * FROM orders")
def scan_parquet(spark, folder):
    return read_parquet(spark, f"{folder}/orders.parquet")


@query("scan_parquet_marker_as_null", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, nullif(o_orderstatus, '5-LOW') AS o_orderstatus FROM orders")
def scan_parquet_marker_as_null(spark, folder):
    df = read_parquet_na(spark, f"{folder}/orders.parquet", marker="5-LOW")
    return df.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("round_trip_parquet", _ORDERS)
def round_trip_parquet(spark, folder):
    path = shared_folder(spark, "orders")
    sinks.write_parquet(_orders(spark, folder), path, partition_by=["o_orderstatus"])
    return read_parquet(spark, path)


# Inference finds 32-bit integers in the text.
@query("round_trip_csv", "SELECT cast(o_orderkey AS int) AS o_orderkey, cast(o_custkey AS int) AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def round_trip_csv(spark, folder):
    path = shared_folder(spark, "orders")
    sinks.write_csv(_orders(spark, folder), path)
    return read_csv(spark, path)


@query("round_trip_csv_with_schema", _ORDERS)
def round_trip_csv_with_schema(spark, folder):
    path = shared_folder(spark, "orders")
    df = _orders(spark, folder)
    sinks.export_csv(df, path)
    return read_csv(spark, path, schema=df.schema)


@query("export_single_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def export_single_csv(spark, folder):
    path = shared_folder(spark, "nations")
    sinks.export_csv(table(spark, folder, "nation"), path, files=1)
    return read_csv(spark, path)


@query("round_trip_json", "SELECT p_partkey, p_name, p_retailprice FROM part")
def round_trip_json(spark, folder):
    path = shared_folder(spark, "parts")
    df = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    sinks.write_json(df, path)
    return spark.read.schema(df.schema).json(path)


@query("result_documents", """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS document FROM nation""")
def result_documents(spark, folder):
    return sinks.as_documents(table(spark, folder, "nation"), ["n_nationkey"])


@query("views_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def views_join(spark, folder):
    register_views({f"v_{n}": table(spark, folder, n) for n in ("nation", "region")})
    return spark.sql("SELECT n_name, r_name FROM v_nation JOIN v_region ON n_regionkey = r_regionkey")


_TABLE = [ColumnSpec("o_orderkey", NUMBER), ColumnSpec("o_orderstatus", CATEGORY), ColumnSpec("o_totalprice", NUMBER)]


@query("external_table", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def external_orders(spark, folder):
    path = shared_folder(spark, "external")
    sinks.write_parquet(typed_view(table(spark, folder, "orders"), _TABLE), path)
    rows = external_table(spark, "colscope_orders", path, _TABLE)
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("typed_projection", "SELECT cast(o_orderkey AS double) AS o_orderkey, o_orderstatus, o_totalprice FROM orders")
def typed_projection(spark, folder):
    return typed_view(table(spark, folder, "orders"), _TABLE)


@query("schema_listing", """
    SELECT column_name, cast(ordinal_position - 1 AS integer) AS position,
           CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'Number' WHEN data_type LIKE 'TIMESTAMP%' THEN 'Date'
                ELSE 'Category' END AS datatype,
           CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'YYYY-MM-DD HH:MM:SS' ELSE '' END AS format
    FROM (SELECT column_name, row_number() OVER () AS ordinal_position, column_type AS data_type FROM (DESCRIBE lineitem))""")
def schema_listing(spark, folder):
    return schema_of(table(spark, folder, "lineitem")).select("column_name", "position", "datatype", "format")


@query("catalog_columns")
def catalog_columns(spark, folder):
    register_views({f"v_{n}": table(spark, folder, n) for n in ("nation", "region", "orders")})
    return list_columns(spark, ["v_nation", "v_region", "v_orders"])
