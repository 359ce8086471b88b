"""Renaming, cleaning, re-typing and updating columns."""

from pyspark.sql import functions as F

from ..operators import clean as cl
from ..specs import CATEGORY, DATE, NUMBER, PERCENTAGE, TEXT, ColumnSpec
from .registry import query, r6, table

# Orders with text in place of numbers: markers, blanks, stray letters, missing values.
DIRTY_SQL = """
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 7 = 0 THEN 'NA' WHEN o_orderkey % 11 = 0 THEN NULL
                WHEN o_orderkey % 13 = 0 THEN '12a' WHEN o_orderkey % 17 = 0 THEN ''
                WHEN o_orderkey % 19 = 0 THEN '1.5e3'
                ELSE ' ' || cast(o_totalprice AS varchar) || ' ' END AS price,
           CASE WHEN o_orderkey % 5 = 0 THEN '+' || cast(o_custkey AS varchar)
                WHEN o_orderkey % 6 = 0 THEN '-' || cast(o_custkey AS varchar)
                ELSE cast(o_custkey AS varchar) END AS customer,
           CASE WHEN o_orderkey % 9 = 0 THEN 'NA' WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS priority
    FROM orders"""


def dirty_orders(spark, folder):
    k, price, cust = F.col("o_orderkey"), F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(k % 7 == 0, "NA").when(k % 11 == 0, None).when(k % 13 == 0, "12a").when(k % 17 == 0, "")
        .when(k % 19 == 0, "1.5e3").otherwise(F.concat(F.lit(" "), price, F.lit(" "))).alias("price"),
        F.when(k % 5 == 0, F.concat(F.lit("+"), cust)).when(k % 6 == 0, F.concat(F.lit("-"), cust))
        .otherwise(cust).alias("customer"),
        F.when(k % 9 == 0, "NA").when(k % 10 == 0, None).otherwise(F.col("o_orderpriority")).alias("priority"))


@query("rename_by_position", "SELECT n_nationkey AS key, n_name AS label, n_regionkey AS region FROM nation")
def rename_by_position(spark, folder):
    return cl.rename_columns(table(spark, folder, "nation"), ["key", "label", "region"])


@query("keep_visible_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def keep_visible_columns(spark, folder):
    df = table(spark, folder, "customer")
    hidden = {"c_name", "c_nationkey", "c_acctbal"}
    return cl.kept_columns(df, [ColumnSpec(c, ignored=c in hidden) for c in df.columns])


@query("clean_numbers", f"""
    WITH dirty AS ({DIRTY_SQL})
    SELECT o_orderkey,
           cast(CASE WHEN regexp_full_match(trim(price), '[-+]?[0-9]+([.][0-9]+)?') THEN trim(price) END AS double) AS price,
           cast(CASE WHEN regexp_full_match(trim(customer), '[-+]?[0-9]+([.][0-9]+)?') THEN trim(customer) END AS integer) AS customer
    FROM dirty""")
def clean_numbers(spark, folder):
    specs = [ColumnSpec("o_orderkey", NUMBER), ColumnSpec("price", NUMBER), ColumnSpec("customer", NUMBER)]
    return cl.cast_columns(dirty_orders(spark, folder), specs)


@query("clean_text", f"""
    WITH dirty AS ({DIRTY_SQL}) SELECT o_orderkey, coalesce(priority, '_MISSING_') AS priority FROM dirty""")
def clean_text(spark, folder):
    return cl.cast_columns(dirty_orders(spark, folder), [ColumnSpec("o_orderkey", NUMBER), ColumnSpec("priority", CATEGORY)])


@query("clean_dataset", f"""
    WITH dirty AS ({DIRTY_SQL})
    SELECT o_orderkey AS id,
           cast(CASE WHEN regexp_full_match(trim(price), '[-+]?[0-9]+([.][0-9]+)?') THEN trim(price) END AS double) AS amount,
           coalesce(priority, '_MISSING_') AS urgency
    FROM dirty""")
def clean_dataset(spark, folder):
    return cl.clean(dirty_orders(spark, folder), [
        ColumnSpec("id", NUMBER), ColumnSpec("amount", NUMBER), ColumnSpec("customer", NUMBER, ignored=True),
        ColumnSpec("urgency", CATEGORY)])


@query("retype_after_update", f"""
    WITH dirty AS ({DIRTY_SQL})
    SELECT o_orderkey, try_cast(trim(price) AS double) AS price, cast(customer AS double) AS customer,
           coalesce(priority, '_MISSING_') AS priority
    FROM dirty""")
def retype_after_update(spark, folder):
    df = dirty_orders(spark, folder)
    return df.select("o_orderkey", cl.retyped(F.col("price"), ColumnSpec("price", NUMBER)).alias("price"),
                     cl.retyped(F.col("customer"), ColumnSpec("customer", PERCENTAGE)).alias("customer"),
                     cl.retyped(F.col("priority"), ColumnSpec("priority", TEXT)).alias("priority"))


@query("update_columns", """
    SELECT coalesce(o_orderstatus, '_MISSING_') AS status, cast(o_orderkey AS double) AS id,
           round(cast(o_totalprice / 1000 AS double), 6) AS thousands,
           cast(o_custkey + 1 AS double) AS o_custkey, o_orderstatus || '/' || o_orderpriority AS tag
    FROM orders""")
def update_columns(spark, folder):
    specs = [
        ColumnSpec("o_orderstatus", CATEGORY, new_name="status"),
        ColumnSpec("o_orderkey", NUMBER, new_name="id", status="modified"),
        ColumnSpec("o_totalprice", status="deleted"),
        ColumnSpec("thousands", NUMBER, status="new", formula="o_totalprice / 1000"),
        ColumnSpec("o_custkey", NUMBER, status="modified", calculated=True, formula=F.col("o_custkey") + 1),
        ColumnSpec("tag", TEXT, status="new", formula="concat(o_orderstatus, '/', o_orderpriority)"),
    ]
    updated = cl.update_columns(table(spark, folder, "orders"), specs)
    return updated.withColumn("thousands", r6("thousands"))


@query("dataset_size", "SELECT count(*) AS rows, 11 AS columns FROM lineitem")
def dataset_size(spark, folder):
    return cl.dataset_size(table(spark, folder, "lineitem"))


@query("complete_rows", """
    SELECT l_orderkey, nullif(l_quantity, 10) AS quantity, nullif(l_returnflag, 'N') AS flag FROM lineitem
    WHERE l_quantity <> 10 AND l_returnflag <> 'N'""")
def complete_rows(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", F.nullif(F.col("l_quantity"), F.lit(10.0)).alias("quantity"),
        F.nullif("l_returnflag", F.lit("N")).alias("flag"), "l_tax")
    return cl.complete_rows(df, ["l_orderkey", "quantity", "flag"])


@query("pairwise_present_rows", """
    SELECT count(*) AS n, count(l_tax) AS k FROM
    (SELECT nullif(l_quantity, 10) AS a, nullif(l_discount, 0.05) AS b, nullif(l_tax, 0.02) AS l_tax FROM lineitem)
    WHERE a IS NOT NULL AND b IS NOT NULL""")
def pairwise_present_rows(spark, folder):
    df = table(spark, folder, "lineitem").select(
        F.nullif(F.col("l_quantity"), F.lit(10.0)).alias("a"), F.nullif(F.col("l_discount"), F.lit(0.05)).alias("b"),
        F.nullif(F.col("l_tax"), F.lit(0.02)).alias("l_tax"))
    return cl.both_present(df, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("k"))


@query("preview_text", """
    SELECT cast(o_orderkey AS varchar) AS _c0, coalesce(cast(nullif(o_custkey, 5) AS varchar), 'NA') AS _c1,
           coalesce(nullif(o_orderstatus, 'F'), 'NA') AS _c2
    FROM orders""")
def preview_text(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif(F.col("o_custkey"), F.lit(5)), F.nullif("o_orderstatus", F.lit("F")))
    return cl.as_preview(df, "NA")


@query("date_columns_stay_text", """
    SELECT o_orderkey, coalesce(nullif(strftime(o_orderdate, '%Y-%m-%d'), '1997-05-28'), '_MISSING_') AS day FROM orders""")
def date_columns_stay_text(spark, folder):
    day = F.nullif(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1997-05-28"))
    df = table(spark, folder, "orders").select("o_orderkey", day.alias("day"))
    return cl.cast_columns(df, [ColumnSpec("o_orderkey", NUMBER), ColumnSpec("day", DATE, format="YYYY-MM-DD")])
