"""Whole-dataset profiles and model reports."""

from pyspark.sql import functions as F

from ..operators import trees as tr
from ..plans import model_report, profile, reprofile
from ..specs import CATEGORY, NUMBER, ColumnSpec
from .registry import query, r6, table

_SPECS = [
    ColumnSpec("id", NUMBER, ignored=True), ColumnSpec("customer", NUMBER, ignored=True), ColumnSpec("status", CATEGORY),
    ColumnSpec("price", NUMBER), ColumnSpec("day", "Date", ignored=True), ColumnSpec("priority", CATEGORY),
]


def _orders_profile(spark, folder):
    return profile(table(spark, folder, "orders"), _SPECS, exact=True)


def _category_bars(c: str, source: str) -> str:
    return f"SELECT '{c}' AS \"column\", {source} AS label, count(*) AS n FROM orders GROUP BY 2"


@query("profile_summary", " UNION ALL ".join([
    f"""SELECT 0 AS position, 'status' AS "column", count(DISTINCT o_orderstatus) AS distinct, 0::bigint AS missing, NULL::double AS mean, NULL::double AS median FROM orders""",
    f"""SELECT 1, 'price', count(DISTINCT o_totalprice), 0, round(avg(o_totalprice), 4), round(quantile_cont(o_totalprice, 0.5), 4) FROM orders""",
    f"""SELECT 2, 'priority', count(DISTINCT o_orderpriority), 0, NULL, NULL FROM orders"""]))
def profile_summary(spark, folder):
    summary = _orders_profile(spark, folder).summary
    return summary.select("position", "column", "distinct", "missing", F.round("mean", 4).alias("mean"),
                          F.round("median", 4).alias("median"))


@query("profile_category_bars", _category_bars("status", "o_orderstatus") + " UNION ALL " + _category_bars("priority", "o_orderpriority"))
def profile_category_bars(spark, folder):
    bars = _orders_profile(spark, folder).histograms
    return bars.filter(F.col("column") != "price").select("column", "label", "n")


@query("profile_contingency", """
    SELECT 'status' AS c1, 'priority' AS c2, x, y, coalesce(n, 0) AS n FROM
    (SELECT DISTINCT o_orderstatus AS x FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority AS y FROM orders)
    LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) ON x = o_orderstatus AND y = o_orderpriority""")
def profile_contingency(spark, folder):
    cells = _orders_profile(spark, folder).contingency
    return cells.filter("c1 = 'status' AND c2 = 'priority'").select("c1", "c2", "x", "y", "n")


@query("profile_after_update", """
    SELECT 0 AS position, 'price' AS "column", count(DISTINCT o_totalprice) AS distinct, round(avg(o_totalprice), 4) AS mean FROM orders
    UNION ALL SELECT 1, 'urgency', count(DISTINCT o_orderpriority), NULL FROM orders
    UNION ALL SELECT 2, 'thousands', count(DISTINCT o_totalprice / 1000), round(avg(o_totalprice / 1000), 4) FROM orders""")
def profile_after_update(spark, folder):
    """One column dropped, one renamed, one calculated; only the last two are profiled again."""
    before = _orders_profile(spark, folder)
    after = reprofile(before, [
        ColumnSpec("status", CATEGORY, status="deleted"), ColumnSpec("price", NUMBER),
        ColumnSpec("priority", CATEGORY, new_name="urgency"),
        ColumnSpec("thousands", NUMBER, status="new", formula="price / 1000")], exact=True)
    return after.summary.select("position", "column", "distinct", F.round("mean", 4).alias("mean"))


@query("model_report_metrics")
def model_report_metrics(spark, folder):
    settings = tr.TreeSettings(features=["l_quantity", "l_discount", "l_linestatus"], label="l_returnflag", max_depth=3)
    _, report = model_report(table(spark, folder, "lineitem"), settings)
    return report["train_labels"].select("label", "actual", r6("precision"), r6("recall"))


@query("model_report_nodes")
def model_report_nodes(spark, folder):
    settings = tr.TreeSettings(features=["l_quantity", "l_discount", "l_linestatus"], label="l_extendedprice", max_depth=3)
    _, report = model_report(table(spark, folder, "lineitem"), settings)
    return report["nodes"]
