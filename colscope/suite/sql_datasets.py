"""SQL over registered datasets, one query per kind of operator it reaches."""

from pyspark.sql import functions as F

from ..operators.clean import as_preview
from ..operators.ranges import range_join
from ..sources import register_views
from .registry import query, table

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

# The same text runs on both sides.
SHARED = {
    "sql_join_revenue": """
        SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name""",
    "sql_left_join": """
        SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
        GROUP BY c_custkey""",
    "sql_right_join": """
        SELECT n_name, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey
        GROUP BY n_name""",
    "sql_full_join": """
        SELECT coalesce(c_nationkey, s_nationkey) AS nation, customers, suppliers
        FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal < 0 GROUP BY 1) c
        FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey""",
    "sql_semi_join": """
        SELECT c_custkey, c_name FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "sql_anti_join": """
        SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (
            SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "sql_group_by": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount,
               count(*) AS n
        FROM lineitem WHERE l_shipdate <= timestamp '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_distinct": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "sql_count_distinct": """
        SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses
        FROM orders GROUP BY o_orderpriority""",
    "sql_having": """
        SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(*) > 12""",
    "sql_rollup": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_cube": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "sql_grouping_sets": """
        SELECT o_orderstatus, o_orderpriority, cast(grouping(o_orderstatus) AS int) AS all_status, count(*) AS n
        FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
    "sql_window_ranking": """
        SELECT o_custkey, o_orderkey, place FROM (
            SELECT o_custkey, o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS int) AS place
            FROM orders) ranked WHERE place <= 3""",
    # Frames run over daily totals, so no window holds more rows than there are days.
    "sql_window_frames": """
        SELECT o_orderpriority, cast(day AS string) AS day, round(sum(total) OVER w, 2) AS last_3_days, round(sum(total) OVER r, 2) AS so_far,
               n - lag(n) OVER (PARTITION BY o_orderpriority ORDER BY day) AS change
        FROM (SELECT o_orderpriority, cast(o_orderdate AS date) AS day, sum(o_totalprice) AS total, count(*) AS n
              FROM orders GROUP BY o_orderpriority, cast(o_orderdate AS date)) daily
        WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
               r AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "sql_union": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_union_all": """
        SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer
        UNION ALL SELECT s_nationkey FROM supplier) both_kinds GROUP BY nation""",
    "sql_intersect": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500",
    "sql_scalar_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "sql_correlated_subquery": """
        SELECT o_orderkey FROM orders o
        WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
    "sql_order_and_limit": """
        SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5""",
    "sql_tree_node_aggregates": """
        SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem
        WHERE 1 = 1 AND l_quantity <= 25.5 AND l_discount > 0.03 GROUP BY 1""",
}


def _run(text: str):
    def run(spark, folder):
        register_views({name: table(spark, folder, name) for name in _TABLES})
        return spark.sql(text)
    return run


for _name, _text in SHARED.items():
    query(_name, _text)(_run(_text))


@query("sql_dataset_from_tables", """
    SELECT r_name, n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def sql_dataset_from_tables(spark, folder):
    """A dataset made by a query over several registered tables."""
    register_views({f"src_{n}": table(spark, folder, n) for n in ("customer", "nation", "region")})
    return spark.sql("""
        SELECT r_name, n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS balance
        FROM src_customer JOIN src_nation ON c_nationkey = n_nationkey JOIN src_region ON n_regionkey = r_regionkey
        GROUP BY r_name, n_name""")


@query("sql_range_join", """
    SELECT b.name, count(*) AS parts, round(avg(p_retailprice), 4) AS mean_price
    FROM part JOIN (SELECT p_brand AS name, min(p_retailprice) + 5 AS lo, max(p_retailprice) - 5 AS hi
                    FROM part GROUP BY p_brand) b ON p_retailprice >= b.lo AND p_retailprice < b.hi
    GROUP BY b.name""")
def sql_range_join(spark, folder):
    """A range join as an equi-join on price steps, which hashes where the plain form compares all rows.

    Steps are a sixteenth of the widest band, so a band meets few of them, and parts are added up per price first, so
    the join's rows are prices and bands.
    """
    register_views({"part": table(spark, folder, "part")})
    return spark.sql("""
        WITH bands AS (SELECT p_brand AS name, min(p_retailprice) + 5 AS lo, max(p_retailprice) - 5 AS hi
                       FROM part GROUP BY p_brand),
             width AS (SELECT greatest(max(hi - lo) / 16, 1e-9) AS step FROM bands),
             steps AS (SELECT name, lo, hi, explode(sequence(floor(lo / (SELECT step FROM width)), floor(hi / (SELECT step FROM width)))) AS place
                       FROM bands WHERE lo < hi),
             priced AS (SELECT p_retailprice, count(*) AS n, floor(p_retailprice / (SELECT step FROM width)) AS place
                        FROM part GROUP BY p_retailprice)
        SELECT name, sum(n) AS parts, round(sum(p_retailprice * n) / sum(n), 4) AS mean_price
        FROM priced JOIN steps ON priced.place = steps.place AND p_retailprice >= lo AND p_retailprice < hi
        GROUP BY name""")


# The 20-row preview is the feature.
@query("sql_prepared_preview", """
    SELECT cast(o_orderkey AS varchar) AS _c0, coalesce(c_name, 'NA') AS _c1,
           coalesce(cast(nullif(o_orderstatus, 'F') AS varchar), 'NA') AS _c2
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 20""")
def sql_prepared_preview(spark, folder):
    register_views({f"prepared_{n}": table(spark, folder, n) for n in ("orders", "customer")})
    rows = spark.sql("""
        SELECT o_orderkey, c_name, nullif(o_orderstatus, 'F') AS status
        FROM prepared_orders LEFT JOIN prepared_customer ON o_custkey = c_custkey""")
    return as_preview(rows.orderBy("o_orderkey").limit(20), "NA")


@query("sql_rows_as_maps", """
    SELECT event_type, 'n' AS key, cast(count(*) AS varchar) AS value FROM events GROUP BY 1
    UNION ALL SELECT event_type, 'users', cast(count(DISTINCT user_id) AS varchar) FROM events GROUP BY 1""")
def sql_rows_as_maps(spark, folder):
    """Ad-hoc query over one dataset, each row as a map of column name to text."""
    register_views({"adhoc": table(spark, folder, "events")})
    rows = spark.sql("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM adhoc GROUP BY event_type")
    as_map = F.create_map(*[e for c in ("n", "users") for e in (F.lit(c), F.col(c).cast("string"))])
    return rows.select("event_type", F.explode(as_map))


# A third of the points have one value, the others crowd near zero; bands lie side by side, and two reach far.
_POINTS = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 100.0 ELSE o_totalprice / 1000.0 * o_totalprice / 1000.0 END AS x
    FROM orders"""
_BANDS = """SELECT c_custkey AS band, c_custkey * 3.0 AS lo, c_custkey * 3.0 + CASE WHEN c_custkey % 97 = 0 THEN 900.0 ELSE 2.5 END AS hi
    FROM customer"""


@query("range_join_skewed_points", f"""
    SELECT band, count(*) AS points, sum(o_orderkey)::BIGINT AS keys
    FROM ({_POINTS}) JOIN ({_BANDS}) ON x >= lo AND x < hi GROUP BY band""")
def range_join_skewed_points(spark, folder):
    """Points and the bands that hold them, over a grid by the points' own quantiles."""
    register_views({n: table(spark, folder, n) for n in ("orders", "customer")})
    points, bands = (spark.sql(q.replace(".0", ".0D").replace("2.5", "2.5D")) for q in (_POINTS, _BANDS))
    pairs = range_join(points, bands, "x", "lo", "hi", closed=False)
    return pairs.groupBy("band").agg(F.count(F.lit(1)).alias("points"), F.sum("o_orderkey").alias("keys"))
