"""Bivariate profiles."""

from pyspark.sql import functions as F

from ..functions.bins import bin_category, bin_number
from ..operators import bivariate as bi
from ..operators import univariate as uni
from ..specs import CATEGORY, NUMBER, TEXT, specs_of
from .profiles import HOLES_SQL, with_holes
from .registry import query, r6, table

_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs_sql(source: str, pairs) -> str:
    return f"WITH src AS ({source}) " + " UNION ALL ".join(
        f"""SELECT '{a}' AS c1, '{b}' AS c2, count(*) AS n, round(corr(cast({a} AS double), cast({b} AS double)), 6) AS correlation,
            round(covar_samp(cast({a} AS double), cast({b} AS double)), 2) AS covariance
            FROM src WHERE {a} IS NOT NULL AND {b} IS NOT NULL""" for a, b in pairs)


def _rounded(df):
    return df.withColumns({"correlation": r6(F.col("correlation")), "covariance": F.round("covariance", 2)})


@query("correlation_and_covariance", _pairs_sql(HOLES_SQL, bi.all_pairs(_NUMBERS)))
def correlation_and_covariance(spark, folder):
    return _rounded(bi.correlations(with_holes(spark, folder), bi.all_pairs(_NUMBERS)))


@query("correlation_few_pairs", _pairs_sql("SELECT * FROM orders", [("o_custkey", "o_totalprice"), ("o_orderkey", "o_totalprice")]))
def correlation_few_pairs(spark, folder):
    return _rounded(bi.correlations(table(spark, folder, "orders"),
                                    [("o_custkey", "o_totalprice"), ("o_orderkey", "o_totalprice")]))


_MATRIX = ["l_quantity", "l_extendedprice", "l_discount"]


@query("correlation_matrix", "WITH src AS (" + HOLES_SQL + ") " + " UNION ALL ".join(
    f"SELECT '{a}' AS \"column\", " + ", ".join(
        f"1.0::double AS {b}" if a == b else f"(SELECT round(corr({a}, {b}), 6) FROM src) AS {b}" if {a, b} != {"l_quantity", "l_discount"}
        else f"0.0::double AS {b}" for b in _MATRIX) for a in _MATRIX))
def correlation_matrix(spark, folder):
    # One pair is left out on purpose: the matrix shows 0 for it.
    long = bi.correlations(with_holes(spark, folder), [("l_extendedprice", "l_quantity"), ("l_extendedprice", "l_discount")])
    matrix = bi.correlation_matrix(long, _MATRIX)
    return matrix.select("column", *[r6(c) for c in _MATRIX])


@query("bin_number_column", """
    SELECT l_orderkey, l_linenumber, CASE WHEN q IS NULL THEN NULL WHEN q < 20 THEN '5.0 - 20.0' WHEN q < 35 THEN '20.0 - 35.0'
           ELSE '35.0 - 45.0' END AS bin
    FROM (SELECT *, nullif(l_quantity, 10) AS q FROM lineitem)""")
def bin_number_column(spark, folder):
    labels = ["5.0 - 20.0", "20.0 - 35.0", "35.0 - 45.0"]
    index = bin_number(F.nullif(F.col("l_quantity"), F.lit(10.0)), labels)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.get(F.array(*map(F.lit, labels)), index).alias("bin"))


@query("bin_category_column", """
    SELECT o_orderkey, CASE WHEN p IS NULL THEN NULL WHEN p IN ('1-URGENT', '2-HIGH') THEN p ELSE 'Others' END AS bin
    FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders)""")
def bin_category_column(spark, folder):
    priority = F.nullif("o_orderpriority", F.lit("5-LOW"))
    return table(spark, folder, "orders").select("o_orderkey", bin_category(priority, ["1-URGENT", "2-HIGH"]).alias("bin"))


_FLAG = bi.BinnedColumn("l_returnflag", ("A", "R", "X", "Others"), numeric=False)
_STATUS = bi.BinnedColumn("l_linestatus", ("F", "O"), numeric=False)
_QUANTITY = bi.BinnedColumn("l_quantity", ("30.0 - 40.0", "1.0 - 15.0", "15.0 - 30.0", "40.0 - 50.0", "90.0 - 99.0"))


def _binned_sql(c: str) -> str:
    return {
        "l_returnflag": "CASE WHEN l_returnflag IN ('A', 'R', 'X') THEN l_returnflag WHEN l_returnflag IS NOT NULL THEN 'Others' END",
        "l_linestatus": "CASE WHEN l_linestatus IN ('F', 'O') THEN l_linestatus WHEN l_linestatus IS NOT NULL THEN 'Others' END",
        "l_quantity": "CASE WHEN l_quantity < 15 THEN '1.0 - 15.0' WHEN l_quantity < 30 THEN '15.0 - 30.0' "
                      "WHEN l_quantity < 40 THEN '30.0 - 40.0' WHEN l_quantity < 90 THEN '40.0 - 50.0' "
                      "WHEN l_quantity >= 90 THEN '90.0 - 99.0' END",
    }[c]


def _mosaic_sql(a: bi.BinnedColumn, b: bi.BinnedColumn) -> str:
    xs, ys = (", ".join(f"('{s}')" for s in c.labels) for c in (a, b))
    return f"""SELECT '{a.name}' AS c1, '{b.name}' AS c2, x, y, n,
            coalesce(round(sum(n) OVER (PARTITION BY x) / nullif(sum(n) OVER (), 0), 6), 0) AS x_share,
            coalesce(round(n / nullif(sum(n) OVER (PARTITION BY x), 0), 6), 0) AS y_share
        FROM (SELECT x, y, count(k) AS n FROM (VALUES {xs}) AS xs(x) CROSS JOIN (VALUES {ys}) AS ys(y)
              LEFT JOIN (SELECT 1 AS k, {_binned_sql(a.name)} AS bx, {_binned_sql(b.name)} AS by_ FROM src) ON bx = x AND by_ = y
              GROUP BY 1, 2)"""


@query("contingency_tables", f"WITH src AS ({HOLES_SQL}) " + " UNION ALL ".join(
    _mosaic_sql(a, b) for a, b in ((_FLAG, _QUANTITY), (_FLAG, _STATUS), (_STATUS, _QUANTITY))))
def contingency_tables(spark, folder):
    cells = bi.mosaic(with_holes(spark, folder), [(_FLAG, _QUANTITY), (_FLAG, _STATUS), (_STATUS, _QUANTITY), (_FLAG, _FLAG)])
    return cells.withColumns({"x_share": r6(F.col("x_share")), "y_share": r6(F.col("y_share"))})


_CUSTOMER_KINDS = [("c_custkey", NUMBER), ("c_name", TEXT), ("c_nationkey", NUMBER), ("c_acctbal", NUMBER), ("c_mktsegment", CATEGORY)]
_COLUMNS_SQL = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{k}' AS datatype, (SELECT count(DISTINCT {c}) FROM customer) AS distinct"
    for i, (c, k) in enumerate(_CUSTOMER_KINDS))


def _customer_summary(spark, folder):
    df = table(spark, folder, "customer")
    return uni.summarize(df, specs_of(df, ("c_mktsegment",)))


@query("contingency_eligible_columns", f"""SELECT "column", "distinct" FROM ({_COLUMNS_SQL})
    WHERE datatype = 'Number' OR (datatype = 'Category' AND "distinct" < 20)""")
def contingency_eligible_columns(spark, folder):
    return bi.eligible_columns(_customer_summary(spark, folder)).select("column", "distinct")


@query("column_pairs", f"""WITH c AS ({_COLUMNS_SQL}) SELECT a."column" AS c1, b."column" AS c2 FROM c a JOIN c b ON a.position <= b.position""")
def column_pairs(spark, folder):
    return bi.column_pairs(_customer_summary(spark, folder))


@query("column_pairs_changed", f"""WITH c AS ({_COLUMNS_SQL}) SELECT a."column" AS c1, b."column" AS c2 FROM c a JOIN c b
    ON a.position <= b.position WHERE a."column" IN ('c_acctbal') OR b."column" IN ('c_acctbal')""")
def column_pairs_changed(spark, folder):
    return bi.column_pairs(_customer_summary(spark, folder), ["c_acctbal"])


@query("pair_lookup_either_order", _pairs_sql("SELECT * FROM lineitem", [("l_quantity", "l_tax")]))
def pair_lookup_either_order(spark, folder):
    long = bi.correlations(table(spark, folder, "lineitem"), bi.all_pairs(_NUMBERS))
    return _rounded(bi.pair_summary(long, "l_tax", "l_quantity"))
