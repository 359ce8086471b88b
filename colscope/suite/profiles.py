"""Univariate profiles."""

from pyspark.sql import functions as F

from ..operators import additive
from ..operators import univariate as uni
from ..operators.distinct import distinct_counts
from ..operators.frequent import frequent_values
from ..operators.quantiles import approximate_quantiles, exact_quantiles
from ..session import shared_folder
from ..specs import CATEGORY, NUMBER, ColumnSpec, specs_of
from .registry import query, r6, table

# Lineitem with some values taken away, so that nulls show in every measure.
HOLES_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, nullif(l_quantity, 10) AS l_quantity,
    l_extendedprice, nullif(l_discount, 0.05) AS l_discount, l_tax, nullif(l_returnflag, 'N') AS l_returnflag,
    l_linestatus, l_shipdate FROM lineitem"""
_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CATEGORIES = ["l_returnflag", "l_linestatus"]


def with_holes(spark, folder):
    return table(spark, folder, "lineitem").withColumns({
        "l_quantity": F.nullif(F.col("l_quantity"), F.lit(10.0)),
        "l_discount": F.nullif(F.col("l_discount"), F.lit(0.05)),
        "l_returnflag": F.nullif("l_returnflag", F.lit("N"))})


def _summary_sql(source: str, specs: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(specs):
        numbers = (f"""round(avg(cast({c} AS double)), 6) AS mean, round(stddev_samp(cast({c} AS double)), 6) AS stddev,
            cast(min({c}) AS double) AS min, cast(max({c}) AS double) AS max, round(quantile_cont(cast({c} AS double), 0.5), 6) AS median"""
                   if kind == NUMBER else
                   "cast(NULL AS double) AS mean, cast(NULL AS double) AS stddev, cast(NULL AS double) AS min, "
                   "cast(NULL AS double) AS max, cast(NULL AS double) AS median")
        parts.append(f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS datatype, count(*) AS rows,
            count(*) - count({c}) AS missing, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct,
            {numbers} FROM src""")
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


def _rounded(summary):
    return summary.withColumns({c: r6(F.col(c)) for c in ("mean", "stddev", "median")})


_LINEITEM_KINDS = [(c, NUMBER) for c in _NUMBERS] + [(c, CATEGORY) for c in _CATEGORIES] + [("l_shipdate", "Date")]


@query("univariate_summary", _summary_sql(HOLES_SQL, _LINEITEM_KINDS))
def univariate_summary(spark, folder):
    df = with_holes(spark, folder)
    return _rounded(uni.summarize(df, specs_of(df, tuple(_CATEGORIES))))


@query("univariate_summary_documents", _summary_sql(
    "SELECT * FROM documents", [("doc_id", NUMBER), ("text", "Text"), ("lang", CATEGORY), ("source", "Text"), ("n_chars", NUMBER)]))
def univariate_summary_documents(spark, folder):
    df = table(spark, folder, "documents")
    return _rounded(uni.summarize(df, specs_of(df, ("lang",))))


@query("univariate_summary_sketched")
def univariate_summary_sketched(spark, folder):
    df = with_holes(spark, folder)
    return uni.summarize(df, specs_of(df, tuple(_CATEGORIES)), exact=False)


@query("missing_counts", "WITH src AS (" + HOLES_SQL + ") " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM src" for c, _ in _LINEITEM_KINDS))
def missing_counts(spark, folder):
    df = with_holes(spark, folder)
    return uni.missing_counts(df, df.columns)


@query("distinct_counts", "WITH src AS (" + HOLES_SQL + ") " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct FROM src"
    for c, _ in _LINEITEM_KINDS))
def distinct_value_counts(spark, folder):
    df = with_holes(spark, folder)
    return distinct_counts(df, df.columns)


@query("grouped_quantiles", """
    SELECT l_returnflag, unnest([0.05::double, 0.5::double, 0.95::double]) AS prob,
           unnest([round(quantile_cont(l_extendedprice, 0.05), 4), round(quantile_cont(l_extendedprice, 0.5), 4),
                   round(quantile_cont(l_extendedprice, 0.95), 4)]) AS quantile
    FROM lineitem GROUP BY 1""")
def grouped_quantiles(spark, folder):
    q = exact_quantiles(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95])
    return q.withColumn("quantile", F.round("quantile", 4))


_TAIL = "l_extendedprice / 1000.0 * (l_extendedprice / 1000.0) * (l_extendedprice / 1000.0) / (1.01 - l_discount)"


@query("grouped_quantiles_long_tail", f"""
    SELECT l_returnflag, unnest([0.001::double, 0.5::double, 0.999::double]) AS prob,
           unnest([round(quantile_cont(x, 0.001), 4), round(quantile_cont(x, 0.5), 4), round(quantile_cont(x, 0.999), 4)]) AS quantile
    FROM (SELECT l_returnflag, {_TAIL} AS x FROM lineitem) GROUP BY 1""")
def grouped_quantiles_long_tail(spark, folder):
    df = table(spark, folder, "lineitem").select("l_returnflag", F.expr(_TAIL.replace("1000.0", "1000D").replace("1.01", "1.01D")).alias("x"))
    return exact_quantiles(df, ["l_returnflag"], "x", [0.001, 0.5, 0.999]).withColumn("quantile", F.round("quantile", 4))


@query("grouped_quantiles_sketched")
def grouped_quantiles_sketched(spark, folder):
    return approximate_quantiles(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95])


@query("column_metrics_lookup", "SELECT * FROM (" + _summary_sql(HOLES_SQL, _LINEITEM_KINDS) + ") WHERE \"column\" = 'l_tax'")
def column_metrics_lookup(spark, folder):
    df = with_holes(spark, folder)
    return _rounded(uni.column_metrics(uni.summarize(df, specs_of(df, tuple(_CATEGORIES))), "l_tax"))


@query("suggested_max_bins", """
    SELECT cast(greatest((SELECT count(DISTINCT l_discount) FROM lineitem), (SELECT count(DISTINCT l_returnflag) FROM lineitem),
                         (SELECT count(DISTINCT l_linenumber) FROM lineitem)) AS bigint) AS max_bins""")
def suggested_max_bins(spark, folder):
    df = table(spark, folder, "lineitem").select("l_discount", "l_returnflag", "l_linenumber", "l_quantity")
    summary = uni.summarize(df, specs_of(df, tuple(_CATEGORIES)))
    return uni.suggested_max_bins(summary, df.columns)


@query("histogram_of_values", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", cast(row_number() OVER (ORDER BY {c}) - 1 AS int) AS bin, cast({c} AS varchar) AS label,
        cast({c} AS double) AS lower, cast({c} AS double) AS upper, count(*) AS n
        FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}""" for c in ("l_discount", "l_tax", "l_linenumber")))
def histogram_of_values(spark, folder):
    return uni.value_histogram(table(spark, folder, "lineitem"), ["l_discount", "l_tax", "l_linenumber"])


def _edges_sql(c: str, bins: int, p1: float, p2: float) -> str:
    steps = uni.inner_steps(bins, (p1, p2))
    return f"""SELECT DISTINCT '{c}' AS "column", unnest(list_concat([lo, hi], inner_edges)) AS edge FROM (
            SELECT lo, hi, list(a + i * ((b - a) / {float(steps)})) AS inner_edges FROM (
                SELECT min(x) AS lo, max(x) AS hi, quantile_cont(x, {p1}) AS a, quantile_cont(x, {p2}) AS b
                FROM (SELECT cast({c} AS double) AS x FROM lineitem)), range(0, {steps} + 1) r(i) GROUP BY 1, 2)"""


@query("bucket_edges", "SELECT \"column\", round(edge, 4) AS edge FROM (" + " UNION ALL ".join(
    _edges_sql(c, 22, 0.05, 0.95) for c in ("l_quantity", "l_extendedprice", "l_partkey")) + ")")
def bucket_edges(spark, folder):
    edges = uni.bucket_edges(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_partkey"], exact=True)
    return edges.select("column", F.explode("edges").alias("edge")).withColumn("edge", F.round("edge", 4))


@query("bucket_edges_full_range", "SELECT \"column\", round(edge, 4) AS edge FROM (" + _edges_sql("l_extendedprice", 10, 0.0, 1.0) + ")")
def bucket_edges_full_range(spark, folder):
    edges = uni.bucket_edges(table(spark, folder, "lineitem"), ["l_extendedprice"], 10, (0.0, 1.0), exact=True)
    return edges.select("column", F.explode("edges").alias("edge")).withColumn("edge", F.round("edge", 4))


@query("bucket_edges_one_open_tail", "SELECT \"column\", round(edge, 4) AS edge FROM (" + _edges_sql("l_extendedprice", 10, 0.0, 0.9) + ")")
def bucket_edges_one_open_tail(spark, folder):
    edges = uni.bucket_edges(table(spark, folder, "lineitem"), ["l_extendedprice"], 10, (0.0, 0.9), exact=True)
    return edges.select("column", F.explode("edges").alias("edge")).withColumn("edge", F.round("edge", 4))


@query("histogram_of_buckets", f"""
    WITH e AS (SELECT "column", list_sort(list(edge)) AS edges FROM (
                   {_edges_sql('l_extendedprice', 22, 0.05, 0.95)} UNION ALL {_edges_sql('l_quantity', 22, 0.05, 0.95)})
               GROUP BY 1),
         b AS (SELECT "column", i - 1 AS bin, edges[i] AS lo, edges[i + 1] AS hi, i = len(edges) - 1 AS final
               FROM (SELECT *, unnest(range(1, len(edges))) AS i FROM e)),
         v AS (SELECT 'l_extendedprice' AS "column", l_extendedprice AS x FROM lineitem
               UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem)
    SELECT b."column", cast(bin AS integer) AS bin, round(lo, 4) AS lower, round(hi, 4) AS upper, count(x) AS n
    FROM b LEFT JOIN v ON v."column" = b."column" AND x >= lo AND (x < hi OR (final AND x = hi))
    GROUP BY ALL""")
def histogram_of_buckets(spark, folder):
    df = table(spark, folder, "lineitem").select("l_extendedprice", "l_quantity")
    bars = uni.histograms(df, specs_of(df), exact=True)
    return bars.select("column", "bin", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "n")


_GIVEN = {"l_quantity": [0.0, 10.0, 20.0, 30.0, 60.0, 70.0], "l_extendedprice": [5000.0, 20000.0, 50000.0, 100000.0]}


@query("histogram_given_edges", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {i} AS bin, '{lo} - {hi}' AS label, {lo}::double AS lower, {hi}::double AS upper,
        (SELECT count(*) FROM lineitem WHERE {c} >= {lo} AND {c} {'<=' if i == len(e) - 2 else '<'} {hi}) AS n"""
    for c, e in _GIVEN.items() for i, (lo, hi) in enumerate(zip(e, e[1:]))))
def histogram_given_edges(spark, folder):
    return uni.bucket_counts(table(spark, folder, "lineitem"), _GIVEN)


def _categories_sql(source: str, c: str, direction: str) -> str:
    return f"""SELECT '{c}' AS "column", label, sum(n)::bigint AS n FROM (
        SELECT CASE WHEN rn < 100 THEN v ELSE 'Others' END AS label, n FROM (
            SELECT cast({c} AS varchar) AS v, count(*) AS n,
                   row_number() OVER (ORDER BY count(*) {direction}, cast({c} AS varchar)) AS rn
            FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)) GROUP BY 1, 2"""


@query("histogram_of_categories", " UNION ALL ".join(
    _categories_sql("customer", c, "DESC") for c in ("c_name", "c_mktsegment", "c_nationkey")))
def histogram_of_categories(spark, folder):
    df = table(spark, folder, "customer")
    return uni.category_histogram(df, ["c_name", "c_mktsegment", "c_nationkey"]).select("column", "label", "n")


_NAMED_OTHERS = """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'Others' ELSE c_mktsegment END AS kind, c_name,
    c_custkey % 1000 AS code FROM customer"""


@query("frequent_values_and_remainder", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", v AS value, sum(n)::bigint AS n, remainder FROM (
        SELECT CASE WHEN rn < 3 THEN v END AS v, n, rn >= 3 AS remainder FROM (
            SELECT cast({c} AS varchar) AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cast({c} AS varchar)) AS rn
            FROM ({_NAMED_OTHERS}) GROUP BY 1)) GROUP BY ALL""" for c in ("kind", "c_name", "code")))
def frequent_values_and_remainder(spark, folder):
    """A value called like the remainder, texts that are all different, and few counters for many values."""
    table(spark, folder, "customer").createOrReplaceTempView("customer")
    return frequent_values(spark.sql(_NAMED_OTHERS), ["kind", "c_name", "code"], 2, counters=3).select("column", "value", "n", "remainder")


@query("histogram_of_rare_categories", _categories_sql("events", "user_id", "ASC"))
def histogram_of_rare_categories(spark, folder):
    return uni.category_histogram(table(spark, folder, "events"), ["user_id"], order="asc").select("column", "label", "n")


@query("histograms_by_type", " UNION ALL ".join([
    """SELECT 'l_discount' AS "column", cast(l_discount AS varchar) AS label, count(*) AS n FROM lineitem GROUP BY 2""",
    _categories_sql("lineitem", "l_returnflag", "DESC"),
    *[f"""SELECT 'l_quantity', '{lo} - {hi}', (SELECT count(*) FROM lineitem WHERE l_quantity >= {lo} AND l_quantity < {hi})"""
      for lo, hi in ((0.0, 20.0), (20.0, 40.0), (40.0, 60.0))]]))
def histograms_by_type(spark, folder):
    df = table(spark, folder, "lineitem").select("l_discount", "l_returnflag", "l_quantity", "l_shipdate")
    bars = uni.histograms(df, specs_of(df, ("l_returnflag",)), edges={"l_quantity": [0.0, 20.0, 40.0, 60.0]})
    return bars.select("column", "label", "n")


@query("histograms_of_documents")
def histograms_of_documents(spark, folder):
    df = table(spark, folder, "documents")
    return uni.histograms(df, specs_of(df, ("lang",)))


@query("number_columns_with_few_values", """
    SELECT 'l_linenumber' AS "column", count(DISTINCT l_linenumber) AS distinct FROM lineitem
    UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem""")
def number_columns_with_few_values(spark, folder):
    df = table(spark, folder, "lineitem").select("l_linenumber", "l_tax", "l_orderkey")
    numbers = [ColumnSpec(c, NUMBER, i) for i, c in enumerate(df.columns)]
    return uni.summarize(df, numbers).filter(F.col("distinct") <= uni.MAX_VALUES_AS_BINS).select("column", "distinct")


@query("summary_added_up", """
    SELECT "column", rows, missing, mean, stddev, min, max, true AS distinct_near, true AS median_near FROM (
        """ + " UNION ALL ".join(f"""
        SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, round(avg({x}), 6) AS mean,
               round(stddev_samp({x}), 6) AS stddev, min({x})::double AS min, max({x})::double AS max
        FROM ({HOLES_SQL})""" for c, x in (("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"),
                                           ("l_tax", "l_tax"), ("l_returnflag", "NULL::double"))) + ")")
def summary_added_up(spark, folder):
    """The profile of three parts of a table, added up in storage: exact but for sketches, which are held to their bounds."""
    df = with_holes(spark, folder).select("l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_orderkey")
    specs = specs_of(df.drop("l_orderkey"), ("l_returnflag",))
    path = shared_folder(spark, "profile")
    for k in range(3):
        rows = additive.finished(additive.add_rows(spark, path, df.filter(F.col("l_orderkey") % 3 == k), specs))
    whole = uni.summarize(df.drop("l_orderkey"), specs).select("column", F.col("distinct").alias("d"), F.col("median").alias("m"))
    ranks = df.agg(F.array(*[F.struct(F.lit(s.name).alias("column"), F.percentile_approx(
        F.col(s.name).try_cast("double"), [0.48, 0.52], 10_000).alias("ends")) for s in specs if s.numeric]).alias("e")).select(F.inline("e"))
    both = rows.join(whole, "column").join(ranks, "column", "left")
    near = F.coalesce(F.col("median").between(F.col("ends")[0], F.col("ends")[1]), F.col("m").isNull())
    return both.select("column", "rows", "missing", r6("mean"), r6("stddev"), "min", "max",
                       (F.abs(F.col("distinct") - F.col("d")) <= 0.05 * F.col("d") + 1).alias("distinct_near"), near.alias("median_near"))
