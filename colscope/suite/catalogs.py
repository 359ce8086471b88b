"""Paging, search, upserts and lookups, on driver tables in the role of catalogs."""

from pyspark.sql import functions as F

from ..operators import bivariate as bi
from ..operators import catalog as cat
from ..operators import split
from ..operators import stored
from ..operators import univariate as uni
from ..session import shared_folder
from ..specs import specs_of
from .registry import draws_sql, query, r6, table


@query("page_of_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def page_of_rows(spark, folder):
    return cat.page(table(spark, folder, "orders"), ["o_orderkey"], 3, 25)


@query("page_after_key", "SELECT * FROM orders WHERE o_orderkey > 74 ORDER BY o_orderkey LIMIT 25")
def page_after_key(spark, folder):
    return cat.page_after(table(spark, folder, "orders"), "o_orderkey", 74, 25)


@query("page_deep", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 975")
def page_deep(spark, folder):
    return cat.deep_page(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 40, 25)


@query("page_info", "SELECT count(*) AS rows, cast(ceil(count(*) / 25.0) AS bigint) AS pages, 6 AS columns FROM orders")
def page_info(spark, folder):
    return cat.page_info(table(spark, folder, "orders"), 25)


@query("top_page_by_value", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20 OFFSET 20")
def top_page_by_value(spark, folder):
    return cat.page(table(spark, folder, "events").select("event_id", "value"), [F.desc("value"), "event_id"], 2, 20)


@query("latest_per_name", """
    SELECT user_id, event_id, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_name(spark, folder):
    newest = cat.latest_per_key(table(spark, folder, "events"), ["user_id"], [F.desc("event_id")])
    return newest.select("user_id", "event_id", "event_type")


@query("search_by_prefix", """
    SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND lower(c_name) LIKE 'customer#0000001%'
    ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5""")
def search_by_prefix(spark, folder):
    found = cat.by_prefix(table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'"), "c_name", "CUSTOMER#0000001")
    return found.orderBy(F.desc("c_acctbal"), "c_custkey").offset(5).limit(10).select("c_custkey", "c_name")


@query("search_by_prefix_count", "SELECT count(*) AS n FROM customer WHERE lower(c_name) LIKE 'customer#0000001%'")
def search_by_prefix_count(spark, folder):
    return cat.by_prefix(table(spark, folder, "customer"), "c_name", "CUSTOMER#0000001").agg(F.count(F.lit(1)).alias("n"))


@query("search_by_pattern", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)R.D') ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def search_by_pattern(spark, folder):
    found = cat.by_pattern(table(spark, folder, "part"), "p_name", "R.D")
    return cat.page(found, [F.desc("p_retailprice"), "p_partkey"], 1, 20).select("p_partkey", "p_name")


@query("names_already_taken", """
    SELECT p_partkey, p_name FROM part p WHERE p_size > 40
    AND EXISTS (SELECT 1 FROM part o WHERE o.p_name = p.p_name AND o.p_partkey <> p.p_partkey)""")
def names_already_taken(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    return cat.taken_names(part.filter("p_size > 40"), part, "p_name", "p_partkey").drop("p_size")


@query("lookup_in_order", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 1, 20, 7) ORDER BY n_nationkey")
def lookup_in_order(spark, folder):
    return cat.pick_in_order(table(spark, folder, "nation"), "n_nationkey", [3, 1, 20, 7], "n_nationkey").select(
        "n_nationkey", "n_name")


@query("model_schema_view", """
    SELECT l_orderkey AS model_id, i.p_size AS position, i.p_name AS input_column, o.p_name AS output_column
    FROM lineitem JOIN part i ON l_partkey = i.p_partkey JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN part o ON o_custkey = o.p_partkey""")
def model_schema_view(spark, folder):
    """Orders in the role of models, their lines as inputs, parts as columns."""
    columns = table(spark, folder, "part").select(
        F.col("p_partkey").alias("column_id"), F.col("p_size").alias("position"), F.col("p_name").alias("name"))
    models = table(spark, folder, "orders").select(F.col("o_orderkey").alias("model_id"), F.col("o_custkey").alias("output_id"))
    inputs = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("model_id"), F.col("l_partkey").alias("column_id"))
    return cat.model_schema(models, inputs, columns)


@query("counts_by_kind", """
    SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
           count(*) FILTER (event_type = 'error') AS error
    FROM events GROUP BY 1""")
def counts_by_kind(spark, folder):
    return cat.counts_by_kind(table(spark, folder, "events"), "user_id", "event_type", ["click", "purchase", "error"])


@query("summary_upsert", """
    SELECT 'l_quantity' AS "column", 60.0::double AS max UNION ALL SELECT 'l_tax', max(l_tax) FROM lineitem
    UNION ALL SELECT 'l_discount', max(l_discount) FROM lineitem""")
def summary_upsert(spark, folder):
    """Stored summaries with one column computed again."""
    df = table(spark, folder, "lineitem").select("l_quantity", "l_tax", "l_discount")
    old = uni.summarize(df, specs_of(df), exact=False).select("column", "max")
    changed = df.select((F.col("l_quantity") + 10).alias("l_quantity"))
    new = uni.summarize(changed, specs_of(changed), exact=False).select("column", "max")
    return cat.upsert(old, new, ["column"])


_PAIRS = [("l_quantity", "l_tax"), ("l_discount", "l_quantity"), ("l_discount", "l_tax")]


@query("pair_summary_upsert", """
    SELECT 'l_tax' AS c1, 'l_quantity' AS c2, round(corr(l_tax, -l_quantity), 6) AS correlation FROM lineitem
    UNION ALL SELECT 'l_discount', 'l_quantity', round(corr(l_discount, l_quantity), 6) FROM lineitem
    UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) FROM lineitem""")
def pair_summary_upsert(spark, folder):
    """A pair stored as (a, b) is replaced by its new summary under (b, a)."""
    df = table(spark, folder, "lineitem")
    old = bi.correlations(df, _PAIRS).select("c1", "c2", r6("correlation"))
    changed = df.withColumn("l_quantity", -F.col("l_quantity"))
    new = bi.correlations(changed, [("l_tax", "l_quantity")]).select("c1", "c2", r6("correlation"))
    return cat.upsert_pairs(old, new)


@query("summaries_without_dropped_columns", """
    SELECT 'l_discount' AS c1, 'l_quantity' AS c2, round(corr(l_discount, l_quantity), 6) AS correlation FROM lineitem""")
def summaries_without_dropped_columns(spark, folder):
    long = bi.correlations(table(spark, folder, "lineitem"), _PAIRS).select("c1", "c2", r6("correlation"))
    return cat.without_columns(long, ["l_tax"], ("c1", "c2"))


@query("train_test_split_by_key", """
    SELECT CASE WHEN o_orderkey % 100 < 80 THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY 1""")
def train_test_split_by_key(spark, folder):
    train, test = split.modulo_split(table(spark, folder, "orders"), "o_orderkey", 80)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _shares(spark, folder, train, test):
    """Rows of both parts, and whether the first has about the share that was asked for."""
    both = train.select(F.lit(1).alias("train")).unionAll(test.select(F.lit(0).alias("train")))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.avg("train").between(0.75, 0.85).alias("share_as_asked"))


_SHARES_SQL = "SELECT count(*) AS rows, true AS share_as_asked FROM lineitem"


@query("train_test_split_by_hash", _SHARES_SQL)
def train_test_split_by_hash(spark, folder):
    return _shares(spark, folder, *split.hash_split(table(spark, folder, "lineitem"), ["l_orderkey"], 80))


@query("train_test_split_random", _SHARES_SQL)
def train_test_split_random(spark, folder):
    return _shares(spark, folder, *split.random_split(table(spark, folder, "lineitem"), 80, 20))


@query("bernoulli_sample", "SELECT count(*) AS rows, true AS share_as_asked FROM lineitem")
def bernoulli_sample(spark, folder):
    """Sampling is the feature: a seeded tenth of the rows, compared with the whole."""
    df = table(spark, folder, "lineitem")
    sample = split.bernoulli_sample(df, 0.1).agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", (sample / F.col("rows")).between(0.08, 0.12).alias("share_as_asked"))


@query("bernoulli_sample_keys", f"""
    SELECT o_orderkey, o_custkey
    FROM ({draws_sql("SELECT o_orderkey, o_custkey FROM orders", ["7", "0", "o_orderkey"])}) WHERE u < 0.1""")
def bernoulli_sample_keys(spark, folder):
    """Sampling is the feature: which rows are in a tenth follows from their keys alone."""
    return split.bernoulli_sample(table(spark, folder, "orders"), 0.1, 7, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("stored_summary_upsert", """
    SELECT 'l_quantity' AS "column", 60.0::double AS max, (SELECT count(*) FROM lineitem) AS rows
    UNION ALL SELECT 'l_discount', max(l_discount), count(*) FROM lineitem""")
def stored_summary_upsert(spark, folder):
    """A stored summary: one column computed again, one dropped, one left as it lies."""
    df = table(spark, folder, "lineitem").select("l_quantity", "l_tax", "l_discount")
    path = shared_folder(spark, "stored-summary")
    kept = uni.summarize(df, specs_of(df), exact=False).select("column", "max", "rows")
    stored.store_keys(kept, path, "column")
    changed = df.select((F.col("l_quantity") + 10).alias("l_quantity"))
    stored.store_keys(uni.summarize(changed, specs_of(changed), exact=False).select("column", "max", "rows"), path, "column")
    stored.drop_keys(spark, path, "column", kept.schema, ["l_tax"])
    return stored.stored_keys(spark, path, "column", kept.schema)


@query("ranked_page_deep", """
    SELECT * REPLACE (nullif(o_orderpriority, '3-MEDIUM') AS o_orderpriority) FROM orders
    ORDER BY nullif(o_orderpriority, '3-MEDIUM') DESC NULLS LAST, o_totalprice, o_orderkey LIMIT 70 OFFSET 700""")
def ranked_page_deep(spark, folder):
    """A page is the feature: the eleventh of 70 rows in an order of text with nulls, numbers and keys."""
    df = table(spark, folder, "orders").withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")))
    path = shared_folder(spark, "ranks")
    stored.write_rank_index(df, path, [F.desc_nulls_last("o_orderpriority"), "o_totalprice", "o_orderkey"], 300)
    return stored.ranked_page(spark, path, 11, 70)
