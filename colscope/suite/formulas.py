"""Calculated columns."""

from pyspark.sql import functions as F

from .. import functions as fx
from .registry import query, r6, table


@query("formula_arithmetic", """
    SELECT p_partkey, p_size + p_retailprice AS added, p_retailprice - p_size AS subtracted,
           p_size * p_retailprice AS multiplied, p_size - p_retailprice - 1 AS chained,
           (p_size + 1) * 2 AS grouped, p_size + 1 * 2 AS ungrouped
    FROM part""")
def formula_arithmetic(spark, folder):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, folder, "part").select(
        "p_partkey", (size + price).alias("added"), (price - size).alias("subtracted"),
        (size * price).alias("multiplied"), (size - price - 1).alias("chained"),
        ((size + 1) * 2).alias("grouped"), (size + F.lit(1) * 2).alias("ungrouped"))


@query("formula_divide", """
    SELECT p_partkey, round(p_retailprice / nullif(p_size - 10, 0), 6) AS divided,
           round(cast(p_size AS double) / 7 / 2, 6) AS chained
    FROM part""")
def formula_divide(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", r6(fx.divide("p_retailprice", F.col("p_size") - 10), "divided"),
        r6(fx.divide(fx.divide("p_size", 7), 2), "chained"))


@query("formula_remainder", """
    SELECT p_partkey, (p_size - 25) % 7 AS signed, p_size % nullif(p_size - 10, 0) AS guarded,
           ((p_size - 25) % 7 + 7) % 7 AS positive,
           ((p_size % nullif(p_size - 10, 0)) + nullif(p_size - 10, 0)) % nullif(p_size - 10, 0) AS positive_guarded
    FROM part""")
def formula_remainder(spark, folder):
    shifted = F.col("p_size") - 25
    other = F.col("p_size") - 10
    guarded = fx.remainder("p_size", other)
    return table(spark, folder, "part").select(
        "p_partkey", fx.remainder(shifted, 7).alias("signed"), guarded.alias("guarded"),
        fx.positive_mod(shifted, 7).alias("positive"),
        fx.remainder(guarded + other, other).alias("positive_guarded"))


@query("formula_power", """
    SELECT p_partkey, pow(p_size, 2) AS squared, round(pow(p_retailprice, 0.5), 6) AS half,
           3 * pow(p_size, 2) + 1 AS binds_first, pow(pow(p_size, 2), 2) AS left_to_right
    FROM part""")
def formula_power(spark, folder):
    squared = fx.power("p_size", 2)
    return table(spark, folder, "part").select(
        "p_partkey", squared.alias("squared"), r6(fx.power("p_retailprice", 0.5), "half"),
        (F.lit(3) * squared + 1).alias("binds_first"), fx.power(squared, 2).alias("left_to_right"))


@query("formula_comparisons", """
    SELECT l_orderkey, l_linenumber, l_quantity >= 25 AS ge, l_quantity > 25 AS gt, l_quantity < 25 AS lt,
           l_quantity = 25 AS eq, l_quantity <> 25 AS ne, l_quantity <= 25 AS le,
           nullif(l_quantity, 7) <> 25 AS null_ne, (l_quantity > 25) = (l_tax > 0.04) AS chained
    FROM lineitem""")
def formula_comparisons(spark, folder):
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (q >= 25).alias("ge"), (q > 25).alias("gt"), (q < 25).alias("lt"),
        (q == 25).alias("eq"), (q != 25).alias("ne"), (q <= 25).alias("le"),
        (F.nullif(q, F.lit(7.0)) != 25).alias("null_ne"), ((q > 25) == (F.col("l_tax") > 0.04)).alias("chained"))


@query("formula_row_aggregates", """
    SELECT l_orderkey, l_linenumber,
           round(l_quantity + l_tax + nullif(l_discount, 0.05), 6) AS row_sum,
           CASE WHEN nullif(l_discount, 0.05) IS NOT NULL THEN least(l_quantity, l_tax, nullif(l_discount, 0.05)) END AS row_min,
           CASE WHEN nullif(l_discount, 0.05) IS NOT NULL THEN greatest(l_quantity, l_tax, nullif(l_discount, 0.05)) END AS row_max
    FROM lineitem""")
def formula_row_aggregates(spark, folder):
    cols = [F.col("l_quantity"), F.col("l_tax"), F.nullif(F.col("l_discount"), F.lit(0.05))]
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(fx.row_sum(*cols), "row_sum"), fx.row_min(*cols).alias("row_min"),
        fx.row_max(*cols).alias("row_max"))


@query("formula_rounding", """
    SELECT c_custkey, cast(ceil(c_acctbal) AS bigint) AS ceiling, cast(floor(c_acctbal) AS bigint) AS floored,
           abs(c_acctbal) AS absolute, round(c_acctbal / 100, 0) AS rounded
    FROM customer""")
def formula_rounding(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", fx.ceiling("c_acctbal").alias("ceiling"), fx.floor("c_acctbal").alias("floored"),
        fx.absolute("c_acctbal").alias("absolute"), fx.round_half_up(F.col("c_acctbal") / 100).alias("rounded"))


@query("formula_logarithms", """
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS log_10,
           CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS log_e,
           CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS root, c_acctbal < 0 AS root_is_nan
    FROM customer""")
def formula_logarithms(spark, folder):
    root = fx.square_root("c_acctbal")
    return table(spark, folder, "customer").select(
        "c_custkey", r6(fx.log10("c_acctbal"), "log_10"), r6(fx.ln("c_acctbal"), "log_e"),
        r6(F.when(~F.isnan(root), root), "root"), F.isnan(root).alias("root_is_nan"))


@query("formula_normalize", """
    SELECT l_orderkey, l_linenumber,
           round(1 + (l_extendedprice - min(l_extendedprice) OVER ()) /
                 (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS price_1_2,
           round((l_partkey - min(l_partkey) OVER ()) * 100.0::double /
                 (max(l_partkey) OVER () - min(l_partkey) OVER ()), 6) AS part_0_100,
           cast(NULL AS double) AS flag, cast(NULL AS double) AS constant
    FROM lineitem""")
def formula_normalize(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.select(
        "l_orderkey", "l_linenumber", r6(fx.normalize(df, "l_extendedprice", 1, 2), "price_1_2"),
        r6(fx.normalize(df, "l_partkey", 0, 100), "part_0_100"), fx.normalize(df, "l_returnflag", 0, 1).alias("flag"),
        fx.normalize(df, F.lit(3), 0, 1).alias("constant"))


@query("formula_outliers", """
    WITH e AS (SELECT event_id, pow(nullif(value, 5.0), 4) AS v FROM events),
         s AS (SELECT avg(v) AS m, stddev_samp(v) AS d FROM e)
    SELECT event_id, abs(v - m) > 3 * d AS outlier,
           round(CASE WHEN abs(v - m) > 3 * d THEN -1 ELSE v END, 2) AS replaced
    FROM e, s""")
def formula_outliers(spark, folder):
    df = table(spark, folder, "events").select(
        "event_id", F.pow(F.nullif(F.col("value"), F.lit(5.0)), F.lit(4)).alias("v"))
    return df.select("event_id", fx.is_outlier(df, "v").alias("outlier"),
                     F.round(fx.replace_outlier(df, "v", F.lit(-1.0)), 2).alias("replaced"))


@query("formula_text", """
    SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, p_name || '-' || cast(p_size AS varchar) AS joined,
           nullif(p_brand, 'Brand#2') || p_type AS joined_null, cast(length('  ' || p_name) AS int) AS size,
           lower(p_brand) AS lowered, upper(p_name) AS raised
    FROM part""")
def formula_text(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", fx.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
        fx.concat("p_name", F.lit("-"), "p_size").alias("joined"),
        fx.concat(F.nullif("p_brand", F.lit("Brand#2")), "p_type").alias("joined_null"),
        fx.length(F.concat(F.lit("  "), "p_name")).alias("size"), fx.lower("p_brand").alias("lowered"),
        fx.upper("p_name").alias("raised"))


@query("formula_text_parts", """
    SELECT p_partkey, left(p_name, 3) AS first_3, right(p_name, 4) AS last_4, right(p_name, 100) AS whole,
           substring(p_name, 2, 5) AS middle, cast(instr(p_name, 'ring') AS int) AS ring_at, cast(instr(p_name, 'zzz') AS int) AS absent
    FROM part""")
def formula_text_parts(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", fx.left("p_name", 3).alias("first_3"), fx.right("p_name", 4).alias("last_4"),
        fx.right("p_name", 100).alias("whole"), fx.substring("p_name", 2, 5).alias("middle"),
        fx.find("p_name", "ring").alias("ring_at"), fx.find("p_name", "zzz").alias("absent"))


@query("formula_text_replace", """
    SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '*', 'g') AS masked,
           regexp_replace(p_brand, 'Brand#([0-9])', 'B\\1', 'g') AS brand
    FROM part""")
def formula_text_replace(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", fx.replace("p_name", "[aeiou]+", "*").alias("masked"),
        fx.replace("p_brand", "Brand#([0-9])", "B$1").alias("brand"))


@query("formula_document_text", """
    SELECT doc_id, cast(length(text) AS int) AS size, cast(instr(text, 'the') AS int) AS first_the, contains(text, 'onen') AS has_onen,
           cast(length(regexp_replace(text, '[0-9]+', '', 'g')) AS int) AS size_without_digits
    FROM documents""")
def formula_document_text(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", fx.length("text").alias("size"), fx.find("text", "the").alias("first_the"),
        fx.contains("text", "onen").alias("has_onen"),
        fx.length(fx.replace("text", "[0-9]+", "")).alias("size_without_digits"))


@query("formula_logic", """
    SELECT l_orderkey, l_linenumber,
           nullif(l_quantity > 25, l_tax = 0.03) AND l_discount > 0.05 AS both_hold,
           nullif(l_quantity > 25, l_tax = 0.03) OR l_discount > 0.05 AS either_holds,
           NOT nullif(l_quantity > 25, l_tax = 0.03) AS negated,
           cast(l_linenumber - 1 AS boolean) AND l_tax > 0 AS number_as_truth
    FROM lineitem""")
def formula_logic(spark, folder):
    maybe = F.nullif(F.col("l_quantity") > 25, F.col("l_tax") == 0.03)
    discounted = F.col("l_discount") > 0.05
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", fx.all_of(maybe, discounted).alias("both_hold"),
        fx.any_of(maybe, discounted).alias("either_holds"), fx.negate(maybe).alias("negated"),
        fx.all_of(F.col("l_linenumber") - 1, F.col("l_tax") > 0).alias("number_as_truth"))


@query("formula_membership", """
    SELECT p_partkey, contains(p_name, 'ring') AS has_ring, contains(p_name, 'r%g') AS has_pattern,
           p_type IN ('ECONOMY', 'PROMO') AS listed, nullif(p_size, 10) IS NULL AS missing,
           coalesce(nullif(p_size, 10), 0) AS filled
    FROM part""")
def formula_membership(spark, folder):
    size = F.nullif(F.col("p_size"), F.lit(10))
    return table(spark, folder, "part").select(
        "p_partkey", fx.contains("p_name", "ring").alias("has_ring"), fx.contains("p_name", "r%g").alias("has_pattern"),
        fx.one_of("p_type", ["ECONOMY", "PROMO"]).alias("listed"), fx.is_null(size).alias("missing"),
        fx.if_null(size, 0).alias("filled"))


@query("formula_conditionals", """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN nullif(l_quantity, 10) > 25 THEN 1 WHEN NOT (nullif(l_quantity, 10) > 25) THEN -1 END AS if_value,
           CASE l_returnflag WHEN 'A' THEN 'last' WHEN 'R' THEN 'returned' END AS case_value
    FROM lineitem""")
def formula_conditionals(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        fx.if_then_else(F.nullif(F.col("l_quantity"), F.lit(10.0)) > 25, F.lit(1), F.lit(-1)).alias("if_value"),
        fx.case_when("l_returnflag", [("A", F.lit("first")), ("R", F.lit("returned")), ("A", F.lit("last"))])
        .alias("case_value"))
