"""Semantic type inference."""

from pyspark.sql import functions as F

from ..operators import infer as inf
from ..specs import AUTO_DETECT, ColumnSpec
from .registry import query, table

# Every form a value can take, derived from order rows.
MIXED_SQL = """
    SELECT o_orderkey, CASE o_orderkey % 16
        WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN 2 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 3 THEN strftime(o_orderdate, '%d-%m-%y')
        WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
        WHEN 6 THEN strftime(o_orderdate, '%d-%m-%Y %H:%M:%S') WHEN 7 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
        WHEN 8 THEN strftime(o_orderdate, '%d/%m/%y %H:%M:%S') WHEN 9 THEN cast(o_totalprice AS varchar)
        WHEN 10 THEN '-' || cast(o_custkey AS varchar) WHEN 11 THEN '0.' || cast(o_custkey AS varchar)
        WHEN 12 THEN ' 1 ' WHEN 13 THEN '' WHEN 14 THEN '5e' ELSE o_orderpriority END AS value
    FROM orders"""

_NUMBER = "regexp_full_match(trim(value), '-?[0-9]+[.]?[0-9]*e?[0-9]*') AND try_cast(trim(value) AS double) IS NOT NULL"


def _type_sql(source: str, legacy: bool = False) -> str:
    """(column_name, value) rows of ``source`` with the type of each value."""
    dates = " ".join(f"WHEN regexp_full_match(trim(value), '{p}') THEN '{f}'" for p, f in inf.DATE_PATTERNS
                     if not legacy or f in inf.LEGACY_FORMATS)
    return f"""
    SELECT *, CASE WHEN kind = 'Date' THEN date_format WHEN kind = 'Text' THEN 'Text' ELSE '' END AS format,
           CASE WHEN kind IN ('Number', 'Percentage') AND contains(value, '.') THEN 2 ELSE 0 END AS decimal
    FROM (SELECT *, CASE WHEN trim(value) = '' THEN 'Null' WHEN date_format IS NOT NULL THEN 'Date'
                         WHEN {_NUMBER} THEN CASE WHEN try_cast(trim(value) AS double) BETWEEN 0 AND 1
                                                  THEN 'Percentage' ELSE 'Number' END
                         ELSE 'Text' END AS kind
          FROM (SELECT *, CASE {dates} END AS date_format FROM ({source})))"""


def _columns_sql(source: str, legacy: bool = False) -> str:
    """Column types resolved from the value types of ``source`` rows (column, value)."""
    whole = "" if legacy else "WHEN kinds = 1 AND one = 'Percentage' AND places = 0 THEN 'Number'"
    return f"""
    WITH typed AS ({_type_sql(source, legacy)}),
    k AS (SELECT "column", count(DISTINCT value) AS vals,
                 count(DISTINCT CASE WHEN kind <> 'Null' THEN kind END) AS kinds,
                 count(DISTINCT CASE WHEN kind <> 'Null' THEN kind || format || cast(decimal AS varchar) END) AS forms,
                 min(CASE WHEN kind <> 'Null' THEN kind END) AS one, max(CASE WHEN kind <> 'Null' THEN kind END) AS other,
                 max(CASE WHEN kind <> 'Null' THEN format END) AS form, max(CASE WHEN kind <> 'Null' THEN decimal END) AS places
          FROM typed GROUP BY 1),
    d AS (SELECT *, CASE WHEN forms = 0 THEN 'Text' {whole}
                         WHEN forms = 1 AND one <> 'Text' THEN one
                         WHEN kinds = 1 AND one IN ('Number', 'Percentage') THEN one
                         WHEN kinds = 2 AND one = 'Number' AND other = 'Percentage' THEN 'Number'
                         WHEN vals < 20 THEN 'Category' ELSE 'Text' END AS datatype FROM k)
    SELECT "column", datatype, CASE datatype WHEN 'Text' THEN 'Text' WHEN 'Category' THEN 'Category'
                                             WHEN 'Date' THEN form ELSE '' END AS format,
           cast(CASE WHEN datatype IN ('Number', 'Percentage') THEN places ELSE 0 END AS integer) AS decimal FROM d"""


def _long_sql(table_name: str, columns: list[str], order: str | None = None) -> str:
    source = f"(SELECT * FROM {table_name} ORDER BY {order} LIMIT 100)" if order else table_name
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", coalesce(cast({c} AS varchar), '') AS value FROM {source}" for c in columns)


def mixed_values(spark, folder):
    k, d = F.col("o_orderkey") % 16, "o_orderdate"
    formats = ["dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yy", "dd-MM-yy", "dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'",
               "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd/MM/yy HH:mm:ss"]
    value = F.when(k == 9, F.col("o_totalprice").cast("string"))
    for i, f in enumerate(formats):
        value = value.when(k == i, F.date_format(d, f))
    cust = F.col("o_custkey").cast("string")
    value = (value.when(k == 10, F.concat(F.lit("-"), cust)).when(k == 11, F.concat(F.lit("0."), cust))
             .when(k == 12, " 1 ").when(k == 13, "").when(k == 14, "5e").otherwise(F.col("o_orderpriority")))
    return table(spark, folder, "orders").select("o_orderkey", value.alias("value"))


@query("infer_value_types", f"""
    SELECT o_orderkey, value, kind AS datatype, format, decimal FROM ({_type_sql(MIXED_SQL)})""")
def infer_value_types(spark, folder):
    return inf.value_types(mixed_values(spark, folder), "value")


_LINEITEM = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]
_DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("infer_column_types_all_rows", _columns_sql(_long_sql("lineitem", _LINEITEM)))
def infer_column_types_all_rows(spark, folder):
    return inf.infer_types(table(spark, folder, "lineitem"), _LINEITEM, partitions=8)


@query("infer_document_types", _columns_sql(_long_sql("documents", _DOCUMENTS)))
def infer_document_types(spark, folder):
    return inf.infer_types(table(spark, folder, "documents"), _DOCUMENTS, sample_rows=None)


# A preview is the feature here: types come from the first 100 rows.
@query("infer_column_types_preview", _columns_sql(_long_sql("orders", ["o_orderkey", "o_totalprice", "o_orderstatus",
                                                                      "o_orderdate", "o_orderpriority"], "o_orderkey")))
def infer_column_types_preview(spark, folder):
    return inf.infer_types(table(spark, folder, "orders"),
                           ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority"],
                           sample_rows=inf.SAMPLE_ROWS, order_by=["o_orderkey"])


_FLAGS_SQL = """SELECT 'quality' AS "column", cast(quality AS varchar) AS value FROM labels UNION ALL
    SELECT 'toxic', cast(toxic AS varchar) FROM labels UNION ALL
    SELECT 'half', cast(quality * 0.5::double AS varchar) FROM labels UNION ALL
    SELECT 'doc_id', cast(doc_id AS varchar) FROM labels"""


def _flags(spark, folder):
    return table(spark, folder, "labels").select("quality", "toxic", (F.col("quality") * 0.5).alias("half"), "doc_id")


@query("infer_flag_types", _columns_sql(_FLAGS_SQL))
def infer_flag_types(spark, folder):
    return inf.infer_types(_flags(spark, folder), sample_rows=None)


@query("infer_flag_types_older_rules", _columns_sql(_FLAGS_SQL, legacy=True))
def infer_flag_types_older_rules(spark, folder):
    return inf.infer_types(_flags(spark, folder), sample_rows=None, legacy=True)


@query("infer_mixed_type", _columns_sql(f"SELECT 'value' AS \"column\", value FROM ({MIXED_SQL})"))
def infer_mixed_type(spark, folder):
    return inf.infer_types(mixed_values(spark, folder), ["value"], sample_rows=None)


@query("auto_detect_new_columns", _columns_sql("""
    SELECT 'ratio' AS "column", cast(round(value / 1000, 3) AS varchar) AS value FROM
    (SELECT * FROM events ORDER BY event_id LIMIT 100)
    UNION ALL SELECT 'tag', event_type || '-' || cast(user_id AS varchar) FROM (SELECT * FROM events ORDER BY event_id LIMIT 100)"""))
def auto_detect_new_columns(spark, folder):
    df = table(spark, folder, "events").select(
        "event_id", F.round(F.col("value") / 1000, 3).alias("ratio"),
        F.concat_ws("-", "event_type", "user_id").alias("tag"))
    specs = [ColumnSpec("ratio", AUTO_DETECT, status="new"), ColumnSpec("tag", AUTO_DETECT, status="new")]
    return inf.detect_new_types(df, specs, ["event_id"])


@query("drop_ragged_lines", """
    SELECT event_id FROM events
    WHERE len(string_split(event_type || ',' || cast(user_id AS varchar) ||
                           CASE WHEN event_type = 'error' THEN ',' ELSE '' END, ',')) = 2""")
def drop_ragged_lines(spark, folder):
    line = F.concat(F.concat_ws(",", "event_type", "user_id"), F.when(F.col("event_type") == "error", ",").otherwise(""))
    lines = table(spark, folder, "events").select("event_id", line.alias("line"))
    return inf.drop_ragged(lines, "line", 2).select("event_id")


# Three fields: the user, a note that may hold separators and quotes, the type.
_QUOTED_LINE = """user_id || ',"' || CASE event_id % 4 WHEN 0 THEN 'a, b' WHEN 1 THEN 'say ""no"", no' WHEN 2 THEN ',' ELSE '' END
    || '",' || event_type || CASE WHEN event_id % 5 = 0 THEN ',' ELSE '' END"""


@query("ragged_quoted_lines", f"""
    SELECT event_id, len(string_split(regexp_replace(line, '"([^"]|"")*"', '', 'g'), ',')) = 3 AS whole
    FROM (SELECT event_id, {_QUOTED_LINE} AS line FROM events)""")
def ragged_quoted_lines(spark, folder):
    """Lines with separators and quotes inside quoted fields: those kept, and the list of those dropped."""
    lines = table(spark, folder, "events").select("event_id", F.expr(_QUOTED_LINE).alias("line"))
    kept = inf.drop_ragged(lines, "line", 3).select("event_id", F.lit(True).alias("whole"))
    return kept.unionByName(inf.ragged_lines(lines, "line", 3).select("event_id", F.lit(False).alias("whole")))
