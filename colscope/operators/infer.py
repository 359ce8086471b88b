"""Semantic type inference from the text form of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import on_driver, plain_names, quoted, renamed_values
from ..specs import AUTO_DETECT, CATEGORY, DATE, NUMBER, PERCENTAGE, TEXT, ColumnSpec
from .distinct import small_distinct_counts

NULL = "Null"
MIN_TEXT_VALUES = 20
SAMPLE_ROWS = 100

# Date patterns in the order they are tried, and the pattern of a number.
DATE_PATTERNS = [
    ("[0-9]{2}-[0-9]{2}-[0-9]{4}", "DD-MM-YYYY"),
    ("[0-9]{4}-[0-9]{2}-[0-9]{2}", "YYYY-MM-DD"),
    ("[0-9]{2}/[0-9]{2}/[0-9]{2}", "DD/MM/YY"),
    ("[0-9]{2}-[0-9]{2}-[0-9]{2}", "DD-MM-YY"),
    ("[0-9]{2}/[0-9]{2}/[0-9]{4}", "DD/MM/YYYY"),
    ("[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z", "YYYY-MM-DDThh:mm:ssZ"),
    ("[0-9]{2}-[0-9]{2}-[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}", "DD-MM-YYYY HH:MM:SS"),
    ("[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", "YYYY-MM-DD HH:MM:SS"),
    ("[0-9]{2}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", "DD/MM/YY HH:MM:SS"),
]
NUMBER_PATTERN = r"-?[0-9]+\.?[0-9]*e?[0-9]*"
# The formats the older rule set knows.
LEGACY_FORMATS = {"DD-MM-YYYY", "YYYY-MM-DD", "DD/MM/YY", "DD-MM-YYYY HH:MM:SS", "YYYY-MM-DD HH:MM:SS",
                  "DD/MM/YY HH:MM:SS"}
_BLANKS = "".join(map(chr, range(1, 33)))


# Every type a value can have: (datatype, format, decimal).  Rows carry the index only.
_KINDS = [(NULL, "", 0), (TEXT, TEXT, 0), (PERCENTAGE, "", 0), (PERCENTAGE, "", 2), (NUMBER, "", 0), (NUMBER, "", 2),
          *[(DATE, fmt, 0) for _, fmt in DATE_PATTERNS]]
_NULL, _TEXT, _PERCENTAGE, _NUMBER, _DATE = 0, 1, 2, 4, 6


def _kind(code: Column) -> Column:
    """Struct (datatype, format, decimal) of a code."""
    return F.element_at(F.array(*[
        F.struct(F.lit(d).alias("datatype"), F.lit(f).alias("format"), F.lit(n).alias("decimal")) for d, f, n in _KINDS
    ]), code + 1)


def trimmed(value: Column) -> Column:
    """Value without blanks and control characters at its ends; most values have none, so those are tested first."""
    clean = (F.substring(value, 1, 1) > " ") & (F.substring(value, -1, 1) > " ")
    return F.when(clean, value).otherwise(F.btrim(value, F.lit(_BLANKS)))


def _parsed(s: Column) -> Column:
    """The number a trimmed value stands for, null if it is none."""
    starts = F.substring(s, 1, 1).between("0", "9") | F.startswith(s, F.lit("-"))
    return F.when(starts & s.rlike(f"^{NUMBER_PATTERN}$"), s.try_cast("double"))


def _text_code(s: Column, number: Column, legacy: bool) -> Column:
    places = F.when(F.contains(s, F.lit(".")), 1).otherwise(0)
    # Dates start with a digit, and no number has a date's form: cheap tests go first.
    code = (F.when(s == "", _NULL).when(number.between(0, 1), F.lit(_PERCENTAGE) + places)
            .when(number.isNotNull(), F.lit(_NUMBER) + places).when(~F.substring(s, 1, 1).between("0", "9"), _TEXT))
    for i, (pattern, fmt) in enumerate(DATE_PATTERNS):
        if not legacy or fmt in LEGACY_FORMATS:
            # A value has the length of its format, which rules out most patterns without matching them.
            code = code.when((F.length(s) == len(fmt)) & s.rlike(f"^{pattern}$"), _DATE + i)
    return code.otherwise(_TEXT)


def _number_code(x: Column, fractional: bool) -> Column:
    """Code of a numeric column's value, the same its text form would get.

    Fractional numbers print with a point, and with an exponent (which makes them text) outside 0.001 to 10
    million.
    """
    code = F.when(x.isNull(), _NULL)
    if fractional:
        plain = (x == 0) | ((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7))
        code = code.when(~plain, _TEXT)
    places = int(fractional)
    return code.when(x.between(0, 1), _PERCENTAGE + places).otherwise(_NUMBER + places)


def _value_codes(df: DataFrame, columns: list[str], legacy: bool) -> DataFrame:
    """(column, code) of every value.

    Columns are made long per family, so the generated code does not grow with their number, and only those
    that are no numbers already are turned into text.
    """
    whole, fractional = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)
    kinds = {c: df.schema[c].dataType for c in columns}
    wholes = [c for c in columns if isinstance(kinds[c], whole)]
    fractions = [c for c in columns if isinstance(kinds[c], fractional)]
    texts = [c for c in columns if c not in wholes and c not in fractions]

    def long(names: list[str], kind: str) -> DataFrame:
        return df.select(*[F.col(c).cast(kind).alias(c) for c in names]).unpivot([], names, "column", "value")

    parts = [long(names, kind).select("column", _number_code(F.col("value"), names is fractions).alias("code"))
             for names, kind in ((wholes, "bigint"), (fractions, "double")) if names]
    if texts:
        steps = long(texts, "string").select("column", trimmed(F.coalesce("value", F.lit(""))).alias("s"))
        steps = steps.select("column", "s", _parsed(F.col("s")).alias("n"))
        parts.append(steps.select("column", _text_code(F.col("s"), F.col("n"), legacy).alias("code")))
    return reduce(DataFrame.unionAll, parts)


def value_types(df: DataFrame, value: str, legacy: bool = False) -> DataFrame:
    """``df`` with the datatype, format and decimal places of each value of a text column."""
    steps = df.withColumn("_s", trimmed(F.coalesce(F.col(value), F.lit(""))))
    steps = steps.withColumn("_n", _parsed(F.col("_s")))
    typed = steps.withColumn("_kind", _kind(_text_code(F.col("_s"), F.col("_n"), legacy)))
    return typed.select(*df.columns, "_kind.datatype", "_kind.format", "_kind.decimal")


def _resolve(kinds: Column, few_values: Column, legacy: bool) -> Column:
    """Type of a column from the set of its values' types (Null left out)."""
    names = F.array_distinct(F.transform(kinds, lambda k: k["datatype"]))
    decimal = F.array_max(F.transform(kinds, lambda k: k["decimal"]))
    only = F.element_at(kinds, 1)

    def made(datatype, fmt, places) -> Column:
        return F.struct(F.lit(datatype).alias("datatype") if isinstance(datatype, str) else datatype.alias("datatype"),
                        F.lit(fmt).alias("format") if isinstance(fmt, str) else fmt.alias("format"),
                        F.lit(places).alias("decimal") if isinstance(places, int) else places.alias("decimal"))

    words = F.when(few_values, made(CATEGORY, CATEGORY, 0)).otherwise(made(TEXT, TEXT, 0))
    rule = F.when(F.size(kinds) == 0, made(TEXT, TEXT, 0))
    one = F.size(names) == 1
    if not legacy:
        rule = rule.when(one & (only["datatype"] == PERCENTAGE) & (decimal == 0), made(NUMBER, "", 0))
    return (
        rule.when((F.size(kinds) == 1) & (only["datatype"] != TEXT), made(only["datatype"], only["format"], only["decimal"]))
        .when(one & only["datatype"].isin(NUMBER, PERCENTAGE), made(only["datatype"], "", decimal))
        .when((F.size(names) == 2) & F.array_contains(names, NUMBER) & F.array_contains(names, PERCENTAGE),
              made(NUMBER, "", decimal))
        .otherwise(words)
    )


def infer_types(df: DataFrame, columns: list[str] | None = None, sample_rows: int | None = None,
                order_by: list[str] | None = None, legacy: bool = False, partitions: int | None = None) -> DataFrame:
    """(column, datatype, format, decimal) of every column, from all rows or the first ``sample_rows``.

    Values of all rows are never shuffled: each task reduces a column to its few value types.  First rows are those
    in the order of ``order_by`` (of all columns if not given), fetched once.  ``partitions`` deals the rows out anew,
    for an input that comes in few large pieces.
    """
    columns = columns or df.columns
    plain = plain_names(df, list(dict.fromkeys([*columns, *(order_by or [])])))
    if plain:
        by_old = {old: new for new, old in plain[1].items()}
        found = infer_types(plain[0], [by_old[c] for c in columns], sample_rows, [by_old[c] for c in order_by or []] or None,
                            legacy, partitions)
        return renamed_values(found, "column", plain[1])
    if sample_rows is not None:
        df = on_driver(df.orderBy(*(order_by or df.columns)).limit(sample_rows))
    elif partitions:
        df = df.repartition(partitions)
    # A handful of (column, type) rows per task reach the shuffle, and the result lives on the driver from here on.
    codes = _value_codes(df, columns, legacy)
    counts = codes.groupBy("column", "code").agg(F.count(F.lit(1)).alias("n"))
    kinds = on_driver(counts.groupBy("column").agg(
        F.sort_array(F.collect_set(F.when(F.col("code") != _NULL, _kind(F.col("code"))))).alias("kinds")))

    def resolved(few: list[str]) -> DataFrame:
        rule = _resolve(F.col("kinds"), F.col("column").isin(few), legacy)
        return kinds.select("column", rule.alias("r")).select("column", "r.datatype", "r.format", "r.decimal")

    words = [r["column"] for r in resolved([]).filter(F.col("datatype") == TEXT).collect()]
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in words])
    return resolved(list(small_distinct_counts(text, words, MIN_TEXT_VALUES)))


def detect_new_types(df: DataFrame, specs: list[ColumnSpec], order_by: list[str] | None = None) -> DataFrame:
    """Types of new columns: declared ones as given, ``AutoDetect`` ones from the first 100 values."""
    auto = [s.final_name for s in specs if s.status == "new" and s.datatype == AUTO_DETECT]
    return infer_types(df, auto, SAMPLE_ROWS, order_by)


def whole_line(column: str, fields: int, separator: str = ",", quote: str = '"') -> Column:
    """Whether a line has the expected number of fields, by the CSV reader's own parse.

    Separators inside quotes do not count, and a doubled quote stands for itself.  An empty line is one empty field, a
    null is no line.
    """
    names = [f"f{i}" for i in range(fields)]
    schema = ", ".join(f"{n} string" for n in [*names, "bad"])
    options = {"sep": separator, "quote": quote, "escape": quote, "columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}
    line = F.col(quoted(column))
    parsed = F.from_csv(line, schema, options)
    return F.when(F.length(line) == 0, F.lit(fields == 1)).otherwise(parsed.isNotNull() & parsed["bad"].isNull())


def drop_ragged(lines: DataFrame, column: str, fields: int, separator: str = ",", quote: str = '"') -> DataFrame:
    """Lines of a text scan that hold the expected number of fields; see :func:`whole_line`."""
    return lines.filter(whole_line(column, fields, separator, quote))


def ragged_lines(lines: DataFrame, column: str, fields: int, separator: str = ",", quote: str = '"') -> DataFrame:
    """The lines that :func:`drop_ragged` drops, null ones included."""
    return lines.filter(~F.coalesce(whole_line(column, fields, separator, quote), F.lit(False)))
