"""Distinct counts and value counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BITMAP_BITS = 32768


def value_family(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    return "double" if isinstance(t, (T.FloatType, T.DoubleType)) else "string"


LONG_TEXT = 64
_DIGEST = "sha256:"


def text_key(x: Column) -> Column:
    """The text itself, or its SHA-256 when it is long, so that whole documents need not be shuffled.

    A digest with its prefix is longer than any text kept as it is, so the two cannot be confused.
    """
    return F.when(F.length(x) > LONG_TEXT, F.concat(F.lit(_DIGEST), F.sha2(x, 256))).otherwise(x)


def is_digest(key: Column) -> Column:
    return (F.length(key) > LONG_TEXT) & F.startswith(key, F.lit(_DIGEST))


def typed_value_counts(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """Physical family -> (column, value, n): how often each value of each column occurs, nulls included.

    Long texts are represented by :func:`text_key`.
    Columns are counted per family so that numbers travel as 8 bytes rather than as text, and duplicates
    collapse before the shuffle.
    """
    families: dict[str, list[str]] = {}
    for name in columns:
        families.setdefault(value_family(df.schema[name].dataType), []).append(name)
    counts = {}
    for family, names in families.items():
        values = {c: F.col(c).cast(family) for c in names}
        if family == "string":
            values = {c: text_key(x) for c, x in values.items()}
        long = df.select(*[x.alias(c) for c, x in values.items()]).unpivot([], names, "column", "value")
        counts[family] = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, number, n) with values as text keys, made once per distinct value."""
    parts = []
    for family, counts in typed_value_counts(df, columns).items():
        number = F.lit(None).cast("double") if family == "string" else F.col("value").cast("double")
        parts.append(counts.select("column", F.col("value").cast("string").alias("value"), number.alias("number"), "n"))
    return reduce(DataFrame.unionAll, parts)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct): exact number of distinct values, null counting as one."""
    return value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))


def _hash_buckets(x: Column) -> Column:
    bit = F.pmod(F.xxhash64(x), F.lit(_BITMAP_BITS))
    return F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(bit)))


def small_distinct_counts(df: DataFrame, columns: list[str], limit: int, nulls: bool = True) -> dict[str, int]:
    """Exact distinct counts of the columns that have fewer than ``limit`` values; others are left out.

    A 4 KB bitmap of value hashes per column comes out of one scan with no shuffle of values.  Occupied bits
    never exceed the distinct values, so a column with ``limit`` or more of them is settled.  Only columns
    below that are counted exactly, and those have few values to shuffle.
    """
    if not columns:
        return {}
    if limit > _BITMAP_BITS // 4:
        raise ValueError("limit is too large for the bitmap")
    first = df.agg(*[_hash_buckets(F.col(c)).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    small = [c for i, c in enumerate(columns) if (first[i] or 0) <= limit]
    if not small:
        return {}
    rows = value_counts(df, small)
    rows = rows if nulls else rows.filter(F.col("value").isNotNull())
    counted = rows.groupBy("column").agg(F.count(F.lit(1)).alias("distinct")).collect()
    found = {**dict.fromkeys(small, 0), **{r["column"]: r["distinct"] for r in counted}}
    return {c: n for c, n in found.items() if n < limit}
