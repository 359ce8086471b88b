"""Cleaning, re-typing and column updates, each a single projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import quoted
from ..specs import CATEGORY, DATE, MISSING, TEXT, ColumnSpec
from .infer import trimmed

# Fixed value: the text form of a number that cleaning keeps.
CLEAN_NUMBER = r"^[-+]?\d+(\.\d+)?$"
WHOLE_TYPES = ("int", "bigint", "decimal(38,0)")


def rename_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """New names for all columns, by position."""
    return df.toDF(*names)


def kept_columns(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Columns that are not ignored; none kept gives a frame without columns."""
    return df.select(*[s.name for s in specs if not s.ignored])


def clean_number(x: Column) -> Column:
    """Text of a plain number without blanks and control characters around it, null for anything else."""
    text = trimmed(x.cast("string"))
    return F.when(text.rlike(CLEAN_NUMBER), text)


def clean_text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(MISSING))


def number_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Physical type of each cleaned number: double if any value has a point, else the least that holds all.

    Columns that already are numbers keep their type unread.  The text ones are settled together in one
    aggregation; whole numbers beyond 32 bits make the column long, beyond 64 bits a decimal, beyond that a double.
    """
    found, text = {}, []
    for c in columns:
        t = df.schema[c].dataType
        if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            found[c] = "double"
        elif isinstance(t, T.NumericType):
            found[c] = "bigint" if isinstance(t, T.LongType) else "int"
        else:
            text.append(c)
    if text:
        flags = []
        for c in text:
            x = clean_number(F.col(quoted(c)))
            too_wide = [F.max(x.isNotNull() & x.try_cast(t).isNull()) for t in WHOLE_TYPES]
            flags += [F.max(F.contains(x, F.lit("."))), *too_wide]
        row = df.agg(*[f.alias(f"f{i}") for i, f in enumerate(flags)]).first()
        step = 1 + len(WHOLE_TYPES)
        for i, c in enumerate(text):
            points, *wide = row[step * i:step * (i + 1)]
            found[c] = "double" if points else next((t for t, w in zip(WHOLE_TYPES, wide) if not w), "double")
    return found


def cast_columns(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Numbers to their physical type (anything else becomes null), text with nulls marked."""
    types = number_types(df, [s.name for s in specs if s.numeric])

    def cleaned(s: ColumnSpec) -> Column:
        if s.numeric:
            x = F.col(quoted(s.name))
            already = isinstance(df.schema[s.name].dataType, T.NumericType)
            return (x.cast(types[s.name]) if already else clean_number(x).try_cast(types[s.name])).alias(s.name)
        x = F.col(quoted(s.name))
        return clean_text(x).alias(s.name) if s.datatype in (TEXT, CATEGORY, DATE) else x

    return df.select(*[cleaned(s) for s in specs])


def clean(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Rename by position, cast by semantic type, drop ignored columns."""
    visible = [s for s in specs if not s.ignored]
    renamed = rename_columns(df, [s.name for s in specs])
    return cast_columns(renamed, visible) if visible else renamed.select()


def retyped(x: Column, spec: ColumnSpec, already_number: bool = False) -> Column:
    """A column after an update: numbers as double (null where they do not parse), text with nulls marked."""
    if spec.numeric:
        return x.cast("double") if already_number else x.cast("string").try_cast("double")
    return clean_text(x) if spec.datatype in (TEXT, CATEGORY, DATE) else x


def update_columns(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Apply a column update in spec order: drop, calculate, pass through, rename and re-type.

    Formulas see the original names, those of deleted columns included.
    """
    sources = []
    for s in specs:
        if s.status == "deleted":
            continue
        calculated = s.status == "new" or (s.status == "modified" and s.calculated)
        source = (s.formula if isinstance(s.formula, Column) else F.expr(s.formula)) if calculated else F.col(s.name)
        sources.append((s, source))
    kinds = df.select(*[x.alias(f"c{i}") for i, (_, x) in enumerate(sources)]).schema  # analysed only
    return df.select(*[retyped(x, s, isinstance(kinds[i].dataType, T.NumericType)).alias(s.final_name)
                       for i, (s, x) in enumerate(sources)])


def dataset_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen columns of the rows where none of them is null."""
    return df.select(*columns).na.drop()


def both_present(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())


def as_preview(df: DataFrame, null_text: str = "") -> DataFrame:
    """All columns as text named by position, nulls replaced."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(null_text)).alias(f"_c{i}")
                       for i, c in enumerate(df.columns)])
