"""Univariate profiling: metrics and histograms of every column in a constant number of passes."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bins import bucket
from ..session import on_driver, plain_names, renamed_values, small_table
from ..specs import CATEGORY, OTHERS, TEXT, ColumnSpec
from .distinct import LONG_TEXT, is_digest, small_distinct_counts, text_key, typed_value_counts, value_counts
from .frequent import frequent_values
from .quantiles import bracket_columns, pick_quantiles

DEFAULT_BINS = 22
DEFAULT_ENDS = (0.05, 0.95)
MAX_VALUES_AS_BINS = 20
MAX_CATEGORIES = 100
_MEDIAN = 0.5


def _stats_rows(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One aggregation over ``df`` whose structs become the rows of a small table."""
    return df.agg(F.array(*structs).alias("stats")).select(F.inline("stats"))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return _stats_rows(df, [
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing")) for c in columns
    ])


def _moments(spec: ColumnSpec, extra: list[Column]) -> Column:
    raw, x = F.col(spec.name), F.col(spec.name).try_cast("double")
    null = F.lit(None).cast("double")
    numbers = [F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)] if spec.numeric else [null] * 4
    return F.struct(
        F.lit(spec.position).alias("position"), F.lit(spec.name).alias("column"),
        F.lit(spec.datatype).alias("datatype"), F.count(F.lit(1)).alias("rows"),
        F.count_if(raw.isNull()).alias("missing"),
        *[a.alias(n) for a, n in zip(numbers, ("mean", "stddev", "min", "max"))], *extra,
    )


def summarize(df: DataFrame, specs: list[ColumnSpec], exact: bool = True) -> DataFrame:
    """One row per column: rows, missing, mean, stddev, min, max, distinct (null is a value), median.

    ``exact=False`` takes one scan without any shuffle of values: distinct from a HyperLogLog sketch and
    median from a quantile sketch.  ``exact=True`` adds one scan that counts values.
    """
    plain = plain_names(df, [s.name for s in specs])
    if plain:
        by_old = {old: new for new, old in plain[1].items()}
        return renamed_values(summarize(plain[0], [replace(s, name=by_old[s.name]) for s in specs], exact), "column", plain[1])
    if not exact:
        def sketches(spec: ColumnSpec) -> list[Column]:
            x = F.col(spec.name)
            median = (F.percentile_approx(x.try_cast("double"), _MEDIAN) if spec.numeric
                      else F.lit(None).cast("double"))
            distinct = F.approx_count_distinct(x) + F.max(x.isNull().cast("int"))
            return [distinct.cast("long").alias("distinct"), median.alias("median")]

        rows = _stats_rows(df, [_moments(s, sketches(s)) for s in specs])
        return rows.withColumn("distinct", F.coalesce("distinct", F.lit(0)))

    # One row per column, so these two results can live on the driver.  They are separate aggregations
    # because a sketch would take the moments out of generated code.
    moments = on_driver(_stats_rows(df, [_moments(s, []) for s in specs]))
    names = [s.name for s in specs]
    numeric = [s.name for s in specs if s.numeric]
    brackets = on_driver(_stats_rows(df, [
        F.struct(F.lit(c).alias("column"), *bracket_columns(F.col(c).try_cast("double"), [_MEDIAN])) for c in numeric
    ])) if numeric else None
    parts = []
    for family, group in _numeric_and_other(names, numeric).items():
        for family_type, counts in typed_value_counts(df, group).items():
            if family == "numeric":
                numbers = counts.withColumn("value", F.col("value").try_cast("double")).filter(F.col("value").isNotNull())
                numbers = numbers.groupBy("column", "value").agg(F.sum("n").alias("n")) if family_type == "string" else numbers
                parts.append(pick_quantiles(numbers, brackets, ["column"], "value", [_MEDIAN], "n").select(
                    "column", F.col("values").alias("distinct"), F.col("quantile").alias("median")))
            else:
                present = counts.groupBy("column").agg(F.count("value").alias("distinct"))
                parts.append(present.withColumn("median", F.lit(None).cast("double")))
    ranks = reduce(DataFrame.unionByName, parts)
    nulls = F.when(F.col("missing") > 0, 1).otherwise(0)
    return moments.join(ranks, "column", "left").select(
        "position", "column", "datatype", "rows", "missing", "mean", "stddev", "min", "max",
        (F.coalesce("distinct", F.lit(0)) + nulls).alias("distinct"), "median")


def _numeric_and_other(names: list[str], numeric: list[str]) -> dict[str, list[str]]:
    groups = {"numeric": numeric, "other": [c for c in names if c not in numeric]}
    return {k: v for k, v in groups.items() if v}


def column_metrics(summary: DataFrame, column: str) -> DataFrame:
    return summary.filter(F.col("column") == column)


def suggested_max_bins(summary: DataFrame, columns: list[str], default: int = 32) -> DataFrame:
    """Bins a tree needs for the chosen columns: the largest distinct count of their discrete ones."""
    number = F.col("datatype").isin("Number", "Percentage")
    discrete = F.when(number, F.when(F.col("distinct") < 20, F.col("distinct")).otherwise(0)).when(
        F.col("datatype") == CATEGORY, F.when(F.col("distinct") < 100, F.col("distinct")).otherwise(0)).otherwise(0)
    return summary.filter(F.col("column").isin(columns)).agg(
        F.coalesce(F.max(discrete), F.lit(default)).cast("long").alias("max_bins"))


def _bar_number(df: DataFrame, column: str) -> Column:
    """A column's value for buckets: in text, ``NA`` counts as 0 and what is no number is left out."""
    x = F.col(column)
    number = x.try_cast("double")
    return F.when(x == "NA", 0.0).otherwise(number) if isinstance(df.schema[column].dataType, T.StringType) else number


def inner_steps(bins: int, ends: tuple[float, float]) -> int:
    """Equal steps left between the end quantiles once each open tail has taken a bin."""
    tails = sum([ends[0] != 0, ends[1] != 1])
    return max(0, bins - tails)


def bucket_edges(df: DataFrame, columns: list[str], bins: int = DEFAULT_BINS,
                 ends: tuple[float, float] = DEFAULT_ENDS, exact: bool = False) -> DataFrame:
    """(column, edges): min, equal steps between the end quantiles, max; one bucket if the steps vanish."""
    probs = [float(e) for e in ends]
    doubles = {c: _bar_number(df, c) for c in columns}
    if exact:
        stats = on_driver(_stats_rows(df, [
            F.struct(F.lit(c).alias("column"), *bracket_columns(x, probs)) for c, x in doubles.items()]))
        long = (df.select(*[x.alias(c) for c, x in doubles.items()]).unpivot([], columns, "column", "value")
                .filter(F.col("value").isNotNull()))
        ranks = pick_quantiles(long, stats, ["column"], "value", probs).groupBy("column").agg(
            F.max(F.when(F.col("prob") == probs[0], F.col("quantile"))).alias("p1"),
            F.max(F.when(F.col("prob") == probs[1], F.col("quantile"))).alias("p2"))
        ends_table = stats.join(ranks, "column").select("column", "lowest", "highest", "p1", "p2")
    else:
        ends_table = _stats_rows(df, [
            F.struct(F.lit(c).alias("column"), F.min(x).alias("lowest"), F.max(x).alias("highest"),
                     F.percentile_approx(x, probs).alias("p")) for c, x in doubles.items()
        ]).select("column", "lowest", "highest", F.col("p")[0].alias("p1"), F.col("p")[1].alias("p2"))
    steps = inner_steps(bins, ends)
    step = (F.col("p2") - F.col("p1")) / F.lit(float(max(steps, 1)))
    inner = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.col("p1") + i * step)
    edges = F.when(F.lit(steps > 0) & (step > 0), F.array_distinct(
        F.sort_array(F.concat(F.array("lowest"), inner, F.array("highest"))))
    ).otherwise(F.array("lowest", "highest"))
    return ends_table.filter(F.col("lowest").isNotNull()).select("column", edges.alias("edges"))


def bucket_label(lower: Column, upper: Column) -> Column:
    return F.concat_ws(" - ", lower.cast("string"), upper.cast("string"))


_BIN_SCHEMA = pa.schema([("column", pa.string()), ("bin", pa.int32()), ("lower", pa.float64()), ("upper", pa.float64())])


def bucket_counts(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(column, bin, label, lower, upper, n) for every bucket of every column, empty ones included.

    Buckets are half-open, the last is closed; nulls and values outside the edges do not count.  All columns
    are counted in one scan, and only bucket numbers reach the shuffle.
    """
    names = list(edges)
    binned = df.select(*[bucket(_bar_number(df, c), edges[c]).alias(c) for c in names])
    counts = (binned.unpivot([], names, "column", "bin").filter(F.col("bin").isNotNull())
              .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n")))
    rows = [{"column": c, "bin": i, "lower": lo, "upper": hi}
            for c in names for i, (lo, hi) in enumerate(zip(edges[c], edges[c][1:]))]
    bins = small_table(df.sparkSession, rows, _BIN_SCHEMA)
    # Both sides have one row per bucket at most.
    return bins.join(counts, ["column", "bin"], "left").select(
        "column", "bin", bucket_label(F.col("lower"), F.col("upper")).alias("label"), "lower", "upper",
        F.coalesce("n", F.lit(0)).alias("n"))


def value_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value for numeric columns with few values, nulls dropped, in value order."""
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    order = Window.partitionBy("column").orderBy("number", "value")
    return counts.select("column", (F.row_number().over(order) - 1).alias("bin"), F.col("value").alias("label"),
                         F.col("number").alias("lower"), F.col("number").alias("upper"), "n")


def category_histogram(df: DataFrame, columns: list[str], order: str = "desc", limit: int = MAX_CATEGORIES) -> DataFrame:
    """The ``limit - 1`` most frequent values per column and ``Others`` for the remainder, which ``remainder`` marks.

    The most frequent ones are counted without counting every value (see :mod:`.frequent`).  ``order="asc"`` keeps the
    least frequent ones: every value is counted, and the rank filter runs as a partial top-k in every task before rows
    meet by column, so a column of many values is never gathered whole.
    """
    if order == "desc":
        top = frequent_values(df, columns, limit - 1)
    else:
        counts = value_counts(df, columns).filter(F.col("value").isNotNull()).select("column", "value", "n")
        rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").asc(), "value"))
        top = counts.withColumn("bin", rank).filter(F.col("bin") < limit).withColumn("remainder", F.lit(False))
        kept = top.groupBy("column").agg(F.sum("n").alias("kept"), F.max("bin").alias("bins"))
        others = (counts.groupBy("column").agg(F.sum("n").alias("total")).join(kept, "column")
                  .filter(F.col("total") > F.col("kept"))
                  .select("column", F.lit(None).cast("string").alias("value"), (F.col("total") - F.col("kept")).alias("n"),
                          (F.col("bins") + 1).alias("bin"), F.lit(True).alias("remainder")))
        top = top.unionByName(others)
    none = F.lit(None).cast("double")
    return _with_texts(df, columns, on_driver(top)).select(
        "column", (F.col("bin") - 1).alias("bin"), F.coalesce("value", F.when(F.col("remainder"), OTHERS)).alias("label"),
        none.alias("lower"), none.alias("upper"), "n", "remainder")


def _with_texts(df: DataFrame, columns: list[str], top: DataFrame) -> DataFrame:
    """Put the texts back where a ranked value is a digest; scans again only if there is one."""
    wanted = top.filter(is_digest(F.col("value"))).select("column", "value")
    found = sorted({r["column"] for r in wanted.collect()})
    if not found:
        return top
    long = df.select(*[F.col(c).cast("string").alias(c) for c in found]).unpivot([], found, "column", "text")
    texts = (long.filter(F.length("text") > LONG_TEXT).withColumn("value", text_key(F.col("text")))
             .join(F.broadcast(wanted), ["column", "value"])
             .groupBy("column", "value").agg(F.min("text").alias("text")))
    return top.join(texts, ["column", "value"], "left").withColumn("value", F.coalesce("text", "value"))


def histograms(df: DataFrame, specs: list[ColumnSpec], bins: int = DEFAULT_BINS,
               ends: tuple[float, float] = DEFAULT_ENDS, edges: dict[str, list[float]] | None = None,
               order: str = "desc", exact: bool = False) -> DataFrame:
    """Histogram of every column by semantic type, as (column, bin, label, lower, upper, n, remainder).

    Numbers with at most 20 distinct values get one bin per value, other numbers get buckets (given in
    ``edges`` or derived), categories and text their frequent values, dates nothing.
    """
    given = dict(edges or {})
    numeric = [s.name for s in specs if s.numeric]
    few = set(small_distinct_counts(df, numeric, MAX_VALUES_AS_BINS + 1))
    many = [c for c in numeric if c not in few]
    derived = [c for c in many if c not in given]
    if derived:
        given.update({r["column"]: r["edges"] for r in bucket_edges(df, derived, bins, ends, exact).collect()})
    categories = [s.name for s in specs if s.datatype in (CATEGORY, TEXT)]
    parts = []
    if few:
        parts.append(value_histogram(df, [c for c in numeric if c in few]))
    if many:
        parts.append(bucket_counts(df, {c: given[c] for c in many if c in given}))
    if categories:
        parts.append(category_histogram(df, categories, order))
    if not parts:
        return small_table(df.sparkSession, [], pa.schema([
            ("column", pa.string()), ("bin", pa.int32()), ("label", pa.string()), ("lower", pa.float64()),
            ("upper", pa.float64()), ("n", pa.int64()), ("remainder", pa.bool_())]))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result.withColumn("remainder", F.coalesce("remainder", F.lit(False))) if "remainder" in result.columns else (
        result.withColumn("remainder", F.lit(False)))
