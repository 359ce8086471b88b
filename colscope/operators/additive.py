"""Summaries that add up: new rows join a stored profile without the old ones being read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import quoted
from ..specs import ColumnSpec
from .stored import store_keys, stored_keys

_HLL_BITS = 14
_KLL_SIZE = 800


def partial_summary(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """One row per column, by one scan: counts, sums of deviations, ends, and sketches of distinct values and ranks.

    Text that is no number counts as present but not in the numbers; not-a-number is left out of them.
    """

    def row(spec: ColumnSpec) -> Column:
        raw = F.col(quoted(spec.name))
        number = raw.try_cast("double") if spec.numeric else F.lit(None).cast("double")
        x = F.when(~F.isnan(number), number)
        # Fingerprints, so that any type goes into one kind of sketch.
        mark = F.when(raw.isNotNull(), F.xxhash64(raw))
        return F.struct(
            F.lit(spec.position).alias("position"), F.lit(spec.name).alias("column"), F.lit(spec.datatype).alias("datatype"),
            F.count(F.lit(1)).alias("rows"), F.count_if(raw.isNull()).alias("missing"), F.count(x).alias("numbers"),
            F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("spread"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.hll_sketch_agg(mark, _HLL_BITS).alias("values"), F.kll_sketch_agg_double(x, _KLL_SIZE).alias("ranks"))

    return df.agg(F.array(*[row(s) for s in specs]).alias("s")).select(F.inline("s"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Partial summaries of disjoint rows as one; columns are told by name, and one that a part lacks is that of the others."""
    rows = reduce(DataFrame.unionByName, parts)
    both = rows.groupBy("column").agg(
        F.min("position").alias("position"), F.max("datatype").alias("datatype"), F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"), F.sum("numbers").alias("numbers"),
        F.try_divide(F.sum(F.col("mean") * F.col("numbers")), F.sum("numbers").cast("double")).alias("mean"),
        F.collect_list(F.struct("numbers", "mean", "spread")).alias("own"),  # one entry for each part
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("values").alias("values"), F.kll_merge_agg_double("ranks", _KLL_SIZE).alias("ranks"))
    spread = F.aggregate("own", F.lit(0.0), lambda total, p: total + F.coalesce(
        p["spread"] + p["numbers"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")), F.lit(0.0)))
    return both.withColumn("spread", F.when(F.col("numbers") > 0, spread)).select(*rows.columns)


def finished(summary: DataFrame) -> DataFrame:
    """Columns of ``univariate.summarize`` from a partial summary; distinct values and the median are sketched."""
    deviation = F.sqrt(F.try_divide(F.col("spread"), F.col("numbers") - 1))
    median = F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(0.5)))
    distinct = F.hll_sketch_estimate("values") + F.when(F.col("missing") > 0, 1).otherwise(0)
    return summary.select("position", "column", "datatype", "rows", "missing", "mean",
                          F.when(F.col("numbers") > 1, deviation).alias("stddev"), "min", "max",
                          distinct.cast("long").alias("distinct"), median.alias("median"))


def add_rows(spark: SparkSession, path: str, new: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Add the summary of new rows to the one stored at ``path`` (its first time: store it), and give what is stored.

    Only the columns of ``specs`` are written again; see :func:`.stored.store_keys` for what a lost job leaves.
    """
    own = partial_summary(new, specs)
    try:
        old = stored_keys(spark, path, "column", own.schema)
    except Exception as error:  # the first rows
        if "PATH_NOT_FOUND" not in str(error):
            raise
        store_keys(own, path, "column")
    else:
        names = [s.name for s in specs]
        store_keys(merged([old.filter(F.col("column").isin(names)), own]), path, "column")
    return stored_keys(spark, path, "column", own.schema)
