"""Functions that need a statistic of the whole column.

The statistic is an uncorrelated scalar subquery: Spark computes it once (merging the subqueries of one
select into a single scan), then treats it as a constant in the row expression, so nothing is joined or
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import as_column

OUTLIER_DEVIATIONS = 3


def _is_numeric(df: DataFrame, x: Column) -> bool:
    return isinstance(df.select(x).schema.fields[0].dataType, T.NumericType)


def normalize(df: DataFrame, x, low: float, high: float) -> Column:
    """Min-max scaling to [low, high]; null for a constant or non-numeric column."""
    x = as_column(x)
    if not _is_numeric(df, x):
        return F.lit(None).cast("double")
    x = x.cast("double")
    smallest, largest = df.agg(F.min(x)).scalar(), df.agg(F.max(x)).scalar()
    return F.lit(float(low)) + F.try_divide((x - smallest) * F.lit(float(high) - float(low)), largest - smallest)


def is_outlier(df: DataFrame, x) -> Column:
    """True where x lies more than three sample standard deviations from the mean; null stays null."""
    x = as_column(x)
    if not _is_numeric(df, x):
        return F.lit(None).cast("boolean")
    x = x.cast("double")
    mean, deviation = df.agg(F.avg(x)).scalar(), df.agg(F.stddev_samp(x)).scalar()
    return F.abs(x - mean) > F.lit(OUTLIER_DEVIATIONS) * deviation


def replace_outlier(df: DataFrame, x, replacement) -> Column:
    """The replacement where x is an outlier, x elsewhere."""
    x = as_column(x)
    if not _is_numeric(df, x):
        return F.lit(None).cast("double")
    outlier = is_outlier(df, x)
    return F.when(outlier, replacement).when(~outlier, x)
