"""The most frequent values of columns, counted exactly without counting every value.

Each task keeps a bounded number of counters a column (Misra and Gries): what it subtracts from them in all is the most
by which any count of the task is too low.  Merged counts and the sum of these errors tell which values can be among
the most frequent, and only those are counted exactly.  Where the errors are too large to tell, as with texts that are
all different, every value of that column is counted.
"""

from __future__ import annotations

import sys
from collections import Counter
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import quoted, shared_folder
from .distinct import text_key, value_family

# Tasks get this module's functions with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTERS = 4096
MOST_CANDIDATES = 100_000


class Counters:
    """Counts of a bounded number of values, none too high and none too low by more than ``error``."""

    def __init__(self, size: int):
        self.size, self.counts, self.error = size, Counter(), 0

    def add(self, counted: dict) -> None:
        self.counts.update(counted)
        if len(self.counts) > 2 * self.size:
            least = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = Counter({v: n - least for v, n in self.counts.items() if n > least})
            self.error += least


def _keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as text keys c0, c1, ..."""
    casts = [F.col(quoted(c)).cast(value_family(df.schema[c].dataType)).cast("string") for c in columns]
    return df.select(*[text_key(x).alias(f"c{i}") for i, x in enumerate(casts)])


def _lower_counts(keys: DataFrame, size: int) -> DataFrame:
    """(column, value, n) from every task; the row of the null value has the task's error."""
    width = len(keys.columns)

    def run(batches):
        held = [Counters(size) for _ in range(width)]
        for batch in batches:
            for own, column in zip(held, batch.columns):
                counted = pc.value_counts(column.drop_null())
                own.add(dict(zip(counted.field(0).to_pylist(), counted.field(1).to_pylist())))
        for i, own in enumerate(held):
            values = [None, *own.counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(values), pa.int32()), pa.array(values, pa.string()),
                 pa.array([own.error, *own.counts.values()], pa.int64())], ["column", "value", "n"])

    return keys.mapInArrow(run, "column int, value string, n long")


def _top(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` largest counts per column, ties by value; a partial top-k runs in every task first."""
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("bin", F.row_number().over(order)).filter(F.col("bin") <= most)


def frequent_values(df: DataFrame, columns: list[str], most: int, counters: int = COUNTERS) -> DataFrame:
    """(column, value, n, bin, remainder): the ``most`` most frequent values per column, in order from bin 1.

    The row with ``remainder`` has a null value and counts all other values, if there are any.  Nulls are not counted,
    long texts are told by :func:`text_key`, and a column without values has no rows.
    """
    if not columns:
        raise ValueError("no columns")
    spark = df.sparkSession
    path = shared_folder(spark, "frequent")
    size = max(counters, most + 1)
    _lower_counts(_keys(df, columns), size).groupBy("column", "value").agg(F.sum("n").alias("n")).write.parquet(path)
    lower = spark.read.schema("column int, value string, n long").parquet(path)
    errors = {r["column"]: r["n"] for r in lower.filter("value is null").collect()}
    known = lower.filter("value is not null")
    ranked: dict[int, list] = {}
    for r in _top(known, most).select("column", "n").collect():
        ranked.setdefault(r["column"], []).append(r["n"])
    every = range(len(columns))
    least = {i: min(ranked[i]) if len(ranked.get(i, [])) == most else 0 for i in every}
    told = [i for i in every if errors.get(i, 0) == 0]
    sure = [i for i in every if 0 < errors.get(i, 0) < least[i]]
    rest = [i for i in every if i not in told and i not in sure]
    parts = [known.filter(F.col("column").isin(told))] if told else []
    if sure:
        bound = reduce(lambda a, i: a.when(F.col("column") == i, least[i] - errors[i]), sure, F)
        some = known.filter(F.col("column").isin(sure)).filter(F.col("n") >= bound.otherwise(0)).select("column", "value")
        parts.append(_counted(df, columns, sure).join(F.broadcast(some) if some.count() <= MOST_CANDIDATES else some,
                                                      ["column", "value"], "left_semi")
                     .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    if rest:
        parts.append(_counted(df, columns, rest).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    top = _top(reduce(DataFrame.unionByName, parts), most).select("column", "value", "n", "bin", F.lit(False).alias("remainder"))
    totals = _keys(df, columns).agg(F.array(*[
        F.struct(F.lit(i).alias("column"), F.count(f"c{i}").alias("total")) for i in every]).alias("t")).select(F.inline("t"))
    kept = top.groupBy("column").agg(F.sum("n").alias("kept"), F.max("bin").alias("bins"))
    others = totals.join(kept, "column").filter(F.col("total") > F.col("kept")).select(
        "column", F.lit(None).cast("string").alias("value"), (F.col("total") - F.col("kept")).alias("n"),
        (F.col("bins") + 1).alias("bin"), F.lit(True).alias("remainder"))
    names = F.array(*[F.lit(c) for c in columns])
    return top.unionByName(others).withColumn("column", names[F.col("column")])


def _counted(df: DataFrame, columns: list[str], some: list[int]) -> DataFrame:
    """(column, value) of every row that is not null in some of the columns."""
    names = [f"c{i}" for i in some]
    long = _keys(df, columns).unpivot([], names, "name", "value").filter(F.col("value").isNotNull())
    return long.select(F.substring("name", 2, 9).cast("int").alias("column"), "value")
