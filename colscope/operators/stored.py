"""Tables kept in a shared folder: summaries replaced key by key, and rows indexed by their rank."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import quoted

_GONE = "__gone"
_IN_PART = (1 << 33) - 1  # the low bits of ``monotonically_increasing_id`` number a part's rows


def store_keys(rows: DataFrame, path: str, key: str) -> None:
    """Put the rows of some keys into the summary at ``path``, in place of what it has for these keys.

    Each key is a partition with a file of its own, and only partitions that are written are replaced, when the job
    ends: a lost job leaves all as it was, and the files of other keys are not touched.  A key that is null is an error.
    """
    named = rows.withColumn(_GONE, F.lit(False)) if _GONE not in rows.columns else rows
    checked = F.when(F.col(quoted(key)).isNull() | (F.col(quoted(key)) == ""), F.raise_error(F.lit(f"{key} is null or empty")))
    named = named.withColumn(key, F.coalesce(checked.cast("string"), F.col(quoted(key)).cast("string")))
    (named.repartition(F.col(quoted(key))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).parquet(path))


def drop_keys(spark: SparkSession, path: str, key: str, schema: T.StructType, gone: list[str]) -> None:
    """Leave a mark in place of the rows of the keys, so that :func:`stored_keys` has them no more."""
    names = spark.createDataFrame([(k, True) for k in gone], f"{quoted(key)} string, {_GONE} boolean")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != key]
    store_keys(names.select(*others, key, _GONE), path, key)


def stored_keys(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """The rows of the summary at ``path``, with the columns of ``schema``; the key is text."""
    fields = [T.StructField(f.name, T.StringType() if f.name == key else f.dataType) for f in schema.fields]
    own = T.StructType([*fields, T.StructField(_GONE, T.BooleanType())])
    return spark.read.schema(own).parquet(path).filter(~F.col(_GONE)).select(*[F.col(quoted(f.name)) for f in fields])


def write_rank_index(df: DataFrame, path: str, order: list[Column | str], rows_per_part: int = 1_000_000,
                     rows_per_file: int = 1_000_000) -> None:
    """Write the rows in parts of a total order, each row with its rank in its part, and the number of rows per part.

    The order may have ties, nulls and any types; ties are broken by a hash of the row, so that a value that many rows
    share is spread over parts.  One count, one range exchange into files of about ``rows_per_file`` rows (or of a part, if
    that is more), each of which holds its parts one after the other; no task has more than about a file.
    """
    in_file = max(rows_per_part, rows_per_file)
    files = max(1, math.ceil(df.count() / in_file))
    most = 2 * math.ceil(in_file / rows_per_part)  # parts a file may have; the last of them takes what is over
    tie = F.xxhash64(*[F.col(quoted(c)) for c in df.columns])
    sorted_ = df.withColumn("__tie", tie).repartitionByRange(files, *order, "__tie").sortWithinPartitions(*order, "__tie")
    numbered = sorted_.drop("__tie").withColumn("__id", F.monotonically_increasing_id())
    file, at = F.shiftright("__id", 33).cast("int"), F.col("__id").bitwiseAND(F.lit(_IN_PART))
    part = F.least(F.floor(at / rows_per_part), F.lit(most - 1).cast("long"))
    placed = numbered.withColumns({"__file": file, "__part": (file * most + part).cast("int"), "__rank": at - part * rows_per_part})
    placed.drop("__id").write.partitionBy("__file").parquet(f"{path}/rows")
    counts = df.sparkSession.read.parquet(f"{path}/rows").groupBy("__file", "__part").agg(F.count(F.lit(1)).alias("n"))
    counts.write.parquet(f"{path}/counts")


def ranked_page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of the rows at ``path`` in their order; only the files that hold it are read."""
    counts = spark.read.parquet(f"{path}/counts")
    first = size * (number - 1)

    def held(rows: list, above: int = 0) -> list[tuple]:
        """Each of the rows that the page reaches into, and the ranks at which its numbers begin and end."""
        spans = [(r, above + end - r["n"], above + end) for r, end in zip(rows, accumulate(r["n"] for r in rows))]
        return [(r, low, high) for r, low, high in spans if low < first + size and first < high]

    files = held(sorted(counts.groupBy("__file").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["__file"]))
    own = F.col("__file").isin([r["__file"] for r, _, _ in files])
    # Only the first and the last part are cut, so what lies between needs no condition of its own.
    parts = held(sorted(counts.filter(own).collect(), key=lambda r: r["__part"]), files[0][1] if files else 0)
    inside = F.lit(False)
    if parts:
        (begin, low, _), (last, top, _) = parts[0], parts[-1]
        part, rank = F.col("__part"), F.col("__rank")
        inside = (part.between(begin["__part"], last["__part"]) & ((part > begin["__part"]) | (rank >= first - low))
                  & ((part < last["__part"]) | (rank < first + size - top)))
    rows = spark.read.parquet(f"{path}/rows").filter(own & inside)
    return rows.orderBy("__part", "__rank").drop("__file", "__part", "__rank")
