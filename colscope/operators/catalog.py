"""Operators on catalog and summary tables: paging, search, upserts, latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import bracket_columns


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in a total order.  Spark keeps the top rows per task and merges those.

    Meant for the first pages; use :func:`page_after` or :func:`deep_page` further down.
    """
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def page_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next page by unique key: rows beyond the last key seen, so depth costs nothing."""
    return df.filter(F.col(key) > F.lit(last)).orderBy(key).limit(size)


def deep_page(df: DataFrame, key: str, number: int, size: int) -> DataFrame:
    """Any page in the order of a unique numeric key that is never null; a null key is an error.

    Quantile sketches bracket the wanted ranks, with a margin of more than their error and two ranks more for small
    tables; rows below the bracket are counted, and only rows inside it are ordered.
    """
    skip = size * (number - 1)
    counted = df.agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("keys")).first()
    total = counted["rows"]
    if counted["keys"] < total:
        raise ValueError(f"{key} is null in {total - counted['keys']} rows")
    if skip >= total:
        return df.limit(0)
    probs = [max(0.0, (skip - 2) / total), min(1.0, (skip + size + 2) / total)]
    marks = df.agg(bracket_columns(F.col(key), probs)[3].alias("marks")).first()["marks"]
    low, high = marks[0], marks[-1]
    below = df.filter(F.col(key) < F.lit(low)).count()
    inside = df.filter(F.col(key).between(F.lit(low), F.lit(high)))
    return inside.orderBy(key).offset(skip - below).limit(size)


def page_info(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("pages"),
                  F.lit(len(df.columns)).alias("columns"))


def latest_per_key(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """The newest row of each key.  Each task drops all but its best row per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def by_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.filter(F.lower(column).startswith(prefix.lower()))


def by_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Case-insensitive regular expression found anywhere in the column."""
    return df.filter(F.col(column).rlike(f"(?i){pattern}"))


def taken_names(candidates: DataFrame, catalog: DataFrame, name: str, id_: str) -> DataFrame:
    """Candidates whose name some other catalog entry already has."""
    names = catalog.select(F.col(name).alias("_name"), F.col(id_).alias("_id"))
    # A name shared by entries with two ids is taken for everyone, so one id range per name is enough.
    owners = names.groupBy("_name").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    other = (F.col("_first") != F.col(id_)) | (F.col("_last") != F.col(id_))
    return candidates.join(owners, (F.col(name) == F.col("_name")) & other, "left_semi")


def pick_in_order(df: DataFrame, key: str, values: list, position: str) -> DataFrame:
    return df.filter(F.col(key).isin(values)).orderBy(position)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and rows of ``old`` whose key it lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def with_pair_key(df: DataFrame, a: str = "c1", b: str = "c2") -> DataFrame:
    """Add the unordered key (pair_low, pair_high) of two columns."""
    return df.withColumns({"pair_low": F.least(a, b), "pair_high": F.greatest(a, b)})


def upsert_pairs(old: DataFrame, new: DataFrame, a: str = "c1", b: str = "c2") -> DataFrame:
    """Upsert where (x, y) and (y, x) are the same key."""
    merged = upsert(with_pair_key(old, a, b), with_pair_key(new, a, b), ["pair_low", "pair_high"])
    return merged.drop("pair_low", "pair_high")


def without_columns(summaries: DataFrame, dropped: list, columns: tuple[str, ...] = ("column",)) -> DataFrame:
    """Summaries that mention none of the dropped columns."""
    kept = summaries
    for c in columns:
        kept = kept.filter(~F.col(c).isin(dropped))
    return kept


def model_schema(models: DataFrame, inputs: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per model input in column order, next to the model's output column.

    ``models`` (model_id, output_id), ``inputs`` (model_id, column_id), ``columns`` (column_id, position,
    name).  Rows stay flat: no model's inputs are gathered into one value.
    """
    names = columns.select("column_id", "position", "name")
    outputs = models.join(names.select(F.col("column_id").alias("output_id"), F.col("name").alias("output_column")),
                          "output_id", "left").select("model_id", "output_column")
    return inputs.join(names, "column_id").join(outputs, "model_id").select(
        "model_id", "position", F.col("name").alias("input_column"), "output_column")


def counts_by_kind(df: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """Entries per key, one column for each kind."""
    wide = df.groupBy(key).pivot(kind, kinds).agg(F.count(F.lit(1)))
    return wide.select(key, *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(k) for k in kinds])
