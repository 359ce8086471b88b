"""Exact quantiles without sorting or collecting a whole column.

A sketch (``percentile_approx``) gives a bracket of values that must hold the wanted rank.  Rows below the bracket are
only counted; values inside it are counted per value and ordered.  No task orders more than ``MOST_ORDERED`` values of
one quantile: a bracket that may hold more is cut at quantiles of its own values, whatever their distribution, and the
slices that hold the rank are the next bracket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import on_driver, shared_folder

MOST_ORDERED = 20_000
_ACCURACY = 2_000
_MARGIN = 2.5 / _ACCURACY
# Fewer values than these are closer to each other in rank than the margins.
_WHOLE = int(4 / _MARGIN)
_CUTS = 64
_FEW_KEYS = 100_000


def bracket_columns(x: Column, probs: list[float]) -> list[Column]:
    """Aggregates from which :func:`pick_quantiles` derives its brackets."""
    marks = [min(1.0, max(0.0, p + d)) for p in probs for d in (-_MARGIN, _MARGIN)]
    return [
        F.count(x).alias("total"), F.min(x).alias("lowest"), F.max(x).alias("highest"),
        F.percentile_approx(x, marks, _ACCURACY).alias("marks"),
    ]


def _brackets(stats: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """One row per key and probability; a group that may be ordered whole has its full range as the bracket."""
    whole = F.col("total") <= max(MOST_ORDERED, _WHOLE)
    entries = [
        F.struct(
            F.lit(float(p)).alias("prob"),
            F.when(whole, F.col("lowest")).otherwise(F.col("marks")[2 * i]).alias("lo"),
            F.when(whole, F.col("highest")).otherwise(F.col("marks")[2 * i + 1]).alias("hi"),
        ) for i, p in enumerate(probs)
    ]
    return stats.filter("total > 0").select(*keys, "total", F.inline(F.array(*entries)))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _narrowed(hits: DataFrame, state: DataFrame, id_: list[str], small) -> tuple[DataFrame, DataFrame, int]:
    """Values and ``before`` of the slices that hold the ranks, and the most values that one of the quantiles has left."""
    grid = [i / _CUTS for i in range(1, _CUTS)]
    cuts = hits.groupBy(*id_).agg(F.percentile_approx("v", grid, 10 * _CUTS).alias("cuts"))
    slice_ = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    sliced = hits.join(small(cuts), id_).select(*id_, "v", "n", slice_.alias("slice"))
    counts = sliced.groupBy(*id_, "slice").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("here"))
    # At most _CUTS rows for each key and probability.
    running = Window.partitionBy(*id_).orderBy("slice")
    placed = counts.join(small(state), id_).withColumn("from", F.col("before") + F.sum("n").over(running) - F.col("n"))
    held = placed.filter((F.col("from") <= F.col("high_rank")) & (F.col("low_rank") < F.col("from") + F.col("n")))
    held = _written(held.select(*id_, "slice", "from", "here"), "slices")
    hits = _written(sliced.join(small(held.select(*id_, "slice")), [*id_, "slice"]).drop("slice"), "bracket")
    left = held.groupBy(*id_).agg(F.min("from").alias("from"), F.sum("here").alias("here"))
    state = _written(state.join(small(left), id_).withColumn("before", F.col("from")).drop("from", "here"), "state")
    return hits, state, left.agg(F.max("here")).first()[0] or 0


def pick_quantiles(counted: DataFrame, stats: DataFrame, keys: list[str], value: str, probs: list[float],
                   weight: str | None = None, few_keys: bool = True) -> DataFrame:
    """(keys, prob, quantile, values) with linear interpolation between neighbouring ranks.

    ``counted`` holds the non-null values; with ``weight`` they are distinct per key and already counted, and
    ``values`` is how many there are.  ``stats`` has one row per key and the columns of :func:`bracket_columns`.
    It is broadcast if ``few_keys`` (columns of a table, nodes of a tree) and joined on the keys otherwise.
    """
    small = F.broadcast if few_keys else lambda df: df
    id_ = [*keys, "prob"]
    v = F.col(value)
    placed = counted.join(small(_brackets(stats, keys, probs)), keys)
    zone = F.when(v < F.col("lo"), -1).when(v > F.col("hi"), 1).otherwise(0)
    if weight:
        hits = placed.select(*id_, "total", zone.alias("zone"), v.alias("v"), F.col(weight).alias("n"))
    else:
        hits = placed.groupBy(*id_, "total", zone.alias("zone"), F.when(zone == 0, v).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    position = F.col("prob") * (F.col("total") - 1)
    state = hits.groupBy(*id_, "total").agg(F.coalesce(F.sum(F.when(F.col("zone") < 0, F.col("n"))), F.lit(0)).alias("before"),
                                            F.count(F.lit(1)).alias("values"))
    state = state.select(*id_, "before", "values", F.floor(position).alias("low_rank"), F.ceil(position).alias("high_rank"),
                         (position - F.floor(position)).alias("fraction"))
    hits = hits.filter("zone = 0").select(*id_, "v", "n")
    # A bracket holds its margins and the sketch's errors of the rows at most, if it is not the whole range.
    inside = F.when(F.col("total") <= max(MOST_ORDERED, _WHOLE), F.col("total")).otherwise(F.col("total") * 2 * (_MARGIN + 1 / _ACCURACY))
    most = stats.agg(F.max(inside)).first()[0] or 0
    bound = max(2, MOST_ORDERED)  # both neighbours of a rank are needed
    if most > bound:
        hits, state = _written(hits, "bracket"), _written(state, "state")
        while most > bound:
            hits, state, most = _narrowed(hits, state, id_, small)
    running = Window.partitionBy(*id_).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = (
        hits.join(small(state), id_)
        .withColumn("upto", F.col("before") + F.sum("n").over(running))
        .withColumn("from", F.col("upto") - F.col("n"))
    )

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("from") <= F.col(rank)) & (F.col(rank) < F.col("upto")), F.col("v")))

    picked = values.groupBy(*id_).agg(at("low_rank").alias("a"), at("high_rank").alias("b"),
                                      F.max("fraction").alias("f"), F.max("values").alias("values"))
    quantile = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + F.col("f") * (F.col("b") - F.col("a")))
    return picked.select(*id_, quantile.alias("quantile"), "values")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact quantiles of ``value`` per key, in two scans of ``rows``.

    Brackets of the keys are written to the shared folder and counted: up to ``_FEW_KEYS`` are broadcast.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    stats = _written(rows.groupBy(*keys).agg(*bracket_columns(F.col(value), probs)), "brackets")
    few = stats.count() <= _FEW_KEYS
    return pick_quantiles(rows, on_driver(stats) if few else stats, keys, value, probs, None, few).drop("values")


def approximate_quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Sketch quantiles per key in one scan (rank error 1/10,000); each is a value of the column."""
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), probs, 10_000).alias("q"))
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.col("q")[i].alias("quantile"))
                      for i, p in enumerate(probs)])
    return sketch.select(*keys, F.inline(pairs)).filter(F.col("quantile").isNotNull())
